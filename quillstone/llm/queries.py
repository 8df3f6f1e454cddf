"""The operators' queries over the whole tables, and DuckDB SQL where SQL can express them."""

from quillstone.llm import exact_dedup, language_id, lm_scoring, mixing, packing, periodic_runs, quality, set_sketch, sharding, simhash, source_divergence, token_files, vector_search

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_packing": packing.op2_packing,
    "op3_mixing": mixing.op3_mixing,
    "op4_vector_search": vector_search.op4_vector_search,
    "op5_quality": quality.op5_quality,
    "op6_sharding": sharding.op6_sharding,
    "op7_simhash": simhash.op7_simhash,
    "op8_lm_scoring": lm_scoring.op8_lm_scoring,
    "op9_token_files": token_files.op9_token_files,
    "op10_language_id": language_id.op10_language_id,
    "op11_set_sketch": set_sketch.op11_set_sketch,
    "op12_source_divergence": source_divergence.op12_source_divergence,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

SQL = {"op1_exact_dedup": exact_dedup.OP1_SQL, "op11_set_sketch": set_sketch.OP11_SQL, "op12_source_divergence": source_divergence.OP12_SQL}
