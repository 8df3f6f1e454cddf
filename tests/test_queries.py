"""Every query with SQL gives the comparison engine's rows; the others run."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from quillstone.plans.queries import QUERIES, SQL


def _plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return round(float(x), 6)
    return str(pd.Timestamp(x)) if hasattr(x, "isoformat") else str(x)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(_plain, r)) for r in df[columns].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def engine(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_dir, engine, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(engine.execute(SQL[name]).df())


def test_parse_pages_reads_every_page(spark, sf_dir):
    assert QUERIES["parse_pages"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def test_fuzzy_match_decides(spark, sf_dir):
    got = QUERIES["fuzzy_match"](spark, sf_dir).toPandas()
    assert got["slug"].is_unique and got["rival_id"].is_unique and set(got["match_confidence"]) == {"medium", "low"}
    assert 0 < (got["slug"].str[1:] != got["rival_id"].str[1:]).sum() < len(got)


def test_fuzzy_match_of_the_whole_table(spark, sf_dir, monkeypatch):
    """Every part against every part, by comparing everyone with everyone."""
    from test_sources import plain_match

    from quillstone.functions.text import name_key
    from quillstone.operators import matching

    sides, real = [], matching.match
    monkeypatch.setattr(matching, "match", lambda home, rival: sides.extend([home, rival]) or real(home, rival))
    got = QUERIES["fuzzy_match"](spark, sf_dir).collect()
    home, rival = ([tuple(r) for r in df.select(df.columns[0], name_key(df["name"])).collect()] for df in sides)
    assert {r.slug: (r.rival_id, r.match_confidence) for r in got} == plain_match(home, rival) and len(home) == len(rival)


@pytest.mark.parametrize("name", ["text_search", "unlinked_rows", "boilerplate", "broken_words", "registration_codes", "age_limits", "answer_years", "csv_report", "tool_search", "delta_page"])
def test_oracles_see_both_sides(engine, name):
    """Rows that the pattern takes and, where a column says so, rows that it does not."""
    rows = engine.execute(SQL[name]).df()
    assert len(rows)
    for column in rows.columns.intersection(["substantive", "broken", "booking_code", "least", "most", "year"]):
        kinds = rows[column].isna() if rows[column].isna().any() else rows[column].astype(str)
        assert kinds.nunique() > 1, column


def test_corroborated_means_two_addresses(spark, sf_dir):
    got = QUERIES["corroborate"](spark, sf_dir).toPandas()
    assert (got["corroborated"] == (got["source_urls"].map(lambda x: len(set(x))) >= 2)).all() and got["corroborated"].any()


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_facts_that_differ_are_corroborated(spark, tmp_path):
    turns = [
        (1, 0, "user", "Leads knee surgery unit. Plays chess on sundays"),
        (1, 1, "assistant", "leads large knee surgery unit.\n\nWrote four books. Ski"),
        (1, 2, "user", "Plays chess most sundays. Plays chess on sundays"),
        (2, 0, "user", "Leads knee surgery unit"),
        (2, 1, "user", None),
    ]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(c, f"src{t}", x) for c, t, _, x in turns], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["corroborate"](spark, str(tmp_path)).collect()
    # a fact gathers the later ones of other turns that share 0.4 of the words, also two of one turn
    want = {("1", "Leads knee surgery unit"): ["0", "1"], ("1", "Plays chess on sundays"): ["0", "2"], ("1", "Wrote four books"): ["1"], ("1", "Ski"): ["1"], ("2", "Leads knee surgery unit"): ["0"]}
    assert {(r.rewrite_id, r.fact.strip()): r.source_ids for r in got} == want and len(got) == len(want)
    assert all(r.corroborated == (len(r.source_ids) > 1) for r in got)
