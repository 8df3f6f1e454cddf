"""The profile record, its checks, and a profiles view over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS, _TEXT, _INT = T.ArrayType(T.StringType()), T.StringType(), T.IntegerType()
_FIELDS = {
    "run_id": _TEXT, "slug": _TEXT, "name": _TEXT, "site": _TEXT, "registration_number": _TEXT, "specialty_primary": _STRINGS, "specialty_sub": _STRINGS, "qualifications": _TEXT, "about_text": _TEXT,
    "has_photo": T.BooleanType(), "bio_depth": _TEXT, "plain_english_score": _INT, "booking_state": _TEXT, "slots_28_days": _INT, "insurers": _STRINGS, "treatments": _STRINGS, "consultation_times": _STRINGS,
    "memberships": _STRINGS, "practising_since": _INT, "price": T.DoubleType(), "manually_reviewed": T.BooleanType(), "scrape_status": _TEXT,
}
PROFILE = T.StructType([T.StructField(k, v) for k, v in _FIELDS.items()])
BIO_DEPTHS = ["missing", "thin", "adequate", "substantive"]
BOOKING_STATES = ["not_bookable", "bookable_no_slots", "bookable_with_slots"]


def validate(profiles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(run_id, slug, rule): one row for each broken rule of a profile; `keys` may name others in their place."""
    rules = {
        "slug_missing": F.col("slug").isNull() | (F.col("slug") == ""),
        "bio_depth_unknown": ~F.col("bio_depth").isin(BIO_DEPTHS),
        "booking_state_unknown": ~F.col("booking_state").isin(BOOKING_STATES),
        "plain_english_range": ~F.col("plain_english_score").between(1, 5),
        "practising_since_range": ~F.col("practising_since").between(1950, 2030),
        "price_negative": F.col("price") < 0,
        "slots_without_booking": (F.col("booking_state") == "not_bookable") & (F.col("slots_28_days") > 0),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return profiles.select(*(keys or ["run_id", "slug"]), F.explode(broken).alias("rule"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles made from `documents` and `labels`; PROFILES_SQL is the same relation for the comparison engine."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars", "text")
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    d = d.join(lab, "doc_id", "left")
    i, n = F.col("doc_id"), F.col("n_chars")
    some = lambda names, k: F.slice(F.array(*map(F.lit, names)), F.lit(1), (n % k).cast("int"))
    return d.select(
        F.concat(F.lit("run-"), (i % 2).cast("string")).alias("run_id"),
        F.concat(F.lit("p-"), F.floor(i / 2).cast("string")).alias("slug"),
        F.concat(F.lit("Dr "), F.split("text", " ")[0], F.lit(" "), F.col("lang")).alias("name"),
        F.when(i % 17 != 0, F.col("source")).alias("site"),
        F.format_string("GMC %07d", i).alias("registration_number"),
        F.array("lang", "source").alias("specialty_primary"),
        F.array().cast("array<string>").alias("specialty_sub"),
        F.when(i % 7 != 0, F.concat("lang", F.lit(" diploma, "), "source")).alias("qualifications"),
        F.when(i % 11 != 0, F.col("text")).alias("about_text"),
        (F.col("toxic") == 0).alias("has_photo"),
        F.when(i % 11 == 0, "missing").when(n <= 300, "thin").when(n <= 1000, "adequate").otherwise("substantive").alias("bio_depth"),
        F.when(i % 13 != 0, (1 + n % 5).cast("int")).alias("plain_english_score"),
        F.when(i % 3 == 0, "bookable_with_slots").when(i % 3 == 1, "bookable_no_slots").otherwise("not_bookable").alias("booking_state"),
        F.when(i % 3 == 0, (n % 9).cast("int")).alias("slots_28_days"),
        some(["axa", "aviva", "vitality"], 4).alias("insurers"),
        some(["biopsy", "scan"], 3).alias("treatments"),
        some(["mon am"], 2).alias("consultation_times"),
        F.slice(F.array(F.lit("society")), F.lit(1), (i % 2).cast("int")).alias("memberships"),
        F.when(i % 5 != 0, (1980 + n % 40).cast("int")).alias("practising_since"),
        ((n % 300).cast("double") + 50.0).alias("price"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("manually_reviewed"),
        F.when(i % 19 == 0, "error").when(i % 19 < 4, "parsed").otherwise("complete").alias("scrape_status"),
    )


PROFILES_SQL = """
SELECT concat('run-', d.doc_id % 2) AS run_id, concat('p-', d.doc_id // 2) AS slug, concat('Dr ', split_part(d.text, ' ', 1), ' ', d.lang) AS name,
  CASE WHEN d.doc_id % 17 <> 0 THEN d.source END AS site, 'GMC ' || lpad(d.doc_id::VARCHAR, 7, '0') AS registration_number, [d.lang, d.source] AS specialty_primary,
  CASE WHEN d.doc_id % 7 <> 0 THEN concat(d.lang, ' diploma, ', d.source) END AS qualifications, CASE WHEN d.doc_id % 11 <> 0 THEN d.text END AS about_text,
  l.toxic = 0 AS has_photo,
  CASE WHEN d.doc_id % 11 = 0 THEN 'missing' WHEN d.n_chars <= 300 THEN 'thin' WHEN d.n_chars <= 1000 THEN 'adequate' ELSE 'substantive' END AS bio_depth,
  CASE WHEN d.doc_id % 13 <> 0 THEN CAST(1 + d.n_chars % 5 AS INT) END AS plain_english_score,
  CASE d.doc_id % 3 WHEN 0 THEN 'bookable_with_slots' WHEN 1 THEN 'bookable_no_slots' ELSE 'not_bookable' END AS booking_state,
  CASE WHEN d.doc_id % 3 = 0 THEN CAST(d.n_chars % 9 AS INT) END AS slots_28_days,
  CAST(d.n_chars % 4 AS INT) AS insurer_count, CAST(d.n_chars % 3 AS INT) AS treatment_count, CAST(d.n_chars % 2 AS INT) AS time_count, CAST(d.doc_id % 2 AS INT) AS membership_count,
  CASE WHEN d.doc_id % 5 <> 0 THEN CAST(1980 + d.n_chars % 40 AS INT) END AS practising_since, CAST(d.n_chars % 300 AS DOUBLE) + 50.0 AS price,
  coalesce(l.quality = 1, false) AS manually_reviewed,
  CASE WHEN d.doc_id % 19 = 0 THEN 'error' WHEN d.doc_id % 19 < 4 THEN 'parsed' ELSE 'complete' END AS scrape_status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
