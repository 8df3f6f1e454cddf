"""Smaller relations behind the desk's pages: lists, look-ups, model answers and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.numbers import percent
from quillstone.functions.text import empty_to_null, whole_year, without_fences
from quillstone.operators.compare import CONFIDENCE, ranked_value
from quillstone.operators.scoring import FLAGS

# The levels that an assessment may give.
LEVELS = {"bio_depth": ["substantive", "adequate", "thin", "missing"], "treatment_specificity": ["highly_specific", "moderately_specific", "generic", "not_applicable"], "qualifications_completeness": ["comprehensive", "adequate", "minimal", "missing"]}
ASSESSMENT = "plain_english_score int, bio_depth string, treatment_specificity string, qualifications_completeness string, clinical_interests array<string>, languages array<string>, notes string, declaration_substantive boolean"


def flag_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in FLAGS.items()], "code string, severity string, description string")


def facet_search(values: DataFrame, column: str, term: str, most: int = 50) -> DataFrame:
    """Distinct values that hold a term, case apart, by name."""
    return values.select(column).distinct().where(F.col(column).ilike(f"%{term}%")).orderBy(column).limit(most)


def by_confidence(links: DataFrame, most: int) -> DataFrame:
    return links.orderBy(ranked_value(F.col("match_confidence"), CONFIDENCE, 0).desc(), "slug").limit(most)


def shuffled(df: DataFrame, most: int, seed: int = 0) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(most)


def newest(df: DataFrame, key: Column, time: str, tie: str) -> DataFrame:
    """Children of a key, newest first."""
    return df.where(key).orderBy(F.desc(time), tie)


def newest_first(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """All rows with their place among their key's, newest first."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time), tie)))


def largest_images(images: DataFrame, most: int = 3) -> DataFrame:
    """Each slug's images of the greatest area; unknown sides count 0."""
    area = F.coalesce("width", F.lit(0)) * F.coalesce("height", F.lit(0))
    rank = F.row_number().over(Window.partitionBy("slug").orderBy(area.desc(), "url"))
    return images.withColumn("rank", rank).where(F.col("rank") <= most)


def win_rates(totals: DataFrame) -> DataFrame:
    """Shares of pairs won from a row of compare.aggregate."""
    n = F.col("rival_better") + F.col("home_better") + F.col("ties")
    return totals.select(*[percent(F.col(c), n).alias(f"{c}_pct") for c in ("rival_better", "home_better", "ties")])


def bar(a: Column, b: Column) -> tuple[Column, Column]:
    """Two counts as shares of the greater, at least 1."""
    top = F.greatest(a, b, F.lit(1))
    return percent(a, top), percent(b, top)


def sources_by_support(facts: DataFrame) -> DataFrame:
    """Counts of corroborated and single-source facts of a rewrite."""
    return facts.groupBy("rewrite_id").agg(F.count_if("corroborated").alias("corroborated"), F.count_if(~F.col("corroborated")).alias("single"))


def queries_for(name: Column, site: Column, specialty: Column) -> Column:
    """Web searches for a person: general, by site (or by specialty, where no site is known), and for a portrait."""
    # The words of the searches.
    quoted = F.concat(F.lit('"'), name, F.lit('"'))
    second = F.when(F.coalesce(site, F.lit("")) != "", F.concat_ws(" ", quoted, site)).otherwise(F.concat_ws(" ", quoted, specialty, F.lit("hospital")))
    return F.array(F.concat_ws(" ", quoted, specialty, F.lit("consultant")), second, F.concat_ws(" ", quoted, specialty, F.lit("portrait photo")))


def answer_list(answer: Column) -> Column:
    """A model's list: a JSON array, or parts between line feeds and semicolons; 'null' and blanks are null."""
    bare = without_fences(answer)
    plain = F.filter(F.transform(F.split(bare, "[\n;]"), lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*•]\s*", ""))), lambda x: x != "")
    parsed = F.when(bare.startswith("["), F.coalesce(F.from_json(bare, "array<string>"), plain)).otherwise(plain)
    return F.when((F.lower(bare) != "null") & (bare != ""), parsed)


def answer_year(answer: Column) -> Column:
    return whole_year(without_fences(answer))


def answer_text(answer: Column) -> Column:
    bare = without_fences(answer)
    return F.when(F.lower(bare) != "null", empty_to_null(bare))


def assessment(answer: Column) -> Column:
    """A model's assessment from JSON, or null if it is no JSON, a level is unknown or the score is not 1 to 5."""
    a = F.from_json(without_fences(answer), ASSESSMENT)
    good = a.plain_english_score.between(1, 5)
    for name, levels in LEVELS.items():
        good = good & a[name].isin(levels)
    return F.when(F.coalesce(good, F.lit(False)), a)


def element_content(element: Column) -> Column:
    """A profile's content of a rewrite element, arrays as JSON."""
    out = F.when(element == "bio", F.col("about_text")).when(element == "qualifications", F.col("qualifications")).when(element == "practising_since", F.col("practising_since").cast("string"))
    for name in ("treatments", "memberships", "specialty_sub"):
        out = out.when(element == name, F.to_json(name))
    return out
