"""Substring search by an index of three-letter parts.

An index holds, for each run, which slugs have a part anywhere in their searched columns, in order of parts, so a lookup reads the row groups of its parts alone. A term's literal pieces (between `%` and `_`)
give the parts that every hit must have; the rarest are intersected, and only the buckets of the slugs that are left are read for the check by `ilike`, which decides. So results are those of a
scan, whatever stands in the term; a term without a piece of three plain letters is a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import any_of
from quillstone.sources import buckets

COLUMNS = ("name", "slug", "site")


def parts_of(text: Column) -> Column:
    """The distinct three-letter parts of a lower-cased text."""
    low, n = F.lower(text), F.length(text) + 3  # lower case may be longer; what is cut short at the end is left out below
    every = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(low, i, F.lit(3)))
    return F.array_distinct(F.filter(every, lambda p: F.length(p) == 3))


def parts_of_term(term: str) -> list[str]:
    """The parts that every text like `%term%` holds: of its literal pieces, those of plain letters alone, for which all lower cases agree. A backslash makes the next sign a literal one."""
    pieces, now, escaped = [], "", False
    for c in term:
        if escaped or c not in "%_\\":
            now, escaped = now + c, False
        elif c == "\\":
            escaped = True
        else:
            pieces.append(now)
            now = ""
    found = {p[i : i + 3].lower() for p in (*pieces, now) for i in range(len(p) - 2)}
    return sorted(p for p in found if p.isascii())


def build(rows: DataFrame, path: str, columns: tuple[str, ...] = COLUMNS, parts: int | None = None) -> None:
    """Index the runs in `rows` (run_id, slug and the columns), in place of what was there of them."""
    every = F.array_distinct(F.flatten(F.array(*[F.coalesce(parts_of(F.col(c)), F.array().cast("array<string>")) for c in columns])))
    found = rows.select("run_id", "slug", F.explode(every).alias("part"))
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    put = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")
    put(found.repartitionByRange(parts, "run_id", "part", "slug").sortWithinPartitions("run_id", "part", "slug"), "postings")
    put(found.groupBy("run_id", "part").agg(F.count(F.lit(1)).alias("n")).repartitionByRange(parts, "run_id", "part").sortWithinPartitions("run_id", "part"), "sizes")


def hits(spark: SparkSession, path: str, run_id: str, term: str, rarest: int = 4) -> DataFrame | None:
    """(slug): those that hold the term's rarest parts; None if the term has none."""
    wanted = parts_of_term(term)
    if not wanted:
        return None
    sizes = buckets.read(spark, f"{path}/sizes").where((F.col("run_id") == run_id) & F.col("part").isin(wanted)).select("part", "n").collect()  # a row a part of the term
    n = {r.part: r.n for r in sizes}
    pick = sorted(wanted, key=lambda p: (n.get(p, 0), p))[:rarest]
    if not n.get(pick[0]):
        pick = pick[:1]
    found = buckets.read(spark, f"{path}/postings").where((F.col("run_id") == run_id) & F.col("part").isin(pick))
    return found.groupBy("slug").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == len(pick)).select("slug")


def search(spark: SparkSession, table: str, path: str, run_id: str, term: str, columns: tuple[str, ...] = COLUMNS, n_buckets: int = buckets.BUCKETS) -> DataFrame:
    """The rows of a run of a bucketed table whose columns hold the term (`ilike '%term%'`), through the index at `path`."""
    rows, like = buckets.read(spark, table).where(F.col("run_id") == run_id), any_of([F.col(c).ilike(f"%{term}%") for c in columns])
    found = hits(spark, path, run_id, term)
    if found is None:
        return rows.where(like)
    where = [r.b for r in found.select(buckets.bucket_of(F.col("slug"), n_buckets).alias("b")).distinct().collect()]  # at most a run's buckets
    return buckets.only(rows, {run_id: where}).join(found, "slug", "left_semi").where(like)
