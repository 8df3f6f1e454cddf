"""Run snapshots: each change is a new relation, and a run is a partition that is written whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

STAGES = ["pending", "crawl_done", "parse_done", "booking_done", "assess_done", "complete"]


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == "completed").orderBy(F.desc("started_at"), "run_id").limit(1)


def unfinished_run(runs: DataFrame) -> DataFrame:
    """The newest run still going."""
    return runs.where(F.col("status") == "running").orderBy(F.desc("started_at"), "run_id").limit(1)


def run_history(runs: DataFrame, pilots: bool = True) -> DataFrame:
    kept = runs if pilots else runs.where(~F.lower("run_id").startswith("pilot-"))
    return kept.orderBy(F.desc("started_at"), "run_id")


def lookup(rows: DataFrame, **keys) -> DataFrame:
    """The row of a key; equality on partition and data columns reaches the scan."""
    for k, v in keys.items():
        rows = rows.where(F.col(k) == v)
    return rows.limit(1)


def merge(old: DataFrame, delta: DataFrame, keys: list[str], changed: str = "changed") -> DataFrame:
    """old with delta's rows put in. delta's array `changed` names the columns that it sets, so a null can be set too; new keys take all of delta."""
    o, d = old.alias("o"), delta.alias("d")
    both = o.join(d, [F.col(f"o.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys], "full")
    is_new, is_set = reduce(Column.__and__, [F.col(f"o.{k}").isNull() for k in keys]), lambda c: F.coalesce(F.array_contains(f"d.{changed}", c), F.lit(False))
    pick = lambda c: F.when(is_new | is_set(c), F.col(f"d.{c}")).otherwise(F.col(f"o.{c}")) if c in delta.columns else F.col(f"o.{c}")
    return both.select(*[F.coalesce(f"o.{k}", f"d.{k}").alias(k) for k in keys], *[pick(c).alias(c) for c in old.columns if c not in keys])


def update_where(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_keys(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def replace_set(rows: DataFrame, clear: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """rows without the cleared keys, then the new rows."""
    return delete_keys(rows, clear, keys).unionByName(new)


def reached(status: Column, stage: str) -> Column:
    """Whether a row is at a stage or beyond; errors and nulls start anew."""
    rank = F.coalesce(*[F.when(status == s, i) for i, s in enumerate(STAGES)], F.lit(-1))
    return rank >= STAGES.index(stage)


def pending(urls: DataFrame, known: DataFrame, stage: str, key: str = "slug") -> DataFrame:
    """The keys that a resumed run still has to take through a stage."""
    done = known.where(reached(F.col("scrape_status"), stage)).select(key)
    return urls.join(done, key, "left_anti")


def with_earlier(urls: DataFrame, known: DataFrame, columns: list[str], key: str = "slug") -> DataFrame:
    """A resumed run's keys with what an earlier attempt left: its status and those columns, nulls where it did not get to them."""
    return urls.join(known.select(key, "scrape_status", *columns), key, "left")


def write_run(rows: DataFrame, path: str) -> None:
    """Replace the partitions of the runs in `rows` and no others."""
    rows.repartition("run_id", F.pmod(F.xxhash64("slug"), F.lit(64))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def copy_run(spark: SparkSession, source: str, target: str, run_id: str) -> None:
    write_run(spark.read.parquet(source).where(F.col("run_id") == run_id), target)


def truncate(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema  # noqa: B018
        return True
    except AnalysisException:
        return False


def status_counts(batch: DataFrame, column: str = "status") -> DataFrame:
    """One row: counts of states, and the batch's own state."""
    n = lambda s: F.count(F.when(F.col(column) == s, 1))
    row = batch.agg(F.count(F.lit(1)).alias("total"), *[n(s).alias(s) for s in ("pending", "running", "completed", "failed")])
    state = F.when(F.col("completed") + F.col("failed") == F.col("total"), F.when(F.col("failed") > 0, "finished_with_errors").otherwise("finished")).when(F.col("running") > 0, "running").otherwise("pending")
    return row.withColumn("state", state)
