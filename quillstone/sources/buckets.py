"""Runs cut into buckets by slug: a merge reads and rewrites only the buckets that its rows fall in.

A table is a folder run_id=.../bucket=.... `upsert` finds its rows' buckets first; their numbers become a filter on the partition columns, so the scan lists no other
folder, and dynamic partition overwrite leaves the others' files as they are. The merged buckets are written aside before they are published, under the batch's number: a batch that is
repeated after a crash, even one that left half of its buckets published, publishes what it had merged and does not merge again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.sources.shared import file_system, finished, remove
from quillstone.sources.snapshots import exists, merge, pending

KEYS = ["run_id", "slug"]
BUCKETS = 64


def bucket_of(slug: Column, buckets: int = BUCKETS) -> Column:
    """A slug's bucket. A table's number of buckets never changes; some hundred thousand rows a bucket is a good size."""
    return F.pmod(F.xxhash64(slug), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table with its bucket column; run_id is text, whatever it looks like."""
    found = spark.read.parquet(path).schema
    return spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) if f.name == "run_id" else f for f in found])).parquet(path)


def write(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replace the buckets that `rows` fall in."""
    _put(rows.withColumn("bucket", bucket_of(F.col("slug"), buckets)), path)


def _put(rows: DataFrame, path: str) -> None:
    rows.repartition("run_id", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "bucket").parquet(path)


def touched(rows: DataFrame) -> dict[str, list[int]]:
    """The buckets of each run that rows with a bucket fall in: at most a table's number of folders."""
    found = rows.groupBy("run_id").agg(F.sort_array(F.collect_set("bucket")).alias("b")).collect()
    return {r.run_id: r.b for r in found}


def only(table: DataFrame, parts: dict[str, list[int]]) -> DataFrame:
    """The rows of those buckets, by a filter on partition columns alone."""
    return table.where(reduce(Column.__or__, [(F.col("run_id") == run) & F.col("bucket").isin(some) for run, some in parts.items()], F.lit(False)))


def folded(delta: DataFrame, order: list[str], keys: list[str] = KEYS, changed: str = "changed") -> DataFrame:
    """One row a key: of each column the value that came last in `order` among the rows that name it in `changed`; by a combinable aggregate."""
    last = F.struct(*order)
    sets = lambda c: F.coalesce(F.array_contains(changed, c), F.lit(False))
    pick = lambda c: F.when(F.max(sets(c)), F.max_by(c, F.when(sets(c), last))).otherwise(F.max_by(c, last))
    rest = [c for c in delta.columns if c not in (*keys, changed, *order)]
    return delta.groupBy(*keys).agg(*[pick(c).alias(c) for c in rest], F.array_distinct(F.flatten(F.collect_set(changed))).alias(changed))


def merged(spark: SparkSession, path: str, delta: DataFrame, keys: list[str] = KEYS, buckets: int = BUCKETS, changed: str = "changed") -> DataFrame:
    """The touched buckets as they will be, with their bucket. `delta`: one row a key, and an array of the columns it sets (snapshots.merge)."""
    delta = delta.withColumn("bucket", bucket_of(F.col("slug"), buckets))
    parts = touched(delta)
    old = only(read(spark, path), parts) if exists(spark, path) else delta.drop(changed).limit(0)
    # the bucket follows from the slug, so it joins the keys and no row meets one of another bucket
    return merge(old, delta, [*keys, "bucket"], changed)


def upsert(spark: SparkSession, path: str, delta: DataFrame, staging: str, batch: int, keys: list[str] = KEYS, buckets: int = BUCKETS, changed: str = "changed") -> None:
    """Merge a batch into the table, once, however often it is called with its number; batches come one after another. `staging` goes with the numbers, as a stream's checkpoint does."""
    aside = f"{staging}/batch={batch}"
    if not finished(spark, aside):
        rows = merged(spark, path, delta, keys, buckets, changed)
        rows.repartition("run_id", "bucket").write.mode("overwrite").partitionBy("run_id", "bucket").parquet(aside)
    publish(spark, aside, path)
    _sweep(spark, staging, batch)


def publish(spark: SparkSession, aside: str, path: str) -> None:
    """Put finished buckets in place; the same ones again change nothing."""
    if exists(spark, aside):  # a batch without rows has no files
        _put(read(spark, aside), path)


def _sweep(spark: SparkSession, staging: str, batch: int) -> None:
    """Delete what earlier batches left aside: only the last one can be repeated."""
    fs, where = file_system(spark, staging)
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) < batch:
            remove(spark, f"{staging}/{name}")


def advance(spark: SparkSession, path: str, run_id: str, stage: str, work, staging: str, batch: int, buckets: int = BUCKETS) -> None:
    """Take a run's unfinished rows through a stage: `work` gets those that have not reached it, as rows of the table, and returns (slug, columns that it found); the status follows."""
    mine = read(spark, path).where(F.col("run_id") == run_id)
    todo = pending(mine, mine, stage)
    found = work(todo.drop("bucket"))
    names = [c for c in found.columns if c not in KEYS]
    delta = found.select(F.lit(run_id).alias("run_id"), "slug", *names, F.lit(stage).alias("scrape_status"), F.array(*map(F.lit, [*names, "scrape_status"])).alias("changed"))
    upsert(spark, path, delta, staging, batch, buckets=buckets)
