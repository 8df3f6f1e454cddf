"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own_dir: str | None = None
_scratch: list[str] = []
_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is named, as in tests."""
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="quillstone-")
    return _own_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there and no executor's loss costs more than a reread."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """stored() with the table's path, for discard()."""
    spark = df.sparkSession
    path = f"{_scratch[-1] if _scratch else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def sweep(spark: SparkSession) -> int:
    """Delete every table that this session's operators have left in the shared folder, and say how many: once no result of theirs is read any more."""
    n = len(_made)
    while _made:
        discard(spark, _made.pop())
    return n


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ours that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored within go to a folder of their own, which is deleted at the end; yields a way to store what is to stay."""
    outer, folder = list(_scratch), f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        inner, _scratch[:] = list(_scratch), outer
        try:
            return stored(df, name)
        finally:
            _scratch[:] = inner

    _scratch.append(folder)
    try:
        yield keep
    finally:
        _scratch[:] = outer
        discard(spark, folder)


def ascii_lower(col):
    return F.translate(col, _UPPER, _LOWER)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """(doc_id, text) alone, null text as empty: other columns, whatever their names, stay outside."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """texts() with `raw`, the text's hash: (doc_id, raw) tells apart texts that share a doc_id or have none."""
    return texts(docs).withColumn("raw", F.xxhash64("text"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs`, all columns, without the texts in `gone` (doc_id, raw) and with one of rows that repeat both (any one, should they differ in other columns)."""
    left = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__raw"))
    twice = left.groupBy("__id", "__raw").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("__id").alias("__i"), F.col("__raw").alias("__r"))
    gone = gone.select(F.col("doc_id").alias("__i"), F.col("raw").alias("__r")).distinct()
    same = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__raw") == F.col("__r"))
    twice = stored(twice, "repeats")
    if twice.isEmpty():
        return left.join(gone.hint("shuffle_hash"), same, "left_anti").select("__row.*")
    both = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("__i", "__r")]
    once = left.join(twice.alias("a").join(gone.alias("b"), both, "left_anti"), same, "left_semi").dropDuplicates(["__id", "__raw"])
    out = left.join(gone.union(twice).hint("shuffle_hash"), same, "left_anti").union(once)
    return out.select("__row.*")


def collapsed(docs: DataFrame) -> DataFrame:
    """keyed_texts() with rows that repeat (doc_id, text) as one, and how many they are in `copies`: so that many equal rows are not one task's work."""
    rows = keyed_texts(docs)
    twice = stored(rows.groupBy("doc_id", "raw").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select(F.col("doc_id").alias("i"), F.col("raw").alias("r"), "copies"), "repeats")
    if twice.isEmpty():
        return rows.withColumn("copies", F.lit(1).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("raw") == F.col("r"))
    many = rows.join(twice, same).drop("i", "r").dropDuplicates(["doc_id", "raw"])
    return rows.join(twice, same, "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(many)


def sums_before(df: DataFrame, key: str, value: str, name: str, most: int = 10_000) -> DataFrame:
    """(key, name): the sum of `value` over the rows of lesser keys. Keys are distinct longs from 0 on. No window holds more than `most` rows: larger tables are summed by ranges of keys first."""
    df = df.select(key, value)
    earlier = lambda w: F.coalesce(F.sum(value).over(w.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    if df.count() <= most:
        return df.select(key, earlier(Window.partitionBy()).alias(name))
    wide, base = f"{key}_range", f"{name}_base"  # names of their own at each level
    cut = df.withColumn(wide, F.floor(F.col(key) / most))
    bases = sums_before(cut.groupBy(wide).agg(F.sum(value).alias(value)), wide, value, base, most)
    within = cut.withColumn("__in", earlier(Window.partitionBy(wide)))
    return within.join(bases, wide).select(key, (F.col(base) + F.col("__in")).alias(name))


def running(df: DataFrame, key: str, order: list[str], value=None, name: str = "before", rows_each: int | None = None, most_buckets: int = 50_000) -> DataFrame:
    """Add `name`: the sum of `value` (default: the count) over the rows of the same `key` that come earlier in `order`.

    `order[0]` is a long spread evenly over all longs, such as a hash. Each key's rows are cut
    into ranges of it, as many as the key has rows for, so a hot key is numbered by many tasks;
    only the ranges' totals (at most about `most_buckets`, plus one a key) are summed over a whole key.
    The number of keys must be small, as the numbers of shards or weighted sources are.
    """
    value = F.lit(1) if value is None else value
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    if rows_each is None:
        total = sizes.agg(F.sum("__n")).first()[0] or 0
        rows_each = max(256, math.ceil(total / most_buckets))
    # a range's number is the upper part of the unsigned order value, scaled to the key's number of ranges
    unit = (F.shiftrightunsigned(F.col(order[0]), 33)) / F.lit(float(1 << 31))
    cut = df.join(F.broadcast(sizes.select(F.col(key).alias("__k"), F.ceil(F.col("__n") / rows_each).alias("__m"))), F.col(key).eqNullSafe(F.col("__k")))
    cut = cut.withColumn("__b", F.floor(unit * F.col("__m")).cast("int")).drop("__k", "__m")
    totals = cut.groupBy(key, "__b").agg(F.sum(value).alias("__t"))
    whole = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col(key).alias("__k"), F.col("__b").alias("__c"), F.coalesce(F.sum("__t").over(whole), F.lit(0)).alias("__base"))
    within = Window.partitionBy(key, "__b").orderBy(*[F.shiftrightunsigned(F.col(order[0]), 1), *order]).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumn("__in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    out = out.join(F.broadcast(base), F.col(key).eqNullSafe(F.col("__k")) & (F.col("__b") == F.col("__c")))
    return out.withColumn(name, (F.col("__base") + F.col("__in")).cast("long")).drop("__b", "__k", "__c", "__base", "__in")
