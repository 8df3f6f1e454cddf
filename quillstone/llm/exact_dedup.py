"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is its length with two polynomial hashes modulo 31-bit primes. A text is
hashed in chunks, all powers of the base at once by numpy, and chunk hashes combine by shifting
the left one by the right one's length: h(ab) = h(a) * B**len(b) + h(b). Any cutting gives the
same value. Texts with equal fingerprints are then compared chunk by chunk: an aggregate
keeps the least and the greatest chunk of each place, so a group of any size streams through
map-side aggregation and never meets in one task. Groups in which a place has two
different chunks (collisions) are split by their whole texts.

Nulls count as empty texts. A null doc_id never names a group that has another. Rows that repeat both
doc_id and text share one verdict and count in group_size; `deduplicate` keeps one of them. Very long texts
are hashed and compared by chunks. An empty table gives an empty result.
Extra input columns are ignored by `verdicts` and kept by `deduplicate`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import ascii_lower, keyed_texts, stored, table, without

PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
CHUNK = 1 << 16
KEY = ["h1", "h2", "n_bytes"]


def _powers(n: int) -> list[np.ndarray]:
    """base**(n-1) ... base**0 for each prime."""
    out = []
    for p, b in zip(PRIMES, BASES):
        v = np.ones(1, np.uint64)
        while len(v) < n:  # doubling: the left half is the right half shifted
            v = np.concatenate([v * np.uint64(pow(b, len(v), p)) % np.uint64(p), v])
        out.append(v[len(v) - n :])
    return out


class Polynomial:
    """Hash values are pairs of ints; `chunk` for up to `size` bytes, `combine` for any two neighbours."""

    def __init__(self, size: int = CHUNK):
        self.size, self.powers = size, _powers(size)

    def chunk(self, data: np.ndarray) -> tuple[int, int]:
        wide = data.astype(np.uint64) + np.uint64(1)  # no zero digits: leading NULs count
        n = len(wide)
        return tuple(int(np.dot(wide, v[self.size - n :]) % np.uint64(p)) for p, v in zip(PRIMES, self.powers))

    @staticmethod
    def combine(left: tuple[int, int], right: tuple[int, int], right_len: int) -> tuple[int, int]:
        return tuple((a * pow(b, right_len, p) + c) % p for a, c, b, p in zip(left, right, BASES, PRIMES))

    def text(self, data: np.ndarray) -> tuple[int, int]:
        h = (0, 0)
        for i in range(0, len(data), self.size):
            part = data[i : i + self.size]
            h = self.combine(h, self.chunk(part), len(part))
        return h


def fingerprints(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """(doc_id, raw, n_bytes, h1, h2, text_sha256) of the texts with A-Z lowered; raw tells apart texts that share a doc_id."""
    schema = "doc_id long, raw long, n_bytes long, h1 long, h2 long, text_sha256 string"

    def run(batches):
        poly = Polynomial(chunk_bytes)
        for batch in batches:
            n, h1, h2, sha = [], [], [], []
            for x in batch.column("text"):
                low = x.as_buffer().to_pybytes().lower()  # bytes.lower() touches A-Z only
                a, b = poly.text(np.frombuffer(low, np.uint8))
                n.append(len(low)), h1.append(a), h2.append(b), sha.append(hashlib.sha256(low).hexdigest())
            longs = [pa.array(v, pa.int64()) for v in (n, h1, h2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("raw"), *longs, pa.array(sha, pa.string())], ["doc_id", "raw", "n_bytes", "h1", "h2", "text_sha256"])

    return keyed_texts(docs).mapInArrow(run, schema)


def verdicts(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256, and raw, which tells apart texts that share a doc_id."""
    prints = stored(fingerprints(docs, chunk_bytes), "prints")
    # a table of its own, so that Spark can cut a hot group's side of the joins below
    groups = stored(prints.groupBy(*KEY).agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id")).where("group_size > 1"), "groups")
    members = stored(prints.join(groups, KEY).select("doc_id", "raw", *KEY).distinct(), "members")
    same = F.col("m.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("m.raw") == F.col("t.raw"))
    whole = keyed_texts(docs).alias("t").join(members.hint("shuffle_hash").alias("m"), same).select("m.doc_id", "m.raw", *[f"m.{k}" for k in KEY], ascii_lower("text").cast("binary").alias("body"))
    at = F.explode(F.sequence(F.lit(0), F.ceil(F.greatest(F.col("n_bytes"), F.lit(1)) / chunk_bytes).cast("int") - 1))
    places = whole.select(*KEY, "body", at.alias("at")).select(*KEY, "at", F.expr(f"substring(body, at * {chunk_bytes} + 1, {chunk_bytes})").alias("part"))
    # in two steps, so that the tasks' parts of a hot group don't all go to one task
    some = places.groupBy(*KEY, "at", F.pmod(F.spark_partition_id(), F.lit(32)).alias("salt")).agg(F.min("part").alias("a"), F.max("part").alias("b"))
    split = stored(some.groupBy(*KEY, "at").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select(*KEY).distinct(), "collisions")
    if split.isEmpty():
        found = prints.join(groups, KEY, "left")
    else:  # the fingerprint is shared by different texts
        parted = whole.join(split, KEY, "left_semi").groupBy(*KEY, "body").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("k"))
        parted = parted.select(*[F.col(c).alias(f"p_{c}") for c in KEY], F.sha2("body", 256).alias("p_sha"), F.lit(True).alias("own"), "n", "k")
        same_text = [F.col(c) == F.col(f"p_{c}") for c in KEY] + [F.col("text_sha256") == F.col("p_sha")]
        found = prints.join(groups, KEY, "left").join(parted, same_text, "left")
        found = found.withColumn("keep_id", F.when(F.col("own"), F.col("k")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("n", "group_size"))
    keep = F.coalesce("keep_id", "doc_id")
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", "raw")


def deduplicate(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """`docs`, all columns, with one row of the largest doc_id of each group of equal texts."""
    of = verdicts(docs, chunk_bytes)
    # texts that differ in case may share the doc_id that stays: the one of the least hash does
    kept = of.where("kept").groupBy("doc_id", "text_sha256").agg(F.min("raw").alias("raw"), F.max("raw").alias("other")).where("raw <> other")
    twice = of.join(kept.select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"), F.col("raw").alias("k_raw")), F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_sha256") == F.col("k_sha"))).where("raw <> k_raw")
    return without(docs, of.where("not kept").select("doc_id", "raw").union(twice.select("doc_id", "raw")))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents")).drop("raw")


OP1_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)
"""
