"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a hashed order, are cut into blocks of `block_bytes` bytes. Block k of a
source of weight w (weights sum to 1) is released at slot floor(k / w) and due at slot ceil((k + 1) / w);
at each slot the released block with the earliest deadline goes next. A source that runs out leaves its
share to the others in the ratio of their weights, so the mixture has every block, and at every slot every source is
within one block of its share; its documents' bytes are within one block and its largest document, as a document is in the block where it begins. `mix` puts
the documents into that order and drops those of sources without a weight. Blocks are counted, not collected: the
schedule is made from each unit's number of blocks (at most about three times `most_blocks` in all), and rows get their
slot by a join on (unit, block).

Without weights, sources get bytes ** `temperature` shares, so a hot source is held back and
small ones are lifted. Any number of sources will do: those smaller than a block share blocks by a hash of their names, so their
`block` is one of the shared unit's, and names and sizes stay in a Spark table. A null source is the source ''. Sources without a weight (or with weight 0)
are not in the mixture; a weight below 1e-12 of the greatest counts as that. Null texts count as one byte's worth. Rows that repeat count as often as they occur. A very long text is
one block's, which it overflows. An empty table gives an empty result. Extra columns, whatever their names, are kept by `mix` and ignored by `schedule`.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from fractions import Fraction
from itertools import accumulate, pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import running, stored, table


def whole_plan(blocks: dict[str | int, int], weights: dict[str | int, float]) -> list[tuple[str | int, int, int, int, int]]:
    """(source, block, release, deadline, slot) of every block of the weighted sources, by earliest deadline first.

    In virtual time v a source of weight w has had min(blocks, w v) blocks; the sum over all sources is the slot. So one that runs out
    leaves its share to the others, and the windows are those of the even flow: they always can be met.
    """
    most = sum(w for w in weights.values() if w > 0)
    exact = {s: max(1, round(w / most * 10**12)) for s, w in weights.items() if w > 0 and blocks.get(s, 0) > 0}
    ends = sorted((Fraction(blocks[s], w), blocks[s], w) for s, w in exact.items())
    at = [e for e, _, _ in ends]
    done = [0, *accumulate(n for _, n, _ in ends)]
    left = [sum(exact.values()) - gone for gone in (0, *accumulate(w for _, _, w in ends))]

    def flow(k: int, w: int) -> int:
        """w times the slot at virtual time k / w."""
        i = bisect_left(at, Fraction(k, w))
        return done[i] * w + k * left[i]

    jobs = []
    for s, w in exact.items():
        slots = [flow(k, w) for k in range(blocks[s] + 1)]
        jobs += [(a // w, -(-b // w), s, k) for k, (a, b) in enumerate(pairwise(slots))]
    jobs.sort(reverse=True)
    out, ready = [], []
    for slot in range(len(jobs)):
        while jobs and jobs[-1][0] <= slot:
            release, deadline, s, k = jobs.pop()
            heapq.heappush(ready, (deadline, s, k, release))
        deadline, s, k, release = heapq.heappop(ready)
        out.append((s, k, release, deadline, slot))
    return out


def pfair(blocks: dict[str, int], weights: dict[str, float]) -> list[tuple[str, int, int, int, int]]:
    """The slots of whole_plan() in which every weighted source still gets its given share."""
    most = sum(w for w in weights.values() if w > 0)
    lasting = min((math.floor(blocks.get(s, 0) * most / w + 1e-9) for s, w in weights.items() if w > 0), default=0)
    return whole_plan(blocks, weights)[:lasting]


def units(rows: DataFrame, weights: dict[str, float] | None, temperature: float, block_bytes: int | None, most_blocks: int) -> tuple[DataFrame, dict[int, int], dict[int, float], int]:
    """`rows` with the unit each is scheduled in, and the units' bytes and weights, and the block's bytes.

    A source of a block or more is a unit; smaller ones share units of about a block, by a hash of their names. Sources without a weight have units of their own, with weight 0.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy("source").agg(F.sum("bytes").alias("size"))
    given = None
    if weights is not None:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items() if w > 0], "name string, weight double")
        sizes = sizes.join(F.broadcast(given), F.col("source") == F.col("name"), "left").drop("name").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    sizes = stored(sizes, "source-sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    # blocks are never more than most_blocks, so a smaller block that is asked for is raised: the schedule is made at the driver and broadcast
    block_bytes = max(1 << 14 if block_bytes is None else block_bytes, -(-total // most_blocks))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("size") / F.lit(float(block_bytes)), F.lit(temperature)))
    large = sizes.where(F.col("size") >= block_bytes).orderBy("source").collect()  # at most total / block_bytes
    small = total - sum(r.size for r in large)
    shared = max(1, -(-small // block_bytes))
    pool = F.lit(len(large)) + F.pmod(F.xxhash64("source"), F.lit(shared)).cast("int")
    others = sizes.where(F.col("size") < block_bytes).withColumn("unit", pool + F.when(F.col("weight") > 0, 0).otherwise(shared))
    # decimals: the sum of a unit's weights is the same in any order
    others = others.groupBy("unit").agg(F.sum("size").alias("size"), F.sum(F.col("weight").cast("decimal(28,15)")).cast("double").alias("weight"), F.max("weight").alias("most")).collect()
    bytes_of = {i: r.size for i, r in enumerate(large)} | {r.unit: r.size for r in others}
    weight_of = {i: r.weight for i, r in enumerate(large)} | {r.unit: max(r.weight, r.most) for r in others}
    named = spark.createDataFrame([(r.source, i) for i, r in enumerate(large)], "name string, own int")
    rows = rows.join(F.broadcast(named), F.col("source") == F.col("name"), "left").drop("name")
    weighted = F.lit(0)
    if given is not None:
        rows = rows.join(F.broadcast(given), F.col("source") == F.col("name"), "left").drop("name")
        weighted = F.when(F.col("weight").isNotNull(), 0).otherwise(shared)
    return rows.withColumn("unit", F.coalesce("own", pool + weighted)), bytes_of, weight_of, block_bytes


def _slots(docs: DataFrame, weights: dict[str, float] | None, temperature: float, block_bytes: int | None, most_blocks: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw"), F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1)).cast("long").alias("bytes"))
    # the place of reading tells equal rows apart, so many of them are cut like others; written once, so that it stays the same
    rows = stored(rows.withColumn("spread", F.xxhash64("doc_id", "source", F.monotonically_increasing_id())), "mixing-rows")
    rows, sizes, weights, block_bytes = units(rows, weights, temperature, block_bytes, most_blocks)
    before = running(rows, "unit", ["spread", "doc_id", "bytes"], F.col("bytes"))
    rows = before.withColumn("block", F.floor(F.col("before") / block_bytes).cast("long"))
    # the last block of a unit may be short; a block that one document overflows leaves its next places empty
    plan = whole_plan({u: -(-b // block_bytes) for u, b in sizes.items()}, weights)
    slots = docs.sparkSession.createDataFrame(plan, "u int, k long, release long, deadline long, slot long")
    return rows.join(F.broadcast(slots), (F.col("unit") == F.col("u")) & (F.col("block") == F.col("k")), "left")


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, block_bytes: int | None = None, most_blocks: int = 4_000) -> DataFrame:
    """One row a document: doc_id, source, bytes, block, and release, deadline, slot, or nulls where its block is not in the mixture."""
    return _slots(docs, weights, temperature, block_bytes, most_blocks).select("doc_id", "source", "bytes", "block", "release", "deadline", "slot", F.col("slot").isNotNull().alias("kept"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, block_bytes: int | None = None, most_blocks: int = 4_000) -> DataFrame:
    """The documents of the mixture with all their columns, partitions and rows in the order of slots. Rows that repeat doc_id, source and text share the first of their slots."""
    slots = _slots(docs, weights, temperature, block_bytes, most_blocks).where("slot is not null").groupBy("doc_id", "source", "raw").agg(F.min("slot").alias("slot"))
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__id"), F.coalesce("source", F.lit("")).alias("__s"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__raw"))
    same = F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__s") == F.col("source")) & (F.col("__raw") == F.col("raw"))
    return rows.join(slots.hint("shuffle_hash"), same).repartitionByRange("slot", "raw").sortWithinPartitions("slot", "raw").select("__row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents"))
