"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are rows with equal texts and never part. A group of at least 1/`grain` of a shard is an
item of its own: there are at most shards * grain of them, whatever the input. Smaller groups join
parcels by a hash of their text, shards * grain parcels at most. Items go, largest
first, into the shard with the tightest remaining capacity that holds them, found in a balanced
tree; the capacity is the smallest at which all items fit (by bisection). So shards come out equal to
within about a parcel, unless one group alone is larger than a shard's share.

Null texts have size 16 and belong to the group of the empty text. An empty table gives an empty result.
Rows that repeat are rows of one group, a null doc_id is kept, and a very long text is one row's size. Extra input columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import running, stored, table, texts


class Capacities:
    """A treap of (remaining, bin) pairs: insert, and take the least pair not below a bound, in logarithmic time."""

    def __init__(self):
        self.root, self.seed = None, 12345

    def insert(self, pair) -> None:
        self.seed = (self.seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        low, high = self._split(self.root, pair)
        self.root = self._merge(self._merge(low, [pair, self.seed >> 20, None, None]), high)

    def take(self, bound):
        """Remove and return the least pair >= bound, or None."""
        low, high = self._split(self.root, bound)
        least, path = high, None
        while least is not None and least[2] is not None:
            path, least = least, least[2]
        if least is None:
            self.root = self._merge(low, high)
            return None
        if path is None:
            high = least[3]
        else:
            path[2] = least[3]
        self.root = self._merge(low, high)
        return least[0]

    def _split(self, node, bound):
        if node is None:
            return None, None
        if node[0] < bound:
            node[3], rest = self._split(node[3], bound)
            return node, rest
        rest, node[2] = self._split(node[2], bound)
        return rest, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a if b is None else b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b


def best_fit_decreasing(items: list[tuple], capacity: int, most: int | None = None) -> dict | None:
    """{name: bin} for (size, name) items; new bins open as needed, or None if more than `most` would. Larger items than the capacity get a bin each."""
    tree, bins, out = Capacities(), 0, {}
    for size, name in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        got = tree.take((size, -1))
        if got is None:
            if bins == most:
                return None
            got = (max(capacity, size), bins)
            bins += 1
        tree.insert((got[0] - size, got[1]))
        out[name] = got[1]
    return out


def even_shards(items: list[tuple], shards: int) -> dict:
    """Best-fit-decreasing at the smallest capacity (by bisection) that takes `shards` bins at most."""
    if not items:
        return {}
    low = max(-(-sum(s for s, _ in items) // shards), max(s for s, _ in items))
    high = low
    while (best := best_fit_decreasing(items, high, shards)) is None:
        high = high + max(1, high // 64)
    for _ in range(12):
        if high - low <= max(1, high // 20_000):
            break
        mid = (low + high) // 2
        got = best_fit_decreasing(items, mid, shards)
        low, high, best = (low, mid, got) if got is not None else (mid + 1, high, best)
    return best


def assign(docs: DataFrame, shards: int = 40, grain: int = 256) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) with sizes of shards near equal."""
    whole = texts(docs)
    rows = stored(whole.select("doc_id", (F.octet_length("text") + 16).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.unhex(F.sha2("text", 256)).alias("grp"), F.monotonically_increasing_id().alias("read")), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    parcel = F.pmod(F.xxhash64("grp"), F.lit(shards * grain))
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"))
    large = F.col("bytes") >= F.lit(max(1, total // (shards * grain)))
    # each at least 1 / (shards * grain) of the total: no more than shards * grain rows
    big = [(r.bytes, bytes(r.grp)) for r in groups.where(large).collect()]
    small = [(r.bytes, r.parcel) for r in groups.where(~large).groupBy(parcel.alias("parcel")).agg(F.sum("bytes").alias("bytes")).collect()]
    found = even_shards(big + small, shards)
    spark = docs.sparkSession
    of_big = spark.createDataFrame([(bytearray(k), v) for k, v in found.items() if isinstance(k, bytes)], "grp binary, big_shard int")
    of_small = spark.createDataFrame([(k, v) for k, v in found.items() if not isinstance(k, bytes)], "parcel long, small_shard int")
    out = rows.withColumn("parcel", parcel).join(F.broadcast(of_big), "grp", "left").join(F.broadcast(of_small), "parcel", "left")
    out = out.select("doc_id", "size", "text_crc32", F.coalesce("big_shard", "small_shard").alias("shard"), F.xxhash64("doc_id", "text_crc32", "read").alias("spread"))
    return running(out, "shard", ["spread", "doc_id", "text_crc32"], name="slot").drop("spread")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
