"""Sets of shingles: their hashes and names, exact comparison of candidate pairs and of families, and the classes that links make. Shared by near_copies and set_sketch.

Families, groups of sets too large for pairs, are compared in tiles of two blocks of up to `block` sets each, where the sets themselves meet, and only
edges that span the confirmed links leave a tile. Families of more than four blocks first link to eight of their members, and then only tiles with sets
outside the largest component are compared: near copies of one text cost time in proportion to their number, while texts of one template that are no near copies are
compared with all their family. Sets and shingles are named by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import simhash
from quillstone.llm.common import keyed_texts, stored

LEADERS = 8
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_U29, _U32 = np.uint64(29), np.uint64(32)
_LANES = np.uint64(0x0101010101010101)



def mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U29)) * _M1 + y
    return (x ^ (x >> _U32)) * _M2


class Words(dict):
    """Places of words in a table of their hashes; starts anew before a text when it has 2**18."""

    def __init__(self):
        self.table = np.zeros(1 << 12, np.uint64)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros(at, np.uint64)])
        self.table[at] = xxhash.xxh64_intdigest(word, simhash.SEED)
        self[word] = at
        return at

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) >= 1 << 18:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.table[at]


def shingle_set(text: bytes, width: int, known: Words | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles, each from the hashes of its words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = (Words() if known is None else known).hashes(words)
    width = min(width, len(words))
    n = len(words) - width + 1
    out = h[:n]
    for k in range(1, width):
        out = mix(out, h[k : k + n])
    out = mix(out, np.uint64(width))
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def named(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, sizes and fingerprints of sets. A fingerprint's bits are those set in more than half the hashes; they are counted in eight byte lanes of a word at a time, which 255 hashes can't overflow."""
    n = np.array([len(x) for x in sets], np.int64)
    mixed, prints = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        flat, begin = np.concatenate([sets[i] for i in some]), np.cumsum(n[some]) - n[some]
        mixed[some] = mix(np.bitwise_xor.reduceat(flat, begin), np.add.reduceat(flat, begin))
        chunks = -(-n[some] // 255)
        first = np.cumsum(chunks) - chunks
        starts = np.repeat(begin - 255 * first, chunks) + 255 * np.arange(chunks.sum())
        ones = np.empty((len(some), 64), np.int64)
        for k in range(8):
            lanes = np.add.reduceat((flat >> np.uint64(k)) & _LANES, starts).view(np.uint8).reshape(-1, 8)
            ones[:, k::8] = np.add.reduceat(lanes, first, axis=0, dtype=np.int64)
        prints[some] = np.packbits(ones * 2 > n[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return mixed, n, prints


def fingerprint(hashes: np.ndarray) -> int:
    return int(named([hashes])[2][0])


def sets_of(batches, width: int, most: int = 1 << 19):
    """(batch of texts, their sets), a part of a batch at a time: as many texts as have about `most` hashes."""
    known = Words()
    for batch in batches:
        first, sets, held = 0, [], 0
        for i, x in enumerate(batch.column("text")):
            sets.append(shingle_set(x.as_buffer().to_pybytes(), width, known))
            held += len(sets[-1])
            if held >= most or i == batch.num_rows - 1:
                yield batch.slice(first, i + 1 - first), sets
                first, sets, held = i + 1, [], 0


def similar(both: np.ndarray, n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of n and m members with `both` in common are at least that similar."""
    return both + 1e-9 >= least * (n + m - both)


def looked_up(docs: DataFrame, ids: DataFrame, prints: DataFrame, width: int) -> DataFrame:
    """(id, n, hashes) of the sets `ids` (id). Texts are looked up in a table of 2**k bits, at most 2**24 bytes, in the tasks that read them, so no text is shuffled."""
    wanted = prints.join(ids, "id", "left_semi").select(F.xxhash64("doc_id", "raw").alias("key")).distinct()
    size = 1 << min(27, max(15, math.ceil(math.log2(16 * max(1, ids.count())))))
    at = F.pmod("key", F.lit(size))
    bits = np.zeros((size // 32768, 4096), np.uint8)
    for r in wanted.select((at + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toLocalIterator():
        bits[r.slice - 1] = np.frombuffer(r.bits, np.uint8)
    bits = bits.ravel()

    def run(batches):
        known, seen = Words(), set()
        for batch in batches:
            key = batch.column("at").to_numpy()
            hit = np.flatnonzero(bits[key >> 3] >> (key & 7).astype(np.uint8) & 1)
            texts = batch.column("text")
            for low in range(0, len(hit), 256):
                names, sizes, _ = named(sets := [shingle_set(texts[i].as_buffer().to_pybytes(), width, known) for i in hit[low : low + 256].tolist()])
                new = [i for i, x in enumerate(names.tolist()) if x not in seen and not seen.add(x)]
                if len(seen) >= 1 << 17:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)[new]), pa.array(sizes[new]), pa.array([sets[i].tobytes() for i in new], pa.binary())], ["id", "n", "hashes"])

    texts = keyed_texts(docs).select("text", F.pmod(F.xxhash64("doc_id", "raw"), F.lit(size)).alias("at"))
    return texts.mapInArrow(run, "id long, n long, hashes binary").join(ids, "id", "left_semi").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of at least that similarity."""

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ha"), batch.column("hb")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                ok.append(bool(similar(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), least)))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    left, right = (sets.select(F.col("id").alias(k), F.col("hashes").alias(f"h{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(check, "a long, b long")


def common_members(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, columns: int = 8192, step: int = 1 << 13) -> np.ndarray:
    """How many members each pair of sets has in common, by bits of those that more than one set holds, `columns` at a time."""
    used, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.cumsum(times > 1) - 1
    keep = times[column] > 1
    owner, column = owner[keep], shared[column[keep]]
    out = np.zeros(len(a), np.int64)
    for low in range(0, int((times > 1).sum()), columns):
        here = (column >= low) & (column < low + columns)
        bits = np.zeros((len(sets), columns), bool)
        bits[owner[here], column[here] - low] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        words = words[:, words.any(axis=0)]
        for i in range(0, len(a), step):
            out[i : i + step] += np.bitwise_count(words[a[i : i + step]] & words[b[i : i + step]]).sum(axis=1, dtype=np.int64)
    return out


def family_links(families: DataFrame, sets: DataFrame, radius: int, least: float, block: int, block_bytes: int = 4 << 20, few: int = 4) -> DataFrame:
    """(a, b): edges that span the confirmed links of each family, given as (family, id)."""
    sized = stored(families.join(sets.select("id", "n"), "id"), "families")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") * 8 / block_bytes)).cast("int")
    lead = [F.min_by("id", F.xxhash64("id", F.lit(k))).alias(f"l{k}") for k in range(LEADERS)]
    held = stored(sized.groupBy("family").agg(blocks.alias("blocks"), *lead), "family-sizes")
    large = held.where(F.col("blocks") > few)
    edges = None
    placed = sized.join(held.select("family", "blocks"), "family").select("family", "id", "blocks", F.lit(0).alias("inner"), F.lit(None).cast("long").alias("root"))
    if not large.isEmpty():
        some = sized.join(large.select("family", F.explode(F.array(*[f"l{k}" for k in range(LEADERS)])).alias("lead")), "family")
        edges = stored(confirmed(some.where("id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct(), sets, least), "leader-links")
        stars = simhash.components(edges)
        rooted = stored(placed.drop("root", "inner").join(stars, F.col("id") == F.col("node"), "left").select("family", "id", "blocks", F.coalesce("root", "id").alias("root")), "rooted")
        counts = rooted.groupBy("family", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("family").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.max("k").alias("k"), F.sum("k").alias("all"))
        # the largest component has blocks of its own, the others come after them
        # a table of its own, so that Spark can cut a hot family's side of the join
        counts = stored(counts.select("family", "main", (F.col("k") / F.col("all")).alias("share")), "family-mains")
        placed = rooted.join(counts, "family")
        inner = F.when(F.col("blocks") > few, F.ceil(F.col("blocks") * F.col("share"))).otherwise(0).cast("int")
        outer = F.when(F.col("blocks") > few, F.ceil(F.col("blocks") * (1 - F.col("share")))).otherwise(F.col("blocks")).cast("int")
        placed = placed.withColumn("inner", inner).withColumn("blocks", F.col("inner") + outer).withColumn("is_main", (F.col("root") == F.col("main")) & (F.col("inner") > 0))
    else:
        placed = placed.withColumn("is_main", F.lit(False))
    spread = F.xxhash64("id")
    number = F.when(F.col("is_main"), F.pmod(spread, F.greatest("inner", F.lit(1)))).otherwise(F.col("inner") + F.pmod(spread, F.greatest(F.col("blocks") - F.col("inner"), F.lit(1)))).cast("int")
    placed = placed.withColumn("block", number)
    # every tile has a block of sets outside the largest component
    low = F.when(F.col("is_main"), F.col("inner")).otherwise(0)
    others = F.when(low < F.col("blocks"), F.sequence(low, F.col("blocks") - 1)).otherwise(F.array().cast("array<int>"))
    tiles = placed.select("family", "id", "root", "block", F.explode(others).alias("other")).select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "root", "block")
    rows = tiles.join(sets, "id").withColumn("tile", F.xxhash64("family", "i", "j"))

    def run(group: pa.Table) -> pa.Table:
        ids, side = group.column("id").to_numpy(), group.column("block").to_numpy()
        roots = np.array([r if r is not None else i for r, i in zip(group.column("root").to_pylist(), ids.tolist())], np.int64)
        have = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("hashes").combine_chunks()]
        n = np.array([len(h) for h in have], np.int64)
        fp = named(have)[2]
        a, b = simhash.Forest(fp, np.zeros(len(ids), np.int64)).links(radius)
        keep = (ids[a] != ids[b]) & (roots[a] != roots[b]) & (np.minimum(n[a], n[b]) + 1e-9 >= least * np.maximum(n[a], n[b]))
        if len(np.unique(side)) > 1:
            keep &= side[a] != side[b]  # pairs of one block meet in its own tile
        a, b = a[keep], b[keep]
        good = similar(common_members(have, a, b), n[a], n[b], least) if len(a) else np.zeros(0, bool)
        label = simhash._components(len(ids), a[good], b[good])
        own = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": ids[own], "b": ids[label[own]]})

    # a tile has two blocks at most, of a bounded number of sets and bytes
    found = rows.groupBy("tile").applyInArrow(run, "a long, b long")
    return found if edges is None else found.union(edges)


def heads(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, k): each set with the first text (none, doc_id, raw) of its component; edges (a, b) between ids."""
    stars = simhash.components(edges)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("k")
    own = prints.groupBy("id").agg(first)
    linked = own.join(stars, F.col("id") == F.col("node"), "left").select("id", "k", F.coalesce("root", "id").alias("class"))
    # tables of their own, so that Spark can cut a hot class's side of the joins
    best = stored(linked.groupBy("class").agg(F.min("k").alias("best"), F.count(F.lit(1)).alias("sets")).where("sets > 1").select("class", "best"), "class-names")
    return stored(linked.join(best, "class", "left").select("id", F.coalesce("best", "k").alias("k")), "classes")
