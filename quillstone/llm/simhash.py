"""SimHash near-duplicates found with BK-trees.

Fingerprint: whole text with A-Z lowered, words `[^\\x20\\x09-\\x0D]+`, shingles of `width` words with
repeats, space-joined; a bit of the 64 is 1 if set in more than half the shingles' XXH64 values (seed 42).
Fewer words than `width`: one shingle of them all; no word: fingerprint zero.

Distinct fingerprints link at `radius` or fewer differing bits. Of p pieces of the bits two such agree on p - radius
at least, so there is a table for each choice of so many pieces, and a shard is the fingerprints that have the
same bits there; p grows with the number of fingerprints (4 up to four million at a radius of 3), so that shards stay small. Shards of more than `tree_rows`
are cut into blocks and every pair of blocks is searched, so no task holds more than two blocks. A
task builds BK-trees for its shards (children keyed by the Hamming distance to their parent) and
each fingerprint follows only the edges within the radius of its distance. Trees are built where a shuffle brings a shard together, not
broadcast: a broadcast of all shards' trees would grow with the input. Found links leave
a task as spanning edges, never as all pairs. Components come from alternating large-star and
small-star rounds over tables in the shared folder.

Null texts count as empty, and all texts without a word are linked. A null doc_id gets the component of its
fingerprint and never names one that has another. Rows that repeat get equal rows in `groups`, and one of them is kept by `deduplicate`, which tells rows apart by
doc_id and text. Very long texts are hashed one at a time. An empty table gives an empty result.
Extra input columns are ignored by `groups` and kept by `deduplicate`.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import discard, keyed_texts, stored, stored_at, table, without

SEED = 42


def fingerprint(text: bytes, width: int = 3) -> int:
    import xxhash

    words = text.lower().split()  # on bytes: A-Z only, and exactly the six ASCII white spaces
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, end = (end - size)[: 1 - width or None].tolist(), end[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[i:j], SEED) for i, j in zip(start, end)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, raw, fp): fp has the 64 bits as a long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x.as_buffer().to_pybytes(), width) for x in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("raw"), pa.array(fps.view(np.int64), pa.int64())], ["doc_id", "raw", "fp"])

    return keyed_texts(docs).mapInArrow(run, "doc_id long, raw long, fp long")


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each index's component under the links a-b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Forest:
    """BK-trees over the fingerprints of many shards, built and searched level by level. root: each element's tree, named by its first element."""

    def __init__(self, fps: np.ndarray, root: np.ndarray):
        self.fps, self.root = fps, root
        left = np.flatnonzero(root != np.arange(len(fps)))
        at, codes, child = root[left], [], []
        while len(left):
            code = at * 65 + np.bitwise_count(fps[left] ^ fps[at])
            order = np.argsort(code, kind="stable")
            left, code = left[order], code[order]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            codes.append(code[first]), child.append(left[first])
            at = np.repeat(left[first], np.diff(np.r_[first, len(code)]))
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], at[rest]
        codes = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        order = np.argsort(codes)
        self.codes, self.child = codes[order], np.concatenate(child)[order] if child else codes

    def links(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (q, node), q < node, of one tree at distances up to `radius`."""
        q, node, found = np.arange(len(self.fps)), self.root, []
        while len(q):
            d = np.bitwise_count(self.fps[q] ^ self.fps[node]).astype(np.int64)
            hit = (d <= radius) & (q < node)
            found.append((q[hit], node[hit]))
            low = np.searchsorted(self.codes, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.codes, node * 65 + np.minimum(d + radius, 64), "right") - low
            q = np.repeat(q, n)
            node = self.child[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(q))]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (q, node)


def _spanning(fps: np.ndarray, shard: np.ndarray, block: np.ndarray, cross: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span what links within each shard; in cross shards only those between the two blocks, whose own shards span the rest."""
    root = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    root = np.repeat(root, np.diff(np.r_[root, len(shard)]))
    a, b = Forest(fps, root).links(radius)
    inside = block[a] == block[b]
    label = _components(len(fps), a[inside], b[inside])
    own = np.flatnonzero((label != np.arange(len(fps))) & ~cross)
    pairs = np.unique(np.stack([label[a[~inside]], label[b[~inside]]], 1), axis=0)
    return np.r_[own, pairs[:, 0]], np.r_[label[own], pairs[:, 1]]


def whole_shards(batches, shard: list[str], columns: list[str], most_pairs: int = 2_000_000):
    """Tables {column: array} of whole shards, numbered in "shard", from batches sorted by shard: as many at a time as have about most_pairs pairs."""
    kept = None

    def cut(t, number):
        start = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        work = np.cumsum(np.diff(np.r_[start, len(number)]) ** 2) // most_pairs
        ends = np.r_[start[np.flatnonzero(np.r_[True, work[1:] != work[:-1]])], len(number)]
        for i, j in zip(ends[:-1], ends[1:]):
            yield {k: v[i:j] for k, v in t.items()} | {"shard": number[i:j]}

    for batch in batches:
        t = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in (*shard, *columns)}
        if kept is not None:
            t = {k: np.concatenate([kept[k], t[k]]) for k in t}
        if not len(t[shard[0]]):
            continue
        new = np.r_[True, np.any([t[k][1:] != t[k][:-1] for k in shard], axis=0)]
        last = np.flatnonzero(new)[-1]  # this shard may go on in the next batch
        number = np.cumsum(new)
        if last:
            yield from cut({k: v[:last] for k, v in t.items()}, number[:last])
        kept = {k: v[last:] for k, v in t.items()}
    if kept is not None:
        yield from cut(kept, np.zeros(len(kept[shard[0]]), np.int64))


def tables(n: int, radius: int, tree_rows: int) -> list[int]:
    """Masks of the bits that name a shard in each table: the fewest pieces of which some stay equal, with keys wide enough that n random fingerprints share them a few at a time."""
    for pieces in range(radius + 1, 65):
        cut = [64 * i // pieces for i in range(pieces + 1)]
        masks = [sum(((1 << (cut[i + 1] - cut[i])) - 1) << cut[i] for i in some) for some in combinations(range(pieces), pieces - radius)]
        if n <= tree_rows // 8 << min(m.bit_count() for m in masks) or pieces >= radius + 5:
            return masks


def links(fps: DataFrame, radius: int = 3, tree_rows: int = 512) -> DataFrame:
    """(a, b): edges over the column `fp` of distinct fingerprints, whose components are those of all links."""
    masks = [m - (1 << 64) if m >> 63 else m for m in tables(fps.count(), radius, tree_rows)]
    banded = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("band", "key"))
    sizes = stored(banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "key", F.ceil(F.col("n") / tree_rows).cast("int").alias("blocks")), "shards")
    placed = banded.join(sizes, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = placed.select("band", "key", "fp", "block", other).select("band", "key", "fp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    shard = ["band", "key", "i", "j"]

    def run(batches):
        for t in whole_shards(batches, shard, ["fp", "block"]):
            a, b = _spanning(t["fp"].view(np.uint64), t["shard"], t["block"], t["i"] != t["j"], radius)
            yield pa.RecordBatch.from_arrays([pa.array(t["fp"][a]), pa.array(t["fp"][b])], ["a", "b"])

    return pairs.repartition(*shard).sortWithinPartitions(*shard, "fp").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of (a, b) that is not its component's root, the least of it."""
    spark = edges.sparkSession
    now, path = stored_at(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        last_path = path
        now, path = stored_at(small.distinct(), "edges")
        discard(spark, last_path)
        last, state = state, tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == last or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(docs: DataFrame, width: int = 3, radius: int = 3, tree_rows: int = 512) -> DataFrame:
    """(doc_id, raw, fp, keep_id, keep_raw): of each text, told apart by doc_id and its hash, the first text of its component."""
    prints = stored(fingerprints(docs, width), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("k")
    fps = stored(prints.groupBy("fp").agg(first), "distinct")
    stars = components(links(fps.select("fp"), radius, tree_rows))
    linked = fps.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "k", F.coalesce("root", "fp").alias("class"))
    named = stored(linked.groupBy("class").agg(F.min("k").alias("best")), "component-names")
    # a table of its own, so that Spark can cut a hot fingerprint's side of the join
    whole = stored(linked.join(named, "class").select(F.col("fp").alias("wfp"), F.col("best").alias("k")), "named")
    return prints.join(whole, F.col("fp") == F.col("wfp")).select("doc_id", "raw", "fp", F.col("k.doc_id").alias("keep_id"), F.col("k.raw").alias("keep_raw"))


def groups(docs: DataFrame, width: int = 3, radius: int = 3, tree_rows: int = 512) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that links reach."""
    return classes(docs, width, radius, tree_rows).select("doc_id", "fp", F.col("keep_id").alias("component_id"))


def deduplicate(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """`docs`, all columns, with one row of each component: one with its least doc_id (of several texts there, that of the least hash)."""
    of = classes(docs, width, radius)
    gone = of.where(~(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("raw") == F.col("keep_raw")))).select("doc_id", "raw")
    return without(docs, gone)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
