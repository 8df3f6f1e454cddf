"""Near copies by shingle similarity: SetSketch registers, banded, compared by likelihood, verified on full sets.

A text's set holds its distinct `width`-word shingles (A-Z lowered, words `[^\\x20\\x09-\\x0D]+`; of fewer words, the whole sequence). Texts link if the Jaccard similarity of their sets is at least
`least`. A set's sketch has `bands * rows` registers: register i is floor(1 - log_base(least h_i)) within 0 to 2**16 - 1, where h_i gives each member an exponential value of rate `RATE`. So
registers are exponentially spaced, truncated minima; sketches of a union are the greater registers (`merged`), and equal registers are as likely as the sets are similar.
Each band of `rows` registers is a key. With 40 bands of 4, a pair of similarity 0.8 shares no key with a chance of 8e-10, whatever its sizes.

Keys are counted first, so those of one set go no further. In shards of up to `most` sets a 64-bit word of the registers' lowest bits sorts out pairs that differ in more than `bits` of them
(by chance 1e-8 at similarity 0.8; unrelated sets differ in 32). The others' whole sketches meet once a pair: the likelihood of the similarity, given both sets' sizes and how many registers of one are greater, equal and
less, must allow `least`: at most `slack` below its maximum, which by chance is more once in 10**9. Every pair left is compared exactly on full sets. Larger shards are families, the sets that share their shard's first
member; shingles.family_links compares them exactly in tiles, so that only edges which span a family's links leave a task. Nothing is capped.

Nulls count as empty. A text without words has an empty set and links with nothing. A null doc_id never names a class that has another, and a class of null ids alone has a null name. Rows that repeat get equal rows in `groups`, and `deduplicate`
keeps one; texts that share a doc_id are told apart. Very long texts are held one at a time, and each contributes one sketch. An empty table gives an empty result. Extra
input columns, whatever their names, are ignored by `groups` and kept by `deduplicate`. Sets and shingles are named by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import simhash
from quillstone.llm.common import keyed_texts, stored, table, without
from quillstone.llm.shingles import confirmed, family_links, heads, looked_up, mix, named, sets_of

BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
_STEP, _M = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_U32 = np.uint64(32)


def registers(sets: list[np.ndarray], count: int, step: int = 1 << 15) -> np.ndarray:
    """[set, register] of sets of hashes, none empty."""
    if not sets:
        return np.zeros((0, count), np.uint16)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    least = np.full((count, len(sets)), np.iinfo(np.uint64).max, np.uint64)
    salts = [np.uint64((i + 1) * _STEP % (1 << 64)) for i in range(count)]
    for low in range(0, len(flat), step):  # as much as a core's cache holds, for all registers
        part = flat[low : low + step]
        first, last = np.searchsorted(starts, [low, low + len(part)])
        cut = starts[first:last] - low
        of = np.arange(first, last)
        if not len(cut) or cut[0]:
            cut, of = np.r_[0, cut], np.r_[first - 1, of]
        for i, salt in enumerate(salts):
            x = (part ^ salt) * _M
            x ^= x >> _U32
            x *= _M
            least[i, of] = np.minimum(least[i, of], np.minimum.reduceat(x, cut))
    h = -np.log1p(-(least.astype(float) * 2.0**-64).clip(2.0**-64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP).astype(np.uint16).T.copy()


def merged(sketches: np.ndarray) -> np.ndarray:
    """The sketch of the union of the sketches' sets."""
    return sketches.max(axis=0)


def log_likelihood(j: np.ndarray, n: np.ndarray, m: np.ndarray, above: np.ndarray, below: np.ndarray, count: int) -> np.ndarray:
    """Of similarities j, for sets of n and m members of which `above` registers are greater in the first, `below` in the second, the other of `count` equal."""
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)
    u, v = n / (n + m), m / (n + m)
    up, down = p(u - v * j), p(v - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        term = lambda k, x: np.where(k > 0, k * np.log(np.maximum(x, 1e-300)), 0.0)
        return term(above, up) + term(below, down) + term(count - above - below, 1 - up - down)


def plausible(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, least: float, slack: float, grid: int = 48) -> np.ndarray:
    """Whether sketches x and y [pair, register] of sets of n and m members allow a similarity of `least`."""
    above, below = (x > y).sum(axis=1)[:, None], (x < y).sum(axis=1)[:, None]
    n, m = n.astype(float)[:, None], m.astype(float)[:, None]
    most = np.minimum(n, m) / np.maximum(n, m)
    j = np.linspace(0, 1, grid)[None, :]
    low, high = j * np.minimum(least, most), least + j * np.maximum(most - least, 0)
    under, over = (log_likelihood(k, n, m, above, below, x.shape[1]).max(axis=1) for k in (low, high))
    return (most[:, 0] + 1e-9 >= least) & (over + slack >= under)


def sketches(docs: DataFrame, width: int, count: int) -> DataFrame:
    """(doc_id, raw, id, n, fp, sketch): the name, size and SimHash fingerprint of each text's set; the sketch where this task had not met the set lately."""

    def run(batches):
        seen: set[int] = set()
        for batch, sets in sets_of(batches, width):
            names, sizes, fps = named(sets)
            new = [i for i, (name, n) in enumerate(zip(names.tolist(), sizes.tolist())) if n and name not in seen and not seen.add(name)]
            if len(seen) > 1 << 17:
                seen.clear()
            out = [None] * len(sets)
            for i, row in zip(new, registers([sets[i] for i in new], count)):
                out[i] = row.astype("<u2").tobytes()
            columns = [batch.column("doc_id"), batch.column("raw"), pa.array(names.view(np.int64)), pa.array(sizes), pa.array(fps.view(np.int64)), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "raw", "id", "n", "fp", "sketch"])

    return keyed_texts(docs).mapInArrow(run, "doc_id long, raw long, id long, n long, fp long, sketch binary")


def banded(known: DataFrame, bands: int, rows: int, mark: str = "low") -> DataFrame:
    """(key, id, n, mark): a row for each band of (id, n, fp, sketch); mark: the fingerprint ("fp") or the first 64 registers' lowest bits ("low")."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.stack([np.frombuffer(x.as_buffer(), "<u2") for x in batch.column("sketch")]).astype(np.uint64)
            low = batch.column("fp").to_numpy()
            if mark == "low":
                low = np.zeros(len(found), np.uint64)
                for i in range(min(64, bands * rows)):
                    low |= (found[:, i] & np.uint64(1)) << np.uint64(i)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(low), bands)).copy()
            for k in range(rows):
                key = mix(key, found[:, k::rows][:, :bands])
            each = lambda c: np.repeat(c, bands)
            columns = key.ravel().view(np.int64), each(batch.column("id").to_numpy()), each(batch.column("n").to_numpy()), each(low.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "n", "mark"])

    return known.select("id", "n", "fp", "sketch").mapInArrow(run, "key long, id long, n long, mark long")


def by_bits(bits: int):
    """Finds the pairs of whole shards whose marks differ in `bits` at most."""

    def near(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        left, right, lag = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
        while lag < len(t["id"]):
            a = np.flatnonzero(t["shard"][lag:] == t["shard"][:-lag])
            if not len(a):
                break
            # of signed numbers the bits of the absolute value would be counted
            a = a[np.bitwise_count((t["mark"][a] ^ t["mark"][a + lag]).view(np.uint64)) <= bits]
            left.append(a), right.append(a + lag)
            lag += 1
        return np.concatenate(left), np.concatenate(right)

    return near


def candidates(shards: DataFrame, least: float, near) -> DataFrame:
    """(a, b), a < b: pairs of one shard (key, id, n, mark) that `near` finds and whose sizes allow the similarity."""

    def run(batches):
        for t in simhash.whole_shards(batches, ["key"], ["id", "n", "mark"], 500_000):
            a, b = near(t)
            n, m = t["n"][a], t["n"][b]
            keep = np.minimum(n, m) + 1e-9 >= least * np.maximum(n, m)
            both = np.unique(np.sort(np.stack([t["id"][a][keep], t["id"][b][keep]], 1), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    return shards.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def likely(pairs: DataFrame, known: DataFrame, least: float, slack: float) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.stack([np.frombuffer(r.as_buffer(), "<u2") for r in batch.column(c)]) for c in ("sa", "sb"))
                keep = pa.array(plausible(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), x, y, least, slack))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    left, right = (known.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, width: int, least: float, bands: int, rows: int, near, mark: str, slack: float, most: int, block: int, radius: int, also=None) -> tuple[DataFrame, DataFrame]:
    """The texts' sets (doc_id, raw, id, n), and edges (a, b) between ids whose components are those of all links. `near` finds candidates in a shard by `mark`; `radius`: that of the trees of a family's tile, 64 for every pair. `also` finds further pairs (a, b) among the distinct sets (id, n, fp, sketch)."""
    both = stored(sketches(docs, width, bands * rows), "sketches")
    prints = both.drop("fp", "sketch")
    known = stored(both.where("sketch is not null").select("id", "n", "fp", "sketch").dropDuplicates(["id"]), "distinct-sketches")
    keys = banded(known, bands, rows, mark)
    held = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("family")).where("k > 1"), "keys")
    # a table of its own: a hot key's rows are cut by Spark in this join and go on as rows of a family
    shared = stored(keys.join(held, "key"), "shards")
    families = stored(shared.where(F.col("k") > most).select("family", "id").distinct(), "family-members")
    found = candidates(shared.where(F.col("k") <= most).select("key", "id", "n", "mark"), least, near)
    pairs = likely(stored(found, "candidates"), known, least, slack)
    if also is not None:
        pairs = pairs.select("a", "b").union(also(known)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    pairs = stored(pairs, "likely")
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(families.select("id")).distinct(), "named")
    sets = stored(looked_up(docs, ids, prints, width), "sets")
    edges = confirmed(pairs, sets, least)
    if not families.isEmpty():
        edges = edges.union(family_links(families, sets, radius, least, block))
    return prints, edges


def classes(docs: DataFrame, width: int = 4, least: float = 0.8, bands: int = 40, rows: int = 4, bits: int = 24, slack: float = 18.0, most: int = 64, block: int = 512) -> DataFrame:
    """(doc_id, raw, n, keep_id, keep_raw): of each text, told apart by doc_id and its hash, the first text of its class."""
    prints, edges = links(docs, width, least, bands, rows, by_bits(bits), "low", slack, most, block, 64)
    alone = prints.where("n = 0").select("doc_id", "raw", "n", F.col("doc_id").alias("keep_id"), F.col("raw").alias("keep_raw"))
    some = prints.where("n > 0")
    return some.join(heads(some, edges), "id").select("doc_id", "raw", "n", F.col("k.doc_id").alias("keep_id"), F.col("k.raw").alias("keep_raw")).union(alone)


def groups(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): component_id is the least doc_id that links reach."""
    return classes(docs, **how).select("doc_id", F.col("n").alias("n_shingles"), F.col("keep_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """`docs`, all columns, with one row of each class: one with its least doc_id (of several texts there, that of the least hash)."""
    gone = classes(docs, **how).where(~(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("raw") == F.col("keep_raw")))).select("doc_id", "raw")
    return without(docs, gone)


def op11_set_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs
), sizes AS (
  SELECT doc_id, count(s) AS n FROM docs LEFT JOIN sets USING (doc_id) GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM docs
  UNION
  SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM least JOIN sizes USING (doc_id)
"""
