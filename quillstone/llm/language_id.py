"""Language identification by error-correcting output codes.

Each language has a codeword of bits, and for each bit a binary classifier over hashed n-grams of bytes (naive Bayes log-odds
between the languages whose bit is 1 and those whose bit is 0) says how strongly the text's bit is 1. A text gets the language
whose codeword has the least loss: log(1 + exp(-margin)) of each bit, weighted by how often the bit's classifier is right on
training documents of that language. The score is the languages' softmax of minus the loss; `ambiguous` marks texts whose two best languages
are close.

Up to four languages (seven bits) the code is exhaustive; more get seeded random codewords, of those tried the ones farthest apart.
Every language that occurs is learned, however many there are. Classifiers are fitted on about `per_lang` documents of each at most, chosen by a hash of
doc_id: tasks count n-grams in a table of fixed size for each language they meet, tables of a language are added up on executors, and the driver adds one
at a time to the bits' sums. What the driver and each task hold is the model: bits x 32,768 weights and languages x bits. Every whole text is then classified in the tasks that read it.

A null text or one without a letter (of any script; numerals are none) is `und` with score 0. Null langs are not learned from. With no language known, all are `und`; with
one, it is everyone's with a letter. Equal losses go to the language first in the alphabet. A null doc_id is never held out. Rows that repeat get equal rows. Very long texts are held one at a
time and counted whole. An empty table gives an empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import stored, table

BUCKETS = 1 << 15
_FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of bits, 0 or 1."""
    if n <= 4:
        columns = [c for c in range(1, 1 << n >> 1)] if n > 1 else [1]
        return np.array([[c >> i & 1 for c in columns] for i in range(n)], np.int64)
    rng, bits, best, far = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(max(1, min(200, 200_000_000 // (n * n)))):
        m = rng.integers(0, 2, (n, bits))
        m = m[:, (m.sum(axis=0) > 0) & (m.sum(axis=0) < n)]
        d = min(_least_distance(m[i : i + 500], m, i) for i in range(0, n, 500))
        if d > far:
            best, far = m, d
    return best


def _least_distance(some: np.ndarray, words: np.ndarray, first: int) -> float:
    x, y = some.astype(np.float32), words.astype(np.float32)
    d = x @ (1 - y).T + (1 - x) @ y.T
    d[np.arange(len(x)), first + np.arange(len(x))] = np.inf
    return float(d.min())


def grams(text: str) -> np.ndarray:
    """Hashed 1-, 2- and 3-grams of the lower-case text's bytes with all but letters as spaces."""
    b = np.frombuffer(b" " + text.lower().encode().translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:]
    out = np.concatenate([b[1:-1], two * np.uint32(2654435761) >> np.uint32(8), three * np.uint32(2246822519) >> np.uint32(7)])
    return (out & np.uint32(BUCKETS - 1)).astype(np.int64)


class Codes:
    """langs, codewords, classifier weights [bucket, bit] and decoding weights [lang, bit]."""

    def __init__(self, langs: list[str], counts):
        """counts: each language's table of n-gram counts, in order; only one is held at a time."""
        self.langs, self.code = langs, codewords(len(langs))
        ones, whole = np.zeros((self.code.shape[1], BUCKETS)), np.zeros(BUCKETS)
        for word, n in zip(self.code, counts):
            share = (n + 0.5) / (n.sum() + 0.5 * BUCKETS)  # each language weighs the same
            whole += share
            for bit in np.flatnonzero(word):
                ones[bit] += share
        n1 = self.code.sum(axis=0)[:, None]
        zeros = (whole - ones) / np.maximum(len(langs) - n1, 1)
        self.weight = (np.log(np.maximum(ones / np.maximum(n1, 1), 1e-12)) - np.log(np.maximum(zeros, 1e-12))).T.astype(np.float32).copy()
        if len(langs) == 1:
            self.weight = np.zeros((BUCKETS, self.code.shape[1]), np.float32)
        self.trust = np.ones(self.code.shape) / self.code.shape[1]

    def margins(self, text: str) -> np.ndarray:
        g = grams(text)
        if len(g) > 2 * BUCKETS:
            total = np.bincount(g, minlength=BUCKETS) @ self.weight.astype(np.float64)
        else:
            total = np.zeros(self.weight.shape[1])
            for i in range(0, len(g), 1 << 13):
                total += self.weight[g[i : i + (1 << 13)]].sum(axis=0, dtype=np.float64)
        return total / len(g) * min(len(g), 300) / 10  # the mean odds, firmer up to some hundred n-grams

    def right(self, text: str, lang: int) -> np.ndarray:
        return (self.margins(text) > 0) == (self.code[lang] > 0)

    def decode(self, text: str) -> tuple[int, float, float]:
        """(language, its score, the second's score)."""
        signed = np.where(self.code > 0, 1, -1) * self.margins(text)
        loss = (self.trust * np.logaddexp(0, -signed)).sum(axis=1) * 4
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        return int(order[0]), float(p[order[0]]), float(p[order[1]]) if len(p) > 1 else 0.0


def _remainder(mod: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)), F.lit(0))


def train(docs: DataFrame, mod: int = 4, held_out: int = 2, per_lang: int = 3000) -> Codes | None:
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("lang").isNotNull() & (_remainder(mod) != held_out))
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}  # a row a language, as the model has
    langs = sorted(sizes)
    if not langs:
        return None
    place = {s: i for i, s in enumerate(langs)}
    # the languages, no more than the model has rows
    rates = docs.sparkSession.createDataFrame([(s, i, min(1.0, per_lang / sizes[s])) for s, i in place.items()], "lang string, place int, rate double")
    # with the place of reading, rows that repeat are drawn one by one: many of them are neither all taken nor all left
    spread = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), 33) / F.lit(float(1 << 31))
    some = usable.join(F.broadcast(rates), "lang").where("text is not null").where(spread < F.col("rate")).select("place", "text")
    some = stored(some.repartition(max(8, min(200, sum(min(per_lang, n) for n in sizes.values()) // 2000))), "language-sample")

    def count(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for text, at in zip(batch.column("text").to_pylist(), batch.column("place").to_pylist()):
                if at not in held and len(held) >= 256:  # 64 MB
                    yield tables(held)
                    held = {}
                held[at] = held.get(at, 0) + np.bincount(grams(text), minlength=BUCKETS)
        yield tables(held)

    def tables(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.astype("<u8").tobytes() for v in held.values()], pa.binary())], ["place", "counts"])

    def add(batches):
        now, total = None, None
        for batch in batches:
            for at, raw in zip(batch.column("place").to_pylist(), batch.column("counts").to_pylist()):
                if at != now and now is not None:
                    yield tables({now: total})
                total = np.frombuffer(raw, "<u8") + (total if at == now else 0)
                now = at
        if now is not None:
            yield tables({now: total})

    whole = some.mapInArrow(count, "place int, counts binary").repartition("place").sortWithinPartitions("place").mapInArrow(add, "place int, counts binary")
    codes = Codes(langs, _in_order(stored(whole, "language-counts"), len(langs)))

    def check(batches):
        right, seen = np.zeros(codes.code.shape, np.int64), np.zeros(len(langs), np.int64)
        for batch in batches:
            for text, at in zip(batch.column("text").to_pylist(), batch.column("place").to_pylist()):
                right[at] += codes.right(text, at)
                seen[at] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at]), pa.array(list(right[at]), pa.list_(pa.int64()))], ["place", "seen", "right"])

    checked = some.mapInArrow(check, "place int, seen long, right array<long>").groupBy("place").agg(F.sum("seen").alias("seen"), *[F.sum(F.get("right", F.lit(b))).alias(f"b{b}") for b in range(codes.code.shape[1])])
    trust = np.full(codes.code.shape, 0.5)
    for r in checked.toLocalIterator():
        trust[r.place] = (np.array(r[2:], float) + 1) / (r.seen + 2)
    codes.trust = trust / trust.sum(axis=1, keepdims=True)
    return codes


def _in_order(counts: DataFrame, n: int):
    """Each language's table, zeros for those of which no text was drawn; one partition at a time is at the driver."""
    at = 0
    for r in counts.repartitionByRange(max(1, n // 64), "place").sortWithinPartitions("place").toLocalIterator():
        for _ in range(at, r.place):
            yield np.zeros(BUCKETS)
        yield np.frombuffer(r.counts, "<u8").astype(float)
        at = r.place + 1
    for _ in range(at, n):
        yield np.zeros(BUCKETS)


def identify(docs: DataFrame, codes: Codes | None, close: float = 0.5) -> DataFrame:
    """(doc_id, text, lang_pred, score, ambiguous): ambiguous if the second language scores over `close` times the first."""

    def run(batches):
        for batch in batches:
            langs, scores, close_by = [], [], []
            for text in batch.column("text").to_pylist():
                if codes is None or not has_letter(text):
                    langs.append("und"), scores.append(0.0), close_by.append(True)
                    continue
                best, p, second = codes.decode(text)
                langs.append(codes.langs[best]), scores.append(p), close_by.append(second > close * p)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(close_by, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs))
    return out.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
