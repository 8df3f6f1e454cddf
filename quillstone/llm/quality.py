"""Quality classifier: histogram gradient-boosted trees over document statistics.

Labels are learned from at most `most_rows` labelled documents, those whose doc_id has the least hashes (of documents that share such a doc_id, those of the least hashes with their statistics). Their statistics are computed
by Spark tasks; the trees (logistic loss, `bins` quantile bins a statistic, complete trees of `depth` levels) are grown from
gradient histograms on that bounded table. The trees are flattened into arrays of statistic, cut and leaf value, and all rows of a batch walk
all trees at once in numpy. Every whole text is scored in the tasks that read it, without a shuffle.

Nulls count as empty texts; empty texts are scored too. Null labels are no labels; repeated labels count as often as they occur. A null
doc_id is never held out. Rows that repeat get equal scores. Very long texts are read whole, one at a time. Without labels every score is 0.5, with one class alone its share. An empty table gives an empty result.
Other columns, whatever their names, never enter a score; `keep_good` keeps them.
"""

from __future__ import annotations

import operator
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import table, texts

_CLASS = np.full(256, 5)  # of bytes: 0 lower case, 1 upper case, 2 digits, 3 white space, 4 common marks, 5 symbols, 6 beyond ASCII
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\v\f", b".,;:'\"-()?")):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 6
STATISTICS = ("log_chars", "lower", "upper", "digit", "space", "mark", "symbol", "wide", "bang", "pipe", "entropy", "log_words", "word_length", "distinct_words", "top_word", "repeats", "distinct_pairs", "log_lines", "distinct_lines", "line_length", "symbol_words", "capital_words")


def statistics(text: str) -> list[float]:
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return [0.0] * len(STATISTICS)
    n = len(data)
    hist = np.bincount(data, minlength=256)
    share = hist[hist > 0] / n
    words, lines = text.split(), text.split("\n")
    w = max(1, len(words))
    counts = Counter(words)
    return [
        np.log1p(n),
        *(np.bincount(_CLASS, hist, 7) / n),
        hist[33] / n,
        hist[124] / n,
        float(-(share * np.log2(share)).sum()),
        np.log1p(len(words)),
        n / w,
        len(counts) / w,
        max(counts.values(), default=0) / w,
        sum(map(operator.eq, words, words[1:])) / w,
        len(set(zip(words, words[1:]))) / w,
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        sum(1 for x in counts if not x[-1].isalnum() and not x[-2:-1].isalnum()) / w,
        sum(map(str.isupper, words)) / w,
    ]


class Trees:
    """Boosted complete trees in heap order: feature and cut [tree, inner node], value [tree, leaf]."""

    def __init__(self, prior: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.prior, self.feature, self.cut, self.value = prior, feature, cut, value

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree, row = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        inner = self.feature.shape[1]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.cut[tree, node])
        margin = self.prior + self.value[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-margin))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, bins: int = 64, rate: float = 0.2, ridge: float = 1.0, least: int = 10) -> Trees:
        inner, n_features = 2**depth - 1, x.shape[1]
        share = (y.sum() + 0.5 * (len(y) == 0)) / max(1, len(y))
        prior = float(np.log(min(max(share, 1e-6), 1 - 1e-6) / (1 - min(max(share, 1e-6), 1 - 1e-6)))) if len(y) else 0.0
        if len(np.unique(y)) < 2:
            return cls(prior, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_features)]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # x <= cuts[b] just for bins up to b
        margin, parts = np.full(len(y), prior), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(depth):
                base, width = 2**level - 1, 2**level
                at = node - base
                best = np.full(width, 1e-9)
                where = np.zeros(width, np.int64)
                for f in range(n_features):
                    if not len(cuts[f]):
                        continue
                    size = len(cuts[f]) + 1
                    key = at * size + binned[:, f]
                    sums = [np.bincount(key, v, width * size).reshape(width, size).cumsum(axis=1) for v in (g, h, None)]
                    (gl, hl, nl), (ga, ha, na) = [s[:, :-1] for s in sums], [s[:, -1:] for s in sums]
                    gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                    gain[(nl < least) | (na - nl < least)] = 0
                    b = gain.argmax(axis=1)
                    better = gain[np.arange(width), b] > best
                    best = np.where(better, gain[np.arange(width), b], best)
                    where = np.where(better, b, where)
                    feature[base : base + width][better] = f
                    cut[base : base + width][better] = cuts[f][b[better]]
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            leaf = node - inner
            value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
            margin += value[leaf]
            parts.append((feature, cut, value))
        return cls(prior, *(np.stack(x) for x in zip(*parts)))


def _remainder(mod: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)), F.lit(1))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 5, held_out: int = 0, most_rows: int = 20_000) -> Trees:
    """Trees for the label, from at most `most_rows` labelled documents outside the held-out fold."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & (_remainder(mod) != held_out))
    some = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most_rows)
    # at most most_rows rows of 16 bytes are broadcast
    chosen = texts(docs).join(F.broadcast(some), "doc_id")

    def run(batches):
        for pdf in batches:
            x = np.array([statistics(t) for t in pdf["text"]]).reshape(-1, len(STATISTICS))
            yield pd.DataFrame(x, columns=list(STATISTICS)).assign(y=pdf["y"].to_numpy(), doc_id=pdf["doc_id"].to_numpy())

    rows = chosen.mapInPandas(run, ", ".join(f"{s} double" for s in STATISTICS) + ", y double, doc_id long")
    # where doc_ids repeat there may be more: those of the least hashes again
    got = rows.orderBy(F.xxhash64("doc_id", *STATISTICS, "y"), "doc_id", *STATISTICS, "y").limit(most_rows).toPandas()
    got = got.sort_values(["doc_id", *STATISTICS, "y"])  # the same trees whatever order the tasks end in
    return Trees.fit(got[list(STATISTICS)].to_numpy(), (got["y"].to_numpy() > 0.5).astype(float))


def scorer(trees: Trees):
    """A pandas function from texts to scores."""

    @F.pandas_udf("double")
    def quality_score(text: pd.Series) -> pd.Series:
        return pd.Series(trees.scores(np.array([statistics(t or "") for t in text]).reshape(-1, len(STATISTICS))))

    return quality_score


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """`docs`, all columns, with the documents that score at least `threshold`."""
    return docs.where(scorer(train(docs, labels))(F.col("text")) >= threshold)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = train(docs, table(spark, sf_dir, "labels"))
    out = texts(docs).select("doc_id", (_remainder(5) == 0).alias("held_out"), scorer(trees)(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
