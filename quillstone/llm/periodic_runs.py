"""Periodic runs of words, found by matching aligned blocks.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least
max(`least_length`, `exponent` * q) words, which no neighbouring word extends with the same period. At each power of two B the text is cut into aligned
blocks of B words. A run of a period from B to 2B - 1 holds exponent - 2 whole aligned blocks in a row whose copies a period later lie in it too, so every
one of their words comes again within 2B - 1 words. Only such blocks are keys of a pyahocorasick automaton over integer sequences, and only the
stretch of up to 3B words from each is searched. An occurrence at a distance from B to 2B - 1 is a seed: it is extended word by word to both sides, exactly.
Stretches that several distances find have their smallest one as the period (two periods of a stretch this long have a common divisor that is a period as well).
Blocks inside a run of a known short period are left out, as all they can find is that run, so a text of one word costs no more than others.

`find` returns every run of whole texts, `collapse` removes the words after a run's first period. The operator has no shuffle: a text is
one row's work. Nulls count as empty texts. A null doc_id is kept. Rows that repeat give equal rows. Very long texts are worked on one at a time, in
time n log n. An empty table gives an empty result. Extra input columns, whatever their names, are ignored by `find` and kept by `collapse`.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import keyed_texts, table, texts


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words."""
    names: dict[bytes, int] = {}
    return np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))


def _next(x: np.ndarray) -> np.ndarray:
    """How many words later each word comes again; the text's length where it does not."""
    order = np.argsort(x, kind="stable")
    out = np.full(len(x), len(x), np.int64)
    same = np.flatnonzero(x[order[1:]] == x[order[:-1]])
    out[order[same]] = order[same + 1] - order[same]
    return out


def _seeds(x: np.ndarray, blocks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of every occurrence of a block `size` to 2 * size - 1 words after it; blocks: their places, ascending."""
    import ahocorasick

    automaton, keys, n = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}, len(x)
    number = np.array([keys.setdefault(tuple(x[p : p + size].tolist()), len(keys)) for p in blocks.tolist()], np.int64)
    for key, i in keys.items():
        automaton.add_word(key, i)
    automaton.make_automaton()
    ends = np.minimum(blocks + 3 * size - 1, n)
    first = np.flatnonzero(np.r_[True, blocks[1:] > ends[:-1]])  # stretches that touch are searched as one
    key, place = [], []
    for low, high in zip(blocks[first].tolist(), ends[np.r_[first[1:] - 1, len(blocks) - 1]].tolist()):
        for end, i in automaton.iter(tuple(x[low:high].tolist())):
            key.append(i), place.append(low + end - size + 1)
    code = np.sort(np.array(key, np.int64) * (n + 1) + np.array(place, np.int64))
    low = np.searchsorted(code, number * (n + 1) + np.minimum(blocks + size, n))
    many = np.searchsorted(code, number * (n + 1) + np.minimum(blocks + 2 * size - 1, n), "right") - low
    at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
    start = np.repeat(blocks, many)
    return start, code[at] % (n + 1) - start


def _agree(x: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i and from j on are equal, going up (step 1) or down (-1)."""
    done, many = 0, 32
    while True:
        room = min(many, (len(x) - max(i, j)) if step > 0 else min(i, j) + 1)
        if room <= 0:
            return done
        a, b = (x[i : i + room], x[j : j + room]) if step > 0 else (x[i - room + 1 : i + 1][::-1], x[j - room + 1 : j + 1][::-1])
        differ = a != b
        if differ.any():
            return done + int(np.argmax(differ))
        done, i, j, many = done + room, i + step * room, j + step * room, many * 2


def runs(x: np.ndarray, least_length: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a sequence of numbers, by start and period."""
    if exponent < 3:
        raise ValueError("a run has its period three times at least")
    n, size = len(x), 1
    found: dict[tuple[int, int], int] = {}
    reach, period = np.zeros(n, np.int64), np.ones(n, np.int64)  # at each word, where the run that reaches furthest ends, and its period
    worst = _next(x) if n else np.zeros(0, np.int64)
    while exponent * size <= n:
        good = worst < 2 * size
        row = np.ones(max(0, len(good) - exponent + 3), bool)
        for k in range(exponent - 2):
            row &= good[k : k + len(row)]
        blocks = np.flatnonzero(row) * size
        blocks = blocks[(reach[blocks] < np.minimum(blocks + 3 * size, n)) | (2 * period[blocks] > size)]
        if len(blocks):
            at, distance = _seeds(x, blocks, size)
            new = (reach[at] < at + distance + size) | (distance % period[at] > 0)
            for p, d in zip(at[new].tolist(), distance[new].tolist()):
                if reach[p] >= p + d + size and d % period[p] == 0:
                    continue
                start = p - _agree(x, p - 1, p + d - 1, -1)
                end = p + d + size + _agree(x, p + size, p + d + size, 1)
                if end - start >= max(least_length, exponent * d):
                    found[start, end] = min(d, found.get((start, end), d))
                    less = np.flatnonzero(reach[start:end] < end) + start
                    reach[less], period[less] = end, d
        if len(worst) % 2:
            worst = worst[:-1]
        worst, size = worst.reshape(-1, 2).max(axis=1), 2 * size
    return sorted((s, e - s, q) for (s, e), q in found.items())


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words is in no run after that run's first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        depth[start + q] += 1
        depth[start + length] -= 1
    return np.cumsum(depth)[:n] == 0


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length/period, exactly; ties to the smallest start, then period."""
    out = None
    for run in found:
        if out is None or run[1] * out[2] > out[1] * run[2]:
            out = run
    return out


def find(docs: DataFrame, least_length: int = 6, exponent: int = 4) -> DataFrame:
    """(doc_id, raw, start, length, period): a row for each run; raw is the hash of the text, start a word's number from 0."""

    def run(batches):
        for batch in batches:
            doc, raw, out = [], [], []
            ids, raws = batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist()
            for name, h, x in zip(ids, raws, batch.column("text")):
                rows = runs(numbered(x.as_buffer().to_pybytes().split()), least_length, exponent)
                doc += [name] * len(rows)
                raw += [h] * len(rows)
                out += rows
            columns = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (doc, raw, *columns)], ["doc_id", "raw", "start", "length", "period"])

    return keyed_texts(docs).mapInArrow(run, "doc_id long, raw long, start long, length long, period long")


def collapse(docs: DataFrame, text_col: str = "text", least_length: int = 6, exponent: int = 4) -> DataFrame:
    """`docs`, all columns: a text with runs becomes its kept words, joined by one space; the others stay as they are."""

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column("__text"):
                words = x.as_buffer().to_pybytes().split() if x.is_valid else []
                found = runs(numbered(words), least_length, exponent)
                keep = kept_words(len(words), found)
                out.append(b" ".join(w for w, k in zip(words, keep) if k).decode() if found else x.as_py())
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(out, pa.string())], ["__row", "__text"])

    rows = docs.select(F.struct("*").alias("__row"), F.col(text_col).alias("__text"))
    done = rows.mapInArrow(run, rows.schema)
    return done.select(*[(F.col("__text") if c == text_col else F.col("__row").getField(c)).alias(c) for c in docs.columns])


def _planted(words: list[bytes], name: int | None) -> list[bytes]:
    """The words with the repeat that the query's contract puts into every tenth text."""
    h = zlib.crc32(str(name).encode()) if name is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document's runs; a null doc_id has no planted repeat."""

    def run(batches):
        for batch in batches:
            out = []
            for name, x in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = _planted(x.as_buffer().to_pybytes().split(), name)
                found = runs(numbered(words))
                top = best(found)
                start, length, q = top or (None, None, None)
                lines = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
                left = b" ".join(w for w, k in zip(words, kept_words(len(words), found).tolist()) if k) if found else b" ".join(words)
                out.append((name, len(found), start, length, q, 1000 * length // q if top else None, hashlib.sha256(lines).hexdigest(), hashlib.sha256(left).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 8, kinds)], [c.split()[0] for c in DIGEST.split(", ")])

    return texts(table(spark, sf_dir, "documents")).mapInArrow(run, DIGEST)
