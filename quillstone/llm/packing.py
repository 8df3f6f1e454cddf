"""Packing documents into sequences by vector best-fit.

A document's ids plus an end id are one piece if they fit a sequence; a longer one is cut into full
sequences' worth, of which only the first may be shorter. Pieces are spread by a hash over blocks of
about `block_rows`, and each block is packed alone, largest piece first. A bin has three residual capacities: tokens,
documents and attention cost (the sum of squared lengths). Of the bins where a piece fits under every
constraint, it takes the one with the greatest weighted dot product of piece and residual ("dot") or with
the least weighted norm of what remains ("norm"), all as shares of a bin; ties go to the oldest bin.
Blocks are large, so each leaves at most a bin or so less than full.

Nulls count as empty texts, one end id long. Rows that repeat are packed as often as they occur. A null doc_id is
kept. A very long text is encoded whole, in one task. An empty table gives an empty result. Extra input columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import stored, table, texts
from quillstone.llm.tokens import default_vocabulary, encoder


def pieces(docs: DataFrame, vocabulary: str, length: int = 1024, end_id: int = 2, memo_bytes: int = 192 << 20) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), without the ids."""

    def run(batches):
        enc = encoder(vocabulary, memo_bytes)
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc, piece, start, size, crc = [], [], [], [], []
            names = batch.column("doc_id").to_pylist()
            for name, raw in zip(names, enc.raws(batch.column("text").to_pylist())):
                ids = np.frombuffer(raw, enc.dtype).astype("<u4").tobytes() + last
                n = len(ids) // 4
                at = [0, *range(n % length or length, n, length), n]
                for k, (i, j) in enumerate(zip(at[:-1], at[1:])):
                    doc.append(name), piece.append(k), start.append(i), size.append(j - i), crc.append(zlib.crc32(ids[4 * i : 4 * j]))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def vector_best_fit(lengths: np.ndarray, length: int, most_docs: int, most_cost: float, rule: str = "norm", weights=(1.0, 0.25, 0.25)) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's (bin, offset); pieces are taken largest first, ties in the given order."""
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    full = np.array([length, most_docs, most_cost], float)
    w = np.array(weights, float)
    items = np.stack([lengths, np.ones(n), lengths.astype(float) ** 2], 1)
    items[:, 2] = np.minimum(items[:, 2], most_cost)  # alone, a piece always fits
    left, name, opened, used = np.empty((0, 3)), np.empty(0, np.int64), 0, 0
    order = np.argsort(-lengths, kind="stable")
    smallest = items.min(axis=0) if n else full
    left, name = np.empty((n, 3)), np.empty(n, np.int64)  # the first `used` rows are the bins still open
    for p in order:
        item = items[p]
        fits = np.flatnonzero((left[:used] >= item).all(axis=1)) if item[0] < length else ()
        if len(fits):
            room = left[fits]
            score = -((room / full * (item / full)) @ w) if rule == "dot" else (((room - item) / full) ** 2) @ w
            at = fits[np.argmin(score)]
            offsets[p], bins[p] = length - left[at, 0], name[at]
            left[at] -= item
        else:
            offsets[p], bins[p] = 0, opened
            at = used
            left[at], name[at] = full - item, opened
            opened, used = opened + 1, used + 1
        if (left[at] < smallest).any():  # nothing more can enter: close it, keeping the bins' order
            left[at : used - 1], name[at : used - 1] = left[at + 1 : used].copy(), name[at + 1 : used].copy()
            used -= 1
    return bins, offsets


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = 1024, end_id: int = 2, most_docs: int | None = None, most_cost: float | None = None, rule: str = "norm", weights=(1.0, 0.25, 0.25), block_rows: int = 8192, memo_bytes: int = 192 << 20) -> DataFrame:
    """pieces() with sequence_id and offset. `memo_bytes`: what a worker keeps of parts' ids. most_docs and most_cost default to what `length` tokens can never exceed."""
    vocabulary = vocabulary or default_vocabulary()
    cut = stored(pieces(docs, vocabulary, length, end_id, memo_bytes).withColumn("read", F.monotonically_increasing_id()), "pieces")
    blocks = max(1, round(cut.count() / block_rows))
    docs_cap, cost_cap = most_docs or length, most_cost or float(length) ** 2

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        bins, offsets = vector_best_fit(group["length"].to_numpy(), length, docs_cap, cost_cap, rule, weights)
        return group.assign(sequence_id=group["block"].astype("int64") * (1 << 32) + bins, offset=offsets).drop(columns="block")

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    # the place of reading, so that equal pieces are spread too
    block = F.pmod(F.xxhash64("doc_id", "start", "read"), F.lit(blocks)).cast("int")
    return cut.withColumn("block", block).drop("read").repartitionById(blocks, "block").groupBy("block").applyInPandas(run, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
