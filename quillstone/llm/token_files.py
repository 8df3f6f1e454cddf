"""Token ids in files: frequency-ranked, byte-aligned codes with separate control bytes.

A part is a run of documents in ascending order of doc_id. Its distinct ids are ranked by their frequency in the part,
commonest first, so that most ranks take one byte. Ranks are written in 1 to 4 bytes, little-endian,
into one data stream; a control byte apart holds the four 2-bit byte counts of four ranks. Reading
looks each control byte up in a table of its four byte counts and gathers all ranks of a block at once in numpy.

Files are Parquet, so any Hadoop store and Spark's commit protocol serve: a row with block -1 has a part's ids by rank,
the other rows have blocks of whole documents (doc_id list, counts, control bytes, data bytes) of about `block_ids` ids.
(part, block) is the order; a part decodes alone. Spark's range partitioning cuts the documents into tasks of about `part_bytes` of text, by doc_id and, where
many rows share one or have none, by the order in which they are read; a task starts a new part after `part_ids` ids, so what it holds is bounded. Parts are numbered by task, and
where each begins comes from sums over ranges of parts.

Nulls count as empty texts, one end id long; a null doc_id sorts first. Rows of equal doc_id follow each other in the order in which they are read. A very long text is
encoded in one task, as a part of its own size. An empty table gives no rows. Extra input columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import shared_dir, stored, sums_before, table, texts
from quillstone.llm.tokens import default_vocabulary, encoder

FORMAT = "part long, block int, docs array<long>, counts array<int>, control binary, data binary"
_ARROW = pa.schema([("part", pa.int64()), ("block", pa.int32()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("control", pa.binary()), ("data", pa.binary())])
#: byte counts of the four codes of each control byte
_SIZES = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack_codes(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of uint32 values."""
    values = np.ascontiguousarray(values, "<u4")
    n = len(values)
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = size - 1
    quad = padded.reshape(-1, 4)
    control = quad[:, 0] | quad[:, 1] << 2 | quad[:, 2] << 4 | quad[:, 3] << 6
    return control.tobytes(), values.view(np.uint8).reshape(n, 4)[np.arange(4, dtype=np.uint8) < size[:, None]].tobytes()


def unpack_codes(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(size, dtype=np.int64) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(1, np.uint8)])
    out = raw[start].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _write_part(part: int, docs: list, ids: list[np.ndarray], block_ids: int):
    """The part's rows: its ids by rank, then blocks."""
    whole = np.concatenate(ids)
    counts = np.bincount(whole)
    by_rank = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    rank = np.zeros(len(counts), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    rows = [(part, -1, [], [len(by_rank)], *pack_codes(by_rank))]
    ends = np.cumsum([len(x) for x in ids])
    at, start = 0, 0
    while at < len(docs):
        to = max(at + 1, int(np.searchsorted(ends, start + block_ids, "right")))
        rows.append((part, len(rows) - 1, docs[at:to], [len(x) for x in ids[at:to]], *pack_codes(rank[whole[start : ends[to - 1]]])))
        at, start = to, int(ends[to - 1])
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, part_bytes: int = 6 << 20, block_ids: int = 1 << 18, part_ids: int = 1 << 22, memo_bytes: int = 192 << 20) -> None:
    rows = texts(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(1, math.ceil(total / part_bytes))

    def run(batches):
        enc, first, parts, names, ids, held = encoder(vocabulary, memo_bytes), TaskContext.get().partitionId() << 32, 0, [], [], 0
        last = np.array([end_id], enc.dtype if end_id <= np.iinfo(enc.dtype).max else "<u4")
        for batch in batches:
            for name, raw in zip(batch.column("doc_id").to_pylist(), enc.raws(batch.column("text").to_pylist())):
                names.append(name), ids.append(np.concatenate([np.frombuffer(raw, enc.dtype), last]))
                held += len(ids[-1])
                if held >= part_ids:
                    yield _write_part(first + parts, names, ids, block_ids)
                    parts, names, ids, held = parts + 1, [], [], 0
        if names:
            yield _write_part(first + parts, names, ids, block_ids)

    order = ["doc_id", "read"]
    ordered = rows.withColumn("read", F.monotonically_increasing_id()).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "text").mapInArrow(run, FORMAT).write.parquet(path)


def _with_ranks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks, each with its part's ids by rank."""
    files = spark.read.schema(FORMAT).parquet(path)
    ranks = files.where("block = -1").select(F.col("part").alias("of"), F.col("counts")[0].alias("r_n"), F.col("control").alias("r_control"), F.col("data").alias("r_data"))
    return files.where("block >= 0").join(ranks, F.col("part") == F.col("of")).drop("of")


def _decoded(batches):
    """(part, block, doc_ids, ends, ids) of each block: ids as little-endian unsigned 32-bit bytes, of which each document's end at 4 * ends."""
    known = (None, None)
    for batch in batches:
        for i in range(batch.num_rows):  # a row is a block: a few hundred thousand ids
            row = {k: batch.column(k)[i] for k in batch.schema.names}
            part, counts = row["part"].as_py(), row["counts"].values.to_numpy().astype(np.int64)
            if known[0] != part:
                known = part, unpack_codes(row["r_control"].as_py(), row["r_data"].as_py(), row["r_n"].as_py()).astype("<u4")
            ids = known[1][unpack_codes(row["control"].as_py(), row["data"].as_py(), int(counts.sum()))]
            yield part, row["block"].as_py(), row["docs"].values, np.cumsum(counts), ids.tobytes()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, at, doc_id, ids): ids as little-endian unsigned 32-bit; at: the document's place in its block."""

    def run(batches):
        for part, block, docs, ends, ids in _decoded(batches):
            found = [ids[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array([block] * n, pa.int32()), pa.array(range(n), pa.int32()), docs, pa.array(found, pa.binary())], ["part", "block", "at", "doc_id", "ids"])

    return _with_ranks(spark, path).mapInArrow(run, "part long, block int, at int, doc_id long, ids binary")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, from the ids that are read back."""
    files = spark.read.schema(FORMAT).parquet(path).where("block >= 0")
    sizes = files.select("part", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    # part: task << 32 plus its number in the task; a task has a few, so sums go over a task's parts and then over the tasks
    parts = stored(sizes.groupBy("part").agg(F.sum("n").alias("n")).withColumn("task", F.shiftright("part", 32)), "parts")
    tasks = sums_before(parts.groupBy("task").agg(F.sum("n").alias("n")), "task", "n", "b")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("task").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = parts.withColumn("inside", inside).join(tasks, "task").select("part", (F.col("inside") + F.col("b")).alias("b"))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("f", first).join(before, "part").select(F.col("part").alias("p"), F.col("block").alias("k"), (F.col("f") + F.col("b")).alias("base"))

    def run(batches):
        for part, block, docs, ends, ids in _decoded(batches):
            first, whole = np.r_[0, ends[:-1]], memoryview(ids)
            crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(first.tolist(), ends.tolist())]
            n = len(crc)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array([block] * n, pa.int32()), docs, pa.array(first), pa.array(ends - first), pa.array(crc, pa.int64())], ["part", "block", "doc_id", "within", "n_tokens", "ids_crc32"])

    docs = _with_ranks(spark, path).mapInArrow(run, "part long, block int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return docs.join(starts, (F.col("part") == F.col("p")) & (F.col("block") == F.col("k"))).select("doc_id", (F.col("base") + F.col("within")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, default_vocabulary())
    return digest(spark, path)
