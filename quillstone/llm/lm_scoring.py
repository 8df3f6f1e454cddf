"""Language-model scores by deleted interpolation of word n-grams.

Tokens: words `[^\\x20\\x09-\\x0D]+` of the whole text with A-Z lowered, then one end token. The model is
P_k(w | h) = a * c(hw) / c(h) + (1 - a) * P_{k-1}(w | h'), P_0 = 1 / (V + 1), with a weight `a` for each order and each
bucket of the context's count (its power of two). Weights maximise the likelihood of a fold of the training
documents under counts from the others (expectation-maximisation over each bucket's histogram of
log2(ML / lower order), in steps of 1/16: its size is fixed, and it holds every event of the fold). Scores use the counts of all
training documents.

Counts never leave the executors. Documents are dealt by a hash of doc_id and text over blocks of about `block_bytes` of text. A block sends the
n-grams it holds, each once with its count, to buckets by their 64-bit hash, as sorted packed arrays: a word
that is everywhere is one entry a block, so no key is hot. A block's messages are as many as the buckets, until these outnumber its n-grams, so
their number grows with the input at most. A bucket adds up its n-grams and answers each block with
the totals alone, in the order the block asked. The block then scores its documents. N-grams are told apart by 64-bit hashes.
The default order is 2: with 3 the n-grams that cross the shuffle, both ways, take more than four times the input's bytes on disk.

Nulls count as empty texts: one end token. A null doc_id is a training document. Rows that repeat count and are scored as often as
they occur, but are read as one. A very long text is a block of its own size, held by one task. Without training documents every token has probability 1. An empty table gives an empty result. Extra input
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import collapsed, stored, table, texts

_M1, _M2, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), 0x5851F42D4C957F2D
STEPS, NONE = 16, -10_000  # steps of the histogram for each power of two; the bin of events that the higher order gives no chance
_U8 = np.dtype("<u8")


def _mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (context ^ (context >> np.uint64(29))) * _M1 + word
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(31))


class Block:
    """The n-grams of some texts: for each order the distinct keys, ascending, and each token's place among them."""

    def __init__(self, rows: list[bytes], order: int):
        import xxhash

        names: dict[bytes, int] = {}
        parts, ends, total = [], [], 0
        for row in rows:
            words = row.lower().split()
            parts.append(np.fromiter((names.setdefault(w, len(names) + 1) for w in words), np.int64, len(words)))
            total += len(words) + 1
            ends.append(total - 1)
        self.ends = np.array(ends, np.int64)
        self.starts = np.r_[0, self.ends[:-1] + 1] if len(ends) else self.ends
        ids = np.zeros(total, np.int64)  # 0: the end
        body = np.ones(total, bool)
        body[self.ends] = False
        if parts:
            ids[body] = np.concatenate(parts)
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(b" end", 1), *[digest(w, 1) for w in names]], np.uint64)  # no word holds a space
        self.first = ids == 0
        used, place = np.unique(hashes, return_inverse=True)
        self.keys, self.places = [used], [place[ids]]
        chain = np.uint64(_START)
        word, key = hashes[ids], hashes[ids]
        for _ in range(1, order):
            context = np.empty(total, np.uint64)
            context[1:] = key[:-1]
            context[self.starts] = chain
            key, chain = _mix(context, word), _mix(np.array([chain], np.uint64), np.array([_START], np.uint64))[0]
            used, place = np.unique(key, return_inverse=True)
            self.keys.append(used), self.places.append(place)

    def counts(self, k: int, copies: np.ndarray) -> np.ndarray:
        """How often the documents, each that many times, hold each key of order k + 1."""
        token = np.repeat(copies, np.diff(np.r_[self.starts, self.ends[-1:] + 1]))
        out = np.zeros(len(self.keys[k]), np.int64)
        for n in np.unique(token):
            out += n * np.bincount(self.places[k][token == n], minlength=len(out))
        return out


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of all: the upper bytes are nearly all zero and compress away."""
    return np.diff(keys, prepend=np.uint64(0)).astype(_U8).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(_U8).ravel(), dtype=np.uint64)


def _pack_counts(n: np.ndarray) -> bytes:
    """Unsigned 32 bits each, or 64 where one needs them; the first byte says which."""
    width = 4 if not len(n) or n.max() < 1 << 32 else 8
    return bytes([width]) + n.astype(f"<u{width}").tobytes()


def _unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _by_block(batches, columns):
    """(block, {column: list}) from batches sorted by block."""
    now, rows = None, {c: [] for c in columns}
    for batch in batches:
        block = batch.column("block").to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for i, j in zip(cut[:-1], cut[1:]):
            if i == j:
                continue
            if now is not None and block[i] != now:
                yield now, rows
                rows = {c: [] for c in columns}
            now = int(block[i])
            for c in columns:
                rows[c] += batch.column(c)[i:j].to_pylist()
    if now is not None:
        yield now, rows


class Model:
    """What every task needs besides its block's counts: totals, and the weights of each order's buckets."""

    def __init__(self, tokens: int, distinct: int, docs: int):
        self.tokens, self.distinct, self.docs, self.weights = tokens, distinct, docs, []

    def ratios(self, block: Block, totals: list[np.ndarray], k: int, lower: np.ndarray):
        """(bucket, ML, ok) of each token at order k + 1."""
        hits = totals[k][block.places[k]].astype(float)
        if k == 0:
            context = np.full(len(hits), float(self.tokens))
        else:
            context = np.empty(len(hits))
            context[1:] = totals[k - 1][block.places[k - 1]][:-1]
            # before a document stand start marks: the context seen once in each document, or a shorter one that began it
            context[block.starts] = self.docs
        known = context > 0
        bucket = np.where(known, np.log2(np.maximum(context, 1)).astype(int), -1) if k else np.zeros(len(hits), int)
        return bucket, np.divide(hits, context, out=np.zeros(len(hits)), where=known), known

    def probability(self, block: Block, totals: list[np.ndarray], orders: int) -> np.ndarray:
        p = np.full(block.ends[-1] + 1, 1.0 / (self.distinct + 1))
        for k in range(orders):
            bucket, ml, known = self.ratios(block, totals, k, p)
            w = np.where(known, self.weights[k][np.minimum(bucket, len(self.weights[k]) - 1)], 0.0)
            p = w * ml + (1 - w) * p
        return p


def fit_weights(events: list[tuple[int, int, int]], rounds: int = 60) -> np.ndarray:
    """Each bucket's weight by EM from (bucket, bin, events); buckets without events take the one below."""
    out, last = [], 0.5
    by: dict[int, list] = {}
    for bucket, at, n in events:
        by.setdefault(bucket, []).append((at, n))
    for bucket in range(max(by, default=0) + 1):
        if bucket in by:
            at, n = np.array(by[bucket], float).T
            r = np.where(at == NONE, 0.0, 2.0 ** (np.maximum(at, NONE / 2) / STEPS))
            w = 0.5
            for _ in range(rounds):
                w = float((n * (w * r / (w * r + 1 - w))).sum() / n.sum())
                w = min(max(w, 1e-6), 1 - 1e-6)
            last = w
        out.append(last)
    return np.array(out)


def _dealt(docs: DataFrame, blocks: int, fold_blocks: int, fold_mod: int, held_out: int, fold: int) -> DataFrame:
    """(block, doc_id, text, copies, held_out); the fold's documents have blocks of their own, from `blocks` on."""
    part = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold_mod)), F.lit(-1))
    spread = F.xxhash64("doc_id", "raw")
    block = F.when(part == fold, blocks + F.pmod(spread, F.lit(fold_blocks))).otherwise(F.pmod(spread, F.lit(blocks))).cast("int")
    return collapsed(docs).select(block.alias("block"), "doc_id", F.col("text").cast("binary").alias("text"), "copies", (part == held_out).alias("held_out"))


def score(docs: DataFrame, order: int = 2, fold_mod: int = 7, held_out: int = 2, fold: int = 3, block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (log10 of the model's probability)."""
    found = score_distinct(docs, order, fold_mod, held_out, fold, block_bytes)
    return found.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def score_distinct(docs: DataFrame, order: int, fold_mod: int, held_out: int, fold: int, block_bytes: int) -> DataFrame:
    """score() of distinct rows, and how many `copies` each stands for."""
    total = texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    fold_blocks = max(1, math.ceil(blocks / fold_mod))
    bits = max(0, math.ceil(math.log2(max(1, total / (2 * block_bytes)))))  # a bucket holds the n-grams of about two blocks' text
    rows = _dealt(docs, blocks, fold_blocks, fold_mod, held_out, fold)

    def ask(batches):
        for number, got in _by_block(batches, ["text", "copies", "held_out"]):
            block = Block(got["text"], order)
            copies = np.where(got["held_out"], 0, got["copies"])
            for k in range(order):
                keys, n = block.keys[k], block.counts(k, copies)
                # as many messages as there are buckets, or n-grams, whichever are fewer
                used, start = np.unique(keys >> np.uint64(64 - bits), return_index=True) if bits else (np.zeros(1, np.uint64), np.zeros(1, np.int64))
                cut = np.r_[start, len(keys)].tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int32)), pa.array([number] * len(used), pa.int32()), pa.array([k] * len(used), pa.int32()), pa.array([_pack_keys(keys[i:j]) for i, j in zip(cut, cut[1:])], pa.binary()), pa.array([_pack_counts(n[i:j]) for i, j in zip(cut, cut[1:])], pa.binary())],
                    ["bucket", "block", "level", "keys", "counts"],
                )

    whole = blocks + fold_blocks
    asked = rows.repartitionById(whole, "block").sortWithinPartitions("block").mapInArrow(ask, "bucket int, block int, level int, keys binary, counts binary")
    answer_schema = "bucket int, block int, level int, total binary, kept binary, distinct long, tokens long, fold_tokens long, bins array<int>, events array<long>"
    arrow = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("level", pa.int32()), ("total", pa.binary()), ("kept", pa.binary()), ("distinct", pa.int64()), ("tokens", pa.int64()), ("fold_tokens", pa.int64()), ("bins", pa.list_(pa.int32())), ("events", pa.list_(pa.int64()))])

    def answer(group: pa.Table) -> pa.Table:
        out, bucket = [], group.column("bucket")[0].as_py()
        levels, names = group.column("level").to_numpy(), group.column("block").to_numpy()
        for k in np.unique(levels).tolist():
            at = np.flatnonzero(levels == k)
            keys = [_unpack_keys(group.column("keys")[i].as_py()) for i in at]
            n = np.concatenate([_unpack_counts(group.column("counts")[i].as_py()) for i in at])
            ends = np.cumsum([len(x) for x in keys])
            in_fold = np.repeat(names[at] >= blocks, [len(x) for x in keys])
            used, place = np.unique(np.concatenate(keys), return_inverse=True)
            whole = np.bincount(place, n, len(used)).astype(np.int64)  # doubles: exact up to 2**53
            folds = np.bincount(place, n * in_fold, len(used)).astype(np.int64)
            for i, b, a in zip(at, ends.tolist(), [0, *ends.tolist()]):
                mine = place[a:b]
                kept = _pack_counts((whole - folds)[mine]) if names[i] >= blocks else None
                out.append((bucket, int(names[i]), k, _pack_counts(whole[mine]), kept, None, None, None, None, None))
            if k == 0:
                seen, kept = folds > 0, whole - folds
                bins = np.where(kept > 0, np.rint(STEPS * np.log2(np.maximum(kept, 1))), NONE)[seen].astype(int)
                which, back = np.unique(bins, return_inverse=True)
                out.append((bucket, -1, 0, None, None, int((whole > 0).sum()), int(whole.sum()), int(folds.sum()), which.tolist(), np.bincount(back, folds[seen], len(which)).astype(int).tolist()))
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

    answers = stored(asked.repartitionById(1 << bits, "bucket").groupBy("bucket").applyInArrow(answer, answer_schema), "ngrams")
    train_docs, fold_docs = (x or 0 for x in rows.agg(F.sum(F.when(~F.col("held_out"), F.col("copies"))), F.sum(F.when(F.col("block") >= blocks, F.col("copies")))).first())
    stats = answers.where("block = -1")
    distinct, tokens, fold_tokens = (x or 0 for x in stats.agg(F.sum("distinct"), F.sum("tokens"), F.sum("fold_tokens")).first())
    model, kept_model = Model(tokens, distinct, train_docs), Model(tokens - fold_tokens, distinct, train_docs - fold_docs)
    hist = stats.select(F.explode(F.arrays_zip("bins", "events")).alias("x")).groupBy("x.bins").agg(F.sum("x.events")).collect()
    shift = STEPS * math.log2((distinct + 1) / max(1, kept_model.tokens))
    kept_model.weights.append(fit_weights([(0, NONE if at == NONE else round(at + shift), n) for at, n in hist]))

    def totals(right: pa.Table, column: str) -> list[np.ndarray]:
        got: list[list] = [[] for _ in range(order)]
        level, bucket = right.column("level").to_pylist(), right.column("bucket").to_pylist()
        for i in sorted(range(len(level)), key=lambda i: bucket[i]):
            got[level[i]].append(_unpack_counts(right.column(column)[i].as_py()))
        return [np.concatenate(x) for x in got]

    for k in range(1, order):  # a pass over the fold for each order: its weights rest on those below

        def tune(left: pa.Table, right: pa.Table) -> pa.Table:
            block = Block(left.column("text").to_pylist(), order)
            counts = totals(right, "kept")
            lower = kept_model.probability(block, counts, k)
            bucket, ml, known = kept_model.ratios(block, counts, k, lower)
            at = np.where(ml > 0, np.rint(STEPS * np.log2(np.maximum(ml, 1e-300) / lower)), NONE).astype(int)[known]
            copies = np.repeat(left.column("copies").to_numpy(), block.ends - block.starts + 1)[known]
            both, place = np.unique(np.stack([bucket[known], at], 1), axis=0, return_inverse=True)
            n = np.bincount(place.ravel(), copies, len(both)).astype(np.int64)
            return pa.table({"bucket": pa.array(both[:, 0], pa.int32()), "at": pa.array(both[:, 1], pa.int32()), "n": pa.array(n, pa.int64())})

        of_fold = lambda df, *columns: df.where(F.col("block") >= blocks).select((F.col("block") - blocks).alias("at"), *columns).repartitionById(fold_blocks, "at").groupBy("at")
        mine = of_fold(rows, "text", "copies").cogroup(of_fold(answers, "level", "bucket", "kept"))
        events = mine.applyInArrow(tune, "bucket int, at int, n long").groupBy("bucket", "at").agg(F.sum("n")).collect()
        kept_model.weights.append(fit_weights([tuple(x) for x in events]))
    model.weights = kept_model.weights
    schema = "doc_id long, copies long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left.column("text").to_pylist(), order)
        counts = totals(right, "total")
        c = counts[0][block.places[0]].astype(float)
        sums = lambda x: np.add.reduceat(x, block.starts)
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "copies": left.column("copies"),
                "held_out": left.column("held_out"),
                "n_tokens": pa.array(block.ends - block.starts + 1, pa.int64()),
                "n_known": pa.array(sums((c > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(len(block.ends), model.tokens), pa.int64()),
                "base_score": pa.array(sums(np.log10((c + 1) / (model.tokens + model.distinct + 1))), pa.float64()),
                "score": pa.array(sums(np.log10(model.probability(block, counts, order))), pa.float64()),
            }
        )

    asked_for = answers.where("block >= 0").select("block", "level", "bucket", "total")
    return rows.repartitionById(whole, "block").groupBy("block").cogroup(asked_for.repartitionById(whole, "block").groupBy("block")).applyInArrow(finish, schema)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
