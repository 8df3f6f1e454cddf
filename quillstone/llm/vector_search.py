"""Approximate nearest neighbours: inverted file with product-quantised residuals and exact reranking.

Coarse centroids (k-means) and the codebooks of the residuals' `parts` sub-vectors are fitted on at most `most_train` vectors, those whose vec_id has
the least hashes. Every vector is indexed: its cell, the codes of its residual and how far the codes are off. Vectors are indexed divided by a power of two and less the sample's mean, so neither
their magnitude nor a part that all share costs precision; the sub-vectors may differ in width by one, so any length has `parts` of them. Two measures are fitted on the true neighbours, among all rows, of at most
`fit_queries` queries, which one pass finds by brute force: how many cells a query visits, the fewest that hold `reach` of them (few in clustered data, over half in data without clusters), and
how much an approximate score may be short of the exact one, as a share of what the codes are off, for `sure` of them. A query goes to the cells whose
centroids have the largest inner product with it, and on until they hold k vectors besides itself. Cells are gathered in groups of about `group_rows` rows, and a larger
cell is cut into several groups, so a hot cell is many tasks' work. In a group the query's tables of inner products with the codebooks give every
vector's approximate score, raised by that shortfall, at once; the `rerank` best, and all that reach the k-th exact score of these, are scored exactly, in double precision, on the original vectors, and the k best of all groups remain.
So coarse codes cost time and not neighbours.

Where data have no clusters, a fixed share of all vectors is visited by every query: as the queries are a share of the rows too, that work grows with the square of the
input. A group's queries stream past its vectors, at most `part_queries` in one task.

Vectors that are null, zero, or hold null or non-finite components take no part, nor those not of the commonest length (of equally common ones the shortest), as no inner product
joins different lengths; a null vec_id neither. A vector is held whole, however long, some thousand to a task. Ties go to the smaller vec_id. Rows that repeat a vec_id are one candidate each and ask one query together, with the least of their vectors. An empty table
gives an empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import stored, table


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k centroids, fewer if x has fewer distinct rows."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centre = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centre)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], 1)
        centre = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centre)
    return centre


def nearest(x: np.ndarray, centre: np.ndarray, step: int = 4096) -> np.ndarray:
    half = (centre**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + step] @ centre.T - half, axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Coarse centroids and codebooks, of vectors divided by `scale` and less the sample's mean; of bounded size."""

    def __init__(self, train: np.ndarray, cells: int, parts: int, scale: float = 1.0, codes: int = 256):
        dim = train.shape[1]
        self.scale, self.mean = scale, (train / scale).mean(axis=0)
        train = self.moved(train)
        cuts = np.linspace(0, dim, min(parts, dim) + 1).astype(int).tolist()
        self.parts = [slice(i, j) for i, j in zip(cuts[:-1], cuts[1:])]
        self.coarse = kmeans(train, cells)
        left = train - self.coarse[nearest(train, self.coarse)]
        self.books = [kmeans(left[:, part], codes, 8) for part in self.parts]

    def moved(self, x: np.ndarray) -> np.ndarray:
        return x / self.scale - self.mean

    def directions(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of queries, and for each what turns its exact score s into that with a moved vector: s / size - base."""
        unit = q / self.scale
        length = np.sqrt((unit**2).sum(axis=1))
        unit = unit / np.where(length > 0, length, 1)[:, None]
        return unit, np.where(length > 0, length, 1) * self.scale**2, unit @ self.mean

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes and the distances of vectors from what their codes stand for."""
        x = self.moved(x)
        cell = nearest(x, self.coarse)
        left = x - self.coarse[cell]
        codes = np.stack([nearest(left[:, part], book) for part, book in zip(self.parts, self.books)], 1).astype(np.uint8)
        return cell, codes, np.sqrt(((x - self.decoded(cell, codes)) ** 2).sum(axis=1))

    def decoded(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.coarse[cell] + np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """[query, part, code]: inner products of the query's parts with the codebooks."""
        out = np.zeros((len(q), len(self.parts), 256))
        for p, (part, book) in enumerate(zip(self.parts, self.books)):
            out[:, p, : len(book)] = q[:, part] @ book.T
        return out


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where("vec_id is not null and v is not null").where(F.coalesce(good, F.lit(False)))
    length = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("v") == (length.n if length else 0))


def true_neighbours(placed: DataFrame, some: pd.DataFrame, index: Index, k: int) -> pd.DataFrame:
    """(q, cell, short) of the k nearest of all rows to each of the queries `some`, by brute force; short: what their approximate scores lack, as a share of what their codes are off."""
    names = some["vec_id"].to_numpy()
    unit = index.directions(np.stack(some["v"].to_numpy()))[0]

    def run(batches):
        held = None  # score, id, cell, short: the k best so far of each query
        for pdf in batches:
            for i in range(0, len(pdf), 4096):
                rows = pdf.iloc[i : i + 4096]
                x, ids, cell = index.moved(np.stack(rows["v"].to_numpy())), rows["vec_id"].to_numpy(), rows["cell"].to_numpy()
                score = unit @ x.T
                score[names[:, None] == ids] = -np.inf
                at = np.argpartition(-score, k - 1, axis=1)[:, :k] if len(ids) > k else np.tile(np.arange(len(ids)), (len(names), 1))
                known, each = index.decoded(cell, np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)), np.take_along_axis(score, at, axis=1)
                off = rows["off"].to_numpy()[at]
                lacks = np.where(off > 0, (each - np.take_along_axis(unit @ known.T, at, axis=1)) / np.where(off > 0, off, 1), 0)
                new = [each, ids[at], cell[at], lacks]
                held = new if held is None else [np.concatenate(x, axis=1) for x in zip(held, new)]
                best = np.argsort(-held[0], axis=1, kind="stable")[:, :k]
                held = [np.take_along_axis(x, best, axis=1) for x in held]
        if held is not None:
            out = pd.DataFrame(dict(zip(("q", "score", "id", "cell", "short"), [np.repeat(np.arange(len(names), dtype=np.int32), held[0].shape[1]), *(x.ravel() for x in held)])))
            yield out[out["score"] > -np.inf]

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    found = placed.select("vec_id", "v", "cell", "codes", "off").mapInPandas(run, "q int, score double, id long, cell int, short double")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "cell", "short").toPandas()  # k rows a query


def fitted(some: pd.DataFrame, truth: pd.DataFrame, index: Index, reach: float, sure: float) -> tuple[int, float]:
    """The fewest cells to visit so that the queries reach that share of their true neighbours, and the shortfall that `sure` of these do not exceed."""
    if not len(truth):
        return 1, 0.0
    unit = index.directions(np.stack(some["v"].to_numpy()))[0]
    rank = np.argsort(np.argsort(-(unit @ index.coarse.T), axis=1, kind="stable"), axis=1)
    needed, short = np.sort(rank[truth["q"], truth["cell"]]), np.sort(truth["short"].to_numpy())
    place = lambda share: max(0, math.ceil(share * len(truth)) - 1)
    return int(needed[place(reach)]) + 1, max(0.0, float(short[place(sure)]))


def layout(sizes: np.ndarray, group_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's first group and its number of groups: cells share a group up to `group_rows` rows, larger ones have several of their own."""
    first, pieces, group, held = np.zeros(len(sizes), int), np.ones(len(sizes), int), 0, 0
    for c, n in enumerate(sizes.tolist()):
        if held and held + n > group_rows:
            group, held = group + 1, 0
        first[c] = group
        if n > group_rows:
            pieces[c] = -(-n // group_rows)
            group, held = group + int(pieces[c]), 0
        else:
            held += n
    return first, pieces


def search(vectors: DataFrame, every: int = 20, k: int = 20, cells: int | None = None, reach: float = 0.97, parts: int = 16, rerank: int = 200, most_train: int = 20_000, fit_queries: int = 512, sure: float = 0.99, group_rows: int = 4096, part_queries: int = 100_000) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    good = usable(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most_train).toPandas().sort_values("vec_id")
    if not len(sample):
        return spark.createDataFrame([], schema)
    total, most = good.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("v", F.abs)))).first()
    index = Index(np.stack(sample["v"].to_numpy()), cells or min(4096, max(1, round(math.sqrt(total)))), parts, 2.0 ** math.frexp(most)[1])

    def place(batches):
        for pdf in batches:
            if len(pdf):
                cell, codes, off = index.encode(np.stack(pdf["v"].to_numpy()))
                yield pdf.assign(cell=cell, codes=[c.tobytes() for c in codes], off=off)

    # the place of reading tells rows that repeat a vec_id apart, so many of them are cut like others
    placed = stored(good.mapInPandas(place, "vec_id long, v array<double>, cell int, codes binary, off double").withColumn("read", F.monotonically_increasing_id()), "index")
    counts = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell: 4096 at most
    size = np.array([counts.get(c, 0) for c in range(len(index.coarse))])
    first, pieces = layout(size, group_rows)
    queries = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_queries).toPandas()
    if not len(some):
        return spark.createDataFrame([], schema)
    probes, short = fitted(some, true_neighbours(placed, some, index, k), index, reach, sure)

    def ask(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            order = np.argsort(-(index.directions(np.stack(pdf["v"].to_numpy()))[0] @ index.coarse.T), axis=1, kind="stable")
            # enough cells for k vectors besides the query, however small they are
            upto = np.maximum(probes, (np.cumsum(size[order], axis=1) < k + 1).sum(axis=1) + 1)
            out = []
            for name, v, row, n in zip(pdf["vec_id"], pdf["v"], order, upto):
                groups: dict[int, list[int]] = {}
                for c in row[:n].tolist():
                    for g in range(first[c], first[c] + pieces[c] if size[c] else first[c]):
                        groups.setdefault(g, []).append(c)
                out += [(name, v, g, cs) for g, cs in groups.items()]
            yield pd.DataFrame(out, columns=["query_id", "q", "grp", "cells"])

    asked = queries.mapInPandas(ask, "query_id long, q array<double>, grp int, cells array<int>")
    places = spark.createDataFrame([(c, int(f), int(p)) for c, (f, p) in enumerate(zip(first, pieces))], "cell int, first int, pieces int")  # a row a cell
    held = placed.join(F.broadcast(places), "cell").withColumn("grp", (F.col("first") + F.pmod(F.xxhash64("vec_id", "read"), F.col("pieces"))).cast("int"))
    # a group's queries stream past its vectors; many are cut into parts, each of which meets the vectors in a task of its own
    cuts = max(1, math.ceil(queries.count() / part_queries))
    vectors_ = held.select("grp", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("part"), F.lit(0).alias("side"), F.col("vec_id").alias("id"), "v", "cell", "codes", "off", F.lit(None).cast("array<int>").alias("cells"))
    queries_ = asked.select("grp", F.pmod(F.xxhash64("query_id"), F.lit(cuts)).cast("int").alias("part"), F.lit(1).alias("side"), F.col("query_id").alias("id"), F.col("q").alias("v"), F.lit(None).cast("int").alias("cell"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("off"), "cells")
    groups = int(first.max()) + int(pieces[first.argmax()])

    def find(batches):
        now, kept, built = None, [], None
        for pdf in batches:
            key, side = pdf["place"].to_numpy(), pdf["side"].to_numpy()
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (side[1:] != side[:-1])]) if len(pdf) else []
            for i, j in zip(cut, [*cut[1:], len(pdf)]):
                if key[i] != now:
                    now, kept, built = key[i], [], None
                rows = pdf.iloc[i:j]
                if not side[i]:
                    kept.append(rows)
                elif kept:
                    built = built or _Held(pd.concat(kept), len(size))
                    for k in range(0, len(rows), 64):
                        yield built.nearest(rows.iloc[k : k + 64], index, rerank, top, short)

    top, place = k, F.col("grp") * cuts + F.col("part")  # a task for each part of each group
    found = vectors_.union(queries_).withColumn("place", place).repartitionById(groups * cuts, "place").sortWithinPartitions("place", "side").mapInPandas(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Held:
    """The vectors of a group, in order of vec_id."""

    def __init__(self, rows: pd.DataFrame, cells: int):
        rows = rows.sort_values("id", kind="stable")
        self.ids, self.x, self.cell, self.off = rows["id"].to_numpy(), np.stack(rows["v"].to_numpy()), rows["cell"].to_numpy().astype(np.int64), rows["off"].to_numpy()
        self.codes = np.ascontiguousarray(np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1).T)
        self.cells = cells

    def nearest(self, queries: pd.DataFrame, index: Index, rerank: int, k: int, short: float) -> pd.DataFrame:
        """Each query's k best of those in its cells: approximate scores of all from the asymmetric tables, exact ones of the `rerank` best and of what may reach the k-th of these."""
        q, names = np.stack(queries["v"].to_numpy()), queries["id"].to_numpy()
        unit, each, base = index.directions(q)
        visited = np.zeros((len(q), self.cells), bool)
        for i, cells in enumerate(queries["cells"]):
            visited[i, cells] = True
        # a row a vector and a column a query, so that a code takes its row of a table at once
        near = np.ascontiguousarray((index.coarse @ unit.T).astype(np.float32))[self.cell]
        for codes, table in zip(self.codes, np.ascontiguousarray(index.tables(unit).transpose(1, 2, 0), np.float32)):
            near += table[codes]
        near += (short * self.off).astype(np.float32)[:, None]
        near = np.ascontiguousarray(near.T)
        slack = 1e-5 * np.abs(near).max(axis=1)  # of single precision
        near[~visited[:, self.cell] | (self.ids == names[:, None])] = -np.inf
        # what ties with the last place is reranked too, so equal copies stay in order of vec_id
        bound = np.partition(near, near.shape[1] - rerank, axis=1)[:, -rerank] if near.shape[1] > rerank else np.full(len(q), -np.inf)
        out = []
        for i, (name, query, row, least) in enumerate(zip(names, q, near, bound)):
            at = np.flatnonzero((row >= least) & (row > -np.inf))
            exact = (self.x[at] * query).sum(axis=1)
            if len(at) >= k:
                kth = np.partition(exact, len(exact) - k)[-k] / each[i] - base[i] - slack[i]
                more = np.flatnonzero((row < least) & (row >= kth))
                if len(more):
                    at, exact = np.r_[at, more], np.r_[exact, (self.x[more] * query).sum(axis=1)]
            best = np.lexsort((self.ids[at], -exact))[:k]
            out.append((np.full(len(best), name), self.ids[at][best], exact[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
