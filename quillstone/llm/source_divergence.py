"""How far each source's terms lie from its language's other sources, by systolic rotation.

Terms are the matches of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` with only A-Z lowered. A language keeps the V terms that at least `least_docs` of its documents hold. A
group (lang, source), and each language as a whole, gives each kept term p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)), where N sums its counts of kept terms; all of it is exact.
Part `pair`: the sum over all kept terms of abs(p - q) between two sources of a language. Part `term`: the terms whose p exceeds the language's, by that excess, the `most` greatest.

A task counts the terms of the documents that it reads and sends a group's term once, so no common term is a hot key. Each language's kept terms are cut into slices of about `slice_terms` by a hash,
and a group's counts of one slice are a vector of bounded size: a bit for each term it holds, and the counts in as few bytes as they need. The groups of a language
are dealt over an even number of seats, about the square root of the number of sources, and a seat's vectors of one slice stay where a shuffle has put them. In round r of a
round-robin tournament (circle method: the last seat stays, the others turn) every seat meets one other: the higher seat's vectors travel to the lower one, and the
meeting gives both directions of each pair. Seats - 1 rounds bring all seats together, a seat's own groups meet at home. `rounds_at_once` rounds are one Spark job, which keeps
the shuffled residents for all of them; pairs' sums over slices come last. At home each group also meets its language's vector, and a heap keeps its best `most` terms of the slice.

So the largest thing in a task is two seats' vectors of a slice, and the work is sources squared times terms, as the result asks for. Null text, language and source count as ''. Groups without
kept terms take part with counts of 0; a language without kept terms gives pairs of value 0. Rows that repeat count as often as they occur; doc_id is not read. A very long text is counted by itself.
Ties go to the lesser item in UTF-8. An empty table gives an empty result. Extra input columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import stored, table

UNIT, PRIOR = 10**9, 5
#: A-Z to a-z, other ASCII that is no letter to a space; the bytes of other characters stay
_TERMS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def shares(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(UNIT * (count + PRIOR) / (n + PRIOR * v)), exact while n + PRIOR * v is below 9 * 10**15: three digits at a time."""
    whole = n + PRIOR * v
    left, out = counts.astype(np.int64) + PRIOR, np.zeros(len(counts), np.int64)
    for _ in range(3):
        out, left = 1000 * out + 1000 * left // whole, 1000 * left % whole
    return out + 1


def packed(places: np.ndarray, counts: np.ndarray, size: int) -> bytes:
    """A slice's vector: one byte for the counts' width, a bit for each of `size` places, the counts of those set."""
    bits = np.zeros(size, bool)
    bits[places] = True
    width = next(w for w in (1, 2, 4, 8) if not len(counts) or int(counts.max()) < 1 << 8 * w)
    return bytes([width]) + np.packbits(bits).tobytes() + counts[np.argsort(places)].astype(f"<u{width}").tobytes()


def unpacked(data: bytes, size: int) -> np.ndarray:
    """The counts of all `size` places."""
    ends = 1 + -(-size // 8)
    out = np.zeros(size, np.int64)
    out[np.unpackbits(np.frombuffer(data, np.uint8)[1:ends], count=size).astype(bool)] = np.frombuffer(data, f"<u{data[0]}", offset=ends)
    return out


def partner(seat, round_: int, seats):
    """Whom a seat meets in a round of the circle method: columns; seats is even."""
    turn = seats - 1
    met = F.pmod(F.lit(round_) - seat, turn)
    return F.when(seat == turn, F.pmod(F.lit(round_) * F.floor(seats / 2), turn)).when(met == seat, turn).otherwise(met).cast("int")


def counted(docs: DataFrame, most_held: int = 300_000) -> DataFrame:
    """(lang, source, term, n, docs): how often each group holds each term, and in how many of its documents."""

    def rows(held):
        langs, sources, found, n, d = [], [], [], [], []
        for (lang, source), (total, seen) in held.items():
            langs += [lang] * len(total)
            sources += [source] * len(total)
            found += total
            n += total.values()
            d += map(seen.__getitem__, total)
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        columns = [pa.array(c, t) for c, t in zip((langs, sources, found, n, d), kinds)]
        columns[2] = columns[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def run(batches):
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        room = most_held
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                words = terms(text.as_buffer().to_pybytes())
                total, seen = held[lang, source]
                before = len(total)
                total.update(words)
                seen.update(set(words))
                room -= len(total) - before
                if room < 0:
                    yield rows(held)
                    held.clear()
                    room = most_held
        yield rows(held)

    some = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return some.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _values(group: pa.Table) -> tuple[list[str], list[bytes], np.ndarray, np.ndarray]:
    order = np.argsort(np.array(group.column("source").to_pylist(), object), kind="stable").tolist()
    take = lambda c: [x for x in group.column(c).take(pa.array(order, pa.int64())).to_pylist()]
    return take("source"), take("vector"), np.array(take("total"), np.int64), np.array(take("size"), np.int64)


def _meet(lang: str, mine: pa.Table, peers: pa.Table | None, step: int = 64) -> pa.Table:
    """(lang, a, b, value) both ways for each pair of a resident and a peer, or of two residents, `step` vectors of each at a time."""
    name_a, vector_a, total_a, size_a = _values(mine)
    name_b, vector_b, total_b, _ = _values(mine if peers is None else peers)
    size, v = int(size_a[0]), int(mine.column("v")[0].as_py())
    dense = lambda vectors, totals, i: np.stack([shares(unpacked(x, size), int(n), v) for x, n in zip(vectors[i : i + step], totals[i : i + step])])
    a, b, value = [], [], []
    for i in range(0, len(name_a), step):
        left = dense(vector_a, total_a, i)
        for j in range(i if peers is None else 0, len(name_b), step):
            right = dense(vector_b, total_b, j)
            for k, row in enumerate(left):
                low = k + 1 if peers is None and i == j else 0
                f = np.abs(right[low:] - row).sum(axis=1).tolist()
                names = name_b[j + low : j + low + len(f)]
                a += [name_a[i + k]] * len(f) + names
                b += names + [name_a[i + k]] * len(f)
                value += f + f
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})


def divergence(docs: DataFrame, least_docs: int = 30, most: int = 50, slice_terms: int = 4096, rounds_at_once: int = 16) -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    some = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    counts = stored(counted(docs), "term-counts")
    by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    by_lang = stored(by_lang, "kept-terms")
    v = by_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("whole").alias("lang_total"))
    langs = some.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(v, "lang", "left").fillna(0, ["v", "lang_total"])
    langs = langs.withColumn("seats", (2 * F.ceil(F.sqrt("sources") / 2)).cast("int")).withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("v") / slice_terms)).cast("int"))
    langs = stored(langs, "languages")
    slice_ = F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice")
    place = (F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1).alias("place")
    places = stored(by_lang.join(langs.select("lang", "slices"), "lang").select("lang", "term", "whole", slice_).select("*", place), "term-places")
    # a table of its own: the joins and sums below need no second look at the terms that are not kept
    cells = stored(counts.join(places, ["lang", "term"]).select("lang", "source", "slice", "place", "n"), "kept-counts")
    groups = some.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").fillna(0, ["total"])
    seat = F.pmod(F.xxhash64("source"), F.col("seats")).cast("int").alias("seat")
    spread = groups.join(langs, "lang").select("lang", "source", "total", "v", "seats", seat, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    lists = cells.groupBy("lang", "source", "slice").agg(F.collect_list(F.struct("place", "n")).alias("cells"))
    sizes = places.groupBy("lang", "slice").agg(F.count(F.lit(1)).alias("size"), F.collect_list(F.struct("place", F.col("whole").alias("n"))).alias("cells"))
    rows = spread.join(lists, ["lang", "source", "slice"], "left").join(sizes.select("lang", "slice", "size"), ["lang", "slice"], "left").fillna(0, ["size"])
    own = sizes.join(langs, "lang").select("lang", "lang_total", "v", "seats", "slice", "size", "cells")

    def pack(batches):
        for batch in batches:
            vectors = []
            for cell, size in zip(batch.column("cells"), batch.column("size").to_pylist()):
                flat = cell.values if cell.is_valid else None
                places, n = (flat.field(k).to_numpy() for k in ("place", "n")) if flat is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                vectors.append(packed(places, n, size))
            at = batch.schema.names.index("cells")
            yield pa.RecordBatch.from_arrays([c if i != at else pa.array(vectors, pa.binary()) for i, c in enumerate(batch.columns)], [c if c != "cells" else "vector" for c in batch.schema.names])

    names = "lang string, slice int, source string, total long, v long, seats int, seat int, vector binary, size long"
    residents = stored(rows.select("lang", "slice", "source", "total", "v", "seats", "seat", "cells", "size").mapInArrow(pack, names), "residents")
    wholes = stored(own.select("lang", "slice", F.col("lang_total").alias("total"), "v", "seats", "cells", "size").mapInArrow(pack, names.replace("source string, ", "").replace("seat int, ", "")), "language-vectors")
    key = ["lang", "slice", "seat"]
    at_home = residents.groupBy(*key)

    def home(key, group):
        return _meet(key[0].as_py(), group, None)

    def meeting(key, mine, peers):
        if not mine.num_rows or not peers.num_rows:
            return _meet("", mine, None).slice(0, 0) if mine.num_rows else _NONE
        return _meet(key[0].as_py(), mine, peers)

    def best(key, mine, whole):
        out = []
        if mine.num_rows and whole.num_rows:
            size, v = whole.column("size")[0].as_py(), whole.column("v")[0].as_py()
            q = shares(unpacked(whole.column("vector")[0].as_py(), size), whole.column("total")[0].as_py(), v)
            for source, vector, total in zip(*(mine.column(c).to_pylist() for c in ("source", "vector", "total"))):
                n = unpacked(vector, size)
                more = shares(n, total, v) - q
                at = np.flatnonzero((n > 0) & (more > 0)).tolist()
                # places of a slice are in the order of its terms, so they decide ties
                out += [(source, p, int(more[p])) for p in heapq.nsmallest(most, at, key=lambda p: (-more[p], p))]
        lang, slice_ = key[0].as_py(), key[1].as_py()
        source, place, value = zip(*out) if out else ((), (), ())
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "slice": pa.array([slice_] * len(out), pa.int32()), "source": pa.array(source, pa.string()), "place": pa.array(place, pa.int32()), "value": pa.array(value, pa.int64())})

    schema = "lang string, a string, b string, value long"
    jobs = [at_home.applyInArrow(home, schema)]
    last = langs.agg(F.max("seats")).first()[0] or 0
    found = None
    for r in range(last - 1):
        met = partner(F.col("seat"), r, F.col("seats"))
        # the higher seat travels; a language with fewer seats has had its rounds
        peers = residents.where(F.col("seats") - 1 > r).withColumn("met", met).where("met < seat").drop("seat").withColumnRenamed("met", "seat")
        jobs.append(at_home.cogroup(peers.groupBy(*key)).applyInArrow(meeting, schema))
        if len(jobs) > rounds_at_once or r == last - 2:
            one = jobs[0]
            for job in jobs[1:]:
                one = one.union(job)
            sums = stored(one.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "meetings")
            found, jobs = sums if found is None else found.union(sums), []
    if found is None:
        found = stored(jobs[0], "meetings")
    pairs = found.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    seated = wholes.select("*", F.explode(F.sequence(F.lit(0), F.col("seats") - 1)).alias("seat"))
    local = at_home.cogroup(seated.groupBy(*key)).applyInArrow(best, "lang string, slice int, source string, place int, value long")
    named = local.join(places.select("lang", "slice", "place", "term"), ["lang", "slice", "place"])
    over = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    term = named.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= most)
    return pairs.withColumn("rank", F.row_number().over(over)).union(term)


_NONE = pa.table({"lang": pa.array([], pa.string()), "a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "value": pa.array([], pa.int64())})


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS read_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), words AS (
  SELECT read_no, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT read_no) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL
), p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * l.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v)::HUGEINT AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
