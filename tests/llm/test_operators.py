"""The training-data operators against brute force on small fixtures with nulls, empties, repeats, ties and clashing columns."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import exact_dedup, language_id, lm_scoring, mixing, near_copies, packing, quality, sharding, shingles, simhash, token_files, vector_search
from quillstone.llm.common import keyed_texts, running, shared_dir, sums_before
from quillstone.llm.tokens import Encoder, default_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, shard string, block string, fp string"
LONG = "word " * 30_000


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns clash with the operators' own names."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), "x", "x", "x", "x", "x") for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    words = ["the", "of", "and", "ñandú", "Straße", "漢字", "a1", "x_y", "don't"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40))), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(40)]
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, "  \n\t ", "en", "a"), (103, LONG, "en", "a"), (104, LONG.upper(), "de", "b"), (105, "Same Text", "en", "a"), (106, "same text", "en", "a"), (107, "same text", "en", "b"), (107, "same text", "en", "b"), (108, "é", "fr", "c"), (109, "É", "fr", "c"), (None, "no id", "en", "a")]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return (text or "").encode().lower()


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dedup.verdicts(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0
    assert packing.pack(empty).count() == 0 and mixing.schedule(empty).count() == 0 and sharding.assign(empty).count() == 0
    assert simhash.groups(empty).count() == 0 and near_copies.groups(empty).count() == 0 and lm_scoring.score(empty).count() == 0
    assert quality.keep_good(empty, labels).count() == 0 and language_id.identify(empty, language_id.train(empty)).count() == 0
    assert vector_search.search(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_sweep_deletes_what_queries_left(spark, odd):
    from pathlib import Path

    from quillstone.llm import common

    kept = simhash.groups(odd)
    path = Path(common._made[-1].removeprefix("file://"))
    assert path.exists() and kept.count() and common.sweep(spark) > 0
    assert not path.exists() and common.sweep(spark) == 0


def test_bounds_hold_for_repeated_rows_and_small_blocks(spark):
    """A language of one text in many rows is learned from one row; blocks that are asked for too small are raised."""
    docs = documents(spark, [(1, "uno dos tres cuatro", "es", "a")] * 400 + [(i, f"one two three {i}", "en", "b") for i in range(2, 60)])
    codes = language_id.train(docs, per_lang=5)
    assert set(codes.langs) == {"es", "en"}
    blocks = mixing.schedule(docs, block_bytes=1, most_blocks=10).select("source", "block").distinct().count()
    assert blocks <= 3 * 10


def test_empty_token_files(spark, empty, tmp_path):
    path = str(tmp_path / "t")
    token_files.write(empty, path, default_vocabulary())
    assert token_files.digest(spark, path).count() == 0


# ---- 1


def test_exact_dedup(odd):
    rows = odd.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[low(r.text)].append(r.doc_id)
    got = exact_dedup.verdicts(odd, chunk_bytes=1000).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(k).hexdigest(): v for k, v in groups.items()}
    for g in got:
        members = by_sha[g.text_sha256]
        ids = [i for i in members if i is not None]
        assert g.doc_id in members and g.group_size == len(members) and g.keep_id == (max(ids) if ids else None) and g.kept == (g.doc_id == g.keep_id)
    left = [r.doc_id for r in exact_dedup.deduplicate(odd).collect()]
    assert set(left) == {max((i for i in v if i is not None), default=None) for v in groups.values()} and odd.columns == exact_dedup.deduplicate(odd).columns


def test_collisions_are_split(odd, monkeypatch):
    """With a fingerprint of length alone, all texts of one length collide, and the results stay the same."""
    want = sorted(map(str, exact_dedup.verdicts(odd).collect()))
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda docs, n, f=exact_dedup.fingerprints: f(docs, n).withColumns({"h1": F.lit(1).cast("long"), "h2": F.lit(1).cast("long")}))
    assert sorted(map(str, exact_dedup.verdicts(odd, chunk_bytes=7).collect())) == want


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300), st.integers(1, 50))
def test_fingerprints_compose(a, b, size):
    poly, whole = exact_dedup.Polynomial(size), exact_dedup.Polynomial(1000)
    arr = lambda x: np.frombuffer(x, np.uint8)
    assert poly.combine(poly.text(arr(a)), poly.text(arr(b)), len(b)) == whole.text(arr(a + b))
    value = 0
    for c in a + b:
        value = (value * exact_dedup.BASES[0] + c + 1) % exact_dedup.PRIMES[0]
    assert whole.text(arr(a + b))[0] == value


# ---- 2, 9


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\t\r\x1c\xa0abZé1'.,s!漢🙂<|>endoftx", max_size=60))
def test_tokens_equal_the_library(text):
    enc = test_tokens_equal_the_library.__dict__.setdefault("enc", Encoder(default_vocabulary(), memo_bytes=60_000))
    assert np.frombuffer(enc.raws([text, text])[1], enc.dtype).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def library_ids(text, end):
    from tokenizers import Tokenizer

    if "t" not in library_ids.__dict__:
        library_ids.t = Tokenizer.from_file(default_vocabulary())
        library_ids.t.encode_special_tokens = True
    t = library_ids.t
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(odd):
    got = packing.pack(odd, length=64, block_rows=100).collect()
    want = Counter()
    for r in odd.collect():
        ids = library_ids(r.text, 2)
        n = len(ids)
        cuts = [0, *range(n % 64 or 64, n, 64), n]
        want.update((r.doc_id, k, i, j - i, zlib.crc32(ids[i:j].tobytes())) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])))
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    bins = defaultdict(list)
    for g in got:
        bins[g.sequence_id].append((g.offset, g.length))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(np.cumsum([0] + [n for _, n in pieces])[:-1]) and sum(n for _, n in pieces) <= 64
    total = sum(g.length for g in got)
    assert len(bins) <= 1.05 * math.ceil(total / 64) + 1


@pytest.mark.parametrize("rule, most_docs, most_cost", [("norm", 3, None), ("dot", 3, None), ("norm", None, 700.0), ("dot", 5, 900.0)])
def test_packing_under_binding_caps(spark, rule, most_docs, most_cost):
    """Document and cost caps bind: no sequence breaks one, none is open to a piece it could still take of the least cost, and every piece is there once."""
    rng = random.Random(9)
    rows = [(i if i % 5 else None, " ".join("word" for _ in range(rng.randint(0, 30))), "en", "a") for i in range(400)] + [(77, "word word", "en", "a")] * 50
    got = packing.pack(documents(spark, rows), length=64, most_docs=most_docs, most_cost=most_cost, rule=rule, block_rows=150).collect()
    assert len(got) == 450 and {g.piece for g in got} == {0}
    bins = defaultdict(list)
    for g in got:
        bins[g.sequence_id].append((g.offset, g.length))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(np.cumsum([0] + [n for _, n in pieces])[:-1]) and sum(n for _, n in pieces) <= 64
        assert len(pieces) <= (most_docs or 64) and (len(pieces) == 1 or sum(n * n for _, n in pieces) <= (most_cost or 64**2))
    assert max(len(p) for p in bins.values()) == most_docs or most_cost
    unbound = {g.sequence_id for g in packing.pack(documents(spark, rows), length=64, block_rows=150).collect()}
    assert len(bins) > len(unbound)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_best_fit_keeps_every_constraint(rule):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 400)
    bins, offsets = packing.vector_best_fit(lengths, 100, 3, 6000.0, rule)
    for b in np.unique(bins):
        mine = lengths[bins == b]
        assert mine.sum() <= 100 and len(mine) <= 3 and ((mine.astype(float) ** 2).sum() <= 6000 or len(mine) == 1)
        order = np.argsort(offsets[bins == b])
        assert offsets[bins == b][order].tolist() == np.cumsum(np.r_[0, mine[order][:-1]]).tolist()
    assert packing.vector_best_fit(np.zeros(0, int), 100, 3, 1.0)[0].tolist() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=50))
def test_codes_round_trip(values):
    control, data = token_files.pack_codes(np.array(values, np.uint32))
    assert token_files.unpack_codes(control, data, len(values)).tolist() == values and len(control) == -(-len(values) // 4)


def test_token_files(spark, odd, tmp_path):
    path = str(tmp_path / "t")
    token_files.write(odd, path, default_vocabulary(), part_bytes=20_000, block_ids=500)
    rows = sorted(odd.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id))
    got = sorted(token_files.digest(spark, path).collect(), key=lambda r: r.start)
    assert [g.doc_id for g in got] == [r.doc_id for r in rows]
    at = 0
    for g, r in zip(got, rows):
        ids = library_ids(r.text, 0)
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert spark.read.parquet(path).where("block >= 0").count() > 3


def test_token_files_of_many_parts_and_equal_ids(spark, tmp_path):
    """A third of the rows without doc_id, a third with one doc_id: parts stay small, and starts are gapless in order of doc_id."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"word {i % 50} of many", "en", "a") for i in range(3000)]
    path = str(tmp_path / "t")
    token_files.write(documents(spark, rows), path, default_vocabulary(), part_bytes=6000, block_ids=20, part_ids=60)
    got = sorted(token_files.digest(spark, path).collect(), key=lambda r: r.start)
    names = [-1 if g.doc_id is None else g.doc_id for g in got]
    assert names == sorted(-1 if r[0] is None else r[0] for r in rows)
    assert [g.start for g in got] == np.cumsum([0] + [g.n_tokens for g in got])[:-1].tolist()
    want = Counter((r[0], zlib.crc32(library_ids(r[1], 0).tobytes())) for r in rows)
    assert Counter((g.doc_id, g.ids_crc32) for g in got) == want
    files = spark.read.parquet(path)
    assert files.where("block = -1").count() > 150 and files.where("block >= 0").groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0), lambda a, x: a + x)).alias("n")).agg(F.max("n")).first()[0] < 200


def test_sums_before(spark):
    got = sums_before(spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n")).where("k % 3 = 0"), "k", "n", "b", most=10).collect()
    total = 0
    for r in sorted(got):
        assert r.b == total
        total += r.k % 7


# ---- 3


def test_pfair_stays_within_one_block():
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    plan = mixing.pfair({s: 1000 for s in weights}, weights)
    seen = Counter()
    for t, (s, k, release, deadline, slot) in enumerate(plan):
        assert slot == t and k == seen[s] and release <= slot < deadline
        seen[s] += 1
        assert all(abs(seen[x] - w * (t + 1)) < 1 for x, w in weights.items())
    small = mixing.whole_plan({"a": 9, "b": 2}, {"a": 1.0, "b": 1e-7})
    assert [p[0] for p in small] == ["a"] * 9 + ["b"] * 2 or sorted(p[:2] for p in small) == [("a", k) for k in range(9)] + [("b", 0), ("b", 1)]
    assert mixing.pfair({}, {}) == [] and mixing.pfair({"a": 3}, {"a": 1.0, "b": 0}) == [("a", k, k, k + 1, k) for k in range(3)]


def test_a_source_that_runs_out_leaves_its_share():
    """Every block gets a slot, and at every slot every source is within one block of what an even flow gives it."""
    blocks = {"hot": 1320, "tiny": 1} | {f"s{i}": 200 + 37 * i for i in range(10)}
    weights = {s: n**0.7 for s, n in blocks.items()} | {"absent": 40.0, "none": 0.0}
    plan = mixing.whole_plan(blocks, weights)
    assert sorted(p[:2] for p in plan) == sorted((s, k) for s, n in blocks.items() for k in range(n))
    assert [p[4] for p in plan] == list(range(len(plan))) and all(release <= slot < deadline for _, _, release, deadline, slot in plan)
    seen, flow = Counter(), dict.fromkeys(blocks, 0.0)
    for s, *_ in plan:
        seen[s] += 1
        slot = 1.0
        while slot > 1e-9:  # the flow of one slot, in steps up to the next source's end
            active = [x for x in blocks if blocks[x] - flow[x] > 1e-9]
            whole = sum(weights[x] for x in active)
            step = min([slot] + [(blocks[x] - flow[x]) * whole / weights[x] for x in active])
            for x in active:
                flow[x] += step * weights[x] / whole
            slot -= step
        assert all(abs(seen[x] - flow[x]) < 1 + 1e-6 for x in blocks)


def test_mixing_keeps_every_row(spark):
    df = documents(spark, [(i, "word " * 20, "en", "small" if i < 3 else "hot") for i in range(300)] + [(900, None, None, None)])
    assert mixing.schedule(df, block_bytes=200).where("kept").count() == 301
    assert sorted(r.doc_id for r in mixing.mix(df, block_bytes=200).collect()) == [*range(300), 900]


def test_mixing_of_many_sources(spark):
    df = spark.range(12_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 20).alias("text"), F.when(F.col("id") < 11_000, F.concat(F.lit("host"), "id")).otherwise("hot").alias("source"))
    got = mixing.schedule(df, block_bytes=6000).toPandas()
    assert len(got) == 12_000 and got["kept"].all() and got["source"].nunique() == 11_001
    sizes = got.groupby("slot")["bytes"].sum()
    assert sizes.max() < 6000 + 60 and (got.groupby("source")["slot"].nunique().drop("hot") == 1).all()
    some = mixing.schedule(df, {"hot": 1.0, "host1": 0.5, "host2": 0.5}, block_bytes=6000).where("kept").toPandas()
    assert len(some) == 1002 and set(some["source"]) == {"hot", "host1", "host2"}


def brute_edf(blocks, weights):
    """(source, block) -> (release, deadline, slot), slot by slot: windows from the even flow, walked from one source's end to the next."""
    total = sum(blocks[s] for s in blocks if weights.get(s, 0) > 0)
    w = {s: Fraction(max(1, round(weights[s] / max(weights.values()) * 10**12))) for s in blocks if weights.get(s, 0) > 0}
    done, at, window = dict.fromkeys(w, Fraction(0)), Fraction(0), {}
    while any(done[s] < blocks[s] for s in w):
        active = [s for s in w if done[s] < blocks[s]]
        whole = sum(w[s] for s in active)
        step = min((blocks[s] - done[s]) * whole / w[s] for s in active)
        for s in active:
            k = math.ceil(done[s])
            while k <= done[s] + step * w[s] / whole:
                window.setdefault((s, k), at + (k - done[s]) * whole / w[s])
                k += 1
            done[s] += step * w[s] / whole
        at += step
    left, out = {(s, k) for s in w for k in range(blocks[s])}, {}
    for slot in range(total):
        due, s, k = min((math.ceil(window[s, k + 1]), s, k) for s, k in left if math.floor(window[s, k]) <= slot)
        out[s, k] = (math.floor(window[s, k]), due, slot)
        left.remove((s, k))
    return out


def test_mixing(spark, odd):
    """The schedule of a table equals a slot-by-slot one, and the stream's bytes stay within a block and a document of each share."""
    rng = random.Random(12)
    rows = [(i if i % 9 else None, "x" * rng.choice([0, 5, 40, 90, 400]), "en", "hot" if i % 3 == 0 else rng.choice("abc")) for i in range(600)] + [(5, "same", "en", "hot")] * 80
    df, block = documents(spark, rows), 200
    given = {"hot": 0.5, "a": 0.2, "b": 0.2, "c": 1e-7}
    for weights in (None, given):
        got = mixing.schedule(df, weights, block_bytes=block).collect()
        assert len(got) == len(rows)
        size = Counter()
        for g in got:
            size[g.source] += g.bytes
        blocks = {s: -(-n // block) for s, n in size.items()}
        want = brute_edf(blocks, weights or {s: (n / block) ** 0.7 for s, n in size.items()})
        assert {(g.source, g.block, g.release, g.deadline, g.slot) for g in got} <= {(*k, *v) for k, v in want.items()}
        for s in size:  # blocks follow each other: each but an overflowed one ends within a document of its end
            mine, total = sorted((g.block, g.bytes) for g in got if g.source == s), 0
            for k, n in mine:
                assert total < (k + 1) * block
                total += n
            longest = max(n for _, n in mine)
            for k in range(blocks[s]):
                assert (k + 1) * block - size[s] % block - block < sum(n for b, n in mine if b <= k) + longest and sum(n for b, n in mine if b <= k) < (k + 1) * block + longest
    mixed = mixing.mix(df, given, block_bytes=block)
    assert mixed.columns == df.columns and mixed.count() == len(rows)
    place = {}
    for g in mixing.schedule(df, given, block_bytes=block).collect():
        place.setdefault((g.doc_id, g.source), set()).add(g.slot)
    slots = [max(place[r.doc_id, r.source]) for r in mixed.where("doc_id is not null and doc_id <> 5").collect()]
    assert slots == sorted(slots)
    some = mixing.mix(odd, {"a": 0.5, "b": 0.5}, block_bytes=60)
    assert some.columns == odd.columns and some.where("source is null or source = 'c'").count() == 0 and some.count() == odd.where("source in ('a', 'b')").count()


def test_running_numbers_a_hot_key(spark):
    df = spark.range(5000).select((F.col("id") % 7 == 0).cast("int").alias("key"), F.xxhash64("id").alias("h"), "id")
    got = running(df, "key", ["h", "id"], F.col("id"), rows_each=100).collect()
    for key in (0, 1):
        total = 0
        for r in sorted((r for r in got if r.key == key), key=lambda r: r.h % (1 << 64)):
            assert r.before == total
            total += r.id


# ---- 4


def test_vector_search(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(10, 16))
    x = centres[rng.integers(0, 10, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    x[500:900] = x[500]  # a large group of copies: ties go to the smaller vec_id
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(3000, None), (3020, [0.0] * 16), (3040, [None] * 16), (3060, [float("nan")] * 16), (3080, [float("inf")] * 16), (3100, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in vector_search.search(df, group_rows=300).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    x = x.astype(np.float32).astype(float)
    recall = []
    assert set(got) == set(range(0, 3000, 20))
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -s))[:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(score - s[v]) < 1e-9 for _, v, score in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        recall.append(len({v for _, v, _ in found} & set(best.tolist())) / 20)
    assert np.mean(recall) >= 0.9
    few = vector_search.search(spark.createDataFrame(rows[:6], df.schema), every=1).collect()
    assert Counter(r.query_id for r in few) == {i: 5 for i in range(6)}


def test_vector_search_of_odd_rows(spark):
    """Clashing column names, null and repeated vec_ids, mixed lengths, queries in several parts."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=8)], "x", 1, 2, 3) for i in range(120)]
    rows += [(None, [1.0] * 8, "x", 1, 2, 3), (40, [2.0] * 8, "x", 1, 2, 3), (40, [2.0] * 8, "x", 1, 2, 3), (200, [1.0] * 5, "x", 1, 2, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, cell int, rank int, grp int")
    known = [(i, np.array(v)) for i, v, *_ in rows if i is not None and len(v) == 8]
    want = []
    for q in range(0, 120, 20):
        mine = min(v.tolist() for i, v in known if i == q)
        best = sorted((-float(np.dot(v, mine)), i) for i, v in known if i != q)[:5]
        want += [(q, r + 1, i) for r, (_, i) in enumerate(best)]
    got = vector_search.search(df, k=5, reach=1.0, rerank=120, group_rows=30, part_queries=2).collect()
    assert sorted((g.query_id, g.rank, g.vec_id) for g in got) == want


def test_vector_recall_on_other_rows(spark):
    """A length that no number of parts divides, huge components, queries unlike the other rows."""
    rng = np.random.default_rng(5)
    n, far = 6000, rng.normal(size=(6000, 32))
    far[::20] = rng.normal(size=(300, 32)) - 3
    for x in (rng.normal(size=(n, 31)), rng.normal(size=(n, 32)) * 1e30, far, np.where(rng.random((n, 1)) < 0.5, np.ones(32), rng.normal(size=(n, 32)))):
        x = x.astype(np.float32).astype(float)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = defaultdict(set)
        for r in vector_search.search(df).collect():
            got[r.query_id].add(r.vec_id)
        recall = []
        for q in range(0, n, 20):
            s = x @ x[q]
            s[q] = -np.inf
            recall.append(len(got[q] & set(np.lexsort((np.arange(n), -s))[:20].tolist())) / 20)
        assert np.mean(recall) >= 0.95, (x.shape, np.mean(recall))


def test_vector_recall_on_the_test_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/../sf0.01/embeddings.parquet")
    rows = df.toPandas()
    x, ids = np.stack(rows["embedding"].to_numpy()).astype(float), rows["vec_id"].to_numpy()
    got = defaultdict(set)
    for r in vector_search.op4_vector_search(spark, f"{sf_dir}/../sf0.01").collect():
        got[r.query_id].add(r.vec_id)
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        recall.append(len(got[ids[q]] & set(ids[np.lexsort((ids, -s))[:20]].tolist())) / 20)
    assert np.mean(recall) >= 0.9


# ---- 5


def test_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.op5_quality(spark, f"{sf_dir}/../sf0.01").toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert ((held["predicted"] == 1) == (held["quality"] == 1)).mean() > 0.95 and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_odd_labels(spark, odd):
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert {r[0] for r in odd.select(quality.scorer(quality.train(odd, none))("text")).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (2, 1)], "doc_id long, quality int")
    assert min(r[0] for r in odd.select(quality.scorer(quality.train(odd, one))("text")).collect()) > 0.9


def test_first_trees_by_brute_force():
    """Every split of two trees of depth 2 is the best of all cuts, tried one by one."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(160, 3)), 1)
    x[:, 2] = 1.0  # no cut
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0) ^ (rng.random(160) < 0.1)).astype(float)
    got = quality.Trees.fit(x, y, rounds=2, depth=2, bins=8, rate=0.3, ridge=1.5, least=6)
    cuts = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, 9)[1:-1]).tolist())) for f in range(3)]
    margin = np.full(160, math.log(y.mean() / (1 - y.mean())))
    for t in range(2):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        nodes = {0: np.arange(160)}
        for node in range(3):
            rows, best = nodes[node], (1e-9, 0, math.inf)
            for f in range(3):
                for c in cuts[f]:
                    left = rows[x[rows, f] <= c]
                    right = rows[x[rows, f] > c]
                    if min(len(left), len(right)) >= 6:
                        gain = sum(g[r].sum() ** 2 / (h[r].sum() + 1.5) for r in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + 1.5)
                        if gain > best[0] + 1e-12:
                            best = (gain, f, c)
            assert (got.feature[t, node], got.cut[t, node]) == best[1:]
            nodes[2 * node + 1], nodes[2 * node + 2] = rows[x[rows, best[1]] <= best[2]], rows[x[rows, best[1]] > best[2]]
        for leaf in range(4):
            rows = nodes[3 + leaf]
            value = 0.3 * g[rows].sum() / (h[rows].sum() + 1.5)
            assert got.value[t, leaf] == pytest.approx(value)
            margin[rows] += value


def test_quality_of_repeated_ids_stays_bounded(spark):
    """A third of the rows share one labelled doc_id: the fit draws from them all and keeps to its bound, the same whatever the partitions."""
    rows = [(1 if i % 3 == 0 else i, f"text number {i} " * (i % 7), "en", "a") for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(600)], "doc_id long, quality int, y string")
    df = documents(spark, rows)
    a, b = (quality.train(d, labels, most_rows=100) for d in (df.repartition(2), df.repartition(9)))
    assert a.prior == b.prior and (a.cut == b.cut).all() and (a.value == b.value).all()


def test_trees_walk_like_nested_ifs():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 4))
    trees = quality.Trees.fit(x, ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float), rounds=10)
    got = trees.scores(x)
    for row, p in zip(x[:50], got[:50]):
        total = trees.prior
        for f, c, v in zip(trees.feature, trees.cut, trees.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > c[node])
            total += v[node - len(f)]
        assert abs(1 / (1 + math.exp(-total)) - p) < 1e-12
    assert (((got > 0.5) == ((x[:, 0] > 0) ^ (x[:, 1] > 0.3))).mean()) > 0.9


# ---- 6


def test_sharding(odd):
    rows = odd.collect()
    got = sharding.assign(odd, 5, grain=4).collect()
    assert sorted((str(g.doc_id), g.size, g.text_crc32) for g in got) == sorted((str(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows)
    of = defaultdict(set)
    for g in got:
        of[(g.size, g.text_crc32)].add(g.shard)
    assert all(len(v) == 1 for v in of.values())
    for shard in {g.shard for g in got}:
        assert sorted(g.slot for g in got if g.shard == shard) == list(range(sum(g.shard == shard for g in got)))


def test_shards_of_a_skewed_table_are_near_equal(spark):
    """Sizes differ by no more than the largest group or parcel; a hot group of copies and long texts among them."""
    rng = random.Random(10)
    rows = [(i, "the hot copy of many", "en", "a") if i % 20 == 0 else (i, f"{i} " + "x" * rng.choice([10, 100, 3000]), "en", "a") for i in range(3000)] + [(None, None, None, None)] * 3
    got = sharding.assign(documents(spark, rows), 8, grain=64).toPandas()
    load = got.groupby("shard")["size"].sum()
    largest = max(got.groupby("text_crc32")["size"].sum().max(), got["size"].sum() / (8 * 64) * 3)
    assert len(got) == len(rows) and len(load) == 8 and load.max() - load.min() <= largest
    assert (got.groupby("text_crc32")["shard"].nunique() == 1).all()
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard")["slot"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(50, 150))
def test_best_fit_decreasing(sizes, capacity):
    items = [(s, i) for i, s in enumerate(sizes)]
    got = sharding.best_fit_decreasing(items, capacity)
    left = []  # by a plain list: the tightest bin, the first of equals
    for s, i in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        fits = [b for b in range(len(left)) if left[b] >= s]
        if fits:
            b = min(fits, key=lambda b: (left[b], b))
        else:
            left.append(max(capacity, s))
            b = len(left) - 1
        left[b] -= s
        assert got[i] == b


def test_even_shards():
    rng = random.Random(2)
    items = [(rng.randint(1, 1000), i) for i in range(3000)]
    loads = Counter()
    for i, b in sharding.even_shards(items, 40).items():
        loads[b] += items[i][0]
    assert len(loads) == 40 and max(loads.values()) <= 1.01 * sum(s for s, _ in items) / 40


# ---- 7


def brute_components(fps, radius):
    names = sorted(fps)
    label = {i: i for i in names}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in names:
        for j in names:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: find(i) for i in names}


def test_simhash(odd):
    import xxhash

    got = {r.doc_id: r for r in simhash.groups(odd, tree_rows=3).collect()}
    fps = {}
    for r in odd.collect():
        words = low(r.text).split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles[:2000]] if len(shingles) < 2000 else None
        fp = got[r.doc_id].fp % (1 << 64)
        if h is not None:
            assert fp == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
        if r.doc_id is not None:
            fps[r.doc_id] = fp
    assert {i: got[i].component_id for i in fps} == brute_components(fps, 3)


def test_links_span_dense_balls(spark):
    """Chains and balls of fingerprints, in shards far over the tree size: the same components as by brute force."""
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {c for c in centres} | {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for c in centres for _ in range(150)}
    fps |= {rng.getrandbits(64) for _ in range(200)}
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    stars = {r.node: r.root for r in simhash.components(simhash.links(df, 3, tree_rows=16)).collect()}
    want = brute_components(signed, 3)
    got = {s: stars.get(s, s) for s in signed}
    assert len({(got[s], want[s]) for s in signed}) == len(set(want.values())) == len(set(got.values()))


def test_forest_finds_every_link():
    rng = np.random.default_rng(0)
    fps = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    fps = np.unique(np.r_[fps, fps ^ np.uint64(5), fps[:50] ^ np.uint64(1 << 60)])
    a, b = simhash.Forest(fps, np.zeros(len(fps), int)).links(3)
    near = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 3}
    assert set(zip(a.tolist(), b.tolist())) == near and len(near) > 300


def word_sets(rows, width=5):
    """Shingle sets of (key, text) rows as tuples of words."""
    out = {}
    for key, t in rows:
        words = low(t).split()
        out[key] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
    return out


def brute_classes(sets, least=0.8):
    """The first key of each key's class, by comparing all pairs."""
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    names = sorted(sets)
    for x, i in enumerate(names):
        for j in names[x + 1 :]:
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("how", [{}, {"most": 2, "block": 32}, {"most": 2, "block": 16}])
def test_near_copies(spark, odd, how):
    """Classes are the components of exact similarity, in dense groups of near copies too, whether pairs, tiles or leaders find them."""
    rng = random.Random(6)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(120)] for _ in range(3)]
    rows = []
    for i in range(240):  # chains and balls: each changes a few words of a base or of the text before
        words = list(base[i % 3])
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(120)] = f"x{rng.randint(0, 9)}"
        rows.append((1000 + i, " ".join(words), "en", "a"))
    for i in range(60):  # short texts, some with a word more than another
        rows.append((2000 + i, " ".join(f"s{i // 2}y{k}" for k in range(8 + i % 2 + i // 20)), "en", "a"))
    docs = odd.unionByName(documents(spark, rows))
    want = brute_classes(word_sets((r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()))
    got = {r.doc_id: r.class_id for r in near_copies.groups(docs, **how).collect() if r.doc_id is not None}
    assert got == want and len(set(got.values())) < len(got) - 150


def test_near_copies_by_pieces_of_fingerprints(spark):
    """The stage's own SimHash step: its pairs span all fingerprints within three bits, also many sets of one fingerprint."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 62, 30)
    fps = [int(b) ^ sum(1 << int(k) for k in rng.choice(62, j % 4, replace=False)) for b in base for j in range(6)] + [int(base[0])] * 40
    known = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "id long, fp long")
    label = list(range(len(fps)))
    find = lambda x: x if label[x] == x else find(label[x])
    for r in near_copies.by_pieces(3, tree_rows=8)(known).collect():
        a, b = sorted((find(r.a), find(r.b)))
        label[b] = a
    for i, x in enumerate(fps):
        for j in range(i):
            assert (x ^ fps[j]).bit_count() > 3 or find(i) == find(j)


def test_near_copies_of_one_template(spark):
    """Pairs just above 0.8 among texts of one template at 0.75, whose distances by sketch overlap; in one tile, and in many."""
    template, rows = " ".join(f"t{i}" for i in range(104)), []
    for i in range(120):
        own = [f"o{i}x{k}" for k in range(17)]
        if i % 3 == 1:
            own[:5] = [f"o{i - 1}x{k}" for k in range(5)]
        rows.append((i, f"{template} {' '.join(own)}", "en", "a"))
    for most, block in ((1, 2048), (1, 20)):
        got = {r.doc_id: r.class_id for r in near_copies.groups(documents(spark, rows), most=most, block=block).collect()}
        assert got == {i: i - (i % 3 == 1) for i in range(120)}


def test_no_near_copy_is_lost_by_shared_ids(spark):
    """Texts that share a doc_id, repeated rows and rows without doc_id are judged by their texts; one row of each class stays."""
    one, two = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(3, one), (5, one + " more"), (5, two), (None, two + " more"), (None, "alone"), (7, "twice"), (7, "twice"), (None, "ghost"), (None, "ghost"), (9, one), (9, one), (2, ""), (4, None), (6, "   ")]
    df = documents(spark, [(i, t, "en", "a") for i, t in rows])
    for module, stays in ((near_copies, {(3, one), (5, two), (None, "alone"), (7, "twice"), (None, "ghost")}), (simhash, None), (exact_dedup, None)):
        out = module.deduplicate(df)
        left = [(r.doc_id, r.text) for r in out.collect()]
        assert out.columns == df.columns and len(left) == len(set(left))
        if module is exact_dedup:
            stays = {(9, one), (5, one + " more"), (5, two), (None, two + " more"), (None, "alone"), (7, "twice"), (None, "ghost"), (4, None), (6, "   ")}
        if module is simhash:
            prints = {(i, t): simhash.fingerprint(low(t)) for i, t in rows}
            names = {k: n for n, k in enumerate(sorted(prints, key=lambda k: (k[0] is None, k[0] or 0)))}
            label = brute_components({n: prints[k] for k, n in names.items()}, 3)
            heads = {n for n in label.values()}
            assert len(left) == len(heads) and {label[names[x]] for x in left} == heads
            continue
        empties = [x for x in left if not (x[1] or "").strip()]
        assert set(left) - set(empties) == {x for x in stays if (x[1] or "").strip()}
        assert empties == ([(2, "")] if module is near_copies else empties) and len(empties) == (1 if module is near_copies else 2)


def test_bits_are_counted_right():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 254, 255, 256, 700):
        h = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
        assert near_copies.fingerprint(h) == sum(1 << b for b in range(64) if sum(int(x) >> b & 1 for x in h) * 2 > n)
    sets = [np.unique(rng.integers(0, 90, rng.integers(0, 60)).astype(np.uint64)) for _ in range(40)]
    a, b = np.triu_indices(40, 1)
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]
    assert shingles.common_members(sets, a, b, columns=64, step=100).tolist() == want


def test_the_radius_loses_no_similar_pair():
    """The chance that fingerprints of sets of similarity 0.8 differ in more than 30 bits, for the sizes that are worst."""

    def differs(o, a, b):  # the chance that a majority bit differs: o members in common, a and b of their own
        pmf = lambda n: np.array([math.comb(n, k) / 2**n for k in range(n + 1)])
        total = 0.0
        for k, p in enumerate(pmf(o)):
            s = 2 * k - o
            x, y = (float(pmf(n)[[2 * i - n + s > 0 for i in range(n + 1)]].sum()) for n in (a, b))
            total += p * (x * (1 - y) + y * (1 - x))
        return total

    worst = max(differs(o, a, o // 4 - a) for o in range(1, 90) for a in range(o // 4 + 1))
    assert sum(math.comb(64, k) * worst**k * (1 - worst) ** (64 - k) for k in range(31, 65)) < 1e-7


# ---- 8


def brute_model(rows, weights, times=1):
    """Bigram scores with given weights, straight from the definition; every row stands for `times`."""
    tokens = [[*low(t).split(), b" end"] for _, t in rows]
    train = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for ts, on in zip(tokens, train):
        if on:
            for a, b in zip([None, *ts], ts):
                uni[b] += times
                bi[a, b] += times
                ctx[a] += times
    n, v = sum(uni.values()), len(uni)
    out = []
    for ts in tokens:
        s = 0.0
        for a, b in zip([None, *ts], ts):
            p = weights[0][0] * uni[b] / n + (1 - weights[0][0]) / (v + 1) if n else 1 / (v + 1)
            if ctx[a]:
                w = weights[1][min(int(math.log2(ctx[a])), len(weights[1]) - 1)]
                p = w * bi[a, b] / ctx[a] + (1 - w) * p
            s += math.log10(p)
        out.append((len(ts), sum(uni[t] > 0 for t in ts), n, sum(math.log10((uni[t] + 1) / (n + v + 1)) for t in ts), s))
    return out


def test_lm_scores(odd, monkeypatch):
    fitted, real = [], lm_scoring.fit_weights
    monkeypatch.setattr(lm_scoring, "fit_weights", lambda events: fitted.append(real(events)) or fitted[-1])
    got = lm_scoring.score(odd, block_bytes=20_000).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = sorted((str(i), *x) for (i, _), x in zip(rows, brute_model(rows, fitted)))
    for g, w in zip(sorted(got, key=lambda g: str(g.doc_id)), want):
        assert (str(g.doc_id), g.n_tokens, g.n_known, g.train_tokens) == w[:4]
        assert g.base_score == pytest.approx(w[4], rel=1e-9) and g.score == pytest.approx(w[5], rel=1e-9)


def test_lm_counts_beyond_32_bits(odd, monkeypatch):
    """Totals of over 2**32 stay whole: every row stands for 2**31 copies."""
    fitted, real = [], lm_scoring.fit_weights
    monkeypatch.setattr(lm_scoring, "fit_weights", lambda events: fitted.append(real(events)) or fitted[-1])
    monkeypatch.setattr(lm_scoring, "collapsed", lambda docs: keyed_texts(docs).withColumn("copies", F.lit(1 << 31).cast("long")))
    got = lm_scoring.score_distinct(odd, 2, 7, 2, 3, 20_000).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = sorted((str(i), *x) for (i, _), x in zip(rows, brute_model(rows, fitted, 1 << 31)))
    for g, w in zip(sorted(got, key=lambda g: str(g.doc_id)), want):
        assert (str(g.doc_id), g.n_tokens, g.n_known, g.train_tokens) == w[:4] and g.train_tokens > 1 << 40
        assert g.base_score == pytest.approx(w[4], rel=1e-9) and g.score == pytest.approx(w[5], rel=1e-9)


def test_lm_scores_of_repeated_rows(spark):
    rows = [(None, "the same text", "en", "a")] * 40 + [(i, f"the text {i % 3} of many", "en", "a") for i in range(30)] + [(8, "the text 2 of many", "en", "a")] * 5
    fitted = []
    real = lm_scoring.fit_weights
    lm_scoring.fit_weights = lambda events: fitted.append(real(events)) or fitted[-1]
    try:
        got = lm_scoring.score(documents(spark, rows), block_bytes=200).collect()
    finally:
        lm_scoring.fit_weights = real
    want = sorted((str(r[0]), *x) for r, x in zip(rows, brute_model([r[:2] for r in rows], fitted)))
    assert len(got) == len(rows)
    for g, w in zip(sorted(got, key=lambda g: (str(g.doc_id), g.n_tokens, g.n_known)), want):
        assert (str(g.doc_id), g.n_tokens, g.n_known, g.train_tokens) == w[:4] and g.base_score == pytest.approx(w[4], rel=1e-9) and g.score == pytest.approx(w[5], rel=1e-9)


def test_messages_are_no_more_than_ngrams_or_buckets():
    block = lm_scoring.Block([b"a b c a b", b"c c"], 2)
    assert [len(k) for k in block.keys] == [4, 8]
    for n in ([5, 2**32 - 1], [2**32, 7], []):
        assert lm_scoring._unpack_counts(lm_scoring._pack_counts(np.array(n, np.int64))).tolist() == n


def test_higher_orders_run_and_help(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    per = {}
    for order in (1, 2, 3):
        rows = lm_scoring.score(docs, order=order, block_bytes=1 << 18).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        per[order] = rows[0] / rows[2]
        base = rows[1] / rows[2]
    assert per[1] > base - 0.2 and per[2] > per[1] and per[3] > per[2] - 0.1


def test_em_finds_the_likeliest_weight():
    events = [(0, 16, 70), (0, lm_scoring.NONE, 30)]
    w = lm_scoring.fit_weights(events)[0]
    like = lambda w: 70 * math.log(w * 2 + 1 - w) + 30 * math.log(1 - w)
    assert abs(w - max(np.linspace(0.001, 0.999, 999), key=like)) < 0.01


# ---- 10


def test_language_id(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.op10_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95 and got["score"].between(0, 1).all()
    codes = language_id.train(docs)
    und = {r.doc_id for r in language_id.identify(odd, codes).where("lang_pred = 'und'").collect()}
    assert und == {100, 101, 102}
    assert language_id.train(docs.where("lang = 'en'")).langs == ["en"]


def test_language_id_by_brute_force(spark):
    """Every row of a small table as a plain decoder gives it, straight from the definition."""
    rng = random.Random(3)
    words = {lang: [f"{x}{y}{z}" for x in a for y in b for z in a] for lang, a, b in (("aa", "bdg", "ae"), ("bb", "kpt", "ou"), ("cc", "mnr", "iy"), ("dd", "szv", "éü"), ("ee", "шжц", "ая"))}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 30))) + rng.choice(["", "!", " 12", "½"]), lang, "a") for i, lang in enumerate(sorted(words) * 12)]
    rows += [(100, None, "aa", "a"), (101, "½ ²", "aa", "a"), (102, "①② 123 _", None, "a"), (103, "bab", None, "a"), (None, "pok tup", "bb", "a"), (104, "x" * 4000 + " bab", "aa", "a"), (0, rows[0][1], "aa", "a")]
    usable = [(t, lang) for i, t, lang, _ in rows if lang and t is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2)]
    langs, code = sorted(words), language_id.codewords(5)
    B = 1 << 15

    def grams(t):
        b = [x if x >= 128 or chr(x).isalpha() else 32 for x in f" {t.lower()} ".encode()]
        two = [(x * 257 + y) % 2**32 for x, y in zip(b, b[1:])]
        three = [(x * 263 + y) % 2**32 for x, y in zip(two, b[2:])]
        return [x % B for x in b[1:-1]] + [((x * 2654435761) % 2**32 >> 8) % B for x in two] + [((x * 2246822519) % 2**32 >> 7) % B for x in three]

    share = []
    for lang in langs:
        n = np.bincount([g for t, x in usable if x == lang for g in grams(t)], minlength=B)
        share.append((n + 0.5) / (n.sum() + 0.5 * B))
    share = np.array(share)
    weight = [np.log(share[code[:, b] == 1].mean(axis=0)) - np.log(share[code[:, b] == 0].mean(axis=0)) for b in range(code.shape[1])]
    margin = {t: np.array([w[grams(t)].mean() for w in weight]) * min(len(grams(t)), 300) / 10 for t in {r[1] for r in rows if r[1]}}
    margins = margin.__getitem__
    trust = np.array([[(sum((margins(t)[b] > 0) == (code[k, b] > 0) for t in mine) + 1) / (len(mine) + 2) for b in range(code.shape[1])] for k, lang in enumerate(langs) for mine in [[t for t, x in usable if x == lang]]])
    trust /= trust.sum(axis=1, keepdims=True)
    want = []
    for i, t, _, _ in rows:
        if t is None or not any(c.isalpha() for c in t):
            want.append((str(i), "und", 0.0))
            continue
        m = margins(t)
        loss = [4 * sum(trust[k, b] * math.log1p(math.exp(-m[b] if code[k, b] else m[b])) for b in range(code.shape[1])) for k in range(5)]
        p = [math.exp(-x) for x in loss]
        want.append((str(i), langs[loss.index(min(loss))], max(p) / sum(p)))
    docs = documents(spark, rows)
    got = language_id.identify(docs, language_id.train(docs)).collect()
    for g, w in zip(sorted((str(g.doc_id), g.lang_pred, g.score) for g in got), sorted(want)):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-5)
    assert sum(w[1] == "und" for w in want) == 3


def test_language_id_of_many_languages(spark):
    """No language is left out, however many there are."""
    rng = random.Random(5)
    rows = []
    for k in range(600):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(6)]
        rows += [(4 * k + j, " ".join(rng.choices(words, k=40)), f"l{k:03}", "a") for j in range(4)]
    docs = documents(spark, rows)
    codes = language_id.train(docs)
    assert len(codes.langs) == 600 and codes.weight.shape[1] < 100
    got = language_id.identify(docs, codes).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95 and got["lang_pred"].nunique() > 590


def test_codewords():
    for n in (2, 3, 4, 5, 12):
        c = language_id.codewords(n)
        assert len({tuple(r) for r in c.tolist()}) == n and (n < 3 or min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= 2)


# ---- the pipeline


def test_pipeline_keeps_what_its_stages_keep(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        before, after = ({r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in (docs, out))
        assert after.items() <= before.items(), name
        if name == "exact_dedup":
            assert len(after) == len({low(t) for t in before.values()}) == len({low(t) for t in after.values()})
        if name == "simhash":
            want = brute_classes(word_sets(before.items()))
            assert after.keys() == set(want.values())
        docs = spark.createDataFrame(out.collect(), out.schema)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert json.dumps(sorted(Counter(r.sequence_id for r in rows))) and max(r.length for r in rows) <= 1024


def test_a_run_leaves_only_the_stages_tables(spark, sf_dir):
    import os

    import corpus_pipeline

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    left = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before)
    assert left == sorted(f"stage-{name}" for name, _ in corpus_pipeline.STAGES)
