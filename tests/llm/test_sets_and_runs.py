"""SetSketch near copies, source divergence and periodic runs against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_operators import documents, empty, low, odd  # noqa: F401

from quillstone.llm import periodic_runs, set_sketch, source_divergence
from quillstone.llm.common import stored


def test_empty(empty):  # noqa: F811
    assert set_sketch.groups(empty).count() == 0 and set_sketch.deduplicate(empty).count() == 0
    assert source_divergence.divergence(empty).count() == 0
    assert periodic_runs.find(empty).count() == 0 and periodic_runs.collapse(empty).count() == 0


# ---- 11


def shingles(text, width=4):
    words = low(text).split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_classes(rows, least=0.8):
    """Each row's least doc_id over links of sets."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= round(100 * least) * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(rows[i][0])
    name = {i: min((x for x in classes[find(i)] if x is not None), default=None) for i in range(len(rows))}
    return Counter((rows[i][0], len(sets[i]), name[i], rows[i][0] == name[i]) for i in range(len(rows)))


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(500)}"
    return out


def families(spark):
    rng, rows = random.Random(5), []
    for f in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(60)]
        for k in range(12):
            rows.append((100 * f + k, " ".join(edited(rng, base, rng.randrange(6))), "en", "a"))
    return documents(spark, rows)


@pytest.mark.parametrize("how", [{}, {"most": 2, "block": 3}, {"most": 1, "block": 50}])
def test_set_sketch_components(spark, odd, how):  # noqa: F811
    docs = odd.union(families(spark))
    want = brute_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter(map(tuple, set_sketch.groups(docs, **how).collect())) == want


def test_set_sketch_keeps_one_of_each_class(odd):  # noqa: F811
    left = set_sketch.deduplicate(odd)
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect())
    classes = brute_classes([(r.doc_id, r.text) for r in odd.collect()])
    assert left.columns == odd.columns and {i for i, *_, kept in classes if kept or i is None} >= {None if none else i for none, i in ids}
    assert {i for i, _, name, _ in classes if i == name and i is not None} == {i for none, i in ids if not none}


def test_registers_are_mergeable_and_as_alike_as_their_sets():
    rng = np.random.default_rng(2)
    whole = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = whole[:2000], whole[1000:]
    x, y, both = set_sketch.registers([a, b, whole], 4096)
    assert (set_sketch.merged(np.stack([x, y])) == both).all()
    assert abs((x == y).mean() - 1 / 3) < 0.04
    many = [whole[i : i + 1 + i % 7] for i in range(200)]
    assert (set_sketch.registers(many, 16, step=5) == np.concatenate([set_sketch.registers([m], 16) for m in many])).all()


def test_likelihood_has_its_maximum_at_the_similarity():
    rng = np.random.default_rng(3)
    whole = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    for at, to in ((3000, 4000), (1000, 5000), (3900, 4000)):
        a, b = whole[:to], whole[to - at : to - at + 4000]
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = set_sketch.registers([a, b], 2048)
        grid = np.linspace(0, min(len(a), len(b)) / max(len(a), len(b)), 400)
        n, m = float(len(a)), float(len(b))
        best = grid[np.argmax(set_sketch.log_likelihood(grid, n, m, (x > y).sum(), (x < y).sum(), 2048))]
        assert abs(best - j) < 0.05


def test_chances_of_losing_a_link():
    """What the docstring says of similarity 0.8: no shared key, too many differing bits, an implausible sketch."""
    from math import comb

    assert (1 - 0.8**4) ** 40 < 8e-10
    assert sum(comb(64, k) * 0.1**k * 0.9 ** (64 - k) for k in range(25, 65)) < 2e-8
    n = np.array([400])
    worst = 0.0
    for equal in range(161):  # pairs of equal size: all that matters is how many registers are equal
        x, y = np.zeros((1, 160), np.uint16), np.zeros((1, 160), np.uint16)
        differ = 160 - equal
        x[0, : differ // 2], y[0, differ // 2 : differ] = 1, 1
        if not set_sketch.plausible(n, n, x, y, 0.8, 18.0)[0]:
            worst += comb(160, equal) * 0.8**equal * 0.2**differ
    assert worst < 1e-8


def test_hot_keys_leave_as_families_and_pairs_stay_few(spark):
    """A group of 300 near copies sends leaders' and tiles' edges, not its 45,000 pairs."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(300)]
    docs = documents(spark, [(i, " ".join(edited(rng, base, 1)), "en", "a") for i in range(300)])
    both = stored(set_sketch.sketches(docs, 4, 160), "t")
    keys = set_sketch.banded(both.where("sketch is not null"), 40, 4)
    held = keys.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1 and k <= 64").select("key")
    assert set_sketch.candidates(keys.join(held, "key"), 0.8, set_sketch.by_bits(24)).count() < 15_000
    assert set_sketch.groups(docs).where("component_id <> 0").count() == 0


# ---- 12


def brute_divergence(rows, least_docs, most):
    import re

    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", src or "", [w for w in word.findall(low(t).decode())]) for t, lang, src in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df, total, by = Counter(), Counter(), defaultdict(Counter)
        for _, src, words in mine:
            df.update(set(words)), total.update(words), by[src].update(words)
        kept = [t for t in df if df[t] >= least_docs]
        v = len(kept)

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept}

        q, p = share(total), {s: share(c) for s, c in by.items()}
        for s in by:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in by if o != s))
            out |= {(lang, s, "pair", o.decode(), -f, i + 1) for i, (f, o) in enumerate(pairs)}
            over = sorted((q[t] - p[s][t], t.encode()) for t in kept if by[s][t] and p[s][t] > q[t])[:most]
            out |= {(lang, s, "term", t.decode(), -f, i + 1) for i, (f, t) in enumerate(over)}
    return out


def many_sources(spark):
    rng, rows = random.Random(9), []
    words = [f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["Ärger", "漢字", "été", "a1b", "Don't"]
    for i in range(260):
        src = f"s{rng.randrange(9)}" if i % 3 else "hot"
        rows.append((i, " ".join(rng.choice(words[:: 1 + len(src) % 2]) for _ in range(rng.randint(1, 12))), "en" if i % 5 else "fr", src))
    return documents(spark, rows + [(900, None, "xx", "a"), (901, "", "xx", "b"), (902, "one two", "xx", None), (903, "three", None, None)])


@pytest.mark.parametrize("how", [{}, {"slice_terms": 3, "rounds_at_once": 2}, {"slice_terms": 1000, "rounds_at_once": 1}])
def test_divergence(spark, odd, how):  # noqa: F811
    docs = many_sources(spark).union(odd)
    want = brute_divergence([(r.text, r.lang, r.source) for r in docs.collect()], 3, 7)
    assert set(map(tuple, source_divergence.divergence(docs, 3, 7, **how).collect())) == want and len(want) > 200


def test_a_flushed_count_is_the_same(spark):
    docs = many_sources(spark)
    one, other = (sorted(map(tuple, source_divergence.counted(docs, n).collect())) for n in (5, 1_000_000))
    assert one == other


@pytest.mark.parametrize("seats", [2, 4, 6, 10])
def test_all_seats_meet_once(spark, seats):
    rows = spark.range(seats).select(F.col("id").cast("int").alias("seat"), F.lit(seats).alias("seats"))
    met = Counter()
    for r in range(seats - 1):
        got = [(x.seat, x.met) for x in rows.select("seat", source_divergence.partner(F.col("seat"), r, F.col("seats")).alias("met")).collect()]
        assert all((b, a) in got and a != b for a, b in got)
        met.update(frozenset(x) for x in got)
    assert len(met) == seats * (seats - 1) // 2 and set(met.values()) == {2}


def test_shares_are_exact_for_huge_counts():
    counts = np.array([0, 1, 10**13, 3 * 10**15], np.int64)
    assert source_divergence.shares(counts, 4 * 10**15, 1000).tolist() == [1 + 10**9 * (int(c) + 5) // (4 * 10**15 + 5000) for c in counts]


@given(st.lists(st.integers(0, 70), unique=True), st.integers(0, 2**40))
def test_vectors_unpack(places, big):
    n = np.arange(len(places), dtype=np.int64) + big + 1
    want = np.zeros(71, np.int64)
    want[places] = n
    assert (source_divergence.unpacked(source_divergence.packed(np.array(places, np.int64), n, 71), 71) == want).all()


# ---- 13


def brute_runs(x, least, exponent):
    n, out = len(x), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i:
                start, end = i, j + q
                if end - start >= max(least, exponent * q) and not any(all(x[a] == x[a + t] for a in range(start, end - t)) for t in range(1, q)):
                    out.append((start, end - start, q))
            i = j + 1
    return sorted(out)


pieces = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9), st.integers(0, 3)), max_size=6)


@settings(max_examples=400, deadline=None)
@given(pieces, st.sampled_from([1, 6, 9]), st.sampled_from([3, 4, 5]))
def test_runs(parts, least, exponent):
    x = [w for words, times, cut in parts for w in (words * times)[: max(1, len(words) * times - cut)]]
    assert periodic_runs.runs(np.array(x, np.int64), least, exponent) == brute_runs(x, least, exponent)


def test_long_repeats_are_one_run():
    for q in (1, 3, 1000):
        x = np.tile(np.random.default_rng(q).permutation(q), 200_000 // q)
        assert periodic_runs.runs(x) == [(0, len(x), q)]
    assert periodic_runs.runs(np.arange(100_000)) == []


def test_find_and_collapse(spark, odd):  # noqa: F811
    docs = odd.union(documents(spark, [(200, "x A b A b A b A b\tA c", "en", "a"), (201, "no no no no no no  way", "en", "a"), (201, "no no no no no no  way", "en", "a")]))
    rows = docs.collect()
    want = Counter()
    for r in rows:
        names = {}
        x = [names.setdefault(w, len(names)) for w in (r.text or "").encode().split()]
        want.update((r.doc_id, *run) for run in (brute_runs(x, 6, 4) if r.doc_id not in (103, 104) else [(0, 30_000, 1)]))
    got = periodic_runs.find(docs)
    assert Counter((g.doc_id, g.start, g.length, g.period) for g in got.collect()) == want
    left = periodic_runs.collapse(docs)
    by = {r.doc_id: r for r in left.collect()}
    assert left.schema == docs.schema and by[200].text == "x A b c" and by[201].text == "no way" and by[103].text == "word" and by[100].text is None
    assert by[102].text == "  \n\t " and by[200].lang == "en" and left.count() == len(rows)


def test_digest_of_runs(spark, sf_dir):
    """The query against brute force on the whole table, planted repeats included."""
    got = {r.doc_id: r for r in periodic_runs.op13_periodic_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    seen = 0
    for d in docs:
        words = (d.text or "").encode().split()
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 700:  # brute force is quadratic
            continue
        names = {}
        found = brute_runs([names.setdefault(w, len(names)) for w in words], 6, 4)
        seen += len(found)
        drop = {i for s, size, q in found for i in range(s + q, s + size)}
        top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        g = got[d.doc_id]
        assert (g.n_runs, g.start, g.length, g.period) == (len(found), *top)
        assert g.exponent_milli == (1000 * top[1] // top[2] if found else None)
        assert g.runs_sha256 == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()).hexdigest()
        assert g.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest()
    assert seen > 5
