"""Names by keys and rounds: hot last names, long names, chains of rows that wait for each other."""

import random
from collections import defaultdict

from pyspark.sql import functions as F
from test_sources import plain_match

from quillstone.functions.text import loose_signature
from quillstone.operators import matching


def frames(spark, home, rival):
    return spark.createDataFrame(home, "slug string, name string"), spark.createDataFrame(rival, "rival_id string, name string")


def matched(spark, home, rival, most=0):
    """In rounds, whatever the blocks' sizes, unless said otherwise."""
    return {r.slug: (r.rival_id, r.match_confidence) for r in matching.match(*frames(spark, home, rival), most).collect()}


def edited(rng, word, letters):
    k, i = rng.randrange(3), rng.randrange(len(word) + 1)
    return word[:i] + (rng.choice(letters) if k < 2 else "") + word[i + (k > 0) :]


def test_pairs_are_all_within_two_edits(spark):
    """Short and long middles against every pair of a block."""
    rng = random.Random(3)
    names = set()
    for n in (0, 1, 2, 5, 38, 39, 40, 41, 42, 43, 44, 45, 90):
        base = "".join(rng.choice("ab") for _ in range(n))
        for k in range(12):
            word = base
            for _ in range(k % 4):
                word = edited(rng, word, "abc")
            names.add(f"x{word} ek")
    names |= {"xa jo ek", "xa lee jo ek", "xa lee jo max ek", "xa lee jo max tom ek", "xa ek", "x ek", "xa jo lee ek"}
    rows = spark.createDataFrame([(n, n) for n in sorted(names)], "who string, key string").withColumn("block", loose_signature(F.col("key")))
    got = {(r.home_key, r.rival_key, r.near, r.distance) for r in matching.candidates(rows, rows).collect()}
    a, b = (rows.select("block", F.col("key").alias(c)) for c in ("h", "r"))
    every = a.join(b, "block").select("h", "r", ((F.col("h") == F.col("r")) | matching.in_order(F.col("h"), F.col("r"))).alias("near"), F.levenshtein("h", "r", 2).alias("d")).where("near or d >= 0")
    assert got == {tuple(r) for r in every.collect()} and len(got) > 500


def test_chains_and_equal_names(spark):
    """Rows that free or take each other's rivals in a chain, and many rows of one name."""
    step = lambda i: "b" * i
    home = [(f"s{99 - i:03}", f"xa{step(i)} ek") for i in range(30)] + [(f"t{i:02}", "bo lee") for i in range(20)]
    rival = [(f"r{i:03}", f"xa{step(i)}c ek") for i in range(28)] + [("r900", "bo lee"), ("r901", "bo leo"), ("r902", "bo b lee")]
    assert matched(spark, home, rival) == plain_match(home, rival)
    rng = random.Random(8)
    for _ in range(1):
        home = [(f"s{rng.randrange(10**6):06}", f"x{rng.choice(['', 'a', 'b', 'ab', 'aa', 'ba'])} {rng.choice(['', 'jo '])}ek") for _ in range(60)]
        home = [(s, " ".join(n.split())) for s, n in dict(home).items()]
        rival = [(f"r{i}", " ".join(f"x{rng.choice(['', 'a', 'b', 'ab', 'bb'])} {rng.choice(['', 'jo '])}ek".split())) for i in range(40)]
        want = plain_match(home, rival)
        for most in (0, 40, 10_000):  # rounds alone, both ways, row by row alone
            assert matched(spark, home, rival, most) == want


def one_by_one(home, rival):
    """plain_match for two-word names of one last name and first letter, with neighbours from deletions."""

    def left(word, n=2):
        out, now = {word}, {word}
        for _ in range(n):
            now = {w[:i] + w[i + 1 :] for w in now for i in range(len(w))}
            out |= now
        return out

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    ids, by = defaultdict(list), defaultdict(set)
    for r, name in rival:
        ids[name].append(r)
    for name in ids:
        for k in left(name.split()[0][1:]):
            by[k].add(name)
    used, out = set(), {}
    for slug, name in sorted(home):
        near = {n for k in left(name.split()[0][1:]) for n in by[k]} - used
        dist = sorted((distance(n.split()[0], name.split()[0]), n) for n in near)
        dist = [(d, n) for d, n in dist if d <= 2]
        same = [n for d, n in dist if d == 0]
        far = [(d, n) for d, n in dist if d]
        far = [n for d, n in far if d == far[0][0]]
        for found, sure in ((same, "medium"), (same, "low"), (far, "low")):
            if len(found) == 1 and len(ids[found[0]]) == 1:
                out[slug] = (ids[found[0]][0], sure)
                used.add(found[0])
                break
    return out


def test_one_block_of_a_hundred_thousand(spark):
    rng, letters = random.Random(11), "abcdefghijklmnopqrst"
    words = ["".join(rng.choice(letters) for _ in range(7)) for _ in range(50_000)]
    home = [(f"s{i:06}", f"x{w} ek") for i, w in enumerate(words)] + [(f"s{rng.randrange(50_000):06}b", f"x{edited(rng, rng.choice(words), letters)} ek") for _ in range(50_000)]
    home = list(dict(home).items())
    rival = [(f"r{i:06}", f"x{edited(rng, w, letters) if i % 3 else w} ek") for i, w in enumerate(words)] + [(f"q{i:06}", f"x{edited(rng, edited(rng, w, letters), letters)} ek") for i, w in enumerate(words[:50_000:2])]
    want = one_by_one(home, rival)
    assert matched(spark, home, rival) == want and len(want) > 40_000
