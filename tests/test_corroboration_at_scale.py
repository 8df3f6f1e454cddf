"""Large elements by joins and rounds against going through their facts one by one."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions.text import fact_words
from quillstone.operators import corroboration

COLUMNS = "rewrite_id string, source_ord int, fact_ord int, source_id string, url string, element string, fact string, confidence string"


def made(rng, n, words, groups=3):
    def fact():
        return " ".join(rng.choice(words) for _ in range(rng.randint(0, 7)))

    kept = [fact() for _ in range(max(2, n // 6))]
    return [(f"w{rng.randrange(groups)}" if i % 50 else None, i // 9, i % 9, f"s{i // 9}", f"u{rng.randrange(6)}" if i % 40 else None, rng.choice(["bio", None]), rng.choice(kept) + rng.choice(["", " " + rng.choice(words)]), rng.choice(["high", "medium", "low", "odd", None])) for i in range(n)]


def plain(rows):
    return sorted((str(r.rewrite_id), str(r.element), str(r.fact), str(r.confidence), tuple(map(str, r.source_ids)), tuple(map(str, r.source_urls)), r.corroborated) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_and_rounds_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    facts = spark.createDataFrame(made(rng, 500, [f"word{i}" for i in range(12 * seed)]), COLUMNS)
    want = plain(corroboration.corroborate(facts).collect())
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)
    for most in (0, 80):
        assert plain(corroboration.corroborate(facts, most=most).collect()) == want


def test_a_chain_settles(spark):
    """Each fact is alike the next: heads and others take turns along the chain."""
    facts = spark.createDataFrame([("w", i, 0, f"s{i}", f"u{i}", "bio", f"aaa{i} bbb{i} aaa{i + 1} bbb{i + 1}", "low") for i in range(14)], COLUMNS)
    got = corroboration.corroborate(facts, least=0.3, most=0).collect()
    assert plain(got) == plain(corroboration.corroborate(facts, least=0.3).collect()) and sorted(len(r.source_ids) for r in got) == [2] * 7


def test_a_group_of_a_hundred_thousand(spark):
    rng = random.Random(5)
    words = [f"w{i:05}" for i in range(60_000)]
    kept = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(40_000)]
    rows = [("r", i, 0, f"s{i}", f"u{i % 5000}", "bio", f"{rng.choice(kept)} {rng.choice(words)}", rng.choice(["high", "low"])) for i in range(100_000)]
    facts = spark.createDataFrame(rows, COLUMNS)
    got = corroboration.corroborate(facts)
    tokens = {r.source_ord: r.w for r in facts.select("source_ord", fact_words(F.col("fact")).alias("w")).collect()}
    want = corroboration._stars([("r", "bio", s, u, f, c, tokens[i]) for _, i, _, s, u, _, f, c in rows], 0.4)
    assert plain(got.collect()) == sorted(("r", "bio", f, c, tuple(s), tuple(u), x) for f, c, s, u, x in want)
