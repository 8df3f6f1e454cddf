"""Facts that several sources state.

Within an element of a rewrite, in the order given, a fact gathers the later facts of other addresses whose words are alike
(Jaccard at least 0.4 to it, not to each other). The group speaks with its surest fact and is corroborated by two distinct addresses.

Elements of some thousand facts at most are gone through one by one, many to a task. For larger ones alike facts are found by joins: each fact's words stand in one order, rare ones first, and two alike
facts share a word among the first n - ceil(0.4 n) + 1 of both. Heads are then settled in rounds: a fact with a head among its earlier neighbours is no head, one all of whose earlier neighbours are no
heads is one, and the others wait for the next round. A fact that is no head belongs to the first head that it is alike.
"""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import fact_words
from quillstone.operators.grouping import map_groups
from quillstone.sources.shared import remove, stored, stored_at

SURE = {"high": 0, "medium": 1, "low": 2}
SCHEMA = "rewrite_id string, element string, fact string, confidence string, source_ids array<string>, source_urls array<string>, corroborated boolean"
GROUP = ["rewrite_id", "element"]


def _stars(rows: list[tuple], least: float) -> list[tuple]:
    words, taken, out, later = [set(r[-1]) for r in rows], set(), [], defaultdict(list)
    for i in reversed(range(len(rows))):
        for w in words[i]:
            later[w].append(i)
    for i, (_, _, source, url, fact, confidence, _) in enumerate(rows):
        for w in words[i]:
            later[w].pop()  # itself: each word's facts after this one are left
        if i in taken:
            continue
        star = [(SURE.get(confidence, 3), fact, confidence, source, url)]
        shared = Counter(j for w in words[i] for j in later[w])
        for j in sorted(shared):
            if j not in taken and rows[j][3] != url and shared[j] >= least * (len(words[i]) + len(words[j]) - shared[j]):
                taken.add(j)
                star.append((SURE.get(rows[j][5], 3), rows[j][4], rows[j][5], rows[j][2], rows[j][3]))
        _, fact, confidence, _, _ = min(star, key=lambda r: r[0])
        urls = list(dict.fromkeys(r[4] for r in star))
        out.append((fact, confidence, list(dict.fromkeys(r[3] for r in star)), urls, len(urls) >= 2))
    return out


def alike(facts: DataFrame, least: float = 0.4) -> DataFrame:
    """(a, b): pairs of facts (group, at, url, words) of one group and two addresses whose words have a Jaccard similarity of `least`, a before b."""
    words = facts.select("group", "at", "url", F.size("words").alias("n"), F.explode("words").alias("word"))
    counts = words.groupBy("group", "word").agg(F.count(F.lit(1)).alias("k")).where("k > 1")  # a word of one fact brings nobody together
    placed = words.join(counts, ["group", "word"]).groupBy("group", "at", "url", "n").agg(F.sort_array(F.collect_list(F.struct("k", "word"))).alias("ranked"))
    # words that no other fact has come first of all, and count in the prefix
    alone = F.col("n") - F.size("ranked")
    first = F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1 - alone
    rows = placed.where(first > 0).select("group", "at", "url", "n", F.posexplode(F.slice("ranked", F.lit(1), first.cast("int"))).alias("i", "r"), alone.alias("alone"), F.col("ranked.word").alias("words"))
    rows = rows.select("group", "at", "url", "n", F.col("r.word").alias("word"), (F.col("alone") + F.col("i")).alias("place"), "words")
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, ["group", "word"]).where("a.at < b.at").where(~F.col("a.url").eqNullSafe(F.col("b.url")))
    both = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))  # no more words than from here on
    enough = lambda k: k + 1e-9 >= least * (F.col("a.n") + F.col("b.n") - k)
    met = met.where(enough(both)).where(enough(F.size(F.array_intersect("a.words", "b.words"))))
    return met.select(F.col("a.at").alias("a"), F.col("b.at").alias("b")).distinct()


def heads(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(at, head): each fact's head, itself where it is one."""
    settled = ids.join(pairs.select(F.col("b").alias("at")).distinct(), "at", "left_anti").select("at", F.lit(True).alias("is_head"))
    settled, path = stored_at(settled, "settled")
    done = -1
    while True:
        n = settled.count()
        if n == done:
            break
        done = n
        seen = pairs.join(settled.select(F.col("at").alias("b")), "b", "left_anti").join(settled.select(F.col("at").alias("a"), "is_head"), "a", "left")
        state = seen.groupBy(F.col("b").alias("at")).agg(F.max(F.coalesce("is_head", F.lit(False))).alias("taken"), F.max(F.col("is_head").isNull()).alias("waits"))
        new = state.where(F.col("taken") | ~F.col("waits")).select("at", (~F.col("taken")).alias("is_head"))
        last = path
        settled, path = stored_at(settled.union(new), "settled")
        remove(settled.sparkSession, last)
    leads = settled.where("is_head").select("at")
    first = pairs.join(leads.withColumnRenamed("at", "a"), "a", "left_semi").groupBy(F.col("b").alias("at")).agg(F.min("a").alias("head"))
    members = first.join(leads, "at", "left_anti")
    return leads.select("at", F.col("at").alias("head")).union(members)


def _large(rows: DataFrame, least: float) -> DataFrame:
    """corroborate() for groups of any size."""
    order = F.struct("source_ord", "fact_ord", "read").alias("at")
    facts = stored(rows.withColumn("read", F.monotonically_increasing_id()).select(F.struct(*GROUP).alias("group"), order, "source_id", "url", "fact", "confidence", "words"), "facts")
    # places are compared within a group only, but name a fact in all of them by `read`
    pairs = stored(alike(facts.where(F.size("words") > 0), least), "alike")
    of = stored(heads(facts.select("at"), pairs), "heads")
    sure = F.coalesce(*[F.when(F.col("confidence") == k, v) for k, v in SURE.items()], F.lit(3))
    member = F.struct((F.col("at") != F.col("head")).alias("later"), "at", sure.alias("sure"), "fact", "confidence", "source_id", "url")
    stars = facts.join(of, "at").groupBy("group", "head").agg(F.sort_array(F.collect_list(member)).alias("star"), F.min_by(F.struct("fact", "confidence"), F.struct(sure, F.col("at") != F.col("head"), "at")).alias("best"))
    urls = F.array_distinct("star.url")
    return stars.select("group.*", "best.fact", "best.confidence", F.array_distinct("star.source_id").alias("source_ids"), urls.alias("source_urls"), (F.size(urls) >= 2).alias("corroborated"))


def corroborate(facts: DataFrame, least: float = 0.4, most: int = 5000) -> DataFrame:
    """facts: (rewrite_id, source_ord, fact_ord, source_id, url, element, fact, confidence). A group is one profile's research on one element; groups of more than `most` facts are no task's work."""
    rows = facts.select("rewrite_id", "element", "source_id", "url", "fact", "confidence", fact_words(F.col("fact")).alias("words"), "source_ord", "fact_ord")
    step = lambda df: map_groups(df, GROUP, ["source_ord", "fact_ord"], lambda key, group: [key + star for star in _stars([r[:7] for r in group], least)], SCHEMA)
    large = stored(facts.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*[F.col(c).alias(f"l_{c}") for c in GROUP]), "large-groups")
    if large.isEmpty():
        return step(rows)
    same = F.col("rewrite_id").eqNullSafe(F.col("l_rewrite_id")) & F.col("element").eqNullSafe(F.col("l_element"))
    return step(rows.join(large, same, "left_anti")).union(_large(rows.join(large, same, "left_semi"), least))


def from_sources(sources: DataFrame) -> DataFrame:
    """facts rows from (rewrite_id, source_ord, source_id, result_url, facts array<struct<element, fact, confidence>>); null arrays have none."""
    rows = sources.select("rewrite_id", "source_ord", "source_id", F.col("result_url").alias("url"), F.posexplode("facts").alias("fact_ord", "f"))
    return rows.select("rewrite_id", "source_ord", "fact_ord", "source_id", "url", "f.element", "f.fact", "f.confidence")


def fact_total(sources: DataFrame) -> DataFrame:
    return sources.agg(F.coalesce(F.sum(F.coalesce(F.size("facts"), F.lit(0))), F.lit(0)).alias("facts"))
