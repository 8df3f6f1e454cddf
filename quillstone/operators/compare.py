"""Comparison of linked profiles of two sources: home and rival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import arrays
from quillstone.functions.numbers import count_where, half_up
from quillstone.operators import ranks
from quillstone.operators.scoring import adjusted, rival_adjusted

CONFIDENCE = {"high": 3, "medium": 2, "low": 1}
DEPTH = {"substantive": 3, "adequate": 2, "thin": 1, "missing": 0}


def ranked_value(column: Column, ranks: dict[str, int], unknown: int | None = None) -> Column:
    return F.coalesce(*[F.when(column == k, v) for k, v in ranks.items()], F.lit(unknown))


def linked_to(links: DataFrame, rivals: DataFrame, few: int = 100_000, parts: int = 64) -> DataFrame:
    """The links to `rivals`. Up to `few` rivals go to every task; more meet the links by rival and a part of the slugs, so no rival's links gather in one task."""
    names = rivals.select("rival_id").where("rival_id is not null").distinct()
    if names.limit(few + 1).count() <= few:
        return links.join(F.broadcast(names), "rival_id", "left_semi")
    spread = names.select(F.col("rival_id").alias("__r"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part"))
    return links.join(spread, (F.col("rival_id") == F.col("__r")) & (F.pmod(F.xxhash64("slug"), F.lit(parts)) == F.col("__part")), "left_semi")


def preferred_links(links: DataFrame, rivals: DataFrame | None = None) -> DataFrame:
    """Each slug's link of the greatest confidence, then the latest, then the least rival_id; with `rivals` only links to theirs. By a combinable aggregate: no slug's links gather, and no rival's."""
    if rivals is not None:
        links = linked_to(links, rivals)
    best = F.struct(-ranked_value(F.col("match_confidence"), CONFIDENCE, 0), -F.unix_micros(F.col("matched_at").cast("timestamp")), F.col("rival_id"))
    return links.groupBy("slug").agg(F.min_by(F.struct("rival_id", "match_confidence", "matched_at"), best).alias("l")).select("slug", "l.*")


def winner(home: Column, rival: Column) -> Column:
    """home, rival, tie (also if both are null) or incomparable (one is null)."""
    return F.when(home.isNull() & rival.isNull(), "tie").when(home.isNull() | rival.isNull(), "incomparable").when(home == rival, "tie").when(home > rival, "home").otherwise("rival")


def pairs(home: DataFrame, rival: DataFrame, links: DataFrame) -> DataFrame:
    """Linked rows of both sides as structs h and r; links with a side missing drop out."""
    h = home.select(F.col("slug"), F.struct("*").alias("h"))
    r = rival.select(F.col("slug").alias("rival_id"), F.struct("*").alias("r"))
    both = preferred_links(links).join(h, "slug").join(r, "rival_id")
    return both.withColumns({"home_adjusted": adjusted(F.col("h.score"), F.col("h.booking_state")), "rival_adjusted": rival_adjusted(F.col("r.score"))})


def dimension_winners(rival_reason: Column | None = None) -> dict[str, Column]:
    """Winner of each compared dimension; a rival's plain-English score counts only if its assessment went through."""
    size = lambda side, *names: sum((arrays.length(F.col(f"{side}.{n}")) for n in names), F.lit(0))
    num = lambda side, name: F.col(f"{side}.{name}").cast("int")
    english = winner(num("h", "plain_english_score"), num("r", "plain_english_score"))
    if rival_reason is not None:
        english = F.when(F.coalesce(rival_reason.rlike("(?i)AI assessment failed|skipped"), F.lit(False)), "incomparable").otherwise(english)
    return {
        "photo": winner(num("h", "has_photo"), num("r", "has_photo")),
        "bio_depth": winner(*[ranked_value(F.col(f"{s}.bio_depth"), DEPTH) for s in "hr"]),
        "treatments_count": winner(size("h", "treatments"), size("r", "treatments")),
        "qualifications_present": winner(*[F.col(f"{s}.qualifications").isNotNull().cast("int") for s in "hr"]),
        "specialties_count": winner(size("h", "specialty_primary", "specialty_sub"), size("r", "specialty_primary", "specialty_sub")),
        "plain_english_score": english,
        "memberships_count": winner(size("h", "memberships"), size("r", "memberships")),
    }


def compared(pairs: DataFrame) -> DataFrame:
    """One row a pair: scores, tiers and an array of dimension winners."""
    dims = F.array(*[F.struct(F.lit(k).alias("dimension"), w.alias("winner")) for k, w in dimension_winners().items()])
    return pairs.select(
        "slug", "rival_id", "match_confidence", F.col("h.score").alias("home_score"), F.col("r.score").alias("rival_score"), F.col("h.tier").alias("home_tier"), F.col("r.tier").alias("rival_tier"),
        half_up(F.col("home_adjusted"), 1).alias("home_adjusted"), half_up(F.col("rival_adjusted"), 1).alias("rival_adjusted"), dims.alias("dimensions"),
    )


def single(home: DataFrame, rival: DataFrame, links: DataFrame, slug: str) -> DataFrame:
    """(slug, comparison): one profile's comparison with its preferred link as a struct of scores, tiers and seven dimensions; null if it has no link or a side is missing. One row always."""
    mine = pairs(home.where(F.col("slug") == slug), rival, links.where(F.col("slug") == slug))
    found = compared(mine).select("slug", F.struct("rival_id", "match_confidence", "home_score", "rival_score", "home_tier", "rival_tier", "home_adjusted", "rival_adjusted", "dimensions").alias("comparison"))
    return home.sparkSession.createDataFrame([(slug,)], "slug string").join(found, "slug", "left")


def aggregate(pairs: DataFrame, home: DataFrame) -> DataFrame:
    """One row over all pairs; scores within two points tie. matched_count counts linked pairs, home_only may go below zero."""
    rows = pairs.withColumn("is_home", F.lit(False)).unionByName(home.select(F.lit(True).alias("is_home")), allowMissingColumns=True)
    diff = F.col("rival_adjusted") - F.col("home_adjusted")
    tiers = [count_where(F.col(f"{s}.tier") == t).alias(f"{n}_{t.lower()}") for s, n in (("h", "home"), ("r", "rival")) for t in ("Gold", "Silver", "Bronze", "Incomplete")]
    out = rows.agg(
        count_where(F.col("is_home")).alias("total_home"),
        count_where(~F.col("is_home")).alias("matched_count"),
        *[half_up(F.avg(F.when(diff.isNotNull(), F.col(c))), 1).alias(n) for c, n in (("h.score", "home_avg_score"), ("r.score", "rival_avg_score"), ("home_adjusted", "home_avg_adjusted"), ("rival_adjusted", "rival_avg_adjusted"))],
        count_where(diff > 2).alias("rival_better"),
        count_where(diff < -2).alias("home_better"),
        count_where(F.abs(diff) <= 2).alias("ties"),
        *tiers,
    )
    rate = F.when(F.col("total_home") > 0, F.col("matched_count") / F.col("total_home")).otherwise(0.0)
    return out.withColumns({"home_only": F.col("total_home") - F.col("matched_count"), "match_rate": half_up(rate, 4)})


def dimension_wins(pairs: DataFrame) -> DataFrame:
    """(dimension, home_wins, rival_wins, ties)."""
    rows = compared(pairs).select(F.inline("dimensions"))
    return rows.groupBy("dimension").agg(*[count_where(F.col("winner") == w).alias(n) for w, n in (("home", "home_wins"), ("rival", "rival_wins"), ("tie", "ties"))])


def deltas(pairs: DataFrame) -> DataFrame:
    """(slug, rival_id, delta, lead): rounded rival lead in adjusted score, pairs without both scores left out."""
    delta = half_up(F.col("rival_adjusted") - F.col("home_adjusted"), 1)
    out = pairs.select("slug", "rival_id", delta.alias("delta")).where("delta is not null")
    return out.withColumn("lead", F.when(F.col("delta") > 2, "rival").when(F.col("delta") < -2, "home").otherwise("tie"))


def delta_page(pairs: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """A page of deltas, the home side's greatest leads first, with each row's rank."""
    return ranks.page(deltas(pairs), [F.asc("delta"), F.asc("slug")], number, size).withColumn("rank", F.col("rank").cast("int"))


def top_gaps(pairs: DataFrame, most: int = 20) -> DataFrame:
    order = [F.desc("delta"), F.asc("slug")]
    top = deltas(pairs).where("delta > 0").orderBy(*order).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # `most` rows


def display_lead(home: Column, rival: Column) -> Column:
    """As shown on a single profile, where a missing score counts as 0."""
    d = F.coalesce(rival, F.lit(0.0)) - F.coalesce(home, F.lit(0.0))
    return F.when(d > 2, "rival").when(d < -2, "home").otherwise("tie")


def checked_links(links: DataFrame, home_number: DataFrame, rival_number: DataFrame) -> DataFrame:
    """Links with their registration numbers compared: a mismatch goes, a match becomes high confidence, an unknown stays."""
    both = links.join(home_number.select("slug", F.col("number").alias("hn")), "slug", "left").join(rival_number.select("rival_id", F.col("number").alias("rn")), "rival_id", "left")
    kept = both.where(~F.coalesce(F.col("hn") != F.col("rn"), F.lit(False)))
    same = F.coalesce(F.col("hn") == F.col("rn"), F.lit(False))
    return kept.withColumns({"match_confidence": F.when(same, "high").otherwise(F.col("match_confidence")), "match_method": F.when(same, "number_match").otherwise(F.col("match_method")), "registration_number": F.coalesce("hn", "rn")}).drop("hn", "rn")


def number_status(home: Column, rival: Column) -> Column:
    """How two registration numbers stand to each other."""
    return F.when(home.isNotNull() & rival.isNotNull(), F.when(home == rival, "match").otherwise("mismatch")).when(home.isNotNull(), "missing_on_rival").when(rival.isNotNull(), "missing_on_home").otherwise("missing_both")
