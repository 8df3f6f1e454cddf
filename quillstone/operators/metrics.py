"""Aggregates, rankings and reports over scored profiles of one run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import arrays
from quillstone.functions.numbers import count_where, half_up, mean, percent, share_where
from quillstone.operators.filters import blank, flag_is, needs_review

TIERS = ("Gold", "Silver", "Bronze", "Incomplete")
DEPTH_GOOD = ("substantive", "adequate")


def _tier_counts() -> list[Column]:
    return [count_where(F.col("tier") == t).alias(f"{t.lower()}_count") for t in TIERS]


UNKNOWN = "Unknown"


def or_unknown(df: DataFrame, *columns: str) -> DataFrame:
    """Nulls of text columns as they are shown."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(UNKNOWN)) for c in columns})


def group_count(df: DataFrame, key: str | Column, most: int | None = None, other: str | None = None) -> DataFrame:
    """(name, n), commonest first; ties by name. Nulls are counted as `other`, if that is given."""
    name = F.col(key) if isinstance(key, str) else key
    out = df.groupBy((name if other is None else F.coalesce(name, F.lit(other))).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return out if most is None else out.where("name is not null").orderBy(F.desc("n"), "name").limit(most)


def element_count(df: DataFrame, array: str, most: int | None = None) -> DataFrame:
    """group_count over an array's elements; a row counts once for each element."""
    return group_count(df.select(F.explode(array).alias("x")), "x", most)


def names(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, nulls apart, in order."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def element_names(df: DataFrame, array: str, name: str) -> DataFrame:
    return names(df.select(F.explode(array).alias(name)), name)


def kpis(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("total_profiles"),
        mean(F.col("score")).alias("avg_score"),
        percent(count_where(F.col("tier") == "Gold"), F.count(F.lit(1))).alias("gold_pct"),
        count_where(F.col("booking_state") == "bookable_with_slots").alias("bookable_count"),
        count_where(~F.col("manually_reviewed") & needs_review()).alias("needs_review"),
        mean(F.col("plain_english_score")).alias("avg_plain_english"),
        count_where(flag_is("has_photo", False)).alias("missing_photos"),
        half_up(F.avg("price"), 2).alias("avg_price"),
    )


def site_leaderboard(scored: DataFrame, most: int = 10) -> DataFrame:
    sites = scored.where("site is not null").groupBy("site").agg(F.count(F.lit(1)).alias("profiles"), mean(F.col("score")).alias("avg_score"), *_tier_counts())
    return sites.orderBy(F.desc("avg_score"), "site").limit(most)


def _benchmark() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("profiles"),
        mean(F.col("score")).alias("avg_score"),
        *_tier_counts(),
        share_where(F.col("has_photo")).alias("photo_pct"),
        share_where(F.col("bio_depth").isin(*DEPTH_GOOD)).alias("bio_quality_pct"),
        share_where(F.col("booking_state") == "bookable_with_slots").alias("bookable_pct"),
        mean(F.col("plain_english_score")).alias("avg_plain_english"),
        share_where(~arrays.missing(F.col("insurers"))).alias("insurer_pct"),
    ]


def top_element(df: DataFrame, key: str, array: str, name: str) -> DataFrame:
    """Each key's commonest array element; ties by name. One row a (key, element) meets, so a hot key is summed before."""
    counts = df.select(key, F.explode(array).alias(name)).groupBy(key, name).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min_by(name, F.struct(-F.col("n"), F.col(name))).alias(name))


def site_benchmark(scored: DataFrame) -> DataFrame:
    known = scored.where("site is not null")
    sites = known.groupBy("site").agg(*_benchmark(), percent(count_where(F.col("tier") == "Gold"), F.count(F.lit(1))).alias("gold_pct"))
    return sites.join(top_element(known, "site", "specialty_primary", "top_specialty"), "site", "left")


def specialty_analysis(scored: DataFrame) -> DataFrame:
    """The benchmark of each specialty; a profile counts once for each it lists."""
    return scored.withColumn("specialty", F.explode("specialty_primary")).groupBy("specialty").agg(*_benchmark())


def specialty_top_flags(scored: DataFrame, most: int = 3) -> DataFrame:
    """(specialty, rank, code, n): the commonest flags."""
    counts = scored.select(F.explode("specialty_primary").alias("specialty"), "flags").select("specialty", F.explode("flags.code").alias("code")).groupBy("specialty", "code").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("specialty").orderBy(F.desc("n"), "code"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most)


def specialty_report(scored: DataFrame) -> DataFrame:
    """specialty_analysis with an array of its top flags."""
    tops = specialty_top_flags(scored).groupBy("specialty").agg(F.array_sort(F.collect_list(F.struct("rank", "code", "n"))).alias("top_flags"))
    return specialty_analysis(scored).join(tops, "specialty", "left")


def specialty_average(scored: DataFrame, specialty: str) -> DataFrame:
    return scored.where(F.array_contains("specialty_primary", specialty) & F.col("score").isNotNull()).agg(mean(F.col("score")).alias("avg_score"), F.count(F.lit(1)).alias("n"))


def gaps() -> dict[str, Column]:
    """Conditions of what a profile lacks."""
    return {
        "missing_photos": flag_is("has_photo", False),
        "thin_bios": F.col("bio_depth") == "thin",
        "missing_bios": F.col("bio_depth") == "missing",
        "bio_needs_expansion": F.col("bio_depth").isin("thin", "missing"),
        "missing_insurers": arrays.missing(F.col("insurers")),
        "missing_times": arrays.missing(F.col("consultation_times")),
        "missing_qualifications": blank("qualifications"),
        "missing_memberships": arrays.missing(F.col("memberships")),
    }


def facets(scored: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(facet, name, n) of all facets from one pass: a row's names are exploded and counted before they are shuffled. `flag` and `linked` count slugs, whose rows in one run are one."""
    one = lambda facet, name: F.struct(F.lit(facet).alias("facet"), name.alias("name"))
    photo = F.when(flag_is("has_photo", True), "has").otherwise("missing")
    scalars = [one(k, F.col(k)) for k in ("tier", "booking_state", "site", "bio_depth")] + [one("photo", photo)]
    lacking = {k: v for k, v in gaps().items() if k in ("bio_needs_expansion", "missing_insurers", "missing_times", "missing_qualifications", "missing_memberships")}
    scalars += [one("gap", F.when(v, F.lit(k))) for k, v in lacking.items()]
    if links is not None:
        scored = scored.join(links.select("slug", F.lit(True).alias("__linked")).distinct(), "slug", "left")
        scalars.append(one("linked", F.when(F.col("__linked"), F.lit("rival"))))
    many = [F.transform("specialty_primary", lambda x: one("specialty", x)), F.transform(F.filter(F.array_distinct("flags.severity"), lambda x: x.isin("fail", "warn")), lambda x: one("flag", x))]
    names = F.concat(F.array(*scalars), *[F.coalesce(m, F.array().cast("array<struct<facet:string,name:string>>")) for m in many])
    return scored.select(F.inline(names)).where("name is not null").groupBy("facet", "name").agg(F.count(F.lit(1)).alias("n"))


def _actions(scored: DataFrame, points: dict[str, tuple[str, float]]) -> DataFrame:
    row = scored.agg(*[count_where(gaps()[k]).alias(k) for k in points])
    items = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(label).alias("action"), F.col(k).alias("profiles"), F.lit(float(p)).alias("points"), (F.col(k) * float(p)).alias("impact")) for i, (k, (label, p)) in enumerate(points.items())])
    ranked = row.select(F.inline(items)).where("profiles > 0")
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("impact"), "seq"))).drop("seq")  # six rows


def quick_actions(scored: DataFrame, most: int = 5) -> DataFrame:
    # Labels and points.
    points = {
        "missing_photos": ("Add profile photos", 10), "missing_bios": ("Write missing biographies", 15), "thin_bios": ("Expand thin biographies", 10),
        "missing_qualifications": ("Add qualifications and credentials", 10), "missing_insurers": ("List accepted insurers", 8), "missing_times": ("Add consultation times", 7),
    }
    return _actions(scored, points).where(F.col("rank") <= most)


def action_centre(scored: DataFrame) -> DataFrame:
    # Labels and points.
    points = {
        "missing_photos": ("Add missing photos", 10), "bio_needs_expansion": ("Expand thin/missing biographies", 12.5), "missing_insurers": ("List accepted insurers", 8),
        "missing_times": ("Add consultation times", 7), "missing_qualifications": ("Add qualifications and credentials", 10), "missing_memberships": ("Add professional memberships", 5),
    }
    return _actions(scored, points)


def recoverable() -> Column:
    """Points that a profile would gain from all actions; blank qualifications do not count as missing here."""
    parts = [
        F.when(flag_is("has_photo", False), 10.0), F.when(F.col("bio_depth") == "missing", 15.0).when(F.col("bio_depth") == "thin", 10.0), F.when(arrays.missing(F.col("insurers")), 8.0),
        F.when(arrays.missing(F.col("consultation_times")), 7.0), F.when(F.col("qualifications").isNull(), 10.0), F.when(arrays.missing(F.col("memberships")), 5.0),
    ]
    return reduce(Column.__add__, [F.coalesce(p, F.lit(0.0)) for p in parts])


def impact_summary(scored: DataFrame) -> DataFrame:
    n, gain = F.count(F.lit(1)), recoverable()
    now = F.coalesce("score", F.lit(0.0))
    return scored.agg(
        mean(F.col("score")).alias("current_avg_score"),
        half_up((F.sum(now) + F.sum(gain)) / F.greatest(n, F.lit(1)), 1).alias("projected_avg_score"),
        percent(count_where(F.col("tier") == "Gold"), n).alias("current_gold_pct"),
        percent(count_where(now + gain >= 80), n).alias("projected_gold_pct"),
        n.alias("total_profiles"),
    )


# The columns of the three lists of profiles.
SHORT_LIST = ["name", "slug", "site", "tier", "score", "booking_state", "has_photo", "bio_depth", "insurer_count", "plain_english_score"]
SEARCH_LIST = ["name", "slug", "site", "specialty_primary", "tier", "score", "plain_english_score", "bio_depth", "has_photo", "booking_state", "price", "insurer_count", "online_bookable", "slots_28_days"]
DETAIL_LIST = [
    "name", "title", "slug", "url", "site", "specialty_primary", "tier", "score", "plain_english_score", "plain_english_reason", "bio_depth", "bio_depth_reason", "treatment_specificity", "treatment_specificity_reason",
    "qualifications_completeness", "has_photo", "booking_state", "price", "insurer_count", "online_bookable", "slots_28_days", "next_slot", "clinical_interests", "languages", "practising_since", "registration_number", "quality_notes", "flags",
]


def listed(scored: DataFrame, columns: list[str]) -> DataFrame:
    """Those columns of scored profiles; counts and bookability are derived, and what a source does not have is null."""
    derived = {"insurer_count": F.coalesce(F.size("insurers"), F.lit(0)), "online_bookable": F.coalesce(F.col("booking_state") != "not_bookable", F.lit(False))}
    have = scored.withColumns({k: v for k, v in derived.items() if k not in scored.columns})
    return have.select(*[F.col(c) if c in have.columns else F.lit(None).cast("string").alias(c) for c in columns])


def short_list(ranked: DataFrame) -> DataFrame:
    """Ranked profiles as reports list them: names and sites never null, scores to one digit."""
    return or_unknown(listed(ranked, [*SHORT_LIST, "rank"]), "name", "site").withColumn("score", half_up(F.col("score"), 1))


def _ranked(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    top = df.orderBy(*order).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # `most` rows


def top_performers(scored: DataFrame, most: int = 5) -> DataFrame:
    return _ranked(scored.where("score is not null"), [F.desc("score"), F.asc("name"), F.asc("slug")], most)


def at_risk(scored: DataFrame, most: int = 8) -> DataFrame:
    rank = F.coalesce(*[F.when(F.col("tier") == t, i) for i, t in enumerate(reversed(TIERS))], F.lit(4))
    return _ranked(scored, [rank.asc(), F.asc_nulls_first("score"), F.asc("name"), F.asc("slug")], most)


def benchmark_profiles(scored: DataFrame, most: int = 5, specialty: str | None = None) -> DataFrame:
    """The best profiles: score, then substantive first, then with photo."""
    some = scored if specialty is None else scored.where(F.array_contains("specialty_primary", specialty))
    substantive, photo = F.coalesce((F.col("bio_depth") == "substantive").cast("int"), F.lit(0)), flag_is("has_photo", True).cast("int")
    return _ranked(some.where("score is not null"), [F.desc("score"), substantive.desc(), photo.desc(), F.asc("slug")], most)


def exemplar(scored: DataFrame, specialty: str) -> DataFrame:
    """The best profile of a specialty, or of all if it has none."""
    mine = F.array_contains("specialty_primary", specialty)
    return scored.where("score is not null").orderBy(F.desc(F.coalesce(mine, F.lit(False))), F.desc("score"), "slug").limit(1)


def exemplar_content(scored: DataFrame, specialty: str, element: str) -> DataFrame:
    """(slug, content): that element of the best profile of a specialty, or of all if it has none. Arrays as JSON, empty ones null."""
    best = benchmark_profiles(scored, 1, specialty).withColumn("own", F.lit(0)).unionByName(benchmark_profiles(scored, 1).withColumn("own", F.lit(1))).orderBy("own").limit(1)
    if element in ("treatments", "specialty_sub", "memberships", "clinical_interests"):
        content = F.when(~arrays.missing(F.col(element)), F.to_json(element))
    else:
        content = F.col("about_text" if element == "bio" else element).cast("string")
    return best.select("slug", content.alias("content"))


def average_of_top(scored: DataFrame, most: int = 5) -> DataFrame:
    return benchmark_profiles(scored, most).agg(half_up(F.avg("score"), 1).alias("benchmark"))


def unpivot(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, metric, value): a row a metric."""
    return df.select(key, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))


def outliers(groups: DataFrame, key: str, metrics: list[str], least_size: int = 5, least_groups: int = 3, beyond: float = 1.5) -> DataFrame:
    """(key, metric, value, z, far): groups whose rounded metric lies far from the groups' mean, the farthest first (far: the distance, not rounded to two digits). Population deviation; metrics without spread are left out."""
    rows = unpivot(groups.where(F.col("profiles") >= least_size), key, metrics)
    stats = rows.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"), F.count(F.lit(1)).alias("n"))
    z = (F.col("value") - F.col("mean")) / F.col("spread")
    near = rows.join(stats.where((F.col("spread") > 1e-12) & (F.col("n") >= least_groups)), "metric")
    far = near.withColumn("z", z).where(F.abs("z") > beyond).withColumn("far", F.round(F.abs("z"), 9))
    return far.orderBy(F.desc("far"), key, "metric").select(key, "metric", "value", half_up(F.col("z"), 2).alias("z"), "far")


def ranked_outliers(groups: DataFrame, key: str, metrics: list[str], **how) -> DataFrame:
    """outliers() with their place, few as they are."""
    found = outliers(groups, key, metrics, **how)
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("far"), key, "metric"))).drop("far")


def standings(scored: DataFrame) -> DataFrame:
    """(slug, specialty, standing): above, below or equal to the rounded mean score of each specialty that a profile lists."""
    rows = scored.select("slug", "score", F.explode("specialty_primary").alias("specialty"))
    means = rows.groupBy("specialty").agg(mean(F.col("score")).alias("m"))
    return rows.join(means, "specialty").select("slug", "specialty", F.when(F.col("score") > F.col("m"), "above").when(F.col("score") < F.col("m"), "below").otherwise("equal").alias("standing"))


def heatmap(groups: DataFrame, key: str, metrics: list[str], tenths: tuple[str, ...] = (), least_size: int = 5) -> DataFrame:
    """(key, metric, value, band): green from 70, amber from 40, red below; metrics out of ten count tenfold."""
    rows = unpivot(groups.where(F.col("profiles") >= least_size), key, metrics)
    level = F.when(F.col("metric").isin(*tenths), F.col("value") * 10).otherwise(F.col("value")) if tenths else F.col("value")
    return rows.withColumn("band", F.when(level >= 70, "green").when(level >= 40, "amber").otherwise("red"))


def radar(groups: DataFrame, key: str, metrics: list[str], chosen: list[str]) -> DataFrame:
    """A row a metric, a column for each chosen group (four at most)."""
    return unpivot(groups.where(F.col(key).isin(chosen[:4])), key, metrics).groupBy("metric").pivot(key, chosen[:4]).agg(F.first("value"))


def narrative(scored: DataFrame) -> DataFrame:
    """One sentence over the run."""
    k = kpis(scored)
    return k.select(F.format_string("%d profiles with an average score of %.1f; %.1f%% are Gold and %d need review.", "total_profiles", "avg_score", "gold_pct", "needs_review").alias("sentence"))


def report(scored: DataFrame, run_id: str) -> DataFrame:
    """One row, the run's report in parts: headline, summary, three strengths, three risks, up to four key actions, questions and a note on how sure it is. Made of the run's figures alone."""
    tiers = scored.agg(*[c.alias(f"tier_{t.lower()}") for c, t in zip([count_where(F.col("tier") == t) for t in TIERS], TIERS)])
    actions = quick_actions(scored).agg(F.array_sort(F.collect_list(F.struct("rank", "action", "profiles", "impact"))).alias("actions"))  # five rows
    impact = impact_summary(scored).select("current_avg_score", "projected_avg_score", "current_gold_pct", "projected_gold_pct")
    one = lambda df: df.withColumn("__one", F.lit(1))
    row = one(kpis(scored)).join(one(tiers), "__one").join(one(actions), "__one").join(one(impact), "__one")  # one row each
    say = F.format_string
    top = F.get("actions", F.lit(0))
    best = F.when(top.isNotNull(), say("%s (%d profiles, up to %.1f points)", top.action, top.profiles, top.impact)).otherwise("none of weight")
    act = lambda a: F.struct(a.action.alias("action"), say("%d profiles lack this.", a.profiles).alias("rationale"), say("Up to %.1f points over the run.", a.impact).alias("expected_impact"), F.lit("0-30 days").alias("time_horizon"))
    return row.select(
        say("Run %s: %.1f of 100 on average, %.1f%% Gold.", F.lit(run_id[:8]), "avg_score", "gold_pct").alias("headline"),
        F.concat_ws(
            " ",
            say("%d profiles score %.1f on average.", "total_profiles", "avg_score"),
            say("%d are Gold, %d Incomplete, %d bookable with slots.", "tier_gold", "tier_incomplete", "bookable_count"),
            F.concat(F.lit("Greatest gain in reach: "), best, F.lit(".")),
            say("With every action taken the average would go from %.1f to %.1f and Gold from %.1f%% to %.1f%%.", "current_avg_score", "projected_avg_score", "current_gold_pct", "projected_gold_pct"),
        ).alias("summary"),
        F.array(say("%d profiles are Gold.", "tier_gold"), say("%d can be booked now.", "bookable_count"), say("Plain English averages %.1f of 5.", "avg_plain_english")).alias("strengths"),
        F.array(say("%d profiles are Incomplete.", "tier_incomplete"), say("%d need review.", "needs_review"), say("%d have no photo.", "missing_photos")).alias("risks"),
        F.transform(F.slice("actions", 1, 4), act).alias("key_actions"),
        F.array(F.lit("Which sites hold most of the Incomplete profiles?"), F.lit("Who sees the first actions through within 30 days?"), F.lit("Should a profile meet a minimum before it is shown?")).alias("questions"),
        F.lit("Figures are exact counts of the run; projections assume that every listed action is taken.").alias("confidence_note"),
    )


def slot_summary(slots: DataFrame, from_date: Column, key: str = "practitioner_id") -> DataFrame:
    """Per key of (slot_date, price text) rows: slots and days before from_date + 28, mean a day, next date, least price."""
    soon = F.col("slot_date") < F.date_add(from_date, 28)
    days = F.countDistinct(F.when(soon, F.col("slot_date")))
    return slots.groupBy(key).agg(
        count_where(soon).alias("slots_28_days"),
        days.alias("days_28_days"),
        half_up(F.try_divide(count_where(soon).cast("double"), days), 1).alias("slots_a_day"),
        F.min("slot_date").alias("next_slot"),
        F.min(F.try_cast("price", "double") if hasattr(F, "try_cast") else F.col("price").try_cast("double")).alias("price"),
    )


def frequency(df: DataFrame, array: str) -> DataFrame:
    return element_count(df, array).orderBy(F.desc("n"), "name")


def presence(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """How many rows hold each condition."""
    return df.agg(*[count_where(c).alias(k) for k, c in conditions.items()])
