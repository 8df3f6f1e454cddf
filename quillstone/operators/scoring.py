"""Completeness score, flags, tier and the scores built on them, as columns of a profile row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.config import NON_PROCEDURAL, ScoringConfig
from quillstone.functions import arrays, numbers, text

# Flag codes, severities and messages; the first eight come from scoring, the others from the stages before.
FLAGS = {
    "PROFILE_NO_PHOTO": ("fail", "Profile has no photo"),
    "CONTENT_MISSING_BIO": ("fail", "Profile has no bio/about section"),
    "CONTENT_THIN_BIO": ("warn", "Profile bio is thin/sparse"),
    "CONTENT_NO_TREATMENTS": ("warn", "No treatments listed"),
    "CONTENT_NO_QUALIFICATIONS": ("fail", "No qualifications listed"),
    "CONTENT_NO_INSURERS": ("warn", "No insurers listed"),
    "BOOKING_NO_SLOTS": ("warn", "Bookable online but no available slots in next 28 days"),
    "BOOKING_NOT_BOOKABLE": ("info", "Not bookable online"),
    "CONTENT_CMS_CORRUPTION": ("warn", "CMS text corruption detected (formatting artifacts)"),
    "PROFILE_SUBSTANTIVE_DECLARATION": ("info", "Declaration contains substantive financial interests"),
    "PROFILE_OUTSIDE_NETWORK": ("info", "Primary hospital is outside the network"),
    "PROFILE_AGE_RESTRICTION": ("info", "Patient age restriction"),
    "QA_LOW_CONFIDENCE": ("warn", "Low confidence"),
}
BOOKING_POINTS, RIVAL_MISSING_POINTS = {"bookable_with_slots": 10.0, "bookable_no_slots": 5.0}, 30.0

# Places whose mention locates a biography.
PLACES = ["london", "manchester", "birmingham", "bristol", "leeds", "edinburgh", "glasgow", "cardiff", "oxford", "cambridge", "hospital", "clinic", "harley street", "surrey", "kent", "essex", "hertfordshire"]


def dimensions(config: ScoringConfig | None = None) -> dict[str, tuple[Column, float]]:
    """Each dimension's earned points, as a column, and its full points."""
    p = (config or ScoringConfig()).points()
    bio, english, booking = F.col("bio_depth"), F.col("plain_english_score"), F.col("booking_state")
    may_speak = bio.isin("substantive", "adequate") if (config or ScoringConfig()).plain_english_needs_bio else F.lit(True)
    full = lambda name, test: F.when(test, p[name]).otherwise(0.0)
    earned = {
        "has_photo": full("has_photo", F.col("has_photo")),
        "bio_depth": F.when(bio == "substantive", p["bio_depth"]).when(bio == "adequate", p["bio_adequate"]).otherwise(0.0),
        "treatments": full("treatments", ~arrays.missing(F.col("treatments"))),
        "qualifications": full("qualifications", F.length("qualifications") > 0),
        "specialty": full("specialty", arrays.length(F.col("specialty_primary")) + arrays.length(F.col("specialty_sub")) > 0),
        "insurers": full("insurers", ~arrays.missing(F.col("insurers"))),
        "consultation_times": full("consultation_times", ~arrays.missing(F.col("consultation_times"))),
        "plain_english": F.when(may_speak & (english >= 4), p["plain_english"]).when(may_speak & (english == 3), p["plain_english_3"]).otherwise(0.0),
        "booking": F.when(booking == "bookable_with_slots", p["booking"]).when(booking == "bookable_no_slots", p["booking_no_slots"]).otherwise(0.0),
        "practising_since": full("practising_since", F.col("practising_since").isNotNull()),
        "memberships": full("memberships", ~arrays.missing(F.col("memberships"))),
    }
    return {k: (v, p[k]) for k, v in earned.items()}


def score(config: ScoringConfig | None = None) -> Column:
    return reduce(Column.__add__, [earned for earned, _ in dimensions(config).values()])


def flags(extra: dict[str, Column] | None = None) -> Column:
    """array<struct<code, severity, message>> in the fixed order; `extra`: conditions of codes that stages before found."""
    bio, booking = F.col("bio_depth"), F.col("booking_state")
    evidence = F.concat(F.coalesce("specialty_primary", F.array().cast("array<string>")), F.coalesce("specialty_sub", F.array().cast("array<string>")))
    when = {
        "PROFILE_NO_PHOTO": ~F.coalesce(F.col("has_photo"), F.lit(False)),
        "CONTENT_MISSING_BIO": F.coalesce(bio == "missing", F.lit(True)),
        "CONTENT_THIN_BIO": bio == "thin",
        "CONTENT_NO_TREATMENTS": arrays.missing(F.col("treatments")) & ~arrays.overlaps_ci(evidence, NON_PROCEDURAL),
        "CONTENT_NO_QUALIFICATIONS": F.coalesce(F.length("qualifications"), F.lit(0)) == 0,
        "CONTENT_NO_INSURERS": arrays.missing(F.col("insurers")),
        "BOOKING_NO_SLOTS": booking == "bookable_no_slots",
        "BOOKING_NOT_BOOKABLE": F.coalesce(booking == "not_bookable", F.lit(True)),
    } | (extra or {})
    one = lambda code: F.struct(F.lit(code).alias("code"), F.lit(FLAGS[code][0]).alias("severity"), F.lit(FLAGS[code][1]).alias("message"))
    return F.array_compact(F.array(*[F.when(test, one(code)) for code, test in when.items()]))


def tier(config: ScoringConfig | None = None) -> Column:
    """From the columns score and flags and the profile's own."""
    c = config or ScoringConfig()
    fails = F.size(F.filter("flags", lambda f: f.severity == "fail"))
    met = {"photo": F.coalesce("has_photo", F.lit(False)), "bio": F.coalesce(F.col("bio_depth") == "substantive", F.lit(False)), "specialty": arrays.length(F.col("specialty_primary")) + arrays.length(F.col("specialty_sub")) > 0}
    out = F.when((fails >= c.incomplete_from_fails) if c.incomplete_from_fails > 0 else F.lit(False), "Incomplete")
    for name in ("Gold", "Silver", "Bronze"):
        test = reduce(Column.__and__, [met[g] for g in c.gates[name]], F.col("score") >= c.thresholds[name])
        if name == "Gold" and c.gold_needs_no_fail:
            test = test & (fails == 0)
        out = out.when(test, name)
    return out.otherwise("Incomplete")


def scored(profiles: DataFrame, config: ScoringConfig | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """profiles with score, flags and tier."""
    return profiles.withColumns({"score": score(config), "flags": flags(extra)}).withColumn("tier", tier(config))


def breakdown(profiles: DataFrame, config: ScoringConfig | None = None) -> DataFrame:
    """(run_id, slug, dimension, earned, most, available): a row a dimension."""
    rows = F.array(*[F.struct(F.lit(k).alias("dimension"), e.cast("double").alias("earned"), F.lit(float(m)).alias("most")) for k, (e, m) in dimensions(config).items()])
    return profiles.select("run_id", "slug", F.inline(rows)).withColumn("available", F.col("most") - F.col("earned"))


def adjusted(score: Column, booking_state: Column) -> Column:
    """Score without booking, out of what is left."""
    booked = F.when(booking_state == "bookable_with_slots", 10.0).when(booking_state == "bookable_no_slots", 5.0).otherwise(0.0)
    return (score - booked) / (100.0 - BOOKING_POINTS["bookable_with_slots"]) * 100.0


def rival_adjusted(score: Column) -> Column:
    """Score out of the points that a rival's page can show."""
    return score / (100.0 - RIVAL_MISSING_POINTS) * 100.0


def seo_parts(keywords: Column | None = None, brands: tuple[str, ...] = ()) -> dict[str, Column]:
    """Five parts of a search score over about_text; keywords default to treatments and specialties. `brands`: further names that locate a biography."""
    bio = F.coalesce("about_text", F.lit(""))
    low = F.lower(bio)
    words = keywords if keywords is not None else F.concat(F.coalesce("treatments", F.array().cast("array<string>")), F.coalesce("specialty_primary", F.array().cast("array<string>")))
    hits = F.size(F.filter(words, lambda w: F.contains(low, F.lower(w))))
    rich = F.when(F.size(words) > 0, F.least(F.lit(30.0), numbers.half_up(30.0 * hits / F.greatest(F.size(words), F.lit(1))))).otherwise(10.0)
    rich = F.when(~arrays.missing(F.col("treatments")), F.greatest(rich, F.lit(5.0))).otherwise(rich)
    count = F.size(F.filter(F.split(bio, r"(?U)\s+"), lambda w: w != ""))
    english = F.col("plain_english_score")
    filled = [F.length(bio) > 0, ~arrays.missing(F.col("treatments")), F.col("qualifications").isNotNull(), ~arrays.missing(F.col("memberships")), F.col("practising_since").isNotNull(), ~arrays.missing(F.col("specialty_primary"))]
    located = text.any_of([low.contains(p) for p in (*PLACES, *brands)]) | F.coalesce(F.contains(low, F.lower("site")), F.lit(False))
    return {
        "keyword_richness": F.when(F.length(bio) > 0, rich).otherwise(0.0),
        "content_length": F.when(count >= 300, 20.0).when(count >= 150, 10.0).otherwise(0.0),
        "patient_language": F.when(english >= 4, 20.0).when(english == 3, 10.0).otherwise(0.0),
        "structured_completeness": numbers.half_up(20.0 * reduce(Column.__add__, [x.cast("int") for x in filled]) / len(filled)),
        "location_signals": F.when(located, 10.0).otherwise(0.0),
    }


def projected(profiles: DataFrame, rewritten: list[str], config: ScoringConfig | None = None) -> DataFrame:
    """profiles scored as if the named elements had been rewritten; a rewritten biography counts as substantive and plain."""
    now = {}
    if "bio" in rewritten:
        now |= {"bio_depth": F.lit("substantive"), "plain_english_score": F.lit(5)}
    if "photo" in rewritten:
        now["has_photo"] = F.lit(True)
    if "qualifications" in rewritten:
        now["qualifications"] = F.coalesce(F.when(F.length("qualifications") > 0, F.col("qualifications")), F.lit("listed"))
    if "practising_since" in rewritten:
        now["practising_since"] = F.coalesce("practising_since", F.lit(2000))
    for name in ("treatments", "memberships", "insurers", "consultation_times", "specialty_sub"):
        if name in rewritten:
            now[name] = F.when(arrays.missing(F.col(name)), F.array(F.lit("listed"))).otherwise(F.col(name))
    return scored(profiles.withColumns(now), config)


def element_points() -> dict[str, tuple[Column, int]]:
    """A rewrite desk's rough points of each element, (now, most); not the score."""
    words = F.size(F.split(F.trim("about_text"), r"(?U)\s+"))
    return {
        "bio": (F.when(F.col("about_text").isNull(), 0).when(words >= 150, 15).when(words >= 50, 8).otherwise(3), 15),
        "treatments": (F.when(arrays.length(F.col("treatments")) >= 5, 10).when(arrays.length(F.col("treatments")) >= 1, 5).otherwise(0), 10),
        "qualifications": (F.when(F.col("qualifications").isNotNull(), 10).otherwise(0), 10),
        "specialty_sub": (F.when(~arrays.missing(F.col("specialty_sub")), 5).otherwise(0), 5),
        "memberships": (F.when(~arrays.missing(F.col("memberships")), 5).otherwise(0), 5),
        "practising_since": (F.when(F.col("practising_since").isNotNull(), 5).otherwise(0), 5),
    }


def elements(profiles: DataFrame) -> DataFrame:
    """(run_id, slug, element, points, most, selected): selected where a rewrite can gain."""
    rows = F.array(*[F.struct(F.lit(k).alias("element"), p.cast("int").alias("points"), F.lit(m).alias("most")) for k, (p, m) in element_points().items()])
    return profiles.select("run_id", "slug", F.inline(rows)).withColumn("selected", F.col("points") < F.col("most"))


def capped(now: Column, gain: Column, most: Column) -> Column:
    return F.least(most, now + gain)
