"""Boundaries of score, tier and flags on hand-made profiles."""

import pytest

from quillstone.config import WEIGHTS, ScoringConfig, normalised, read_config, reset_config, save_config
from quillstone.operators import scoring
from quillstone.schema import PROFILE, validate

FULL = {
    "run_id": "r", "slug": "s", "name": "Dr A B", "site": "x", "registration_number": "1", "specialty_primary": ["Cardiology"], "specialty_sub": [], "qualifications": "MBBS", "about_text": "t", "has_photo": True,
    "bio_depth": "substantive", "plain_english_score": 4, "booking_state": "bookable_with_slots", "slots_28_days": 10, "insurers": ["a", "b"], "treatments": ["a", "b"], "consultation_times": ["mon"], "memberships": ["m"],
    "practising_since": 2005, "price": 100.0, "manually_reviewed": False, "scrape_status": "complete",
}


def score(spark, config=None, **changes):
    row = FULL | changes
    df = spark.createDataFrame([tuple(row[f] for f in PROFILE.fieldNames())], PROFILE)
    r = scoring.scored(df, config).first()
    return r.score, r.tier, [f.code for f in r.flags]


@pytest.mark.parametrize(
    "changes, expected",
    [
        ({}, (100, "Gold", [])),
        ({"specialty_primary": [], "specialty_sub": ["Knee"]}, (100, "Gold", [])),
        ({"plain_english_score": 3, "booking_state": "bookable_no_slots", "treatments": [], "specialty_primary": ["psychiatry"]}, (80, "Gold", ["BOOKING_NO_SLOTS"])),
        ({"plain_english_score": 3, "booking_state": "bookable_no_slots", "treatments": []}, (80, "Gold", ["CONTENT_NO_TREATMENTS", "BOOKING_NO_SLOTS"])),
        ({"qualifications": None}, (90, "Silver", ["CONTENT_NO_QUALIFICATIONS"])),
        ({"qualifications": ""}, (90, "Silver", ["CONTENT_NO_QUALIFICATIONS"])),
        ({"qualifications": None, "bio_depth": None}, (65, "Incomplete", ["CONTENT_MISSING_BIO", "CONTENT_NO_QUALIFICATIONS"])),
        ({"has_photo": None}, (90, "Bronze", ["PROFILE_NO_PHOTO"])),
        ({"bio_depth": "adequate"}, (95, "Silver", [])),
        ({"bio_depth": "thin"}, (75, "Silver", ["CONTENT_THIN_BIO"])),
        ({"specialty_primary": None, "specialty_sub": None}, (90, "Incomplete", [])),
        ({"booking_state": None, "insurers": None}, (82, "Gold", ["CONTENT_NO_INSURERS", "BOOKING_NOT_BOOKABLE"])),
    ],
)
def test_score(spark, changes, expected):
    assert score(spark, **changes) == expected


def test_breakdown_sums_to_score(spark):
    df = spark.createDataFrame([tuple((FULL | {"bio_depth": "thin"})[f] for f in PROFILE.fieldNames())], PROFILE)
    rows = scoring.breakdown(df).collect()
    assert len(rows) == 11 and sum(r.earned for r in rows) == 75 and sum(r.most for r in rows) == 100
    assert {r.dimension for r in rows if r.available > 0} == {"bio_depth", "plain_english"}


def test_config(tmp_path):
    assert normalised({k: 1.0 for k in WEIGHTS})["has_photo"] == 9.0909
    assert sum(normalised({k: 3.3 for k in WEIGHTS}).values()) == pytest.approx(100)
    assert normalised({k: 0.0 for k in WEIGHTS}) == WEIGHTS
    c = ScoringConfig.coerce({"weights": {"booking": "x", "has_photo": -1}, "gold_needs_no_fail": "FALSE", "thresholds": {"Gold": 50}})
    assert c.weights == WEIGHTS and c.gold_needs_no_fail is False and not c.ordered()
    path = str(tmp_path / "c.json")
    assert read_config(path) == ScoringConfig()
    assert save_config(path, {"thresholds": {"Gold": 90}}, "me").version == 2
    assert read_config(path).thresholds["Gold"] == 90 and reset_config(path, "me").version == 3
    with pytest.raises(ValueError):
        save_config(path, {"thresholds": {"Gold": 10}}, "me")


def test_config_for_older_callers():
    c = ScoringConfig.coerce({"thresholds": {"Gold": 85}, "gates": {"Silver": ["specialty", "odd", "photo"]}})
    assert c.total() == 100 and c.mandatory() == {"Gold": (85.0, ["has_photo", "bio_depth_substantive", "specialty_non_empty"]), "Silver": (60.0, ["has_photo", "specialty_non_empty"]), "Bronze": (40.0, ["specialty_non_empty"]), "Incomplete": (0.0, [])}


def test_config_changes_tier(spark):
    assert score(spark, ScoringConfig.coerce({"gold_needs_no_fail": False}), qualifications=None)[1] == "Gold"
    assert score(spark, ScoringConfig.coerce({"incomplete_from_fails": 0}), qualifications=None, has_photo=False)[1] == "Bronze"


def test_validate(spark):
    row = FULL | {"bio_depth": "odd", "plain_english_score": 9, "price": -1.0}
    df = spark.createDataFrame([tuple(row[f] for f in PROFILE.fieldNames())], PROFILE)
    assert {r.rule for r in validate(df).collect()} == {"bio_depth_unknown", "plain_english_range", "price_negative"}
