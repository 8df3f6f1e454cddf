"""Filters, sort orders and pages of the explorer, as columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import arrays, text
from quillstone.operators import ranks


@dataclass(frozen=True)
class ProfileFilter:
    """Optional conditions, all of which must hold; None asks nothing."""

    run_id: str | None = None
    site: str | None = None
    tier: str | None = None
    tiers: tuple[str, ...] | None = None
    booking_state: str | None = None
    bio_depth: str | None = None
    search: str | None = None
    has_photo: bool | None = None
    has_fail: bool | None = None
    has_warn: bool | None = None
    flag_code: str | None = None
    bio_depths: tuple[str, ...] | None = None
    missing_insurers: bool | None = None
    missing_times: bool | None = None
    missing_qualifications: bool | None = None
    missing_memberships: bool | None = None
    least_score: float | None = None
    most_score: float | None = None
    specialty: str | None = None
    manually_reviewed: bool | None = None

    def conditions(self) -> list[Column]:
        out = []
        eq = {"run_id": "run_id", "tier": "tier", "booking_state": "booking_state", "bio_depth": "bio_depth", "manually_reviewed": "manually_reviewed"}
        out += [F.col(c) == getattr(self, k) for k, c in eq.items() if getattr(self, k) is not None]
        if self.site:
            out.append(F.col("site").ilike(f"%{self.site}%"))
        if self.search:
            out.append(text.any_of([F.col(c).ilike(f"%{self.search}%") for c in ("name", "slug", "site")]))
        if self.has_photo is not None:  # no photo includes unknown
            out.append(flag_is("has_photo", self.has_photo))
        if self.has_fail:
            out.append(has_severity("fail"))
        if self.has_warn:
            out.append(has_severity("warn"))
        if self.flag_code:
            out.append(arrays.has(F.col("flags"), lambda f: f.code == self.flag_code))
        for name, column in (("tiers", "tier"), ("bio_depths", "bio_depth")):
            if getattr(self, name):
                out.append(F.col(column).isin(list(getattr(self, name))))
        if self.missing_insurers:
            out.append(arrays.missing(F.col("insurers")))
        if self.missing_times:
            out.append(arrays.missing(F.col("consultation_times")))
        if self.missing_qualifications:
            out.append(blank("qualifications"))
        if self.missing_memberships:
            out.append(arrays.missing(F.col("memberships")))
        if self.least_score is not None:
            out.append(F.col("score") >= self.least_score)
        if self.most_score is not None:
            out.append(F.col("score") <= self.most_score)
        if self.specialty:
            out.append(F.coalesce(F.array_contains("specialty_primary", self.specialty), F.lit(False)))
        return out

    def apply(self, profiles: DataFrame) -> DataFrame:
        return profiles.where(reduce(Column.__and__, self.conditions(), F.lit(True)))


def flag_is(column: str, value: bool) -> Column:
    """True exactly; or false including null."""
    known = F.coalesce(F.col(column), F.lit(False))
    return known if value else ~known


def blank(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(column) == "")


def has_severity(severity: str) -> Column:
    return arrays.has(F.col("flags"), lambda f: f.severity == severity)


def needs_review() -> Column:
    """Incomplete, or any fail flag, or any doubt about the extraction."""
    return (F.col("tier") == "Incomplete") | arrays.has(F.col("flags"), lambda f: (f.severity == "fail") | (f.code == "QA_LOW_CONFIDENCE"))


def review_reasons() -> Column:
    return F.array_compact(
        F.array(
            F.when(F.col("tier") == "Incomplete", F.lit("Incomplete tier")),
            F.when(has_severity("fail"), F.lit("Fail flags")),
            F.when(arrays.has(F.col("flags"), lambda f: f.code == "QA_LOW_CONFIDENCE"), F.lit("Low confidence")),
        )
    )


TIER_RANK = {"Gold": 4, "Silver": 3, "Bronze": 2, "Incomplete": 1}


def sort_key(key: str | None, descending: bool = False) -> tuple[Column, bool]:
    """A whitelisted key's column and direction; an unknown key is name ascending, whatever the direction. Ties go by slug."""
    keys = {
        "score": F.col("score"),
        "name": F.col("name"),
        "site": F.col("site"),
        "tier": F.coalesce(*[F.when(F.col("tier") == t, r) for t, r in TIER_RANK.items()], F.lit(0)),
        "bio_depth": F.col("bio_depth"),
        "booking_state": F.col("booking_state"),
        "plain_english": F.col("plain_english_score"),
    }
    return (keys[key], descending) if key in keys else (F.col("name"), False)


def sort_order(key: str | None, descending: bool = False) -> list[Column]:
    """sort_key as an order with the slug as tie-break."""
    column, down = sort_key(key, descending)
    return [column.desc() if down else column.asc(), F.asc("slug")]


# The second list of sort modes, of callers that ask by name.
SORT_MODES = {"score_desc": ("score", True), "score_asc": ("score", False), "price_desc": ("price", True), "price_asc": ("price", False)}


def mode_key(mode: str | None) -> tuple[Column, bool]:
    """A mode's column and direction; any other is by name. Ties go by slug."""
    column, descending = SORT_MODES.get(mode, ("name", False))
    return F.col(column), descending


def sort_mode(mode: str | None) -> list[Column]:
    """mode_key as an order with the slug as tie-break."""
    column, down = mode_key(mode)
    return [column.desc() if down else column.asc(), F.asc("slug")]


def resorted(groups: DataFrame, metric: str, key: str, metrics: list[str], descending: bool = True) -> DataFrame:
    """Group rows, few as they are, by one of their metrics."""
    if metric not in metrics:
        raise ValueError(f"unknown metric {metric}")
    return groups.orderBy(F.desc(metric) if descending else F.asc(metric), key)


def page(profiles: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """Page `number` (from 1) of `size` rows with their `rank`; deep pages too (ranks.page). ranks.page_after goes on from a page's last row."""
    return ranks.page(profiles, order, number, size)


def clamp_limit(n: int | None, default: int = 20, most: int = 50) -> int:
    return min(n or default, most)


def preferred_run(runs: DataFrame, allow_pilot: bool = True) -> DataFrame:
    """The newest completed run, full ones before pilots."""
    pilot = F.col("run_id").startswith("pilot-")
    rows = runs.where(F.col("status") == "completed")
    return (rows if allow_pilot else rows.where(~pilot)).orderBy(pilot, F.desc("started_at"), "run_id").limit(1)
