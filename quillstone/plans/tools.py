"""Queries that callers ask for by name, with parameters from outside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.filters import ProfileFilter, clamp_limit, mode_key
from quillstone.operators.metrics import DETAIL_LIST, SEARCH_LIST, listed
from quillstone.operators.ranks import tops
from quillstone.sources.shared import stored

#: parameter of a search -> field of ProfileFilter
SEARCH_PARAMETERS = {
    "site": "site", "tier": "tier", "booking_state": "booking_state", "bio_depth": "bio_depth", "has_photo": "has_photo", "search": "search", "flag_code": "flag_code", "score_min": "least_score", "score_max": "most_score", "specialty": "specialty",
}


def search_profiles(scored: DataFrame, **params) -> DataFrame:
    """(total, 14 columns): up to `limit` profiles (20; 50 at most) that meet the parameters, by `sort_by`, each with the number of all that do."""
    mode = params.pop("sort_by", None)
    return search_modes(scored, [mode or "name"], **params).orderBy("place").drop("mode", "place")


def search_modes(scored: DataFrame, modes: list[str], **params) -> DataFrame:
    """(mode, 14 columns, place, total): search_profiles under each of several sort modes. The profiles that meet the parameters are found and written once, with the columns that the list shows; their number and all pages come from there."""
    chosen = ProfileFilter(**{field: params[name] for name, field in SEARCH_PARAMETERS.items() if params.get(name) is not None}).apply(scored)
    found = stored(listed(chosen, SEARCH_LIST), "found")
    pages = tops(found, {m: mode_key(m) for m in modes}, "slug", clamp_limit(params.get("limit")), "mode")
    return pages.withColumn("total", F.lit(found.count()))


def profile_detail(scored: DataFrame, slug: str | None = None, name: str | None = None) -> DataFrame:
    """28 columns of one profile, by slug or else by a part of its name; no row if there is none."""
    if not slug and not name:
        raise ValueError("give a slug or a name")
    found = scored.where(F.col("slug") == slug) if slug else scored.where(F.col("name").ilike(f"%{name}%")).orderBy("slug")
    return listed(found.limit(1), DETAIL_LIST)


TOOLS = {"search_profiles": search_profiles, "profile_detail": profile_detail}


def execute(scored: DataFrame, tool: str, params: dict) -> DataFrame:
    """Run a named tool over the scored profiles of one run."""
    if tool not in TOOLS:
        raise ValueError(f"unknown tool {tool}")
    return TOOLS[tool](scored, **params)
