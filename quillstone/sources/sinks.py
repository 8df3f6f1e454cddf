"""CSV and JSON writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.text import csv_field
from quillstone.operators.filters import ProfileFilter, page, sort_order
from quillstone.operators.metrics import listed

CONTACTS = ["phone", "mobile", "email", "website"]


def as_text(df: DataFrame, name: str) -> Column:
    nested = isinstance(df.schema[name].dataType, (T.ArrayType, T.StructType, T.MapType))
    return F.to_json(name) if nested else F.col(name).cast("string")


def csv_lines(df: DataFrame, columns: dict[str, str] | None = None, contacts: bool = False) -> DataFrame:
    """(line): one CSV line a row; nested values as JSON. `columns` maps columns to headers, in order; contact columns stay out unless asked for."""
    names = list(columns or {c: c for c in df.columns})
    names = [c for c in names if contacts or c not in CONTACTS]
    return df.select(F.concat_ws(",", *[csv_field(as_text(df, c)) for c in names]).alias("line"))


def csv_header(df: DataFrame, columns: dict[str, str] | None = None, contacts: bool = False) -> str:
    headers = {c: c for c in df.columns} if columns is None else columns
    quote = lambda s: '"' + s.replace('"', '""') + '"' if any(x in s for x in ',"\n') else s
    return ",".join(quote(h) for c, h in headers.items() if contacts or c not in CONTACTS)


AUDIT = "at timestamp, action string, run_id string, by string"


def export_profiles(scored: DataFrame, path: str, wanted: ProfileFilter | None = None, sort_by: str | None = None, descending: bool = False, contacts: bool = False, audit: str | None = None, by: str = "unknown", most: int = 100_000) -> str:
    """Write a run's profiles that meet a filter as lines of CSV, in order, the first `most` of them, and return their header. Contact columns go along only if asked for, and then a row of the table `audit` says when, of which run and for whom.

    Places come from ranges of the order, so the cut is no task's work. Nothing to export is an error, and leaves no audit row.
    """
    rows = (wanted or ProfileFilter()).apply(scored)
    rows = page(rows, sort_order(sort_by, descending), 1, most)
    first = rows.select("run_id").first()
    if first is None:
        raise ValueError("no data to export")
    columns = {c: c for c in scored.columns}
    if contacts and audit:
        spark = scored.sparkSession
        spark.range(1).select(F.current_timestamp().alias("at"), F.lit("export_with_contact_data").alias("action"), F.lit(first.run_id).alias("run_id"), F.lit(by).alias("by")).write.mode("append").json(audit)
    csv_lines(rows.orderBy("rank"), columns, contacts).write.text(path)
    return csv_header(scored, columns, contacts)


# The columns that a report may have, with their headers.
REPORT_COLUMNS = {
    "name": "Name", "title": "Title Prefix", "slug": "Slug", "url": "Profile URL", "registration_number": "Registration Number", "site": "Hospital", "score": "Completeness Score", "tier": "Quality Tier", "plain_english_score": "Plain English Score",
    "bio_depth": "Bio Depth", "treatment_specificity": "Treatment Specificity", "qualifications_completeness": "Qualifications Rating", "has_photo": "Has Photo", "specialty_primary": "Specialties", "insurer_count": "Insurer Count",
    "practising_since": "Practising Since", "languages": "Languages", "clinical_interests": "Clinical Interests", "booking_state": "Booking State", "online_bookable": "Online Bookable", "slots_28_days": "Available Slots (28 days)",
    "price": "Consultation Price", "next_slot": "Next Available", "days_to_next_slot": "Days to First Available", "plain_english_reason": "Plain English Reason", "bio_depth_reason": "Bio Depth Reason", "treatment_specificity_reason": "Treatment Reason",
    "qualifications_reason": "Qualifications Reason", "quality_notes": "AI Quality Notes", "flags": "All Flags (JSON)", "scrape_status": "Scrape Status", "scrape_error": "Scrape Error",
}


def report_lines(scored: DataFrame, columns: list[str], tier: str = "all", site: str = "") -> tuple[str, DataFrame]:
    """(header, (line, name, slug) in order of name) of the allowed ones among `columns`, in the order given, for a tier and for sites that hold a text."""
    chosen = {c: REPORT_COLUMNS[c] for c in columns if c in REPORT_COLUMNS}
    if not chosen:
        raise ValueError("no valid columns selected")
    rows = scored if tier in ("", "all") else scored.where(F.col("tier") == tier)
    rows = rows.where(F.col("site").ilike(f"%{site}%")) if site else rows
    rows = listed(rows, list(dict.fromkeys([*chosen, "name", "slug"]))).orderBy("name", "slug")
    fields = [csv_field(as_text(rows, c)) for c in chosen]
    return csv_header(rows, chosen, contacts=True), rows.select(F.concat_ws(",", *fields).alias("line"), "name", "slug")


# The action plan's headers.
ACTION_COLUMNS = {"rank": "Rank", "action": "Action", "profiles": "Profiles Affected", "points": "Points Per Profile", "impact": "Total Impact"}


def action_plan(actions: DataFrame) -> tuple[str, DataFrame]:
    """(header, lines by rank) of ranked actions; the action stands in quotes, whole numbers without a point."""
    plain = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    line = F.concat_ws(",", plain("rank"), F.concat(F.lit('"'), "action", F.lit('"')), plain("profiles"), plain("points"), plain("impact"))
    return ",".join(ACTION_COLUMNS.values()), actions.orderBy("rank").select("rank", line.alias("line"))


def write_csv(df: DataFrame, path: str, columns: dict[str, str] | None = None, contacts: bool = False) -> None:
    """Text files of lines; the header is for whoever joins them (csv_header)."""
    csv_lines(df, columns, contacts).write.text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)
