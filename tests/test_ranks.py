"""Ranks, pages and first rows of many orders against plain sorting."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.operators import filters, ranks
from quillstone.plans.queries import QUERIES


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(i, rng.choice([None, "a", "b", "c"]), rng.choice([None, 1.5, -2.0, 7.0]), f"s{i:04}") for i in range(700)]
    return spark.createDataFrame(data, "id int, kind string, x double, slug string").repartition(5).cache()


def in_order(data, keys):
    """Plain rows sorted by (column, descending): nulls first, or last where descending."""
    for c, down in reversed(keys):
        data = sorted(data, key=lambda r: (r[c] is not None, r[c] if r[c] is not None else 0), reverse=down) if c != "kind" else sorted(data, key=lambda r: (r[c] is not None, r[c] or ""), reverse=down)
    return data


def test_ranked(rows):
    want = {r.slug: i + 1 for i, r in enumerate(in_order(rows.collect(), [("x", True), ("slug", False)]))}
    for parts in (1, 7, 300):
        assert {r.slug: r.rank for r in ranks.ranked(rows, [F.desc("x"), F.asc("slug")], parts=parts).collect()} == want
    got = {r.slug: r.rank for r in ranks.ranked(rows, [F.desc("x"), F.asc("slug")], within=["kind"], parts=9).collect()}
    seen = {}
    for r in in_order(rows.collect(), [("x", True), ("slug", False)]):
        seen[r.kind] = seen.get(r.kind, 0) + 1
        assert got[r.slug] == seen[r.kind]
    assert ranks.ranked(rows.limit(0), [F.asc("slug")]).count() == 0


@pytest.mark.parametrize("keys", [[("x", True), ("slug", False)], [("kind", False), ("x", False), ("slug", True)], [("kind", True), ("slug", False)]])
def test_pages_after_the_last_row(rows, keys):
    want, got, last = [r.slug for r in in_order(rows.collect(), keys)], [], None
    while True:
        some = ranks.page_after(rows, keys, last, 130).collect()
        if not some:
            break
        got += [r.slug for r in some]
        last = tuple(some[-1][c] for c, _ in keys)
    assert got == want


def test_deep_pages_equal_shallow_ones(rows):
    order = filters.sort_mode("score_asc")[1:]
    for number in (1, 3, 14, 15):
        shallow, deep = (ranks.page(rows, order, number, 50, shallow=s).collect() for s in (10_000, 0))
        assert sorted((r.slug, r.rank) for r in shallow) == sorted((r.slug, r.rank) for r in deep) == [(f"s{i:04}", i + 1) for i in range(50 * number - 50, min(700, 50 * number))]


def test_tops(rows):
    orders = {"x up": ("x", False), "x down": ("x", True), "kind up": ("kind", False), "kind down": ("kind", True), "id down": ("id", True)}
    got = ranks.tops(rows, {k: (F.col(c), down) for k, (c, down) in orders.items()}, "slug", 9).collect()
    for k, (c, down) in orders.items():
        assert [r.slug for r in sorted((g for g in got if g.order == k), key=lambda r: r.place)] == [r.slug for r in in_order(rows.collect(), [(c, down), ("slug", False)])[:9]]


@pytest.mark.parametrize("name, scans", [("explorer_orders", 2), ("csv_report", 2), ("site_orders", 2), ("deep_page", 2), ("tool_search", 1)])
def test_one_scan_and_no_single_task(spark, sf_dir, name, scans):
    """A profile scan reads documents and labels; what is written in between is read again in its place. A window's rows without a key are at most a range's each."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) <= scans
    for single in re.findall(r"Exchange SinglePartition[^\n]*\n[^\n]*", plan):
        raise AssertionError(single)
