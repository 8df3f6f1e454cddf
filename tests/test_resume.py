"""Bucketed merges, the stream that rests on them, and its progress."""

import os
import re
import time
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quillstone.sources import buckets, snapshots
from quillstone.streaming.ingest import merge_pages
from quillstone.streaming.progress import ProgressTable, stage_counts


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("part-*.parquet")}


def table(spark, n, runs=("a", "7")):
    rows = spark.range(n).select(F.concat(F.lit("s"), "id").alias("slug"), (F.col("id") * 2).alias("x"), F.lit("old").alias("note"))
    return rows.crossJoin(spark.createDataFrame([(r,) for r in runs], "run_id string"))


def delta(spark, rows, changed):
    return spark.createDataFrame(rows, "run_id string, slug string, x long, note string").withColumn("changed", F.array(*map(F.lit, changed)))


def test_a_merge_rewrites_only_its_buckets(spark, tmp_path):
    path = f"{tmp_path}/t"
    buckets.write(table(spark, 400), path, 16)
    before = files(path)
    assert len(before) == 32
    old = {(r.run_id, r.slug): (r.x, r.note) for r in buckets.read(spark, path).collect()}
    some = delta(spark, [("a", "s3", -1, None), ("a", "s4", -2, None), ("7", "new", 5, "n")], ["note", "x"])
    want = {(r.run_id, r.b) for r in some.select("run_id", buckets.bucket_of(F.col("slug"), 16).alias("b")).collect()}
    buckets.upsert(spark, path, some, f"{tmp_path}/staged", 0, buckets=16)
    after = files(path)
    gone, new = set(before) - set(after), set(after) - set(before)
    place = lambda names: {tuple(re.match(r"run_id=(\w+)/bucket=(\d+)/", n).groups()) for n in names}
    assert place(gone) <= place(new) == {(r, str(b)) for r, b in want} and len(new) == len(want)
    assert all(before[n] == after[n] for n in set(before) & set(after))
    got = {(r.run_id, r.slug): (r.x, r.note) for r in buckets.read(spark, path).collect()}
    assert got == old | {("a", "s3"): (-1, None), ("a", "s4"): (-2, None), ("7", "new"): (5, "n")}


def test_the_plan_reads_no_other_bucket(spark, tmp_path):
    path = f"{tmp_path}/t"
    buckets.write(table(spark, 400), path, 16)
    some = delta(spark, [("a", "s3", -1, None)], ["x"])
    rows = buckets.merged(spark, path, some, buckets=16)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan)
    number = some.select(buckets.bucket_of(F.col("slug"), 16)).first()[0]
    scan = buckets.only(buckets.read(spark, path), {"a": [number]})
    scan.collect()
    assert scan._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numFiles").get().value() == 1
    assert {(r.slug, r.x, r.note) for r in rows.where("slug = 's3'").collect()} == {("s3", -1, "old")}


def test_changes_of_one_key_fold_in_order(spark):
    rows = spark.createDataFrame(
        [("a", "s", 1, 10, "p", ["x", "note"]), ("a", "s", 3, None, "q", ["x"]), ("a", "s", 2, 30, "r", ["note"]), ("a", "t", 1, 4, "z", ["note"])],
        "run_id string, slug string, at int, x int, note string, changed array<string>",
    )
    got = {r.slug: (r.x, r.note, set(r.changed)) for r in buckets.folded(rows, ["at"]).collect()}
    assert got == {"s": (None, "r", {"x", "note"}), "t": (4, "z", {"note"})}


def test_a_batch_that_died_while_publishing_is_published_again(spark, tmp_path, monkeypatch):
    path, staged = f"{tmp_path}/t", f"{tmp_path}/staged"
    buckets.write(table(spark, 100, ("a",)), path, 8)
    some = delta(spark, [("a", f"s{i}", -i, "new") for i in range(0, 100, 3)], ["x", "note"])

    def half(spark, aside, target):
        buckets._put(buckets.read(spark, aside).where("bucket < 3"), target)
        for f in Path(target).rglob("bucket=5/*"):  # old files gone, new ones not there yet
            f.unlink()
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(buckets, "publish", half)
        with pytest.raises(OSError):
            buckets.upsert(spark, path, some, staged, 4, buckets=8)
    for _ in range(2):
        buckets.upsert(spark, path, some, staged, 4, buckets=8)
        got = {r.slug: (r.x, r.note) for r in buckets.read(spark, path).collect()}
        assert got == {f"s{i}": ((-i, "new") if i % 3 == 0 else (2 * i, "old")) for i in range(100)}
    buckets.upsert(spark, path, delta(spark, [("a", "s0", 9, None)], ["x"]), staged, 5, buckets=8)
    assert os.listdir(staged) == ["batch=5"] and buckets.read(spark, path).where("slug = 's0'").first().x == 9
    buckets.upsert(spark, path, delta(spark, [("a", "s0", 9, None)], ["x"]).limit(0), staged, 6, buckets=8)
    assert buckets.read(spark, path).count() == 100


def test_a_stage_runs_for_unfinished_rows_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([("a", "p", "parse_done", None), ("a", "q", "booking_done", 1), ("a", "r", "error", None), ("b", "p", "parse_done", None)], "run_id string, slug string, scrape_status string, n int")
    buckets.write(rows, path, 4)
    seen = []

    def work(todo):
        seen.extend(sorted(r.slug for r in todo.collect()))
        return todo.select("slug", F.lit(7).alias("n"))

    for batch in range(2):
        buckets.advance(spark, path, "a", "booking_done", work, f"{tmp_path}/staged", batch, 4)
    got = {(r.run_id, r.slug): (r.scrape_status, r.n) for r in buckets.read(spark, path).collect()}
    assert seen == ["p", "r"] and got == {("a", "p"): ("booking_done", 7), ("a", "q"): ("booking_done", 1), ("a", "r"): ("booking_done", 7), ("b", "p"): ("parse_done", None)}


def pages(spark, folder):
    """Three files, of which two have a page of the same slug."""
    page = lambda name: f"<h1>{name}</h1><h2>About</h2><p>About {name}</p>"
    for k, rows in enumerate([[(1, "ann"), (2, "bo")], [(3, "ann"), (4, "cy")], [(5, "di"), (6, None)]]):
        some = [(i, f"https://x/{n}?a=1" if n else None, page(f"{n} {i}") if n else None) for i, n in rows]
        spark.createDataFrame(some, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files are taken in order of time
    return folder


@pytest.mark.parametrize("again", [False, True])
def test_a_killed_stream_ends_with_the_same_table(spark, tmp_path, monkeypatch, again):
    source = pages(spark, f"{tmp_path}/pages")
    start = lambda where: merge_pages(spark, source, f"{tmp_path}/{where}", f"{tmp_path}/{where}-checkpoint", "r1", 1, 4, again)
    start("whole").awaitTermination()
    real, calls = buckets.publish, []

    def dies(spark, aside, path):
        calls.append(aside)
        if len(calls) == 2:  # the second batch, between writing aside and publishing
            raise OSError("killed")
        real(spark, aside, path)

    monkeypatch.setattr(buckets, "publish", dies)
    with pytest.raises(StreamingQueryException):
        start("torn").awaitTermination()
    first = buckets.read(spark, f"{tmp_path}/torn").count()
    start("torn").awaitTermination()
    read = lambda where: sorted((r.slug, r.page_id, r.about_text, r.scrape_status) for r in buckets.read(spark, f"{tmp_path}/{where}").collect())
    assert first == 2 and read("torn") == read("whole") and len(read("whole")) == 4
    assert dict((s, i) for s, i, *_ in read("whole"))["ann"] == (3 if again else 1)
    assert calls[1] == calls[2]  # the batch was published from what it had merged


def test_progress_of_a_running_stream(spark, tmp_path):
    source = pages(spark, f"{tmp_path}/pages")
    listener = ProgressTable(spark, f"{tmp_path}/progress")
    spark.streams.addListener(listener)
    try:
        merge_pages(spark, source, f"{tmp_path}/t", f"{tmp_path}/c", "r1", 1, 4, observed="parse").awaitTermination()
        until = time.time() + 30
        want = {("input", "rows"): 6, ("parse", "pages"): 6, ("parse", "without_html"): 1}
        got = {}
        while got != want and time.time() < until:
            time.sleep(0.5)
            if snapshots.exists(spark, f"{tmp_path}/progress"):
                got = {(r.stage, r.name): r.n for r in stage_counts(spark, f"{tmp_path}/progress").collect()}
    finally:
        spark.streams.removeListener(listener)
    assert got == want and not listener.failed
