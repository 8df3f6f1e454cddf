"""A database over JDBC: Derby, which comes with Spark, in memory."""

import uuid

import pytest
from pyspark.sql import functions as F

from quillstone.sources import jdbc


@pytest.fixture
def url():
    return f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"


def profiles(spark, n=50, run="r1"):
    return spark.range(n).select(F.lit(run).alias("run_id"), F.concat(F.lit("p"), "id").alias("slug"), "id", (F.col("id") * 1.5).alias("score"), F.array(F.lit("a"), F.col("id").cast("string")).alias("tags"), F.when(F.col("id") % 2 == 0, F.lit("x")).alias("note"))


def rows(spark, url, table="profiles", **how):
    return {(r.run_id, r.slug): (r.id, r.score, r.tags, r.note) for r in jdbc.read_table(spark, url, table, **how).collect()}


def test_a_second_sync_replaces(spark, url):
    runs = spark.createDataFrame([("r1", "completed"), ("r2", "running")], "run_id string, status string")
    both = profiles(spark).union(profiles(spark, 5, "r2"))
    assert jdbc.sync_run(runs, both, url, "r1", connections=3, batch_size=7) == 50
    first = rows(spark, url)
    assert len(first) == 50 and first["r1", "p3"] == (3, 4.5, '["a","3"]', None)
    later = both.withColumns({"score": F.when(F.col("id") == 3, F.lit(None)).otherwise(F.col("score")), "note": F.lit("new")}).where("id > 1").union(profiles(spark, 61).where("id >= 60"))
    jdbc.sync_run(runs.withColumn("status", F.lit("failed")), later, url, "r1")
    got = rows(spark, url)
    assert len(got) == 51 and got["r1", "p3"] == (3, None, '["a","3"]', "new") and got["r1", "p0"] == first["r1", "p0"] and got["r1", "p60"][0] == 60
    assert [tuple(r) for r in jdbc.read_table(spark, url, "runs").collect()] == [("r1", "failed")]
    with pytest.raises(ValueError):
        jdbc.sync_run(runs, both, url, "none")


def test_reads_are_partitioned_and_pushed_down(spark, url):
    jdbc.upsert(profiles(spark, 100), url, "profiles", ["run_id", "slug"])
    whole = jdbc.read_table(spark, url, "profiles", "id", rows_each=30)
    assert whole.rdd.getNumPartitions() == 4 and rows(spark, url, column="id", rows_each=30) == rows(spark, url)
    some = whole.where("id > 90").select("slug")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,90)" in plan and some.count() == 9
    assert sum(1 for x in whole.rdd.glom().map(len).collect() if x) == 4
    assert jdbc.bounds(spark, url, "profiles", "id") == (0, 99, 100)


def test_repeated_keys_leave_the_last(spark, url):
    twice = spark.createDataFrame([("r", "s", 1, "old"), ("r", "s", 2, "new"), ("r", "t", 1, "one")], "run_id string, slug string, at int, v string")
    assert jdbc.upsert(twice, url, "t", ["run_id", "slug"], order=["at"]) == 2
    assert {(r.slug, r.v) for r in jdbc.read_table(spark, url, "t").collect()} == {("s", "new"), ("t", "one")}
    jdbc.upsert(twice.select("run_id", "slug").distinct(), url, "keys", ["run_id", "slug"])
    assert jdbc.read_table(spark, url, "keys").count() == 2


def test_a_failed_merge_leaves_the_table(spark, url):
    jdbc.upsert(profiles(spark, 3), url, "profiles", ["run_id", "slug"])
    before = rows(spark, url)
    with pytest.raises(Exception):  # noqa: B017
        jdbc.upsert(profiles(spark, 5).withColumn("slug", F.when(F.col("id") < 4, F.col("slug"))), url, "profiles", ["run_id", "slug"])
    assert rows(spark, url) == before
    with jdbc.connection(spark, url) as conn:
        found = conn.getMetaData().getTables(None, None, "profiles_%", None)
        assert not found.next()
