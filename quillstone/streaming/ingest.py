"""Streams: pages into a snapshot, appended or merged, and windowed event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.sources import buckets
from quillstone.sources.html import parse
from quillstone.sources.snapshots import exists, pending

PAGES = "page_id long, url string, html string"


def ingest_pages(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Parse each new page file once and append its profile; a restart goes on after the last finished batch."""
    pages = spark.readStream.schema(PAGES).parquet(source)
    return parse(pages).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()


def merge_pages(spark: SparkSession, source: str, target: str, checkpoint: str, run_id: str, files_each: int = 1000, n_buckets: int = buckets.BUCKETS, again: bool = False, observed: str | None = None) -> StreamingQuery:
    """Parse new page files into a run's buckets, a micro-batch at a time: a slug that has reached `parse_done` stays as it is, unless `again`; of several pages of a slug the one with the greatest page_id counts.

    Batches are idempotent by their number (buckets.upsert), so a query that dies anywhere, even while a batch is being published, goes on with the table that an undisturbed one would have. `observed` names
    the counts of pages read that progress reports carry.
    """

    def merge(batch: DataFrame, number: int) -> None:
        pages = batch.withColumn("slug", F.regexp_replace(F.regexp_extract("url", "([^/]+)/?$", 1), r"[?#].*$", "")).where("slug <> ''")
        if not again and exists(spark, target):
            known = buckets.read(spark, target).where(F.col("run_id") == run_id)
            pages = pending(pages, known.select("slug", "scrape_status"), "parse_done")
        latest = pages.groupBy("slug").agg(F.max_by(F.struct("page_id", "url", "html"), "page_id").alias("p")).select("slug", "p.*")
        rows = parse(latest).withColumns({"run_id": F.lit(run_id), "scrape_status": F.lit("parse_done")})
        names = [c for c in rows.columns if c not in buckets.KEYS]
        delta = rows.withColumn("changed", F.array(*map(F.lit, names))).persist()  # read for its buckets and for the merge: pages are parsed, and counted, once
        try:
            buckets.upsert(spark, target, delta, f"{checkpoint}/staged", number, buckets=n_buckets)
        finally:
            delta.unpersist()

    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_each).parquet(source)
    if observed:
        pages = pages.observe(observed, F.count(F.lit(1)).alias("pages"), F.count(F.when(F.col("html").isNull(), 1)).alias("without_html"))
    return pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of a batch or a stream of events; a stream closes windows behind its watermark."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
