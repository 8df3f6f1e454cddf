"""A running stream's counts as a table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query string, run string, batch long, at timestamp, stage string, name string, n long"


class ProgressTable(StreamingQueryListener):
    """Appends each batch's observed counts (DataFrame.observe: one row a metric) and its input rows to a table as they are reported; add it with spark.streams.addListener.

    Rows carry the batch's number, so a reader keeps one of a batch that ran twice. Queries that `only` does not name are left alone.
    """

    def __init__(self, spark: SparkSession, path: str, only: set[str] | None = None):
        self.spark, self.path, self.only, self.failed = spark, path, only, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.only is not None and p.name not in self.only:
            return
        from datetime import datetime

        at = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
        counts = [("input", "rows", p.numInputRows)]
        for stage, row in (p.observedMetrics or {}).items():
            counts += [(stage, name, int(n)) for name, n in row.asDict().items() if n is not None]
        rows = [(p.name, str(p.runId), p.batchId, at, stage, name, n) for stage, name, n in counts]
        try:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        except Exception as e:  # a report that can't be written must not end the query; it is kept for whoever asks
            self.failed.append(e)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def stage_counts(spark: SparkSession, path: str):
    """(query, stage, name, n): sums over batches, of each batch once, in its latest run."""
    from pyspark.sql import functions as F

    rows = spark.read.schema(SCHEMA).parquet(path)
    once = rows.groupBy("query", "batch", "stage", "name").agg(F.max_by("n", "at").alias("n"))
    return once.groupBy("query", "stage", "name").agg(F.sum("n").alias("n"))
