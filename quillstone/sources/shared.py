"""Tables in the folder that all executors share: where lineage ends, so that a lost executor costs a reread."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The one that spark.checkpoint.dir names; one of our own only where none is named and all runs on this machine, as in tests."""
    global _own
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _own = _own or "file://" + tempfile.mkdtemp(prefix="quillstone-")
    return _own


def stored(df: DataFrame, name: str) -> DataFrame:
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` written to the shared folder and read back, and its path, for remove()."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system, its path object) of a path in any store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    fs, where = file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(where)
