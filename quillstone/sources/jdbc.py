"""Tables of a database over JDBC: partitioned reads, and batched upserts through a staging table."""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@contextmanager
def connection(spark: SparkSession, url: str, properties: dict[str, str] | None = None):
    """A connection of the driver's own, for one transaction: committed at the end, rolled back after an error."""
    jvm = spark.sparkContext._jvm
    given = jvm.java.util.Properties()
    for k, v in (properties or {}).items():
        given.setProperty(k, v)
    conn = jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        conn.setAutoCommit(False)
        yield conn
        conn.commit()
    except BaseException:
        conn.rollback()
        raise
    finally:
        conn.close()


def execute(conn, statement: str) -> int:
    s = conn.createStatement()
    try:
        return s.executeUpdate(statement)
    finally:
        s.close()


def table_exists(conn, table: str) -> bool:
    found = conn.getMetaData().getTables(None, None, table, None)
    try:
        return found.next()
    finally:
        found.close()


def bounds(spark: SparkSession, url: str, table: str, column: str, properties: dict[str, str] | None = None):
    """(least, greatest, rows) of a column, by the database's own aggregate."""
    c = quoted(column)
    query = f"(SELECT min({c}) AS lo, max({c}) AS hi, count(*) AS n FROM {quoted(table)}) b"
    row = spark.read.jdbc(url, query, properties=properties or {}).first()
    return tuple(row)


def read_table(spark: SparkSession, url: str, table: str, column: str | None = None, rows_each: int = 200_000, properties: dict[str, str] | None = None) -> DataFrame:
    """A table, read by as many connections as it has `rows_each` rows, by ranges of `column` (a number, date or timestamp, best an indexed one) between its least and greatest value. Filters and columns reach the database.

    Ranges are equally wide, so give a column without large gaps; nulls are read with the lowest range. Without a column, or with one value, one connection reads all.
    """
    properties = properties or {}
    lo, hi, n = bounds(spark, url, table, column, properties) if column else (None, None, 0)
    parts = math.ceil(n / rows_each)
    if parts < 2 or lo is None or lo == hi:
        return spark.read.jdbc(url, quoted(table), properties=properties)
    edge = lambda x: x if isinstance(x, int) else math.floor(x) if hasattr(x, "__floor__") else str(x)
    return spark.read.jdbc(url, quoted(table), column=quoted(column), lowerBound=edge(lo), upperBound=edge(hi), numPartitions=parts, properties=properties)


def flat(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which any database can hold."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return rows.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in rows.schema])


def create_if_absent(rows: DataFrame, url: str, table: str, keys: list[str], properties: dict[str, str] | None = None) -> None:
    """An empty table of rows' columns with a primary key, unless there is one of the name."""
    spark = rows.sparkSession
    with connection(spark, url, properties) as conn:
        if table_exists(conn, table):
            return
    texts = ", ".join(f"{f.name} VARCHAR(255)" for f in rows.schema if f.name in keys and isinstance(f.dataType, T.StringType))
    writer = rows.limit(0).write
    (writer.option("createTableColumnTypes", texts) if texts else writer).jdbc(url, quoted(table), mode="ignore", properties=properties or {})
    with connection(spark, url, properties) as conn:
        for k in keys:
            execute(conn, f"ALTER TABLE {quoted(table)} ALTER COLUMN {quoted(k)} NOT NULL")
        execute(conn, f"ALTER TABLE {quoted(table)} ADD PRIMARY KEY ({', '.join(map(quoted, keys))})")


def upsert(rows: DataFrame, url: str, table: str, keys: list[str], order: list[str] | None = None, connections: int = 8, batch_size: int = 1000, properties: dict[str, str] | None = None) -> int:
    """Put rows into a table: a row whose keys are there replaces the one that has them, in all of its columns; the others are new. Returns how many rows went in.

    Executors write batches to a staging table of this call's own, `connections` at a time; then one MERGE in one transaction puts them in, so readers see all or nothing and a call that died before it left the
    table as it was. A task that runs twice may stage a row twice, and rows may repeat a key: the last one in `order` counts (any one without an order), as the staged rows are reduced by
    key in the database. Null keys are an error, as a primary key asks. Columns that the table has besides stay as they are, null in new rows.
    """
    spark, properties = rows.sparkSession, properties or {}
    names, rank = list(rows.columns), F.struct(*(order or rows.columns))
    one = flat(rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in names]), rank).alias("row")).select("row.*"))
    create_if_absent(one, url, table, keys, properties)
    staging = f"{table}_{uuid.uuid4().hex[:12]}"
    target = f"t.{{0}} = s.{{0}}"
    both, rest = " AND ".join(target.format(quoted(k)) for k in keys), [c for c in names if c not in keys]
    setting = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{quoted(c)} = s.{quoted(c)}' for c in rest)}" if rest else ""
    into = f"({', '.join(map(quoted, names))}) VALUES ({', '.join('s.' + quoted(c) for c in names)})"
    with connection(spark, url, properties) as conn:
        # of the target's own types, so that keys compare alike; without its key, as a task may come twice
        execute(conn, f"CREATE TABLE {quoted(staging)} AS SELECT {', '.join(map(quoted, names))} FROM {quoted(table)} WITH NO DATA")
    try:
        one.repartition(connections).write.option("batchsize", batch_size).jdbc(url, quoted(staging), mode="append", properties=properties)
        with connection(spark, url, properties) as conn:
            return execute(conn, f"MERGE INTO {quoted(table)} t USING {quoted(staging)} s ON {both}{setting} WHEN NOT MATCHED THEN INSERT {into}")
    finally:
        with connection(spark, url, properties) as conn:
            execute(conn, f"DROP TABLE {quoted(staging)}")


def sync_run(runs: DataFrame, profiles: DataFrame, url: str, run_id: str, properties: dict[str, str] | None = None, **how) -> int:
    """Copy a run's record and its profiles to the tables `runs` and `profiles` of a database; a second sync replaces what the first one put there. Returns the number of profiles."""
    record = runs.where(F.col("run_id") == run_id)
    if record.isEmpty():
        raise ValueError(f"no run {run_id}")
    upsert(record, url, "runs", ["run_id"], properties=properties, **how)
    return upsert(profiles.where(F.col("run_id") == run_id), url, "profiles", ["run_id", "slug"], properties=properties, **how)
