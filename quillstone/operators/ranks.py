"""Ranks and pages of ordered rows without one task that sees them all."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.sources.shared import stored


def ranked(rows: DataFrame, order: list[Column], name: str = "rank", within: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """rows with their place (from 1) in `order`, among those of equal `within` where given. The order must tell all rows apart, or ties are placed anyhow.

    Two passes: rows are cut into `parts` ranges of the order (default: spark.sql.shuffle.partitions), sorted and numbered within each and written; then each range begins where the counts of the earlier ones end. Only
    those counts, one a range and group, are summed in order, without groups at the driver. The table lies in the shared folder.
    """
    within = within or []
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*map(F.col, within), *order]
    cut = stored(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("__at", 33)
    keys = {f"__k{i}": F.col(c) for i, c in enumerate(within)}
    sizes = cut.groupBy(part.alias("__part"), *[c.alias(k) for k, c in keys.items()]).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    if within:
        earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that a group has rows in
        starts = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0).cast("long"))).drop("__n")
    else:
        found = sorted(map(tuple, sizes.collect()))  # a row for each range
        before = [0, *accumulate(n for _, n, _ in found)]
        starts = rows.sparkSession.createDataFrame([(p, first, b) for (p, _, first), b in zip(found, before)], "__part long, __first long, __before long")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(k)) for k, c in zip(keys, within)], part == F.col("__part"))
    out = cut.join(starts, same)
    return out.withColumn(name, F.col("__before") + F.col("__at") - F.col("__first") + 1).drop("__at", "__part", "__first", "__before", *keys)


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 50, name: str = "rank", shallow: int = 10_000) -> DataFrame:
    """Page `number` (from 1) of `size` rows with their places. Pages that end within `shallow` rows are the last of so many; deeper ones come from `ranked`, so no task sorts more than its range."""
    first = (max(1, number) - 1) * size
    if first + size > shallow:
        return ranked(rows, order, name).where(F.col(name).between(first + 1, first + size))
    some = rows.orderBy(*order).limit(first + size)  # at most `shallow` rows
    return some.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long")).where(F.col(name) > first)


def page_after(rows: DataFrame, keys: list[tuple[str, bool]], last: tuple | None, size: int = 50) -> DataFrame:
    """The `size` rows after `last`, the previous page's last values of `keys` (column, descending), or the first page: whatever the depth, a task keeps `size` rows. Nulls come first, or last where descending."""
    order = [F.desc(c) if down else F.asc(c) for c, down in keys]
    if last is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for (c, down), value in zip(keys, last):
            if value is None:
                further = F.lit(False) if down else F.col(c).isNotNull()
            else:
                further = ((F.col(c) < value) | F.col(c).isNull()) if down else F.col(c) > value
            beyond = beyond | (equal & F.coalesce(further, F.lit(False)))
            equal = equal & F.col(c).eqNullSafe(F.lit(value))
        rows = rows.where(beyond)
    return rows.orderBy(*order).limit(size)


def tops(rows: DataFrame, orders: dict[str, tuple[Column, bool]], tie: str, size: int, label: str = "order", name: str = "place") -> DataFrame:
    """The first `size` rows in each of several orders (a number's or text's column, descending), ties by `tie`, in one pass: each task passes on its own first `size` rows of an order. Nulls come first, or last where descending."""
    entries = []
    for k, (key, down) in orders.items():
        text = isinstance(rows.select(key.alias("k")).schema["k"].dataType, T.StringType)
        number = F.lit(None).cast("double") if text else F.coalesce(-key.cast("double"), F.lit(float("inf"))) if down else key.cast("double")
        up, low = (key if text and not down else F.lit(None).cast("string")), (key if text and down else F.lit(None).cast("string"))
        entries.append(F.struct(F.lit(k).alias("label"), number.alias("number"), up.alias("up"), low.alias("low")))
    each = rows.withColumn("__o", F.explode(F.array(*entries)))
    first = Window.partitionBy("__o.label").orderBy("__o.number", "__o.up", F.desc("__o.low"), tie)
    some = each.withColumn(name, F.row_number().over(first)).where(F.col(name) <= size)
    return some.select(F.col("__o.label").alias(label), *rows.columns, name)
