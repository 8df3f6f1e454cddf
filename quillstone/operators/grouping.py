"""Groups of small size, handled in order, many to a task."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def map_groups(df: DataFrame, keys: list[str], order: list[str], each: Callable[[tuple, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Rows of `each(key, rows)` for every group, its rows sorted by `order`, as tuples of df's columns. Groups stream through their partition: only one is held at a time."""
    at = [df.columns.index(k) for k in keys]
    names = StructType.fromDDL(schema).fieldNames()

    def run(batches):
        now, rows = None, []
        for pdf in batches:
            out = []
            for row in pdf.astype(object).itertuples(index=False, name=None):
                key = tuple(row[i] for i in at)
                if key != now and rows:
                    out += each(now, rows)
                    rows = []
                now = key
                rows.append(row)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(each(now, rows) if rows else [], columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
