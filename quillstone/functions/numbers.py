"""Number helpers as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded with halves towards plus infinity, as a double."""
    factor = float(10**digits)
    return (F.floor(x * factor + 0.5) / factor).cast("double")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """part of whole in percent; a whole of 0 counts as 1."""
    return half_up(100.0 * part / F.greatest(whole, F.lit(1)), digits)


def count_where(condition: Column) -> Column:
    """How many rows hold it; 0 over no rows."""
    return F.count(F.when(condition, 1))


def share_where(condition: Column, digits: int = 1) -> Column:
    """In percent of all rows, nulls as no; 0 over no rows."""
    return half_up(F.coalesce(F.avg(F.when(condition, 100.0).otherwise(0.0)), F.lit(0.0)), digits)


def mean(x: Column, digits: int = 1) -> Column:
    """Rounded mean, 0 without values."""
    return half_up(F.coalesce(F.avg(x), F.lit(0.0)), digits)
