"""Array helpers as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(a: Column) -> Column:
    """Number of elements; a null array has none."""
    return F.coalesce(F.size(a), F.lit(0))


def missing(a: Column) -> Column:
    return length(a) == 0


def has(a: Column, test) -> Column:
    """Whether some element passes; a null array has none."""
    return F.coalesce(F.exists(a, test), F.lit(False))


def distinct_ci(a: Column) -> Column:
    """Without elements that differ from an earlier one in case alone; the first spelling stays, order too."""
    return F.filter(a, lambda x, i: ~F.exists(F.slice(a, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))


def merged_ci(a: Column, b: Column) -> Column:
    """a, then the elements of b that are not in a, case apart."""
    a, b = F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))
    return F.concat(a, F.filter(b, lambda x: ~F.exists(a, lambda y: F.lower(y) == F.lower(x))))


def overlaps_ci(a: Column, values: list[str]) -> Column:
    """Whether an element is among the values, case apart."""
    return has(a, lambda x: F.lower(x).isin([v.lower() for v in values]))


def keys_outside(m: Column, known: list[str]) -> Column:
    """A map's keys that are not known ones."""
    return F.array_except(F.map_keys(m), F.array(*map(F.lit, known)))
