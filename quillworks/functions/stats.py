"""Statistics of the scorer as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def round4(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5) / 10000


def ratio(a: Column, b: Column) -> Column:
    """To four places; null over nothing."""
    return F.when(b > 0, round4(a.cast("double") / b.cast("double")))


def wilson(k: Column, n: Column) -> Column:
    """95 % interval of a share as (low, high), clamped and to four places; null over nothing."""
    k, n = k.cast("double"), n.cast("double")
    p, z2 = k / n, Z * Z
    under = 1 + z2 / n
    center = (p + z2 / (2 * n)) / under
    half = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / under
    low, high = F.greatest(F.lit(0.0), center - half), F.least(F.lit(1.0), center + half)
    return F.when(n > 0, F.struct(round4(low).alias("low"), round4(high).alias("high")))


def median(x: Column) -> Column:
    return F.percentile(x, 0.5)


def p95(x: Column) -> Column:
    """The value at place floor(0.95 n) - 1 of the sorted list, not interpolated; null of nothing.

    An exact order statistic of a group: the group's values meet in one task, as they do for an exact median.
    """
    n = F.count(x)
    return F.when(n > 0, F.get(F.array_sort(F.collect_list(x)), F.greatest(F.lit(0), F.floor(n * 0.95).cast("int") - 1)))
