"""Array expressions: a row's draws live in one array column, so a band needs no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_percentile(ordered: Column, p: float) -> Column:
    """Linear-interpolation percentile of an ascending array without NULLs."""
    n = F.size(ordered)
    pos = F.lit(p) * (n - 1)
    lo = F.floor(pos)
    a = F.element_at(ordered, (lo + 1).cast("int"))
    b = F.element_at(ordered, F.least(lo + 2, n).cast("int"))
    return F.when(n > 0, a + (b - a) * (pos - lo))


def percentile(values: Column, p: float) -> Column:
    return sorted_percentile(F.sort_array(F.filter(values, lambda x: x.isNotNull())), p)


def with_percentiles(df: DataFrame, values: str, levels: dict[str, float]) -> DataFrame:
    """Named percentiles of an array column; the array is sorted once."""
    d = df.withColumn("_sorted", F.sort_array(F.filter(values, lambda x: x.isNotNull())))
    return d.withColumns({n: sorted_percentile(F.col("_sorted"), p) for n, p in levels.items()}).drop("_sorted")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
