"""Order statistics over a whole table, or inside large groups, without a window over all of it.

A table is first reduced to one row per distinct value (a value shared by a third of the rows
is one row by then), cut into value buckets at approximate quantiles, scanned inside each
bucket, and corrected by the totals of the buckets before it. Only the bucket totals (at most
``BUCKETS`` rows a group) meet in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def _with(d: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join with one row (or bucket row) per group; a NULL in the group is a group like others."""
    o = other.withColumnsRenamed({c: f"_g_{c}" for c in by})
    return d.join(o, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]).drop(*[f"_g_{c}" for c in by])


def by_value(df: DataFrame, value: str, by: Sequence[str] = (), **measures: Column) -> DataFrame:
    """One row per distinct value (in each group of ``by``) with its measures, and the value bucket it falls in."""
    d = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*[c.alias(n) for n, c in measures.items()])
    cuts = [i / BUCKETS for i in range(1, BUCKETS)]
    splits = d.groupBy(*by).agg(F.percentile_approx(value, cuts, 10000).alias("_splits"))   # one row of fixed size a group
    d = _with(d, splits, by) if by else d.join(F.broadcast(splits))
    return d.withColumn("_bucket", F.size(F.filter("_splits", lambda s: s < F.col(value)))).drop("_splits")


def add_before(d: DataFrame, value: str, measures: list[str], by: Sequence[str] = ()) -> DataFrame:
    """For each measure its sum over smaller values (``m_before``) and over all (``m_total``) of the group."""
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)   # at most BUCKETS rows a group
    every = Window.partitionBy(*by).orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = d.groupBy(*by, "_bucket").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    totals = totals.select(*by, "_bucket", *[F.coalesce(F.sum(f"_{m}").over(earlier), F.lit(0)).alias(f"_{m}_off") for m in measures],
                           *[F.sum(f"_{m}").over(every).alias(f"{m}_total") for m in measures])
    d = d.select("*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_{m}_in") for m in measures])
    d = _with(d, totals, [*by, "_bucket"]) if by else d.join(F.broadcast(totals), "_bucket")
    for m in measures:
        d = d.withColumn(f"{m}_before", F.col(f"_{m}_in") + F.col(f"_{m}_off")).drop(f"_{m}_in", f"_{m}_off")
    return d


def running_extreme(d: DataFrame, value: str, measure: str, out: str, how: str) -> DataFrame:
    """Running max over smaller-or-equal values, or (how="min") running min over larger-or-equal."""
    agg = F.max if how == "max" else F.min
    order = F.col(value).asc() if how == "max" else F.col(value).desc()
    b_order = F.col("_bucket").asc() if how == "max" else F.col("_bucket").desc()
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy(b_order).rowsBetween(Window.unboundedPreceding, -1)     # at most BUCKETS rows
    totals = d.groupBy("_bucket").agg(agg(measure).alias("_m")).select("_bucket", agg("_m").over(earlier).alias("_edge"))
    pick = F.greatest if how == "max" else F.least
    return (d.withColumn("_run", agg(measure).over(inside)).join(F.broadcast(totals), "_bucket")
            .withColumn(out, pick("_run", "_edge")).drop("_run", "_edge"))
