"""Cross-sections, rankings, agreement with benchmarks, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions.columns import ordered, whole
from pitpanel.operators.asof import asof
from pitpanel.operators.calendar import Keys
from pitpanel.operators.scan import add_before, by_value


def average_rank(value: str, by: Keys) -> Column:
    """Rank from 1 within a group, ties sharing the mean of their ranks (a column); for groups bounded by the calendar."""
    ties = F.count(value).over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (ties - 1) / 2.0


def average_ranks(df: DataFrame, value: str, by: Keys, out: str) -> DataFrame:
    """Rank from 1 within a group, ties sharing the mean of their ranks: by, value, ``out`` and ``n_total``, one row per distinct value."""
    r = add_before(by_value(df, value, by, n=F.count("*")), value, ["n"], by)
    return r.select(*by, value, (F.col("n_before") + (F.col("n") + 1) / 2.0).alias(out), "n_total")


def latest_cross_section(gaps: DataFrame, entity: str, time: str, value: str, focus: int) -> DataFrame:
    """The last month with any value: every entity's rank (1 = largest), the focus entity's
    rank, the median and the count."""
    known = gaps.where(F.col(value).isNotNull())
    last = known.agg(F.max(time).alias("_last"))                                            # one row
    d = known.join(F.broadcast(last), known[time] == F.col("_last")).drop("_last").withColumn("_neg", -F.col(value))
    ranks = add_before(by_value(d, "_neg", n=F.count("*")), "_neg", ["n"])
    ranked = d.join(ranks.select("_neg", (F.col("n_before") + 1).alias("rank"), F.col("n_total").alias("n")), "_neg")
    holds = lambda place: (F.col("n_before") < place) & (F.col("n_before") + F.col("n") >= place)
    at = lambda place: F.max(F.when(holds(place), -F.col("_neg")))
    middle = ranks.agg(((at(F.floor((F.col("n_total") + 1) / 2)) + at(F.floor((F.col("n_total") + 2) / 2))) / 2).alias("median"))
    focal = d.agg(F.max(F.when(F.col(entity) == focus, F.col("_neg"))).alias("_focus")).crossJoin(middle)       # one row each
    focal = focal.join(ranks.select(F.col("_neg").alias("_focus"), (F.col("n_before") + 1).alias("focus_rank")), "_focus", "left")
    return ranked.join(F.broadcast(focal.select("median", "focus_rank"))).select(
        entity, time, value, "rank", "focus_rank", "median", "n")


def episodes(gaps: DataFrame, spec: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    """Mean before and after each episode and whether it moved as expected.

    ``spec`` is (entity, label, before_from, before_to, after_from, after_to, direction)."""
    j = gaps.join(F.broadcast(spec), entity)                                                # settings table
    within = lambda a, b: F.col(time).between(F.col(a), F.col(b))
    g = j.groupBy(entity, "label", "direction").agg(
        F.avg(F.when(within("before_from", "before_to"), F.col(value))).alias("before_mean"),
        F.avg(F.when(within("after_from", "after_to"), F.col(value))).alias("after_mean"))
    g = g.withColumn("change", F.col("after_mean") - F.col("before_mean"))
    return g.withColumn("as_expected", F.signum("change") == F.col("direction"))


def year_average(gaps: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    return gaps.where(F.col(value).isNotNull()).groupBy(entity, F.year(time).alias("year")).agg(F.avg(value).alias(value))


def rank_agreement(df: DataFrame, entity: str, time: str, ours: str, theirs: str) -> DataFrame:
    """Rank correlation within each period (mean, min), pooled and within-entity correlation,
    share of equal signs: one row."""
    d = df.where(F.col(ours).isNotNull() & F.col(theirs).isNotNull())
    d = d.select(time, ours, theirs, (F.col(ours) - F.avg(ours).over(whole([entity]))).alias("_d1"),
                 (F.col(theirs) - F.avg(theirs).over(whole([entity]))).alias("_d2"))
    # equal pairs of a period are one row with their count; ranks come from buckets, not from a window over the period
    pairs = d.groupBy(time, ours, theirs).agg(F.count("*").alias("_w"))
    for c, r in ((ours, "_r1"), (theirs, "_r2")):
        ranks = average_ranks(d, c, [time], r).select(F.col(time).alias("_t"), F.col(c).alias("_v"), (F.col(r) - (F.col("n_total") + 1) / 2.0).alias(r))
        pairs = pairs.join(ranks, F.col(time).eqNullSafe(F.col("_t")) & (F.col(c) == F.col("_v"))).drop("_t", "_v")
    s = lambda a, b: F.sum(F.col("_w") * F.col(a) * F.col(b))
    spread = s("_r1", "_r1") * s("_r2", "_r2")
    by_time = pairs.groupBy(time).agg(F.when(spread > 0, s("_r1", "_r2") / F.sqrt(spread)).alias("_rank_corr")).agg(
        F.avg("_rank_corr").alias("mean_rank_corr"), F.min("_rank_corr").alias("min_rank_corr"))
    pooled = d.agg(F.count("*").alias("n"), F.corr(ours, theirs).alias("pooled_corr"), F.corr("_d1", "_d2").alias("within_corr"),
                   F.avg((F.signum(ours) == F.signum(theirs)).cast("double")).alias("same_sign"))
    return pooled.crossJoin(by_time)                                                        # one row each


def event_readings(series: DataFrame, events: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    """For each assessed (entity, year, published): our year average and our reading at publication."""
    known = series.where(F.col(value).isNotNull())
    yr = known.groupBy(entity, F.year(time).alias("year")).agg(F.avg(value).alias("year_mean"))
    at = asof(events, known, [entity], "published", time, [value])
    return at.join(yr, [entity, "year"], "left").withColumnRenamed(value, "at_publication")


def agreement(df: DataFrame, by: Keys, a: str, b: str, at_least: int = 3) -> DataFrame:
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    gap = F.col(a) - F.col(b)
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.corr(a, b).alias("corr"),
                           F.avg((F.signum(a) == F.signum(b)).cast("double")).alias("same_sign"),
                           F.avg(gap).alias("mean_diff"), F.avg(F.abs(gap)).alias("mean_abs_diff"))
    return g.select(*by, "n", *[F.when(F.col("n") >= at_least, F.col(c)).alias(c)
                                for c in ("corr", "same_sign", "mean_diff", "mean_abs_diff")])


def correlation_screen(df: DataFrame, keys: Keys, time: str, target: str, drivers: Sequence[str]) -> DataFrame:
    """Correlation of the target with each driver, in levels and in changes, one row per driver."""
    w = ordered(keys, time)
    d = df.withColumns({f"_d_{c}": F.col(c) - F.lag(c).over(w) for c in [target, *drivers]})
    pairs = F.array(*[F.struct(F.lit(c).alias("driver"), F.col(c).alias("x"), F.col(f"_d_{c}").alias("dx")) for c in drivers])
    e = d.select(*keys, F.col(target).alias("y"), F.col(f"_d_{target}").alias("dy"), F.explode(pairs).alias("p"))
    return e.groupBy(*keys, F.col("p.driver").alias("driver")).agg(
        F.corr("y", "p.x").alias("corr_levels"), F.corr("dy", "p.dx").alias("corr_changes"))


def latest_readings(df: DataFrame, keys: Keys, time: str, models: Sequence[str]) -> DataFrame:
    """One row per model: its latest value and the month it is from."""
    long = df.unpivot([*keys, time], list(models), "model", "value").where("value is not null")
    return long.groupBy(*keys, "model").agg(F.max(time).alias("as_of"), F.max_by("value", time).alias("value"))
