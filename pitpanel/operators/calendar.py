"""Calendar, frequency and alignment.

Every operator takes a long table and the names of its key and time columns. Windows are
partitioned by the series key; a series is at most one row per period, so a partition is
bounded by the calendar, not by the raw data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions.columns import months_from, ordered, past, quarter_of, trailing, whole

Keys = Sequence[str]


def downsample(df: DataFrame, keys: Keys, time: str, value: str, rules: DataFrame, default: str = "mean") -> DataFrame:
    """Months from a higher frequency; ``rules`` (keys, how) says mean or last per series.

    Both results come from one aggregation, the rule only chooses between them."""
    m = df.groupBy(*keys, F.trunc(time, "MM").alias("ref_month")).agg(
        F.avg(value).alias("_mean"), F.max_by(value, time).alias("_last"))
    how = F.coalesce(F.col("how"), F.lit(default))
    return m.join(rules, list(keys), "left").select(
        *keys, "ref_month", how.alias("how"), F.when(how == "last", F.col("_last")).otherwise(F.col("_mean")).alias(value))


def finished_periods(df: DataFrame, keys: Keys, time: str, value: str, today: Column, unit: str = "MM") -> DataFrame:
    """Mean and count per period of daily data, without the period ``today`` falls in."""
    return (df.where(F.col(time) < F.trunc(today, unit))
            .groupBy(*keys, F.trunc(time, unit).alias("period"))
            .agg(F.avg(value).alias("mean"), F.count(value).alias("count")).where("count > 0"))


def month_last(df: DataFrame, keys: Keys, time: str, value: str) -> DataFrame:
    return (df.where(F.col(value).isNotNull()).groupBy(*keys, F.trunc(time, "MM").alias("ref_month"))
            .agg(F.max_by(value, time).alias(value)))


def quarter_mean(df: DataFrame, keys: Keys, month: str, value: str, months: int = 1) -> DataFrame:
    """Mean per quarter where at least ``months`` months are present (3 = complete quarters only)."""
    return (df.groupBy(*keys, quarter_of(month).alias("quarter"))
            .agg(F.avg(value).alias(value), F.count(value).alias("months")).where(F.col("months") >= months))


def year_mean(df: DataFrame, keys: Keys, month: str, value: str, months: int = 12) -> DataFrame:
    return (df.groupBy(*keys, F.year(month).alias("year"))
            .agg(F.avg(value).alias(value), F.count(value).alias("months")).where(F.col("months") >= months))


def spine(df: DataFrame, keys: Keys, month: str, values: Keys) -> DataFrame:
    """A row for every month between a series' first and last; the new rows hold NULL.

    Each row is exploded up to the next observed month, so the gap filling needs one window
    and no join back to the observations."""
    nxt = F.lead(month).over(ordered(keys, month))
    filled = (df.withColumn("_to", F.coalesce(F.add_months(nxt, -1), F.col(month)))
              .withColumn("_m", F.explode(F.sequence(F.col(month), F.col("_to"), F.expr("interval 1 month")))))
    return filled.select(*keys, F.col("_m").alias(month),
                         *[F.when(F.col("_m") == F.col(month), F.col(v)).alias(v) for v in values])


def missing_periods(df: DataFrame, keys: Keys, month: str, value: str) -> DataFrame:
    """Months without a value inside the series' own range."""
    seen = df.where(F.col(value).isNotNull()).select(*keys, month)
    nxt = F.lead(month).over(ordered(keys, month))
    first, last = F.add_months(month, 1), F.add_months(nxt, -1)
    return (seen.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
            .select(*keys, F.explode(F.sequence("_first", "_last", F.expr("interval 1 month"))).alias("missing")))


def publication_lag(df: DataFrame, lags: DataFrame, on: str, month: str) -> DataFrame:
    """Date each value by the month-end at which it was public (calendar shift, lag per series).

    ``lags`` (on, lag) is a settings table; a series without a row is public at once."""
    return (df.join(lags, on, "left")
            .withColumn("info_month", F.add_months(month, F.coalesce("lag", F.lit(0)))).drop("lag"))


def carry_forward(df: DataFrame, keys: Keys, month: str, value: str, periods: int) -> Column:
    """Last known value for at most ``periods`` further rows of a complete grid (a column)."""
    return F.last(value, ignorenulls=True).over(ordered(keys, month).rowsBetween(-periods, 0))


def fill_inside(df: DataFrame, keys: Keys, month: str, value: str, other: str) -> DataFrame:
    """Fill gaps strictly inside ``value``'s range from ``other``; never extend it."""
    known = F.when(F.col(value).isNotNull(), F.col(month))
    lo, hi = F.min(known).over(whole(keys)), F.max(known).over(whole(keys))
    inside = F.col(value).isNull() & F.col(other).isNotNull() & (F.col(month) > lo) & (F.col(month) < hi)
    return df.withColumn("was_filled", inside).withColumn(value, F.when(inside, F.col(other)).otherwise(F.col(value)))


def fill_union(df: DataFrame, other: DataFrame, keys: Keys, month: str, value: str) -> DataFrame:
    """Keep ``df``'s values; take every later key it lacks from ``other`` (gaps and tail)."""
    base = df.where(F.col(value).isNotNull()).select(*keys, month, value, F.lit("base").alias("origin"))
    extra = other.where(F.col(value).isNotNull()).select(*keys, month, value, F.lit("other").alias("origin"))
    both = base.unionByName(extra)
    has = F.max(F.when(F.col("origin") == "base", 1).otherwise(0)).over(Window.partitionBy(*keys, month))
    first = F.min(F.when(F.col("origin") == "base", F.col(month))).over(whole(keys))
    return (both.withColumn("_has", has).withColumn("_first", first)
            .where((F.col("origin") == "base") | ((F.col("_has") == 0) & (F.col(month) > F.col("_first"))))
            .drop("_has", "_first"))


def annual_to_quarters(annual: DataFrame, keys: Keys, value: str, info: Column, lag: int,
                       quarters: DataFrame) -> DataFrame:
    """Quarterly path of an annual series from the years public at ``info``.

    Year Y stands at 1 July and is public ``lag`` months after December Y. Linear in days
    between published years, flat after the last, nothing before the first. ``quarters``
    (keys, quarter) is the grid to fill."""
    at = F.make_date(F.col("year"), F.lit(7), F.lit(1))
    public = F.add_months(F.make_date(F.col("year"), F.lit(12), F.lit(1)), lag) <= info
    points = annual.where(public).select(*keys, at.alias("quarter"), F.col(value).alias("_v"), F.lit(1).alias("_point"))
    grid = quarters.select(*keys, "quarter", F.lit(None).cast("double").alias("_v"), F.lit(0).alias("_point"))
    both = points.unionByName(grid)
    back = ordered(keys, "quarter").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = ordered(keys, "quarter").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    when = F.when(F.col("_point") == 1, F.col("quarter"))
    val = F.when(F.col("_point") == 1, F.col("_v"))
    out = both.select(*keys, "quarter", "_point",
                      F.max(when).over(back).alias("_t0"), F.last(val, True).over(back).alias("_v0"),
                      F.min(when).over(ahead).alias("_t1"), F.first(val, True).over(ahead).alias("_v1")).where("_point = 0")
    days = F.datediff("quarter", "_t0") / F.when(F.datediff("_t1", "_t0") != 0, F.datediff("_t1", "_t0"))
    path = F.when(F.col("_t0").isNull(), None).otherwise(
        F.col("_v0") + F.coalesce((F.col("_v1") - F.col("_v0")) * days, F.lit(0.0)))
    return out.select(*keys, "quarter", path.alias(value))


def interpolate_inside(df: DataFrame, keys: Keys, month: str, value: str) -> DataFrame:
    """Linear between known neighbours (by month count); ends stay NULL."""
    back, ahead = past(keys, month), ordered(keys, month).rowsBetween(0, Window.unboundedFollowing)
    when = F.when(F.col(value).isNotNull(), F.col(month))
    d = df.select("*", F.last(value, True).over(back).alias("_v0"), F.max(when).over(back).alias("_t0"),
                  F.first(value, True).over(ahead).alias("_v1"), F.min(when).over(ahead).alias("_t1"))
    share = months_from(month, "_t0") / months_from("_t1", "_t0")
    mid = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share
    return (d.withColumn("interpolated", F.col(value).isNull() & F.col("_v0").isNotNull() & F.col("_v1").isNotNull())
            .withColumn(value, F.coalesce(F.col(value), mid)).drop("_v0", "_v1", "_t0", "_t1"))


def backcast_stock(df: DataFrame, keys: Keys, month: str, stock: str, older: str, flow: str) -> DataFrame:
    """Fill a stock: older definition where the new one is missing, linear inside, and before
    the first value the next stock less the next flow. ``label`` says which applied.

    The backward chain stops where a flow is missing. Needs a complete grid."""
    first = F.coalesce(stock, older)
    d = interpolate_inside(df.withColumn("_s", first), keys, month, "_s")
    w_after = ordered(keys, month).rowsBetween(1, Window.unboundedFollowing)
    start = F.min(F.when(F.col("_s").isNotNull(), F.col(month))).over(whole(keys))
    d = d.withColumn("_start", start)
    before = F.col(month) < F.col("_start")
    need = F.when(F.col(month) <= F.col("_start"), F.col(flow))
    d = (d.withColumn("_base", F.max(F.when(F.col(month) == F.col("_start"), F.col("_s"))).over(whole(keys)))
         .withColumn("_flow", F.sum(need).over(w_after))
         .withColumn("_hole", F.max(F.when((F.col(month) <= F.col("_start")) & F.col(flow).isNull(), 1).otherwise(0)).over(w_after)))
    chained = F.when(before & (F.col("_hole") == 0), F.col("_base") - F.col("_flow"))
    label = (F.when(F.col(stock).isNotNull(), "current").when(F.col(older).isNotNull(), "older")
             .when(F.col("interpolated"), "interpolated").when(chained.isNotNull(), "cumulated flow").otherwise("not yet published"))
    return (d.withColumn("label", label).withColumn("filled", F.when(before, chained).otherwise(F.col("_s")))
            .drop("_s", "_start", "_base", "_flow", "_hole", "interpolated"))


def fiscal_date(fy_start: Column, month: Column, first_month: int = 4) -> Column:
    """Calendar month start of ``month`` in the fiscal year that begins in ``fy_start``."""
    return F.make_date(fy_start + (month < first_month).cast("int"), month, F.lit(1))


def trailing_full(keys: Keys, month: str, value: str, n: int, how: str = "mean") -> Column:
    """Trailing sum or mean of ``n`` grid rows, NULL unless all ``n`` are present (a column)."""
    w = trailing(keys, month, n)
    agg = F.avg(value).over(w) if how == "mean" else F.sum(value).over(w)
    return F.when(F.count(value).over(w) == n, agg)


def trailing_partial(keys: Keys, month: str, value: str, n: int, at_least: int) -> Column:
    w = trailing(keys, month, n)
    return F.when(F.count(value).over(w) >= at_least, F.avg(value).over(w))


def trailing_asof(df: DataFrame, probes: DataFrame, keys: Keys, month: str, value: str, n: int, at: str) -> DataFrame:
    """Mean of the last ``n`` non-null values on or before each probe date (NULL if fewer)."""
    seen = df.where(F.col(value).isNotNull())
    w = trailing(keys, month, n)
    mean = F.when(F.count(value).over(w) == n, F.avg(value).over(w))
    facts = seen.select(*keys, F.col(month).alias("_t"), F.lit(0).alias("_kind"), mean.alias("_mean"))
    asks = probes.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_mean"))
    order = Window.partitionBy(*keys).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    # the last fact counts even when its mean is NULL, so carry a struct
    fact = F.when(F.col("_kind") == 0, F.struct("_t", "_mean"))
    return (facts.unionByName(asks).withColumn("_f", F.last(fact, True).over(order)).where("_kind = 1")
            .select(*keys, F.col("_t").alias(at), F.col("_f._mean").alias("norm")))


def staircase(annual: DataFrame, keys: Keys, value: str, months: DataFrame, month: str) -> DataFrame:
    """Annual values carried to months from January; of duplicated years the last row counts.

    ``annual`` carries ``seq`` to order duplicates."""
    one = annual.groupBy(*keys, "year").agg(F.max_by(value, "seq").alias("_v"))
    facts = one.select(*keys, F.make_date("year", F.lit(1), F.lit(1)).alias(month), F.col("_v"), F.lit(0).alias("_kind"))
    asks = months.select(*keys, month, F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_kind"))
    order = Window.partitionBy(*keys).orderBy(month, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return (facts.unionByName(asks).withColumn(value, F.last("_v", True).over(order)).where("_kind = 1")
            .select(*keys, month, value))
