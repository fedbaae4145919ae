"""What was known when: as-of and bitemporal operators.

``asof`` unions facts and probes and carries the last fact forward, one shuffle on the key.
The bitemporal operators expand each release over the months it was the current one, so no
range join is needed and a key's rows are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions.columns import months_from, ordered, past, quarter_of, whole
from pitpanel.operators.calendar import Keys, annual_to_quarters, spine

MONTH = "interval 1 month"


def asof(probes: DataFrame, facts: DataFrame, keys: Keys, at: str, time: str, cols: Sequence[str],
         order: str | None = None, first_if_none: bool = False) -> DataFrame:
    """Each probe with the latest fact at or before it (of equal times the highest ``order``).

    Adds ``cols`` and ``fact_time``. With ``first_if_none`` a probe before the first fact
    takes the first one and ``backcast`` is true."""
    rest = [c for c in probes.columns if c not in keys]
    seq = F.col(order).cast("double") if order else F.lit(0.0)
    f = facts.select(*keys, F.col(time).cast("date").alias("_t"), F.lit(0).alias("_kind"), seq.alias("_seq"),
                     F.struct(F.col(time).alias("fact_time"), *cols).alias("_fact"))
    p = probes.select(*keys, F.col(at).cast("date").alias("_t"), F.lit(1).alias("_kind"), F.lit(0.0).alias("_seq"),
                      F.struct(*rest).alias("_probe"))
    both = f.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_kind", "_seq")
    d = both.withColumn("_known", F.last("_fact", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if first_if_none:
        d = (d.withColumn("_first", F.first("_fact", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
             .withColumn("backcast", F.col("_known").isNull() & F.col("_first").isNotNull())
             .withColumn("_known", F.coalesce("_known", "_first")))
    extra = ["backcast"] if first_if_none else []
    return d.where("_kind = 1").select(*keys, "_probe.*", "_known.*", *extra)


def information_set(long: DataFrame, settings: DataFrame, keys: Keys, series: list[str], base: str) -> DataFrame:
    """Wide table of what was public at each month-end.

    ``long`` is (keys, series_id, ref_month, value); ``settings`` is (series_id, lag, carry):
    months until public, and for how many further months the last print stands in for a late
    one. The grid ends at the last month of ``base``."""
    dated = long.join(settings, "series_id").withColumn("info_month", F.add_months("ref_month", F.col("lag")))
    end = F.max(F.when(F.col("series_id") == base, F.col("info_month"))).over(whole(keys))
    dated = dated.withColumn("_end", end).where("info_month <= _end")
    wide = dated.groupBy(*keys, "info_month").agg(
        *[F.max(F.when(F.col("series_id") == s, F.struct("value", "carry"))).alias(s) for s in series])
    grid = spine(wide, keys, "info_month", series)
    cells = [F.struct(F.col(f"{s}.value").alias("value"), F.col(f"{s}.carry").alias("carry"), F.col("info_month").alias("at")) for s in series]
    w = past(keys, "info_month")
    for s, cell in zip(series, cells):
        grid = grid.withColumn(f"_{s}", F.last(F.when(F.col(f"{s}.value").isNotNull(), cell), True).over(w))
    kept = [F.when(months_from("info_month", f"_{s}.at") <= F.col(f"_{s}.carry"), F.col(f"_{s}.value")).alias(s) for s in series]
    return grid.select(*keys, "info_month", *kept)


def nowcast(annual: DataFrame, targets: DataFrame, keys: Keys, value: str, lag: int, lookback: int) -> DataFrame:
    """Annual level extrapolated to each target month from the years public at ``info``.

    ``targets`` is (keys, target, info, ...). A year is public ``lag`` months after its
    December; growth is the mean of the last ``lookback`` published years (fewer if there are
    fewer, none with one year). The level stands at July of the last published year."""
    w = ordered(keys, "year")
    hist = F.collect_list(value).over(w.rowsBetween(-lookback, 0))
    f = annual.where(F.col(value).isNotNull()).withColumn("_h", hist)
    k = F.size("_h") - 1
    f = f.select(*keys, F.add_months(F.make_date("year", F.lit(12), F.lit(1)), lag).alias("public"), "year",
                 F.col(value).alias("_last"), F.when(k > 0, F.pow(F.col(value) / F.col("_h")[0], 1.0 / k)).alias("_g"))
    j = asof(targets, f, keys, "info", "public", ["year", "_last", "_g"])
    months = (F.year("target") - F.col("year")) * 12 + F.month("target") - 7
    return j.withColumn("nowcast", F.col("_last") * F.pow("_g", months / 12.0)).drop("_last", "_g", "fact_time")


def quarterly_with_availability(df: DataFrame, keys: Keys, month: str, flow: str, price: str, lag: int) -> DataFrame:
    """Quarter rows: summed flow, mean price, and the month the quarter became public."""
    q = df.groupBy(*keys, quarter_of(month).alias("quarter")).agg(F.sum(flow).alias(flow), F.avg(price).alias(price))
    return q.withColumn("available", F.add_months("quarter", lag))


def known_each_month(rel: DataFrame, keys: Keys) -> DataFrame:
    """Every series as it stood at every month-end: (keys, ref_month, info_month, value).

    A release stands from the end of its month until the month before the next release, the last one
    until the last release month of the whole table."""
    m = rel.groupBy(*keys, "ref_month", F.trunc("realtime_start", "MM").alias("_from")).agg(
        F.max_by("value", "realtime_start").alias("value"))
    w = Window.partitionBy(*keys, "ref_month").orderBy("_from")
    until = rel.agg(F.trunc(F.max("realtime_start"), "MM").alias("_until"))                  # one row
    m = m.crossJoin(F.broadcast(until)).withColumn("_to", F.coalesce(F.add_months(F.lead("_from").over(w), -1), F.col("_until"))).where("_from <= _to")
    return m.select(*keys, "ref_month", F.explode(F.sequence("_from", "_to", F.expr(MONTH))).alias("info_month"), "value")


def yoy_as_known(known: DataFrame, keys: Keys) -> DataFrame:
    """Year-on-year % of the latest observation, both legs as known at the month-end."""
    group = [*keys, "info_month"]
    d = known.withColumn("_last", F.max("ref_month").over(Window.partitionBy(*group)))
    now = F.max(F.when(F.col("ref_month") == F.col("_last"), F.col("value")))
    before = F.max(F.when(F.col("ref_month") == F.add_months("_last", -12), F.col("value")))
    return d.groupBy(*group).agg(F.max("_last").alias("ref_month"), ((now / before - 1) * 100).alias("yoy"))


def first_release(rel: DataFrame, keys: Keys) -> DataFrame:
    return rel.groupBy(*keys, "ref_month").agg(
        F.min_by("value", "realtime_start").alias("value"), F.min("realtime_start").alias("released"))


def last_release(rel: DataFrame, keys: Keys) -> DataFrame:
    return rel.groupBy(*keys, "ref_month").agg(F.max_by("value", "realtime_start").alias("value"))


def at_snapshots(rel: DataFrame, keys: Keys, snapshots: list[str]) -> DataFrame:
    """The latest value of every reference month as of each snapshot date.

    The list of snapshots is a setting; each release counts for the snapshots after it."""
    dates = F.array(*[F.lit(s).cast("date") for s in snapshots])
    hit = F.filter(dates, lambda s: s >= F.col("realtime_start"))
    return (rel.withColumn("snapshot", F.explode(hit))
            .groupBy("snapshot", *keys, "ref_month").agg(F.max_by("value", "realtime_start").alias("value")))


def annual_panel_at(annual: DataFrame, lags: DataFrame, keys: Keys, infos: list[str], names: list[str]) -> DataFrame:
    """Annual values public at each information date: long (keys, series_id, year, value) in,
    one column per series out. ``lags`` (series_id, lag) counts months after December."""
    dates = F.array(*[F.lit(s).cast("date") for s in infos])
    public = F.add_months(F.make_date("year", F.lit(12), F.lit(1)), F.col("lag"))
    d = (annual.join(lags, "series_id").withColumn("_public", public)
         .withColumn("info", F.explode(F.filter(dates, lambda t: t >= F.col("_public")))))
    return d.groupBy("info", *keys, "year").agg(
        *[F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(s) for s in names])


def latest_published(panel: DataFrame, keys: Keys, order: str, names: list[str]) -> DataFrame:
    """The most recent non-null value of each variable; their dates may differ."""
    return panel.groupBy(*keys).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in names])


def quarterly_set_at(monthly: DataFrame, annual: DataFrame, stock: DataFrame, keys: Keys, info: Column,
                     month_lag: int, annual_lag: int) -> DataFrame:
    """Quarterly estimation set as it could be assembled at ``info``: log of the complete
    quarter's mean, the interpolated annual series, and the last stock ratio public by then.

    ``stock`` is (keys, quarter, available, ratio)."""
    pub = monthly.where(F.add_months("ref_month", month_lag) <= info)
    q = pub.groupBy(*keys, quarter_of("ref_month").alias("quarter")).agg(
        F.when(F.count("value") == 3, F.log(F.avg("value"))).alias("log_level"))
    a = annual_to_quarters(annual, keys, "value", info, annual_lag, q.select(*keys, "quarter"))
    s = stock.where(F.col("available") <= info).select(*keys, "quarter", "ratio")
    d = q.join(a, [*keys, "quarter"], "left").join(s, [*keys, "quarter"], "left")
    return d.select(*keys, "quarter", "log_level", F.log("value").alias("log_annual"),
                    F.last("ratio", True).over(past(keys, "quarter")).alias("ratio"))


def compare_runs(current: DataFrame, early: DataFrame, keys: Keys, time: str, value: str, parts: Sequence[str],
                 until: Column | None = None) -> DataFrame:
    """Two runs of the same model, month by month: how many months changed and by how much."""
    c = current.select(*keys, time, F.col(value).alias("_c"), *[F.col(p).alias(f"_c_{p}") for p in parts])
    e = early.select(*keys, time, F.col(value).alias("_e"), *[F.col(p).alias(f"_e_{p}") for p in parts])
    d = c.join(e, [*keys, time]).where("_c is not null and _e is not null")
    if until is not None:
        d = d.where(F.col(time) <= until)
    d = d.withColumn("_d", F.col("_c") - F.col("_e"))
    size = F.abs("_d")
    return d.groupBy(*keys).agg(
        F.count("*").alias("n_months"), F.sum((size > 1e-9).cast("int")).cast("bigint").alias("n_changed"),
        F.avg(size).alias("mean_abs"), F.max(size).alias("max_abs"),
        F.max_by(time, F.struct(size, F.date_diff(F.lit("2200-01-01").cast("date"), time))).alias("max_month"),
        F.max(time).alias("last_month"), F.max_by("_d", time).alias("last_diff"),
        *[F.avg(F.abs(F.col(f"_c_{p}") - F.col(f"_e_{p}"))).alias(f"mean_abs_{p}") for p in parts])


def due_checks(df: DataFrame, keys: Keys, month: str, value: str, today: Column, release_day: int, stale_after: int) -> DataFrame:
    """Last month per series against the month that should be out by ``today`` (month m is
    released on ``release_day`` of m + 1), and whether the series went stale."""
    back = F.when(F.dayofmonth(today) >= release_day, 1).otherwise(2)
    expected = F.add_months(F.trunc(today, "MM"), -back)
    end = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(month).alias("last_month"))
    behind = months_from(expected, "last_month")
    return end.select(*keys, "last_month", expected.alias("expected"), (F.col("last_month") < expected).alias("overdue"),
                      (behind > stale_after).alias("stale"))


def series_ends(df: DataFrame, keys: Keys, month: str, value: str) -> DataFrame:
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(F.min(month).alias("first"), F.max(month).alias("last"), F.count("*").alias("n"),
                                    F.max_by(value, month).alias("last_value"))
