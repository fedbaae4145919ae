"""Derived measures and regression inputs. All windows need a complete monthly grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions.columns import ordered, past, ratio, trailing, whole
from pitpanel.operators.calendar import Keys


def derived_measures(df: DataFrame, logs: Sequence[str], differentials: dict[str, tuple[str, str]],
                     ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """Log levels, differences and ratios as new columns; a zero denominator gives NULL."""
    cols = {f"log_{c}": F.log(c) for c in logs}
    cols |= {n: F.col(a) - F.col(b) for n, (a, b) in differentials.items()}
    cols |= {n: ratio(F.col(a), F.col(b)) for n, (a, b) in ratios.items()}
    return df.withColumns(cols)


def annualised_pct(flow: str, base: str, per_year: int) -> Column:
    """flow at an annual rate as % of base; NULL where the base is missing or zero."""
    return ratio(F.col(flow) * per_year, F.col(base)) * 100


def wide(long: DataFrame, keys: Keys, time: str, series: list[str]) -> DataFrame:
    """One column per listed series on a common grid (the list keeps the plan free of a scan
    for distinct values)."""
    return long.groupBy(*keys, time).pivot("series_id", series).agg(F.max("value"))


def flow_plus_stock_change(keys: Keys, time: str, flow: str, stock: str) -> Column:
    return F.col(flow) + F.col(stock) - F.lag(stock).over(ordered(keys, time))


def log_return(keys: Keys, time: str, value: str, scale: float = 100.0) -> Column:
    return F.log(F.col(value) / F.lag(value).over(ordered(keys, time))) * scale


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def flow_frame(df: DataFrame, keys: Keys, time: str, price: str, flows: dict[str, float], drivers: Sequence[str]) -> DataFrame:
    """Price and drivers as log changes x 100, flows scaled, rows with any gap dropped."""
    cols = [log_return(keys, time, price).alias("move"), *[(F.col(f) / s).alias(f) for f, s in flows.items()],
            *[log_return(keys, time, d).alias(f"d_{d}") for d in drivers]]
    out = df.select(*keys, time, *cols)
    return complete_rows(out, ["move", *flows, *[f"d_{d}" for d in drivers]])


def standardise_past(df: DataFrame, keys: Keys, time: str, cols: Sequence[str], lag: int = 1) -> DataFrame:
    """Columns lagged ``lag`` periods and standardised with the mean and sd of the rows before
    each row; a zero sd counts as one."""
    lagged = df.withColumns({f"{c}_lag": F.lag(c, lag).over(ordered(keys, time)) for c in cols})
    before = past(keys, time, -1)
    out = {}
    for c in cols:
        x = f"{c}_lag"
        sd = F.stddev_samp(x).over(before)
        out[f"{c}_z"] = (F.col(x) - F.avg(x).over(before)) / F.when(sd == 0, 1.0).otherwise(sd)
    return lagged.withColumns(out)


def lag_matrix(df: DataFrame, keys: Keys, time: str, cols: Sequence[str], lags: int) -> DataFrame:
    w = ordered(keys, time)
    return df.withColumns({f"{c}_l{k}": F.lag(c, k).over(w) for c in cols for k in range(1, lags + 1)})


def dynamic_terms(df: DataFrame, keys: Keys, time: str, cols: Sequence[str], k: int) -> tuple[DataFrame, list[str]]:
    """First differences of each regressor at leads and lags -k..k, as columns d_<col>_<j>."""
    w = ordered(keys, time)
    d = df.withColumns({f"_d_{c}": F.col(c) - F.lag(c).over(w) for c in cols})
    name = lambda c, j: f"d_{c}_{'m' if j < 0 else 'p'}{abs(j)}"
    terms = {name(c, j): F.lead(f"_d_{c}", j).over(w) if j > 0 else F.lag(f"_d_{c}", -j).over(w)
             for c in cols for j in range(-k, k + 1)}
    return d.withColumns(terms).drop(*[f"_d_{c}" for c in cols]), list(terms)


def demean(df: DataFrame, keys: Keys, cols: Sequence[str], at_least: int) -> DataFrame:
    """Columns less their entity mean; entities with fewer rows are dropped."""
    w = whole(keys)
    d = df.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= at_least).drop("_n")
    return d.withColumns({f"{c}_dm": F.col(c) - F.avg(c).over(w) for c in cols})


def balanced_panel(df: DataFrame, entity: str, time: str, cols: Sequence[str], at_least: int = 10) -> DataFrame:
    """Complete rows of the periods every entity covers; empty if there are too few of them."""
    d = complete_rows(df, cols)
    entities = d.agg(F.count_distinct(entity).alias("_all"))
    cover = d.groupBy(time).agg(F.count_distinct(entity).alias("_n"))
    common = cover.crossJoin(F.broadcast(entities)).where("_n = _all").select(time)     # one-row side
    size = common.agg(F.count("*").alias("_periods"))
    return d.join(common, time, "left_semi").crossJoin(F.broadcast(size)).where(F.col("_periods") >= at_least).drop("_periods")


def two_factor_state(df: DataFrame, keys: Keys, time: str, a: str, b: str, at_least: int) -> DataFrame:
    """High/low label of two factors against their medians so far; NULL until both exist."""
    w = past(keys, time)
    med = lambda c: F.when(F.count(c).over(w) >= at_least, F.percentile(c, F.lit(0.5)).over(w))
    d = df.withColumn("median_a", med(a)).withColumn("median_b", med(b))
    side = lambda c, m: F.when(F.col(c) > F.col(m), "Hi").otherwise("Lo")
    label = F.concat(F.lit("A"), side(a, "median_a"), F.lit("_B"), side(b, "median_b"))
    return d.withColumn("state", F.when(F.col("median_a").isNotNull() & F.col("median_b").isNotNull(), label))


def own_sign(df: DataFrame, gap: str, slope: str, flip: Sequence[str]) -> DataFrame:
    """An external assessment on our convention: gap over its elasticity, signs flipped."""
    return df.withColumn("implied_gap", ratio(F.col(gap), F.col(slope))).withColumns({f"own_{c}": -F.col(c) for c in flip})


def smoothed_set(df: DataFrame, keys: Keys, time: str, value: str, price: str, other: str) -> DataFrame:
    """Smoothing means, yearly changes and the depreciation a price differential justifies."""
    w = ordered(keys, time)
    mean = lambda c, n: F.avg(c).over(trailing(keys, time, n))
    yoy = lambda c: (F.col(c) / F.lag(c, 12).over(w) - 1) * 100
    return df.withColumns({f"{value}_mean3": mean(value, 3), f"{value}_mean12": mean(value, 12), f"{value}_yoy": yoy(value),
                           f"{price}_yoy": yoy(price), f"{other}_yoy": yoy(other)}).withColumn(
        "justified", F.col(f"{price}_yoy") - F.col(f"{other}_yoy"))
