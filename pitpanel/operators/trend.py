"""Trends by a two-state filter in linear time.

The penalised trend of a series has second differences of variance 1 / smooth around observations of
variance 1. With level and slope as state, and both unknown at the start, the filtered level at t is the end
point of the trend of the data up to t, and the smoothed level is the trend of all data. Gains depend on the
position alone: they are worked out once for the longest series of a batch, and all series of the batch move on
together, one observation at a time. A series is one array, bounded by the calendar; no row has an array."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.operators.calendar import Keys, trailing_full

STEP = np.array([[1.0, 1.0], [0.0, 1.0]])          # level takes the slope, slope stays


def gains(n: int, smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """By position: the filter's gain (level, slope) and the smoother's 2 x 2 gain on the next state.

    Two observations fix both states; positions before the second have no gain."""
    forward, back, p = np.zeros((n, 2)), np.zeros((n, 2, 2)), np.array([[1.0, 1.0], [1.0, 2.0]])
    for t in range(2, n):
        ahead = STEP @ p @ STEP.T + 1.0 / smooth
        back[t - 1] = p @ STEP.T @ np.linalg.inv(ahead)
        forward[t] = ahead[:, 0] / (ahead[0, 0] + 1.0)
        p = ahead - np.outer(forward[t], ahead[0])
    return forward, back


def filter_batch(series: list[np.ndarray], smooth: float, two_sided: bool) -> list[np.ndarray]:
    """The trends of many series of any lengths, all moved on together."""
    sizes = np.array([len(v) for v in series])
    n = int(sizes.max(initial=0))
    y, level, slope = (np.zeros((len(series), n)) for _ in range(3))
    for i, v in enumerate(series):
        y[i, :len(v)] = v
    level[:, :2] = y[:, :2]
    if n > 1:
        slope[:, 1] = y[:, 1] - y[:, 0]
    forward, back = gains(n, smooth)
    for t in range(2, n):
        ahead = level[:, t - 1] + slope[:, t - 1]
        miss = y[:, t] - ahead
        level[:, t], slope[:, t] = ahead + forward[t, 0] * miss, slope[:, t - 1] + forward[t, 1] * miss
    if two_sided:
        for t in range(n - 2, 0, -1):
            inner = sizes > t + 1                                        # the last observation's filtered state is its smoothed one
            up = level[:, t + 1] - level[:, t] - slope[:, t]
            turn = slope[:, t + 1] - slope[:, t]
            level[:, t] += np.where(inner, back[t, 0, 0] * up + back[t, 0, 1] * turn, 0.0)
            slope[:, t] += np.where(inner, back[t, 1, 0] * up + back[t, 1, 1] * turn, 0.0)
        if n > 2:
            level[:, 0] = np.where(sizes > 2, level[:, 1] - slope[:, 1], level[:, 0])
    return [level[i, :k] for i, k in enumerate(sizes)]


def _trends(df: DataFrame, keys: Keys, time: str, value: str, smooth: float, two_sided: bool) -> DataFrame:
    """keys, time, _i (place from 1), _trend of every observation."""

    @F.pandas_udf("array<double>")
    def trend(values: pd.Series) -> pd.Series:
        return pd.Series(filter_batch([np.asarray(v, float) for v in values], smooth, two_sided), dtype=object)

    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v")))).alias("_r"))
    d = g.select(*keys, F.col("_r.t").alias("_t"), trend(F.col("_r.v")).alias("_l"))
    return d.select(*keys, F.posexplode(F.arrays_zip("_t", "_l")).alias("_i", "_z")).select(*keys, F.col("_z._t").alias(time), (F.col("_i") + 1).alias("_i"), F.col("_z._l").alias("_trend"))


def one_sided_trend(df: DataFrame, keys: Keys, time: str, value: str, smooth: float, at_least: int) -> DataFrame:
    """Column ``trend``: at each observation the end point of the trend of the data up to it."""
    t = _trends(df, keys, time, value, smooth, False).where(F.col("_i") >= at_least)
    return df.join(t.select(*keys, time, F.col("_trend").alias("trend")), [*keys, time], "left")


def two_sided_trend(df: DataFrame, keys: Keys, time: str, value: str, smooth: float) -> DataFrame:
    """Column ``trend_expost``: the trend using later observations too (reference only)."""
    t = _trends(df, keys, time, value, smooth, True)
    return df.join(t.select(*keys, time, F.col("_trend").alias("trend_expost")), [*keys, time], "left")


def trend_gap(df: DataFrame, keys: Keys, time: str, value: str, price: str, smooth: float, at_least: int) -> DataFrame:
    """Log gap of the series to its one-sided trend (positive below the trend), in %, and the
    price the trend implies."""
    d = one_sided_trend(df, keys, time, value, smooth, at_least)
    d = d.withColumn("gap_log", F.log("trend") - F.log(value))
    return d.withColumns({"misalignment_pct": (F.col("trend") / F.col(value) - 1) * 100, "fair": F.col(price) * F.exp(-F.col("gap_log"))})


def cyclical_gaps(q: DataFrame, keys: Keys, own: str, partners: list[str], smooth: float, at_least: int) -> DataFrame:
    """Own gap: log 4-quarter sum against its one-sided trend, in %. Partner gap: mean of the
    partners' gaps that are known, averaged over 4 quarters."""
    d = q.withColumn("_own", F.log(trailing_full(keys, "quarter", own, 4, "sum")))
    d = one_sided_trend(d, keys, "quarter", "_own", smooth, at_least).withColumn("own_gap", (F.col("_own") - F.col("trend")) * 100).drop("trend", "_own")
    for p in partners:
        d = d.withColumn("_p", F.log(p))
        d = one_sided_trend(d, keys, "quarter", "_p", smooth, at_least).withColumn(f"_gap_{p}", (F.col("_p") - F.col("trend")) * 100).drop("trend", "_p")
    cols = F.filter(F.array(*[F.col(f"_gap_{p}") for p in partners]), lambda x: x.isNotNull())
    mean = F.when(F.size(cols) > 0, F.aggregate(cols, F.lit(0.0), lambda s, x: s + x) / F.size(cols))
    d = d.withColumn("_mean", mean)
    return d.withColumn("partner_gap", trailing_full(keys, "quarter", "_mean", 4)).drop("_mean", *[f"_gap_{p}" for p in partners])
