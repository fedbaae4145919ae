"""Forecast variants: threshold, cubic and random-walk coefficients, fitted at every origin.

A series is one array (bounded by the calendar); an origin is a stretch of it, cut where it is fitted. All origins
of a batch are fitted together: every threshold comes from one order by |x| and its running sums, all noise
ratios move through the observations side by side, so no row is repeated for a candidate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.functions.columns import past
from pitpanel.operators.calendar import Keys
from pitpanel.operators.forecast import forecasts, per_horizon, targets
from pitpanel.operators.regression import products, solve_gram


def origins(df: DataFrame, keys: Keys, time: str, level: str, x: str, horizons: Sequence[int], min_train: int) -> DataFrame:
    """keys, h, time, x, y, f_drift, train, n_train: the realised (x, y) pairs at each origin."""
    d = targets(df, keys, time, level, [x], horizons).withColumnRenamed(x, "x")
    by = [*keys, "h"]
    g = d.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("_r"))
    o = g.select(*by, "_r", F.posexplode("_r").alias("_i", "_o")).where(F.col("_o.x").isNotNull())
    known = F.filter(F.slice("_r", F.lit(1), F.greatest(F.col("_i") + 1 - F.col("h"), F.lit(0))), lambda r: r["x"].isNotNull() & r["y"].isNotNull())
    o = o.select(*by, F.col("_o.t").alias(time), F.col("_o.x").alias("x"), F.col("_o.y").alias("y"), known.alias("train")).where(F.size("train") >= min_train)
    mean = F.aggregate("train", F.lit(0.0), lambda s, r: s + r["y"]) / F.size("train")
    return o.select(*by, time, "x", "y", mean.alias("f_drift"), "train", F.size("train").alias("n_train"))


def _solve(g: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Solutions of stacks of small symmetric systems in unit-diagonal scale; of least length where singular."""
    s = np.sqrt(np.einsum("...ii->...i", g))
    s[s == 0] = 1.0
    return np.einsum("...ij,...j->...i", np.linalg.pinv(g / (s[..., :, None] * s[..., None, :]), rcond=1e-13, hermitian=True), v / s) / s


def threshold_batch(xs: list[np.ndarray], ys: list[np.ndarray], quantiles: Sequence[float], min_side: int) -> np.ndarray:
    """For many samples: band edge, constant, slope inside and outside of the best threshold (NaN edge: the linear fit)."""
    n = np.array([len(v) for v in xs])
    x, y, size = (np.zeros((len(xs), n.max())) for _ in range(3))
    size += np.inf
    for i, (a, b) in enumerate(zip(xs, ys)):
        order = np.argsort(np.abs(a), kind="stable")
        x[i, :len(a)], y[i, :len(a)], size[i, :len(a)] = a[order], b[order], np.abs(a)[order]
    run = lambda v: np.concatenate([np.zeros((len(v), 1)), np.cumsum(v, 1)], 1)
    sx, sxx, sxy, sy, syy = run(x), run(x * x), run(x * y), y.sum(1), (y * y).sum(1)
    row = np.arange(len(n))
    linear = _solve(np.stack([np.stack([n, sx[:, -1]], 1), np.stack([sx[:, -1], sxx[:, -1]], 1)], 1), np.stack([sy, sxy[:, -1]], 1))
    out = np.column_stack([np.full(len(n), np.nan), linear[:, 0], linear[:, 1], linear[:, 1]])
    best = np.full(len(n), np.inf)
    for q in quantiles:
        at = q * (n - 1)
        lo = np.floor(at).astype(int)
        c = size[row, lo] + (size[row, np.minimum(lo + 1, n - 1)] - size[row, lo]) * (at - lo)
        k = (size <= c[:, None]).sum(1)
        ix, ixx, ixy = (v[row, k] for v in (sx, sxx, sxy))
        ox, oxx, oxy = sx[:, -1] - ix, sxx[:, -1] - ixx, sxy[:, -1] - ixy
        zero = np.zeros(len(n))
        g = np.stack([np.stack([n, ix, ox], 1), np.stack([ix, ixx, zero], 1), np.stack([ox, zero, oxx], 1)], 1)
        v = np.stack([sy, ixy, oxy], 1)
        beta = _solve(g, v)
        ssr = syy - (beta * v).sum(1)
        better = (k >= min_side) & (n - k >= min_side) & ((ssr < best) | ((ssr == best) & (c < out[:, 0])))
        best[better] = ssr[better]
        out[better] = np.column_stack([c, beta])[better]
    return out


def threshold_forecasts(o: DataFrame, by: Keys, time: str, quantiles: Sequence[float], min_side: int = 12) -> DataFrame:
    """Slope inside and outside a band of |x|; the band edge is the quantile with the smallest
    sum of squares among those leaving ``min_side`` rows on either side, else the linear fit."""

    @F.pandas_udf("c double, const double, inside double, outside double")
    def fit(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        got = threshold_batch([np.asarray(v) for v in x], [np.asarray(v) for v in y], quantiles, min_side) if len(x) else np.zeros((0, 4))
        return pd.DataFrame(got, columns=["c", "const", "inside", "outside"])

    d = o.withColumn("_b", fit("train.x", "train.y")).withColumn("c", F.when(~F.isnan("_b.c"), F.col("_b.c")))
    slope = F.when(F.col("c").isNull() | (F.abs("x") <= F.col("c")), F.col("_b.inside")).otherwise(F.col("_b.outside"))
    return d.select(*by, time, "x", "y", "f_drift", "n_train", (F.col("_b.const") + slope * F.col("x")).alias("f_model"),
                    F.col("_b.inside").alias("slope"), "c", F.when(F.col("c").isNotNull(), F.col("_b.outside")).alias("slope_outside"))


def cubic_forecasts(df: DataFrame, keys: Keys, time: str, level: str, x: str, horizons: Sequence[int], min_train: int) -> DataFrame:
    """y on x and x cubed; the product sums run along each series, so an origin costs one solve."""
    d = targets(df, keys, time, level, [x], horizons).withColumnRenamed(x, "x")
    by = [*keys, "h"]
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    d = d.withColumns({"_x": F.when(ok, F.col("x")), "_y": F.when(ok, F.col("y"))}).withColumns({"_x3": F.col("_x") * F.col("_x") * F.col("_x"), "_1": F.when(ok, F.lit(1.0))})
    cols = [F.col("_1"), F.col("_x"), F.col("_x3"), F.col("_y")]
    lagged = lambda agg: lambda c: per_horizon(horizons, lambda h: agg(c).over(past(by, time, -h)))
    d = d.withColumns({"_g": products(cols, agg=lagged(F.sum)), "n_train": lagged(F.count)(F.col("_x")), "f_drift": lagged(F.avg)(F.col("_y"))})
    d = d.where(F.col("x").isNotNull() & (F.col("n_train") >= min_train)).withColumn("_s", solve_gram("_g"))
    b = F.col("_s.beta")
    return d.select(*by, time, "x", "y", "f_drift", "n_train", (b[0] + b[1] * F.col("x") + b[2] * F.pow("x", 3)).alias("f_model"),
                    b[1].alias("slope"), b[2].alias("cubic"))


def drifting_batch(xs: list[np.ndarray], ys: list[np.ndarray], ratios: Sequence[float]) -> np.ndarray:
    """For many samples: noise ratio, constant and slope at the end of the likeliest filter (ties: the first ratio)."""
    n = np.array([len(v) for v in xs])
    x, y = (np.zeros((len(xs), n.max())) for _ in range(2))
    for i, (a, b) in enumerate(zip(xs, ys)):
        x[i, :len(a)], y[i, :len(a)] = a, b
    there = np.arange(x.shape[1]) < n[:, None]
    mx, my = x.sum(1) / n, y.sum(1) / n
    dx, dy = (x - mx[:, None]) * there, (y - my[:, None]) * there
    vx, noise = (dx * dx).sum(1) / n, (dy * dy).sum(1) / n
    with np.errstate(invalid="ignore", divide="ignore"):
        slope = (dx * dy).sum(1) / n / vx
    noise = np.where(noise > 0, noise, 1.0)[:, None]
    q = np.asarray(ratios, float)[None, :]
    q0, q1 = q * noise, q * noise / np.maximum(vx, 1e-12)[:, None]
    wide = np.ones_like(q0)
    a, b = (my - slope * mx)[:, None] * wide, slope[:, None] * wide
    p00, p01, p11, like = 10 * noise * wide, 0 * wide, 10 * noise * wide, 0 * wide
    for t in range(x.shape[1]):
        on, xt = there[:, t, None], x[:, t, None]
        u00, u11 = p00 + q0, p11 + q1
        z0, z1 = u00 + p01 * xt, p01 + u11 * xt
        f = z0 + xt * z1 + noise
        miss = y[:, t, None] - a - b * xt
        new = (a + z0 / f * miss, b + z1 / f * miss, u00 - z0 * z0 / f, p01 - z0 * z1 / f, u11 - z1 * z1 / f, like - 0.5 * (np.log(f) + miss * miss / f))
        a, b, p00, p01, p11, like = (np.where(on, v, old) for v, old in zip(new, (a, b, p00, p01, p11, like)))
    order = np.argsort(np.asarray(ratios), kind="stable")
    best = order[np.argmax(like[:, order], 1)]
    row = np.arange(len(n))
    return np.column_stack([np.asarray(ratios, float)[best], a[row, best], b[row, best]])


def drifting_forecasts(o: DataFrame, by: Keys, time: str, ratios: Sequence[float]) -> DataFrame:
    """Constant and slope as random walks, filtered from the least-squares start; the noise ratio
    is the one with the highest likelihood on the training sample."""

    @F.pandas_udf("q double, const double, slope double")
    def fit(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        got = drifting_batch([np.asarray(v) for v in x], [np.asarray(v) for v in y], ratios) if len(x) else np.zeros((0, 3))
        return pd.DataFrame(got, columns=["q", "const", "slope"])

    d = o.withColumn("_b", fit("train.x", "train.y"))
    return d.select(*by, time, "x", "y", "f_drift", "n_train", (F.col("_b.const") + F.col("_b.slope") * F.col("x")).alias("f_model"), F.col("_b.slope").alias("slope"), F.col("_b.q").alias("q"))


def variant_forecasts(df: DataFrame, keys: Keys, time: str, level: str, x: str, horizons: Sequence[int], min_train: int,
                      quantiles: Sequence[float], ratios: Sequence[float], window: int) -> DataFrame:
    """All variants with the same training cut and targets, one ``variant`` key."""
    by = [*keys, "h"]
    o = origins(df, keys, time, level, x, horizons, min_train)
    parts = {"linear": forecasts(df, keys, time, level, x, horizons, min_train),
             "rolling": forecasts(df, keys, time, level, x, horizons, min_train, window),
             "threshold": threshold_forecasts(o, by, time, quantiles), "cubic": cubic_forecasts(df, keys, time, level, x, horizons, min_train),
             "drifting": drifting_forecasts(o, by, time, ratios)}
    cols = [*by, time, "x", "y", "f_drift", "f_model", "slope"]
    return reduce(DataFrame.unionByName, [d.select(*cols, F.lit(n).alias("variant")) for n, d in parts.items()])
