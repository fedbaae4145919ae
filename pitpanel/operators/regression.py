"""Regression from sufficient statistics.

Spark sums the products of all columns per group (map-side combined, so a hot group costs no
more than any other); only one small product matrix per group reaches a solver.
Conventions: the constant comes first; HAC covariances use Bartlett weights over consecutive
rows of the estimation sample and no small-sample factor; clustered covariances carry the
G / (G - 1) x (n - 1) / (n - k) factor; both give normal p-values. A t is NULL where the standard
error is zero, an r2 where y does not vary.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from pitpanel.functions.columns import ordered, ratio, whole
from pitpanel.functions.tails import p_chi2_upper, p_normal_two
from pitpanel.operators.calendar import Keys

NUMBERS = ArrayType(DoubleType())
# a string here would need a running session at import time
SOLUTION = StructType([StructField("beta", NUMBERS), StructField("inv", NUMBERS), StructField("ssr", DoubleType())])


def _square(values: pd.Series) -> np.ndarray:
    k = int(round(len(values.iloc[0]) ** 0.5))
    return np.stack([np.asarray(v, dtype=float) for v in values]).reshape(-1, k, k)


def invert(a: np.ndarray) -> np.ndarray:
    """Inverse of a symmetric product matrix, solved in unit-diagonal scale; pseudo-inverse
    where it is singular. A column that is zero in all rows has zeros here."""
    s = np.sqrt(np.diag(a))
    out, on = np.zeros(a.shape), np.flatnonzero(s)
    if len(on):
        s = np.outer(s[on], s[on])
        c = a[np.ix_(on, on)] / s
        out[np.ix_(on, on)] = (np.linalg.inv(c) if np.linalg.cond(c) < 1e13 else np.linalg.pinv(c)) / s
    return out


@F.pandas_udf(SOLUTION)
def solve_gram(gram: pd.Series) -> pd.DataFrame:
    """Least squares from the product matrix of [regressors..., y]."""
    rows = []
    for g in _square(gram) if len(gram) else []:
        inv = invert(g[:-1, :-1])
        beta = inv @ g[:-1, -1]
        rows.append((beta.tolist(), inv.ravel().tolist(), float(g[-1, -1] - beta @ g[:-1, -1])))
    return pd.DataFrame(rows, columns=["beta", "inv", "ssr"])


@F.pandas_udf(NUMBERS)
def sandwich(inv: pd.Series, meat: pd.Series) -> pd.Series:
    out = [(a @ (m + m.T) / 2 @ a).ravel().tolist() for a, m in zip(_square(inv), _square(meat))] if len(inv) else []
    return pd.Series(out, dtype=object)


@F.pandas_udf(DoubleType())
def quadratic_form(vector: pd.Series, matrix: pd.Series) -> pd.Series:
    """v' pinv(M) v."""
    out = []
    for v, m in zip(vector, _square(matrix)) if len(vector) else []:
        v = np.asarray(v, dtype=float)
        out.append(float(v @ np.linalg.pinv((m + m.T) / 2) @ v))
    return pd.Series(out, dtype="float64")


def products(cols: Sequence[Column], agg=F.sum, weight: Column | None = None) -> Column:
    """The full product matrix of the columns as one flat array of sums (a column)."""
    k = len(cols)
    cells = {}
    for i in range(k):
        for j in range(i, k):
            x = cols[i] * cols[j]
            cells[i, j] = agg(x if weight is None else x * weight)
    return F.array(*[cells[min(i, j), max(i, j)] for i in range(k) for j in range(k)])


def design(xs: Sequence[str], intercept: bool) -> list[Column]:
    return ([F.lit(1.0)] if intercept else []) + [F.col(x).cast("double") for x in xs]


def gram(df: DataFrame, by: Keys, y: str, xs: Sequence[str], intercept: bool = True) -> DataFrame:
    """by, n, gram, sum_y, sum_yy over complete rows."""
    d = df.dropna(subset=[y, *xs])
    yy = F.col(y).cast("double")
    return d.groupBy(*by).agg(F.count("*").alias("n"), products([*design(xs, intercept), yy]).alias("gram"),
                              F.sum(yy).alias("_sy"), F.sum(yy * yy).alias("_syy"))


def attach(df: DataFrame, small: DataFrame, by: Keys) -> DataFrame:
    """Join per-group results back to rows; without keys the result is one row."""
    return df.join(small, list(by)) if by else df.crossJoin(F.broadcast(small))


def ols(df: DataFrame, by: Keys, y: str, xs: Sequence[str], intercept: bool = True) -> DataFrame:
    """by, n, k, beta, inv, ssr, r2, se (classical), t."""
    k = len(xs) + int(intercept)
    g = gram(df, by, y, xs, intercept).where(F.col("n") > k)
    d = g.withColumn("_s", solve_gram("gram")).select(*by, "n", "_sy", "_syy", F.lit(k).alias("k"), "_s.*")
    tss = F.col("_syy") - (F.col("_sy") * F.col("_sy") / F.col("n") if intercept else F.lit(0.0))
    d = d.withColumn("r2", 1 - ratio(F.col("ssr"), tss))
    s2 = F.col("ssr") / (F.col("n") - k)
    se = F.array(*[F.sqrt(s2 * F.col("inv")[i * k + i]) for i in range(k)])
    d = d.withColumn("se", se)
    return d.withColumn("t", F.zip_with("beta", "se", ratio)).drop("_sy", "_syy")


def fitted(xs: Sequence[str], intercept: bool = True, beta: str = "beta") -> Column:
    return reduce(lambda a, b: a + b, [F.col(beta)[i] * x for i, x in enumerate(design(xs, intercept))])


def with_residuals(df: DataFrame, fit: DataFrame, by: Keys, y: str, xs: Sequence[str], intercept: bool = True) -> DataFrame:
    """Complete rows with ``fitted`` and ``resid`` of their group's fit."""
    d = attach(df.dropna(subset=[y, *xs]), fit.select(*by, "beta"), by)
    d = d.withColumn("fitted", fitted(xs, intercept))
    return d.withColumn("resid", F.col(y) - F.col("fitted")).drop("beta")


def lag_weight(lag: int, lags: Column | int) -> Column:
    lags = F.lit(lags) if isinstance(lags, int) else lags
    return F.greatest(F.lit(0.0), 1.0 - F.lit(float(lag)) / (lags + 1))


def long_run_products(df: DataFrame, by: Keys, time: str, scores: Sequence[str], lags: Column | int, max_lag: int,
                      demean: bool = False) -> DataFrame:
    """by, n, meat: sum of s s' plus weighted lagged products, as one flat matrix.

    Each score is first summed with its weighted lags, so k columns are lagged, not k x k. The
    matrix is not symmetric; its symmetric part is the long-run product."""
    if demean:
        df = df.withColumns({s: F.col(s) - F.avg(s).over(whole(by)) for s in scores})
    w = ordered(by, time)
    smooth = {f"_z_{s}": reduce(lambda a, b: a + b, [F.col(s)] + [
        2.0 * lag_weight(j, lags) * F.coalesce(F.lag(s, j).over(w), F.lit(0.0)) for j in range(1, max_lag + 1)]) for s in scores}
    d = df.withColumns(smooth)
    cells = [F.sum(F.col(a) * F.col(f"_z_{b}")) for a in scores for b in scores]
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.array(*cells).alias("meat"), F.array(*[F.avg(s) for s in scores]).alias("mean_score"))


def identified(i: int) -> Column:
    """Whether regressor ``i`` of a fit is other than zero in some row; if not, its coefficient is unknown."""
    return F.col("inv")[i * (F.size("beta") + 1)] != 0


def _with_cov(fit: DataFrame, k: int) -> DataFrame:
    se = F.array(*[F.sqrt(F.col("cov")[i * k + i]) for i in range(k)])
    return fit.withColumn("se", se).withColumn("t", F.zip_with("beta", "se", ratio))


def ols_hac(df: DataFrame, by: Keys, time: str, y: str, xs: Sequence[str], lags: Column | int, max_lag: int | None = None,
            intercept: bool = True) -> DataFrame:
    """OLS with HAC covariance: by, n, beta, inv, cov, se, t, r2, ssr.

    ``lags`` may differ by group (a column of ``by``); then ``max_lag`` bounds it."""
    max_lag = lags if isinstance(lags, int) else max_lag
    fit = ols(df, by, y, xs, intercept).drop("se", "t")
    k = len(xs) + int(intercept)
    names = [f"_s{i}" for i in range(k)]
    d = with_residuals(df, fit, by, y, xs, intercept)
    d = d.select(*by, time, *[(x * F.col("resid")).alias(n) for n, x in zip(names, design(xs, intercept))])
    meat = long_run_products(d, by, time, names, lags, max_lag).select(*by, "meat")
    return _with_cov(attach(fit, meat, by).withColumn("cov", sandwich("inv", "meat")).drop("meat"), k)


def ols_clustered(df: DataFrame, by: Keys, cluster: str, y: str, xs: Sequence[str], intercept: bool = True) -> DataFrame:
    """OLS with covariance clustered on ``cluster``: score sums per cluster, then their products."""
    fit = ols(df, by, y, xs, intercept).drop("se", "t")
    k = len(xs) + int(intercept)
    names = [f"_s{i}" for i in range(k)]
    d = with_residuals(df, fit, by, y, xs, intercept)
    sums = d.groupBy(*by, cluster).agg(*[F.sum(x * F.col("resid")).alias(n) for n, x in zip(names, design(xs, intercept))])
    meat = sums.groupBy(*by).agg(F.count("*").alias("clusters"), F.array(*[F.sum(F.col(a) * F.col(b)) for a in names for b in names]).alias("meat"))
    j = attach(fit, meat, by)
    g, n = F.col("clusters"), F.col("n")
    factor = g / (g - 1) * (n - 1) / (n - k)
    cov = F.transform(sandwich("inv", "meat"), lambda c: c * F.col("_f"))
    return _with_cov(j.withColumn("_f", factor).withColumn("cov", cov).drop("meat", "_f"), k)


def terms(fit: DataFrame, by: Keys, names: Sequence[str], p_values: bool = True, keep: Sequence[str] = ("n", "r2")) -> DataFrame:
    """One row per coefficient: by, term, coef, se, t, p; NULL but for the term where its regressor is always zero."""
    cells = F.array(*[F.struct(F.lit(n).alias("term"), *[F.when(identified(i), F.col(c)[i]).alias(a) for c, a in (("beta", "coef"), ("se", "se"), ("t", "t"))])
                      for i, n in enumerate(names)])
    d = fit.select(*by, *keep, F.inline(cells))
    return d.withColumn("p", p_normal_two("t")) if p_values else d


def contributions(df: DataFrame, fit: DataFrame, by: Keys, y: str, xs: Sequence[str]) -> DataFrame:
    """Each row's value split into coefficient x regressor, drift and residual (they add up)."""
    d = attach(df.dropna(subset=[y, *xs]), fit.select(*by, "beta"), by)
    d = d.withColumns({f"from_{x}": F.col("beta")[i + 1] * F.col(x) for i, x in enumerate(xs)}).withColumn("drift", F.col("beta")[0])
    parts = reduce(lambda a, b: a + b, [F.col(f"from_{x}") for x in xs])
    return d.withColumn("residual", F.col(y) - F.col("drift") - parts).drop("beta")


def window_attribution(df: DataFrame, by: Keys, time: str, y: str, xs: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """Sums of contributions over the latest rows of each window length, with coefficients from
    all rows (``fit`` = full) and from the rows outside the window (``fit`` = outside)."""
    d = df.dropna(subset=[y, *xs])
    d = d.withColumn("_back", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(time).desc())))
    d = d.withColumn("months", F.explode(F.array(*[F.lit(m) for m in windows])))
    inside = F.col("_back") <= F.col("months")
    key = [*by, "months"]
    full, outside = ols(d, key, y, xs), ols(d.where(~inside), key, y, xs)
    fits = full.withColumn("fit", F.lit("full")).unionByName(outside.withColumn("fit", F.lit("outside")))
    rows = d.where(inside).join(fits.select(*key, "fit", "beta"), key)
    parts = {f"from_{x}": F.sum(F.col("beta")[i + 1] * F.col(x)) for i, x in enumerate(xs)}
    g = rows.groupBy(*key, "fit").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.sum(y).alias("actual"),
                                      F.sum(F.col("beta")[0]).alias("drift"), *[c.alias(n) for n, c in parts.items()])
    return g.withColumn("residual", F.col("actual") - F.col("drift") - reduce(lambda a, b: a + b, [F.col(n) for n in parts]))


def two_stage(df: DataFrame, by: Keys, time: str, y: str, endog: str, instruments: Sequence[str], controls: Sequence[str],
              lags: int) -> DataFrame:
    """2SLS of y on one endogenous regressor: slope, HAC se, first-stage F, Hansen J and its p."""
    z = [*controls, *instruments]
    k, q = len(controls) + 1, len(instruments)
    d = df.dropna(subset=[y, endog, *z])
    first = ols_hac(d, by, time, endog, z, lags)
    kz = k + q
    block = F.array(*[F.col("cov")[i * kz + j] for i in range(k, kz) for j in range(k, kz)])
    first = first.select(*by, F.slice("beta", k + 1, q).alias("_b"), block.alias("_v"), F.col("beta").alias("_first"))
    first = first.withColumn("first_stage_f", quadratic_form("_b", "_v") / q)
    hat = d.join(first.select(*by, F.col("_first").alias("beta")), list(by)).withColumn("_hat", fitted(z)).drop("beta")
    xs = [*controls, "_hat"]
    second = ols(hat, by, y, xs).select(*by, "n", "beta", "inv")
    u = hat.join(second.select(*by, "beta"), list(by)).withColumn("_u", F.col(y) - fitted([*controls, endog])).drop("beta")
    s_names, g_names = [f"_s{i}" for i in range(k + 1)], [f"_g{i}" for i in range(kz)]
    u = u.select(*by, time, *[(x * F.col("_u")).alias(n) for n, x in zip(s_names, design(xs, True))],
                 *[(x * F.col("_u")).alias(n) for n, x in zip(g_names, design(z, True))])
    meat = long_run_products(u, by, time, s_names, lags, lags, demean=True).select(*by, "meat")
    score = u.groupBy(*by).agg(F.array(*[F.avg(g) for g in g_names]).alias("_gbar"))
    moment = long_run_products(u, by, time, g_names, lags, lags, demean=True).select(*by, F.col("n").alias("_n"), F.col("meat").alias("_gm"))
    j = second.join(meat, list(by)).join(score, list(by)).join(moment, list(by)).join(first.select(*by, "first_stage_f", "_b"), list(by))
    j = j.withColumn("_cov", sandwich("inv", "meat")).withColumn("se", F.sqrt(F.col("_cov")[(k + 1) * (k + 1) - 1]))
    # J = n g' (meat / n)^-1 g
    j = j.withColumn("hansen_j", F.col("_n") * F.col("_n") * quadratic_form("_gbar", "_gm"))
    j = j.withColumn("beta", F.col("beta")[k]).withColumn("t", F.col("beta") / F.col("se"))
    return j.select(*by, "n", "beta", "se", "t", "first_stage_f", "hansen_j",
                    (p_chi2_upper("hansen_j", F.lit(float(q - 1))) if q > 1 else F.lit(None).cast("double")).alias("j_p"),
                    *[F.col("_b")[i].alias(f"first_{n}") for i, n in enumerate(instruments)])


def mean_test(df: DataFrame, by: Keys, time: str, x: str, lags: Column | int, max_lag: int | None = None) -> DataFrame:
    """Mean of a series with a Bartlett long-run variance: by, n, mean, var_of_mean, t."""
    max_lag = lags if isinstance(lags, int) else max_lag
    d = df.where(F.col(x).isNotNull()).select(*by, time, F.col(x).alias("_x"), F.col(x).alias("_raw"))
    m = long_run_products(d, by, time, ["_x"], lags, max_lag, demean=True)
    means = d.groupBy(*by).agg(F.avg("_raw").alias("mean"))
    j = attach(m, means, by)
    j = j.withColumn("var_of_mean", F.greatest(F.col("meat")[0] / F.col("n"), F.lit(1e-300)) / F.col("n"))
    return j.select(*by, "n", "mean", "var_of_mean", (F.col("mean") / F.sqrt("var_of_mean")).alias("t"))
