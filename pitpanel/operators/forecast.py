"""Out-of-sample forecasts from a gap, and their scores.

All horizons run in one plan: a horizon is part of the key, so the fits of every origin are
running aggregates over one sort per (entity, horizon)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions.columns import ordered, past, whole
from pitpanel.operators.calendar import Keys
from pitpanel.operators.regression import mean_test, ols_hac


def per_horizon(horizons: Sequence[int], make: Callable[[int], Column], h: str = "h") -> Column:
    """A column whose expression depends on the row's horizon."""
    out = None
    for n in horizons:
        out = F.when(F.col(h) == n, make(n)) if out is None else out.when(F.col(h) == n, make(n))
    return out


def targets(df: DataFrame, keys: Keys, time: str, level: str, keep: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """One row per (row, horizon): y = level h months ahead less level now. Complete grid."""
    w = ordered(keys, time)
    d = df.withColumns({f"_y{h}": F.lead(level, h).over(w) - F.col(level) for h in horizons})
    cells = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"_y{h}").alias("y")) for h in horizons])
    return d.select(*keys, time, level, *keep, F.inline(cells))


def forecasts(df: DataFrame, keys: Keys, time: str, level: str, x: str, horizons: Sequence[int], min_train: int,
              window: int | None = None) -> DataFrame:
    """For each origin with a known x: forecast from the rows whose target is realised by then.

    Training rows need y and x. ``window`` keeps the last ``window`` of them for the slope; the
    drift always uses all. Columns: h, x, y, f_drift, f_model, slope, const, n_train."""
    d = targets(df, keys, time, level, [x], horizons).withColumnRenamed(x, "x")
    by = [*keys, "h"]
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    d = d.withColumns({"_x": F.when(ok, F.col("x")), "_y": F.when(ok, F.col("y"))})
    d = d.withColumn("_k", F.count("_x").over(past(by, time)))
    # the k-th training row sees the rows numbered k - window + 1 .. k (or 1 .. k)
    rows = Window.partitionBy(*by).orderBy("_k").rangeBetween(
        Window.unboundedPreceding if window is None else -(window - 1), Window.currentRow)
    every = Window.partitionBy(*by).orderBy("_k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({"_b": F.regr_slope("_y", "_x").over(rows), "_a": F.regr_intercept("_y", "_x").over(rows),
                       "_m": F.avg("_y").over(every)})
    fit = F.when(F.col("_x").isNotNull(), F.struct("_a", "_b", "_m", "_k"))
    d = d.withColumn("_fit", per_horizon(horizons, lambda h: F.last(fit, True).over(past(by, time, -h))))
    out = d.select(*by, time, "x", "y", F.col("_fit._m").alias("f_drift"), (F.col("_fit._a") + F.col("_fit._b") * F.col("x")).alias("f_model"),
                   F.col("_fit._b").alias("slope"), F.col("_fit._a").alias("const"), F.col("_fit._k").alias("n_train"))
    return out.where(F.col("x").isNotNull() & (F.col("n_train") >= min_train))


def score_card(fc: DataFrame, by: Keys, time: str, at_least: int = 12) -> DataFrame:
    """RMSEs, ratio, out-of-sample R2, hit rates, slope range; NULLs under ``at_least`` outcomes."""
    y, f0, f1 = F.col("y"), F.col("f_drift"), F.col("f_model")
    known = y.isNotNull()
    mean = lambda c: F.avg(F.when(known, c))
    rmse = lambda f: F.sqrt(mean((y - f) * (y - f)))
    share = lambda c: mean(c.cast("double"))
    g = fc.groupBy(*by).agg(
        F.count("y").alias("n_oos"), F.min(F.when(known, F.col(time))).alias("first"), F.max(F.when(known, F.col(time))).alias("last"),
        rmse(F.lit(0.0)).alias("rmse_zero"), rmse(f0).alias("rmse_drift"), rmse(f1).alias("rmse_model"),
        (1 - F.sum(F.when(known, (y - f1) * (y - f1))) / F.sum(F.when(known, (y - f0) * (y - f0)))).alias("oos_r2"),
        share(F.signum(f1) == F.signum(y)).alias("hit_rate"), share(y > 0).alias("naive_hit_rate"),
        share(F.signum(f1 - f0) == F.signum(y - f0)).alias("hit_rate_excess"), share(f1 < 0).alias("share_down"),
        F.min("slope").alias("slope_min"), F.max("slope").alias("slope_max"), F.max_by("slope", time).alias("slope_last"))
    g = g.withColumn("rmse_ratio", F.col("rmse_model") / F.col("rmse_drift"))
    stats = [c for c in g.columns if c not in (*by, "n_oos")]
    return g.select(*by, "n_oos", *[F.when(F.col("n_oos") >= at_least, F.col(c)).alias(c) for c in stats])


def clark_west(fc: DataFrame, by: Keys, time: str, max_h: int) -> DataFrame:
    """One-sided test of the model against the nested drift forecast: by, n, stat. ``h`` in ``by``."""
    y, f0, f1 = F.col("y"), F.col("f_drift"), F.col("f_model")
    adj = (y - f0) * (y - f0) - ((y - f1) * (y - f1) - (f0 - f1) * (f0 - f1))
    d = fc.withColumn("_adj", adj)
    return mean_test(d, by, time, "_adj", F.col("h") - 1, max(max_h - 1, 0)).select(*by, "n", F.col("t").alias("stat"))


def diebold_mariano(fc: DataFrame, by: Keys, time: str, max_h: int) -> DataFrame:
    """Difference of squared errors with the small-sample factor: by, n, stat."""
    y = F.col("y")
    loss = (y - F.col("f_drift")) * (y - F.col("f_drift")) - (y - F.col("f_model")) * (y - F.col("f_model"))
    m = mean_test(fc.withColumn("_d", loss), by, time, "_d", F.col("h") - 1, max(max_h - 1, 0))
    n, h = F.col("n"), F.col("h")
    factor = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    return m.select(*by, "n", (F.col("t") * factor).alias("stat"))


def overlap_robust_slope(df: DataFrame, keys: Keys, time: str, level: str, x: str, horizons: Sequence[int]) -> DataFrame:
    """Slope of the h-period change on x with standard errors from one-period residuals and the
    regressor summed over the last h rows (well sized when h is long). by + n, beta, const, se, t."""
    d = df.dropna(subset=[level, x])
    w = ordered(keys, time)
    d = d.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(whole(keys)),
                       "_r": F.lead(level).over(w) - F.col(level)})
    d = d.withColumn("_e", F.col("_r") - F.avg("_r").over(whole(keys)))
    d = d.withColumns({f"_z{h}": F.sum(x).over(w.rowsBetween(-(h - 1), 0)) for h in horizons}
                      | {f"_y{h}": F.lead(level, h).over(w) - F.col(level) for h in horizons})
    cells = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"_z{h}").alias("_z"), F.col(f"_y{h}").alias("_y")) for h in horizons])
    d = d.select(*keys, F.col(x).alias("_x"), "_i", "_n", "_e", F.inline(cells))
    e2 = F.when((F.col("_i") >= F.col("h") - 1) & (F.col("_i") < F.col("_n") - 1), F.col("_e") * F.col("_e"))
    ok = F.col("_y").isNotNull()
    g = d.groupBy(*keys, "h").agg(
        F.count("_y").alias("n"), F.regr_slope("_y", "_x").alias("beta"), F.regr_intercept("_y", "_x").alias("const"),
        F.avg(F.when(ok, F.col("_x"))).alias("_m1"), F.avg(F.when(ok, F.col("_x") * F.col("_x"))).alias("_m2"),
        F.avg(e2 * F.col("h") * F.col("h")).alias("_s11"), F.avg(e2 * F.col("h") * F.col("_z")).alias("_s12"),
        F.avg(e2 * F.col("_z") * F.col("_z")).alias("_s22"))
    det = F.col("_m2") - F.col("_m1") * F.col("_m1")
    # second row of the inverse second-moment matrix: (-m1, 1) / det
    v = (F.col("_m1") * F.col("_m1") * F.col("_s11") - 2 * F.col("_m1") * F.col("_s12") + F.col("_s22")) / (det * det) / F.col("n")
    g = g.withColumn("se", F.sqrt(v))
    return g.select(*keys, "h", "n", "beta", "const", "se", (F.col("beta") / F.col("se")).alias("t"))


def non_overlapping_slopes(df: DataFrame, keys: Keys, time: str, level: str, x: str, horizons: Sequence[int], at_least: int = 8) -> DataFrame:
    """Slope on every h-th row for each of the h offsets; median, min, max over offsets."""
    d = targets(df.dropna(subset=[level, x]), keys, time, level, [x], horizons).where(F.col("y").isNotNull())
    by = [*keys, "h"]
    d = d.withColumns({"_off": (F.row_number().over(ordered(by, time)) - 1) % F.col("h")})
    per = d.groupBy(*by, "_off").agg(F.count("*").alias("_n"), F.regr_slope("y", x).alias("_b"), F.regr_sxx("y", x).alias("_sxx"),
                                     F.regr_syy("y", x).alias("_syy"))
    s2 = (F.col("_syy") - F.col("_b") * F.col("_b") * F.col("_sxx")) / (F.col("_n") - 2)
    per = per.withColumn("_t", F.col("_b") / F.sqrt(s2 / F.col("_sxx")))
    keep = F.col("_n") >= at_least
    med = lambda c: F.percentile(F.when(keep, F.col(c)), F.lit(0.5))
    return per.groupBy(*by).agg(med("_b").alias("beta_median"), F.min(F.when(keep, F.col("_b"))).alias("beta_min"),
                                F.max(F.when(keep, F.col("_b"))).alias("beta_max"), med("_t").alias("t_median"),
                                F.count(F.when(keep, 1)).alias("offsets"))


def state_conditional(df: DataFrame, keys: Keys, time: str, level: str, x: str, prob: str, h: int) -> DataFrame:
    """h-period change on x split by a state probability, HAC."""
    d = targets(df, keys, time, level, [x, prob], [h])
    d = d.withColumns({"x_calm": F.col(x) * (1 - F.col(prob)), "x_stress": F.col(x) * F.col(prob)})
    return ols_hac(d, keys, time, "y", ["x_calm", "x_stress"], max(h - 1, 1))


def current_forecast(df: DataFrame, keys: Keys, time: str, level: str, x: str, horizons: Sequence[int], window: int | None = None) -> DataFrame:
    """Forecast from the latest x with every realised target (or the last ``window``)."""
    d = targets(df, keys, time, level, [x], horizons)
    by = [*keys, "h"]
    ok = F.col(x).isNotNull() & F.col("y").isNotNull()
    back = F.row_number().over(Window.partitionBy(*by, "_ok").orderBy(F.col(time).desc()))
    d = d.withColumn("_ok", ok).withColumn("_back", back)
    used = F.col("_ok") if window is None else F.col("_ok") & (F.col("_back") <= window)
    yy, xx = F.when(used, F.col("y")), F.when(used, F.col(x))
    g = d.groupBy(*by).agg(F.regr_slope(yy, xx).alias("slope"), F.regr_intercept(yy, xx).alias("const"),
                           F.avg(F.when(F.col("_ok"), F.col("y"))).alias("drift_only"),
                           F.min(F.when(used, F.col(time))).alias("train_from"), F.max(F.when(used, F.col(time))).alias("train_to"),
                           F.max(F.when(F.col(x).isNotNull(), F.col(time))).alias("as_of"), F.max_by(x, F.when(F.col(x).isNotNull(), F.col(time))).alias("x"))
    return g.withColumn("forecast", F.col("const") + F.col("slope") * F.col("x"))


def directional_scores(fc: DataFrame, by: Keys, time: str, per_year: int = 12) -> DataFrame:
    """Hit rate, Pearson and rank correlation of forecast and outcome, and the return, running
    total and information ratio of trading the forecast's sign."""
    from pitpanel.operators.crosssection import average_rank

    d = fc.where(F.col("y").isNotNull() & F.col("f_model").isNotNull())
    d = d.withColumns({"_r1": average_rank("y", by), "_r2": average_rank("f_model", by), "_ret": F.signum("f_model") * F.col("y")})
    d = d.withColumn("_cum", F.sum("_ret").over(past(by, time)))
    return d.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((F.signum("f_model") == F.signum("y")).cast("double")).alias("hit_rate"),
        F.corr("y", "f_model").alias("pearson"), F.corr("_r1", "_r2").alias("spearman"), F.avg("_ret").alias("mean_return"),
        F.max_by("_cum", time).alias("total_return"), F.min("_cum").alias("worst_total"),
        (F.avg("_ret") / F.stddev_samp("_ret") * F.sqrt(F.lit(float(per_year)))).alias("information_ratio"))


def choose(scores: DataFrame, by: Keys, name: str, base: str, loss: str, p: str, gain: float) -> DataFrame:
    """Pre-set rule: the variant with the lowest loss among those that beat ``base`` by at least
    ``gain`` and have a lower p; ``base`` if there is none."""
    ref = scores.where(F.col(name) == base).select(*by, F.col(loss).alias("_l0"), F.col(p).alias("_p0"))
    d = scores.join(ref, list(by), "right")
    better = (F.col(name) != base) & (F.col("_l0") - F.col(loss) >= gain) & (F.col(p) < F.col("_p0"))
    return d.groupBy(*by).agg(F.coalesce(F.min_by(name, F.when(better, F.struct(loss, name))), F.lit(base)).alias("choice"),
                              F.count(F.when(better, 1)).alias("candidates"))
