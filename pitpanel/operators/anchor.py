"""Fundamentals anchors: pooled and single-entity dynamic regressions, gaps from them, draws."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions.arrays import with_percentiles
from pitpanel.functions.columns import ordered, past, whole
from pitpanel.functions.draws import pick
from pitpanel.operators.asof import asof
from pitpanel.operators.calendar import Keys
from pitpanel.operators.features import dynamic_terms
from pitpanel.operators.gaps import draw_table
from pitpanel.operators.regression import NUMBERS, attach, ols_clustered, ols_hac, sandwich, solve_gram
from pitpanel.operators.scan import add_before, by_value
from pitpanel.session import settled


def dynamic_rows(df: DataFrame, keys: Keys, time: str, y: str, xs: Sequence[str], k: int) -> tuple[DataFrame, list[str]]:
    """Complete rows with the differenced leads and lags; entities with fewer than 2k + 3 dropped."""
    d, terms = dynamic_terms(df.dropna(subset=[y, *xs]), keys, time, xs, k)
    d = d.dropna(subset=terms)
    return d.withColumn("_size", F.count("*").over(whole(keys))).where(F.col("_size") >= 2 * k + 3).drop("_size"), terms


def demeaned(df: DataFrame, keys: Keys, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_dm": F.col(c) - F.avg(c).over(whole(keys)) for c in cols})


def pooled_fit(df: DataFrame, by: Keys, entity: str, time: str, y: str, xs: Sequence[str], k: int) -> tuple[DataFrame, DataFrame]:
    """Pooled dynamic regression with entity effects, covariance clustered by entity.

    Returns (fit per ``by``: n, clusters, b, t, v; effects per entity: alpha, alpha_se, n_obs).
    The effect is the mean of y less the long-run part."""
    keys = [*by, entity]
    d, terms = dynamic_rows(df, keys, time, y, xs, k)
    cols = [*xs, *terms]
    dm = demeaned(d, keys, [y, *cols])
    fit = ols_clustered(dm, by, entity, f"{y}_dm", [f"{c}_dm" for c in cols], intercept=False)
    m, p = len(xs), len(cols)
    v = F.array(*[F.col("cov")[i * p + j] for i in range(m) for j in range(m)])
    fit = fit.select(*by, "n", "clusters", F.slice("beta", 1, m).alias("b"), F.slice("t", 1, m).alias("t"), v.alias("v"))
    lev = attach(d, fit.select(*by, "b"), by).withColumn("_lev", F.col(y) - long_run(xs))
    effects = lev.groupBy(*keys).agg(F.avg("_lev").alias("alpha"), (F.stddev_samp("_lev") / F.sqrt(F.count("*"))).alias("alpha_se"), F.count("*").alias("n_obs"))
    return fit, effects


def long_run(xs: Sequence[str], b: str = "b") -> Column:
    return reduce(lambda s, c: s + c, [F.col(b)[i] * F.col(x) for i, x in enumerate(xs)])


def residuals(df: DataFrame, fit: DataFrame, effects: DataFrame, by: Keys, entity: str, time: str, y: str, xs: Sequence[str], k: int) -> DataFrame:
    d, _ = dynamic_rows(df, [*by, entity], time, y, xs, k)
    d = attach(d, fit.select(*by, "b"), by).join(effects.select(*by, entity, "alpha"), [*by, entity])
    return d.select(*by, entity, time, (F.col(y) - long_run(xs) - F.col("alpha")).alias("resid"))


def information_sets(panel: DataFrame, available: str, time: str) -> DataFrame:
    """A row per date at which something became public: info, its number from 1, periods known by then and the number of dates.

    As many rows as the calendar has dates; months in between reuse the last one."""
    first = panel.groupBy(time).agg(F.min(available).alias("info")).groupBy("info").agg(F.count("*").alias("_new"))
    dates = panel.select(F.col(available).alias("info")).distinct().join(first, "info", "left")
    calendar = Window.orderBy("info")
    return dates.select("info", F.row_number().over(calendar).alias("_at"), F.sum(F.coalesce("_new", F.lit(0))).over(calendar).alias("periods"), F.count("*").over(Window.partitionBy()).alias("_dates"))


def expanding_products(df: DataFrame, entity: str, time: str, available: str, y: str, xs: Sequence[str], k: int, at_least: int) -> tuple[DataFrame, int]:
    """Each entity's dynamic rows as products at every information set: info, entity, n, w (products around the
    entity's mean, [xs, terms, y] flat) and mean (of xs, then y); and the number of columns.

    A dynamic row is public when the last of the rows it uses is. Its products are summed once by that date and
    cumulated along the dates, so a row is read once, whatever the number of later sets; an entity with nothing
    new at a date carries its products on."""
    d = df.dropna(subset=[y, *xs]).withColumn("_ready", F.max(available).over(ordered([entity], time).rowsBetween(-(k + 1), k)))
    d, terms = dynamic_terms(d, [entity], time, xs, k)
    cols = [*xs, *terms, y]
    p = len(cols)
    start = past([entity], time)
    d = d.dropna(subset=terms)
    d = d.select(entity, "_ready", *[F.first(F.col(c).cast("double")).over(start).alias(f"_o{i}") for i, c in enumerate(cols)], *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    d = d.withColumns({f"_v{i}": F.col(f"_v{i}") - F.col(f"_o{i}") for i in range(p)})          # from the first row on: no digits are lost in the sums
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    g = d.groupBy(entity, "_ready").agg(F.count("*").alias("n"), *[F.first(f"_o{i}").alias(f"_o{i}") for i in range(p)], *[F.sum(f"_v{i}").alias(f"_s{i}") for i in range(p)],
                                        *[F.sum(F.col(f"_v{i}") * F.col(f"_v{j}")).alias(f"_p{i}_{j}") for i, j in cells])
    so_far = past([entity], "_ready")
    sums = ["n", *[f"_s{i}" for i in range(p)], *[f"_p{i}_{j}" for i, j in cells]]
    g = g.withColumns({c: F.sum(c).over(so_far) for c in sums}).where(F.col("n") >= 2 * k + 3)
    cell = lambda i, j: F.col(f"_p{i}_{j}") - F.col(f"_s{i}") * F.col(f"_s{j}") / F.col("n")
    mean = F.array(*[F.col(f"_o{i}") + F.col(f"_s{i}") / F.col("n") for i in (*range(len(xs)), p - 1)])
    g = g.select(entity, F.col("_ready").alias("info"), "n", F.array(*[cell(min(i, j), max(i, j)) for i in range(p) for j in range(p)]).alias("w"), mean.alias("mean"))
    sets = information_sets(df, available, time)
    g = g.join(sets.select("info", "_at", "_dates"), "info").drop("info")
    until = F.coalesce(F.lead("_at").over(ordered([entity], "_at")), F.col("_dates") + 1)
    g = g.withColumn("_until", (until - 1).cast("int")).withColumn("_at", F.explode(F.sequence("_at", "_until")))
    return g.join(sets.where(F.col("periods") >= at_least).select("_at", "info"), "_at").drop("_at", "_until", "_dates"), p


def expanding_pooled_fit(df: DataFrame, entity: str, time: str, available: str, y: str, xs: Sequence[str], k: int, at_least: int) -> tuple[DataFrame, DataFrame]:
    """``pooled_fit`` at every information set with ``at_least`` known periods, from products alone: fit by info, effects by (info, entity)."""
    products_, p = expanding_products(df, entity, time, available, y, xs, k, at_least)
    g = settled(products_)
    m, q = len(xs), p - 1
    w = lambda i, j: F.col("w")[i * p + j]
    total = F.array(*[F.sum(w(min(i, j), max(i, j))) for i in range(p) for j in range(p)])
    fit = g.groupBy("info").agg(F.sum("n").alias("n"), F.count("*").alias("clusters"), total.alias("_g")).where(F.col("n") > q)
    fit = settled(fit.withColumn("_s", solve_gram("_g")).select("info", "n", "clusters", "_s.beta", "_s.inv"))
    d = g.join(fit.select("info", "beta"), "info")
    score = [w(i, q) - reduce(lambda a, c: a + c, [w(i, j) * F.col("beta")[j] for j in range(q)]) for i in range(q)]
    d = d.withColumn("_z", F.array(*score))
    meat = d.groupBy("info").agg(F.array(*[F.sum(F.col("_z")[i] * F.col("_z")[j]) for i in range(q) for j in range(q)]).alias("_meat"))
    factor = F.col("clusters") / (F.col("clusters") - 1) * (F.col("n") - 1) / (F.col("n") - q)
    done = fit.join(meat, "info").withColumn("_f", factor).withColumn("_c", sandwich("inv", "_meat"))
    cov = lambda i, j: F.col("_c")[i * q + j] * F.col("_f")
    done = done.select("info", "n", "clusters", F.slice("beta", 1, m).alias("b"), F.array(*[F.col("beta")[i] / F.sqrt(cov(i, i)) for i in range(m)]).alias("t"),
                       F.array(*[cov(i, j) for i in range(m) for j in range(m)]).alias("v"))
    side = [*range(m), q]
    weight = lambda i: F.lit(1.0) if i == q else -F.col("beta")[i]
    square = reduce(lambda a, c: a + c, [weight(i) * weight(j) * w(i, j) for i in side for j in side])
    alpha = F.col("mean")[m] - reduce(lambda a, c: a + c, [F.col("beta")[i] * F.col("mean")[i] for i in range(m)])
    effects = d.select("info", entity, alpha.alias("alpha"), (F.sqrt(F.greatest(square, F.lit(0.0)) / (F.col("n") - 1)) / F.sqrt(F.col("n").cast("double"))).alias("alpha_se"), F.col("n").alias("n_obs"))
    return done, effects


def anchor_gaps(months: DataFrame, panel: DataFrame, fit: DataFrame, effects: DataFrame, entity: str, xs: Sequence[str], available: str) -> DataFrame:
    """Each month's gap from the latest fit, the latest published regressors and the latest level.

    ``months`` is (entity, ref_month, level): the level public at that month."""
    f = fit.join(effects, "info").select(entity, "info", "alpha", "alpha_se", "b", "v")
    m = asof(months.withColumn("_at", F.col("ref_month")), f, [entity], "_at", "info", ["info", "alpha", "alpha_se", "b", "v"])
    x = panel.select(entity, available, *xs)
    m = asof(m.drop("fact_time"), x, [entity], "_at", available, list(xs)).drop("fact_time", "_at")
    star = F.col("alpha") + long_run(xs)
    m = m.withColumn("star", star)
    return m.withColumns({"gap_log": F.col("star") - F.col("level"), "misalignment_pct": (F.exp(F.col("star") - F.col("level")) - 1) * 100})


@F.pandas_udf(NUMBERS)
def cholesky(v: pd.Series) -> pd.Series:
    """Lower factor of a covariance matrix (row-major); tiny negative roots count as zero."""
    out = []
    for a in v:
        if a is None:
            out.append(None)
            continue
        k = int(round(len(a) ** 0.5))
        m = np.asarray(a, dtype=float).reshape(k, k)
        w, q = np.linalg.eigh((m + m.T) / 2)
        r = np.linalg.qr((q * np.sqrt(np.clip(w, 0, None))).T)[1].T
        out.append((r * np.sign(np.where(np.diag(r) == 0, 1.0, np.diag(r)))).ravel().tolist())
    return pd.Series(out, dtype=object)


def parameter_band(gaps: DataFrame, xs: Sequence[str], seed: int, draws: int, levels: Sequence[float]) -> DataFrame:
    """Band of the gap from normal draws of the entity effect and the slopes (their covariance).

    The draws are one broadcast row; each row maps them through x'L."""
    names = [f"z{i}" for i in range(len(xs))]
    d = gaps.where(F.col("star").isNotNull()).withColumn("_l", cholesky("v"))
    d = d.join(F.broadcast(draw_table(gaps.sparkSession, seed, draws, ["z_alpha", *names], [])))
    m = len(xs)
    load = [reduce(lambda a, b: a + b, [F.col(x) * F.col("_l")[i * m + j] for i, x in enumerate(xs)]) for j in range(m)]
    d = d.withColumns({f"_w{j}": c for j, c in enumerate(load)})

    def one(i: Column) -> Column:
        slopes = reduce(lambda a, b: a + b, [F.col(f"_w{j}") * F.get(F.col(n), i) for j, n in enumerate(names)])
        return F.col("gap_log") + F.col("alpha_se") * F.get(F.col("z_alpha"), i) + slopes

    d = d.withColumn("_draws", F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), one))
    d = with_percentiles(d, "_draws", {f"gap_p{round(100 * p)}": p for p in levels})
    return d.drop("_draws", "_l", "z_alpha", *names, *[f"_w{j}" for j in range(m)])


def cluster_bootstrap(df: DataFrame, entity: str, time: str, y: str, xs: Sequence[str], k: int, draws: int, seed: int, block: int) -> DataFrame:
    """Bootstrap draws of the pooled slopes and of every entity's effect.

    Whole entities are drawn with replacement: each entity's product matrix is summed once and
    a draw only adds matrices. The effect is the mean of a moving-block resample of y - x'b, so
    it needs the resampled means of y and x, not the residuals."""
    d, terms = dynamic_rows(df, [entity], time, y, xs, k)
    cols = [*xs, *terms]
    dm = demeaned(d, [entity], [y, *cols])
    z = [F.col(f"{c}_dm") for c in [*cols, y]]
    p = len(z)
    cells = {(i, j): f"_g{i}_{j}" for i in range(p) for j in range(i, p)}
    g = dm.groupBy(entity).agg(*[F.sum(z[i] * z[j]).alias(n) for (i, j), n in cells.items()])
    # number the entities 0..G-1: bucket totals and a rank inside each bucket
    ids = add_before(by_value(g.select(entity), entity, n=F.count("*")), entity, ["n"]).select(entity, F.col("n_before").cast("int").alias("_id"), F.col("n_total").cast("int").alias("_G"))
    picks = (ids.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long"))))
             .select("draw", pick(seed, "cluster", F.col("_G"), F.col("draw"), F.col("_id")).alias("_id")))
    summed = picks.join(ids.drop("_G"), "_id").join(g, entity).groupBy("draw").agg(*[F.sum(n).alias(n) for n in cells.values()])
    full = F.array(*[F.col(cells[min(i, j), max(i, j)]) for i in range(p) for j in range(p)])
    betas = summed.withColumn("_s", solve_gram(full)).select("draw", F.slice("_s.beta", 1, len(xs)).alias("b"))
    # moving blocks inside each entity: its rows are one array, a draw reads places of it
    cols = [y, *xs]
    rows = d.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]))).alias("_r"))
    n = F.size("_r")
    fan = rows.select(entity, "_r", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long"))).alias("draw"))
    start = lambda i: pick(seed, "block", F.greatest(n - block + 1, F.lit(1)), F.col(entity), F.col("draw"), F.floor(i / block))
    taken = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("_r"), F.least(start(i) + i % block, n - 1).cast("int")))
    fan = fan.withColumn("_s", taken)
    total = lambda name: F.aggregate("_s", F.lit(0.0), lambda a, r: a + r[name])
    means = fan.select(entity, "draw", *[(total(f"v{i}") / n).alias(c if i else "_y") for i, c in enumerate(cols)])
    j = means.join(betas, "draw")
    return j.select(entity, "draw", "b", (F.col("_y") - long_run(xs)).alias("alpha"))


def gap_draws(months: DataFrame, draws: DataFrame, entity: str, xs: Sequence[str], level: str) -> DataFrame:
    """``months`` (entity, level, xs, ...) with ``draws``: the gap under every bootstrap draw of the entity, in the draws' order.

    An entity's draws are one array, as many as the setting says; months meet it by entity."""
    packed = draws.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct("draw", "b", "alpha"))).alias("_d"))
    d = months.join(packed, entity)
    fit = lambda z: reduce(lambda a, c: a + c, [z["b"][i] * F.col(x) for i, x in enumerate(xs)], z["alpha"])
    return d.withColumn("draws", F.transform("_d", lambda z: fit(z) - F.col(level))).drop("_d")


def refit_origins(df: DataFrame, keys: Keys, time: str, y: str, xs: Sequence[str], at_least: int, every: int) -> DataFrame:
    """Rows under each refit origin: an expanding sample, re-estimated every ``every`` complete rows."""
    d = df.withColumn("_ok", reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (y, *xs)]))
    d = d.withColumn("_k", F.when(F.col("_ok"), F.row_number().over(ordered([*keys, "_ok"], time))))
    origin = F.col("_ok") & (F.col("_k") >= at_least) & ((F.col("_k") - at_least) % every == 0)
    o = d.where(origin).select(*keys, F.col(time).alias("origin"))
    return d.drop("_ok", "_k").join(o, list(keys)).where(F.col(time) <= F.col("origin"))


def entity_fits(df: DataFrame, keys: Keys, time: str, y: str, xs: Sequence[str], k: int, at_least: int, every: int, lags: int) -> DataFrame:
    """Dynamic regression of each entity at its refit origins: const and slopes with their covariance."""
    by = [*keys, "origin"]
    d, terms = dynamic_terms(refit_origins(df, keys, time, y, xs, at_least, every), by, time, xs, k)
    fit = ols_hac(d, by, time, y, [*xs, *terms], lags)
    m, p = len(xs) + 1, len(xs) + len(terms) + 1
    v = F.array(*[F.col("cov")[i * p + j] for i in range(m) for j in range(m)])
    return fit.select(*by, "n", F.slice("beta", 1, m).alias("b"), v.alias("v"))


def entity_gaps(df: DataFrame, fits: DataFrame, keys: Keys, time: str, level: str, xs: Sequence[str], permanent: Sequence[str] = ()) -> DataFrame:
    """Gap of the level to the fitted value with the coefficients of the last refit; with
    ``permanent`` columns also the gap to the fit at permanent values."""
    d = asof(df.withColumn("_at", F.col(time)), fits, keys, "_at", "origin", ["origin", "b", "v"]).drop("_at", "fact_time")
    star = F.col("b")[0] + reduce(lambda a, c: a + c, [F.col("b")[i + 1] * F.col(x) for i, x in enumerate(xs)])
    d = d.withColumn("star", star).withColumn("gap_log", F.col(level) - F.col("star"))
    if permanent:
        total = F.col("b")[0] + reduce(lambda a, c: a + c, [F.col("b")[i + 1] * F.col(x) for i, x in enumerate(permanent)])
        d = d.withColumn("gap_log_total", F.col(level) - total)
    return d


def expost_gaps(months: DataFrame, finals: DataFrame, entity: str, xs: Sequence[str], later: DataFrame) -> DataFrame:
    """Gap with later information: the final fit applied to each period's own regressors, mixed
    half and half with the gap under the norm published afterwards.

    ``months`` is (entity, ref_month, quarter, level, xs); ``later`` is (entity, quarter, gap_other)."""
    d = months.join(finals.select(entity, "alpha", "b"), entity).join(later, [entity, "quarter"])
    d = d.withColumn("gap_anchor", F.col("alpha") + long_run(xs) - F.col("level"))
    return d.withColumn("gap_expost", 0.5 * F.col("gap_anchor") + 0.5 * F.col("gap_other"))
