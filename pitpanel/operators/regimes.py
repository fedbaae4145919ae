"""Two-state regimes: filtered, predicted and smoothed probabilities, refits, transitions.

A series is folded as one array (bounded by the calendar); state 1 is the one with the larger
variance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.functions.columns import ordered
from pitpanel.operators.calendar import Keys

PARAMS = ("m0", "m1", "s0", "s1", "p00", "p11")


def _stack(columns: list[pd.Series], fill: float = 0.0) -> tuple[list[np.ndarray], np.ndarray]:
    """Ragged series as (rows, longest) arrays, one per column, and the rows' lengths."""
    sizes = np.array([len(v) for v in columns[0]])
    out = []
    for c in columns:
        a = np.full((len(sizes), sizes.max(initial=0)), fill)
        for i, v in enumerate(c):
            a[i, :len(v)] = v
        out.append(a)
    return out, sizes


def _cut(a: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return [a[i, :k] for i, k in enumerate(sizes)]


def _density(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return F.exp(-0.5 * z * z) / (sd * 2.5066282746310002)


def filter_pass(d0: np.ndarray, d1: np.ndarray, p00: np.ndarray, p11: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prior, predictive density and filtered probability of state 1 for stacks of series, from the states' densities.

    The start is the long-run share of state 1 under the first row's transitions."""
    prior, total, state = (np.empty_like(d0) for _ in range(3))
    f = (1 - p00[:, 0]) / (2 - p00[:, 0] - p11[:, 0]) if d0.shape[1] else None
    for t in range(d0.shape[1]):
        prior[:, t] = f * p11[:, t] + (1 - f) * (1 - p00[:, t])
        total[:, t] = prior[:, t] * d1[:, t] + (1 - prior[:, t]) * d0[:, t]
        f = state[:, t] = prior[:, t] * d1[:, t] / total[:, t]
    return prior, total, state


def _array_of(df: DataFrame, keys: Keys, row: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_r"))


def filtered(df: DataFrame, keys: Keys, time: str, ret: str) -> DataFrame:
    """Filtered and one-step-ahead probability of state 1 and the predictive density.

    Parameters are columns of the row, so transitions may change from row to row. A batch's series move on
    together, one observation at a time, and every state is written once."""

    @F.pandas_udf("prior array<double>, density array<double>, filtered array<double>")
    def run(d0: pd.Series, d1: pd.Series, p00: pd.Series, p11: pd.Series) -> pd.DataFrame:
        stacks, sizes = _stack([d0, d1, p00, p11], 0.5)
        with np.errstate(invalid="ignore", divide="ignore"):
            out = filter_pass(*stacks)
        return pd.DataFrame({n: pd.Series(_cut(a, sizes), dtype=object) for n, a in zip(("prior", "density", "filtered"), out)})

    c = {n: F.col(n).cast("double") for n in PARAMS}
    r = F.col(ret).cast("double")
    row = F.struct(F.col(time).alias("t"), _density(r, c["m0"], c["s0"]).alias("d0"), _density(r, c["m1"], c["s1"]).alias("d1"), c["p00"].alias("p00"), c["p11"].alias("p11"))
    g = _array_of(df.where(F.col(ret).isNotNull()), keys, row).select(*keys, F.col("_r.t").alias("_t"), run("_r.d0", "_r.d1", "_r.p00", "_r.p11").alias("_o"))
    z = F.explode(F.arrays_zip("_t", "_o.prior", "_o.density", "_o.filtered"))
    return g.select(*keys, z.alias("_z")).select(*keys, F.col("_z._t").alias(time), F.col("_z.prior").alias("p_predicted"), F.col("_z.density").alias("density"), F.col("_z.filtered").alias("p_filtered"))


def smoothed(f: DataFrame, keys: Keys, time: str) -> DataFrame:
    """Ex-post probability of state 1 from filtered and predicted ones (p00, p11 per row)."""

    @F.pandas_udf("array<double>")
    def run(state: pd.Series, ahead: pd.Series, p11: pd.Series) -> pd.Series:
        (s, nx, stay), sizes = _stack([state, ahead, p11], 0.5)
        for t in range(s.shape[1] - 2, -1, -1):
            inner = sizes > t + 1
            later = s[:, t + 1]
            back = s[:, t] * (stay[:, t] * later / nx[:, t + 1] + (1 - stay[:, t]) * (1 - later) / (1 - nx[:, t + 1]))
            s[:, t] = np.where(inner, back, s[:, t])
        return pd.Series(_cut(s, sizes), dtype=object)

    row = F.struct(F.col(time).alias("t"), F.col("p_filtered").alias("f"), F.col("p_predicted").alias("n"), F.col("p11").cast("double").alias("p"))
    g = _array_of(f, keys, row).select(*keys, F.col("_r.t").alias("_t"), run("_r.f", "_r.n", "_r.p").alias("_s"))
    return g.select(*keys, F.explode(F.arrays_zip("_t", "_s")).alias("_z")).select(*keys, F.col("_z._t").alias(time), F.col("_z._s").alias("p_smoothed"))


# spread of calm and stress in units of the series' own, and the chance to stay in each
STARTS = np.array([(0.6, 1.6, 0.9, 0.8), (0.4, 1.2, 0.95, 0.95), (0.8, 2.5, 0.97, 0.7), (0.9, 1.1, 0.5, 0.5)])


def fit_batch(series: list[np.ndarray], rounds: int = 200, tol: float = 1e-8) -> np.ndarray:
    """Two-state Gaussian parameters of many series at once by expectation-maximisation: a row of PARAMS and the
    log likelihood per series and start, in that order. A row that has settled leaves the batch."""
    (r,), sizes = _stack([pd.Series(series, dtype=object)])
    there = np.arange(r.shape[1]) < sizes[:, None]
    n = len(STARTS)
    r, there, start = np.repeat(r, n, 0), np.repeat(there, n, 0), np.tile(STARTS, (len(series), 1))
    size = there.sum(1)
    mean = (r * there).sum(1) / size
    sd = np.sqrt((((r - mean[:, None]) * there) ** 2).sum(1) / size)
    sd[sd == 0] = 1.0
    par = np.column_stack([mean, mean, start[:, 0] * sd, start[:, 1] * sd, start[:, 2:], np.full(len(r), -np.inf)])
    live = np.arange(len(r))
    for _ in range(rounds):
        x, on, (m0, m1, s0, s1, p00, p11, old) = r[live], there[live], (c[:, None] for c in par[live].T)
        dens = lambda m, s: np.where(on, np.exp(-0.5 * ((x - m) / s) ** 2) / (s * np.sqrt(2 * np.pi)) + 1e-300, 1.0)
        wide = np.ones_like(x)
        prior, total, f = filter_pass(dens(m0, s0), dens(m1, s1), p00 * wide, p11 * wide)
        like = np.where(on, np.log(total), 0.0).sum(1)
        g, stay, sizes_on = f.copy(), np.zeros((len(live), 4)), on.sum(1)
        for t in range(x.shape[1] - 2, -1, -1):
            inner = on[:, t + 1]
            up, down = g[:, t + 1] / np.maximum(prior[:, t + 1], 1e-300), (1 - g[:, t + 1]) / np.maximum(1 - prior[:, t + 1], 1e-300)
            pair = np.column_stack([(1 - f[:, t]) * p00[:, 0] * down, (1 - f[:, t]) * (1 - p00[:, 0]) * up, f[:, t] * (1 - p11[:, 0]) * down, f[:, t] * p11[:, 0] * up])
            stay += np.where(inner[:, None], pair, 0.0)
            g[:, t] = np.where(inner, pair[:, 2] + pair[:, 3], f[:, t])
        w1 = (g * on).sum(1)
        w0 = sizes_on - w1
        new0, new1 = ((1 - g) * on * x).sum(1) / np.maximum(w0, 1e-12), (g * on * x).sum(1) / np.maximum(w1, 1e-12)
        v0 = ((1 - g) * on * (x - new0[:, None]) ** 2).sum(1) / np.maximum(w0, 1e-12)
        v1 = (g * on * (x - new1[:, None]) ** 2).sum(1) / np.maximum(w1, 1e-12)
        least = 0.05 * sd[live]
        ratio = lambda a, b: np.clip(a / np.maximum(a + b, 1e-300), 1e-6, 1 - 1e-6)
        par[live] = np.column_stack([new0, new1, np.maximum(np.sqrt(v0), least), np.maximum(np.sqrt(v1), least), ratio(stay[:, 0], stay[:, 1]), ratio(stay[:, 3], stay[:, 2]), like])
        live = live[like - old[:, 0] >= tol]
        if not len(live):
            break
    swap = par[:, 2] > par[:, 3]                                     # state 1 is the wide one
    par[swap] = par[swap][:, [1, 0, 3, 2, 5, 4, 6]]
    return par


def refits(df: DataFrame, keys: Keys, time: str, ret: str, at_least: int, every: int) -> DataFrame:
    """Parameters estimated on the data up to every refit origin: keys, origin, m0..p11.

    A series is one array; an origin is a prefix of it, cut where it is fitted, so no history is shuffled a
    second time. All prefixes of a batch are fitted together from several starts; the likeliest is kept."""

    @F.pandas_udf(",".join(f"{p} array<double>" for p in (*PARAMS, "likelihood")))
    def fit(prefix: pd.Series) -> pd.DataFrame:
        par = fit_batch([np.asarray(v, float) for v in prefix]) if len(prefix) else np.zeros((0, 7))
        return pd.DataFrame([list(p.T) for p in par.reshape(-1, len(STARTS), 7)], columns=[*PARAMS, "likelihood"])

    seen = df.where(F.col(ret).isNotNull())
    g = _array_of(seen, keys, F.struct(F.col(time).alias("t"), F.col(ret).cast("double").alias("v"))).where(F.size("_r") >= at_least)
    g = g.select(*keys, "_r", F.explode(F.sequence(F.lit(at_least), F.size("_r"), F.lit(every))).alias("_n"))
    g = g.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys, "_n")          # few bytes, much work
    d = g.select(*keys, F.element_at("_r.t", F.col("_n")).alias("origin"), fit(F.slice("_r.v", F.lit(1), F.col("_n"))).alias("_f"))
    best = (F.array_position("_f.likelihood", F.array_max("_f.likelihood")) - 1).cast("int")
    return d.select(*keys, "origin", *[F.get(F.col(f"_f.{p}"), best).alias(p) for p in PARAMS])


def realtime(df: DataFrame, params: DataFrame, keys: Keys, time: str, ret: str) -> DataFrame:
    """Filtered probability at each date from the last refit's parameters, filtering the whole
    history up to that date (a refit changes the past of the filter, not its own past readings)."""
    spans = params.withColumn("_until", F.lead("origin").over(ordered(keys, "origin")))
    j = df.where(F.col(ret).isNotNull()).select(*keys, time, ret).join(spans, list(keys))
    j = j.where(F.col("_until").isNull() | (F.col(time) < F.col("_until")))
    f = filtered(j, [*keys, "origin"], time, ret)
    return f.where(F.col(time) >= F.col("origin"))


def transition_forecast(df: DataFrame, keys: Keys, time: str, state: str, horizons: Sequence[int]) -> DataFrame:
    """Transition shares of a two-state label, steady state, durations, and the probability of
    state 1 ahead of the last observation: pi + (p - pi) (p00 + p11 - 1)^h."""
    d = df.where(F.col(state).isNotNull()).withColumn("_prev", F.lag(state).over(ordered(keys, time)))
    cnt = lambda a, b: F.count_if((F.col("_prev") == a) & (F.col(state) == b))
    g = d.groupBy(*keys).agg(cnt(0, 0).alias("n00"), cnt(0, 1).alias("n01"), cnt(1, 0).alias("n10"), cnt(1, 1).alias("n11"),
                             F.max_by(state, time).alias("now"))
    g = g.where("n00 + n01 > 0 and n10 + n11 > 0 and n01 + n10 > 0")
    g = g.withColumns({"p00": F.col("n00") / (F.col("n00") + F.col("n01")), "p11": F.col("n11") / (F.col("n10") + F.col("n11"))})
    g = g.withColumns({"steady": (1 - F.col("p00")) / (2 - F.col("p00") - F.col("p11")),
                       "duration_0": F.when(F.col("p00") < 1, 1 / (1 - F.col("p00"))), "duration_1": F.when(F.col("p11") < 1, 1 / (1 - F.col("p11")))})
    root = F.col("p00") + F.col("p11") - 1
    return g.withColumns({f"p_{h}": F.col("steady") + (F.col("now") - F.col("steady")) * F.pow(root, float(h)) for h in horizons})


def by_state(df: DataFrame, keys: Keys, state: str, value: str) -> DataFrame:
    known = df.where(F.col(state).isNotNull() & F.col(value).isNotNull())
    return known.groupBy(*keys, state).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
                                           F.min(value).alias("min"), F.max(value).alias("max"))
