"""What moved a series: direction tests, reaction functions, shocks, projections, predictive tests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.functions.columns import ordered, ratio
from pitpanel.functions.tails import p_normal_two
from pitpanel.operators.calendar import Keys
from pitpanel.operators.features import lag_matrix
from pitpanel.operators.forecast import targets
from pitpanel.operators.regression import contributions, identified, ols, ols_hac, with_residuals


def _coef(fit: DataFrame, by: Keys, at: int, name: str) -> DataFrame:
    return fit.select(*by, F.col("beta")[at].alias(f"{name}_coef"), F.col("t")[at].alias(f"{name}_t"))


def direction_tests(df: DataFrame, keys: Keys, time: str, move: str, flow: str, driver: str, lags: int) -> DataFrame:
    """Does the flow predict the next move, and the move the next flow? Both 5% tests and a verdict."""
    w = ordered(keys, time)
    d = df.withColumns({"_next": F.lead(move).over(w), "_prev": F.lag(move).over(w)})
    lead = _coef(ols_hac(d, keys, time, "_next", [flow, driver], lags), keys, 1, "flow_to_move")
    rev = _coef(ols_hac(d, keys, time, flow, ["_prev", driver], lags), keys, 1, "move_to_flow")
    j = lead.join(rev, list(keys)).withColumns({f"{n}_p": p_normal_two(f"{n}_t") for n in ("flow_to_move", "move_to_flow")})
    two = (F.col("flow_to_move_p") < 0.05) & (F.col("move_to_flow_p") < 0.05)
    return j.withColumn("reading", F.when(two, "two-way").otherwise("one-way or none"))


def reaction(df: DataFrame, keys: Keys, time: str, move: str, xs: Sequence[str], flow: str, policy: str, lags: int) -> DataFrame:
    """Reaction of the policy to the move and the flow, the policy's naive coefficient in the
    move's own regression, and the effect of one policy unit priced at minus the flow's coefficient."""
    react = ols_hac(df, keys, time, policy, [move, flow], lags)
    naive = ols_hac(df, keys, time, move, [*xs, policy], lags)
    price = ols(df, keys, move, xs).select(*keys, (-F.col("beta")[1 + list(xs).index(flow)]).alias("price"))
    r = react.select(*keys, "n", F.col("beta")[1].alias("on_move"), F.col("t")[1].alias("on_move_t"), F.col("beta")[2].alias("on_flow"),
                     F.col("t")[2].alias("on_flow_t"), F.col("r2").alias("reaction_r2"))
    k = len(xs) + 1
    return r.join(naive.select(*keys, F.col("beta")[k].alias("naive_coef"), F.col("t")[k].alias("naive_t")), list(keys)).join(price, list(keys))


def absorbed_pressure(df: DataFrame, priced: DataFrame, keys: Keys, time: str, move: str, policy: str, windows: Sequence[int]) -> DataFrame:
    """Over the latest months: policy total, its effect, the move without it, and the share absorbed."""
    d = df.join(priced.select(*keys, "price"), list(keys))
    d = d.withColumns({"_effect": F.col("price") * F.col(policy),
                       "_back": F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(time).desc()))})
    d = d.withColumn("months", F.explode(F.array(*[F.lit(w) for w in windows]))).where(F.col("_back") <= F.col("months"))
    g = d.groupBy(*keys, "months").agg(F.min(time).alias("start"), F.max(time).alias("end"), (-F.sum(policy)).alias("net_sold"),
                                       F.sum(move).alias("actual"), (-F.sum("_effect")).alias("absorbed"),
                                       F.sum(F.col(move) - F.col("_effect")).alias("pressure"))
    share = F.when((F.col("pressure") > 0) & (F.col("absorbed") > 0), F.col("absorbed") / F.col("pressure"))
    return g.withColumn("absorbed_share", share)


def shock(df: DataFrame, keys: Keys, time: str, flow: str, before: Sequence[str], lagged: Sequence[str], lags: int) -> DataFrame:
    """Residual of the flow on same-month ``before`` variables and lags of all (column shock)."""
    d = lag_matrix(df, keys, time, lagged, lags)
    xs = [*before, *[f"{c}_l{k}" for c in lagged for k in range(1, lags + 1)]]
    fit = ols(d, keys, flow, xs)
    s = with_residuals(d, fit, keys, flow, xs).select(*keys, time, F.col("resid").alias("shock"))
    return df.join(s, [*keys, time], "left")


def local_projections(df: DataFrame, keys: Keys, time: str, move: str, shock_col: str, contemporaneous: Sequence[str],
                      lagged: Sequence[str], lags: int, horizons: int) -> DataFrame:
    """Cumulative move over t..t+h on the shock, h = 0..horizons, HAC with h + 1 lags.

    The horizon is a key: all projections are one plan."""
    d = lag_matrix(df, keys, time, lagged, lags)
    xs = [shock_col, *contemporaneous, *[f"{c}_l{k}" for c in lagged for k in range(1, lags + 1)]]
    w = ordered(keys, time)
    cums = [reduce(lambda a, b: a + b, [F.lead(move, j).over(w) if j else F.col(move) for j in range(h + 1)]) for h in range(horizons + 1)]
    d = d.withColumns({f"_y{h}": c for h, c in enumerate(cums)})
    cells = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"_y{h}").alias("_y")) for h in range(horizons + 1)])
    long = d.select(*keys, time, *xs, F.inline(cells))
    fit = ols_hac(long, [*keys, "h"], time, "_y", xs, F.col("h") + 1, max_lag=horizons + 1)
    return fit.select(*keys, "h", "n", F.col("beta")[1].alias("beta"), F.col("se")[1].alias("se"), F.col("t")[1].alias("t"))


def impact_bounds(ordering_a: DataFrame, keys: Keys) -> DataFrame:
    """Impact of the shock between zero (the move reacts first) and the first ordering's estimate."""
    a = ordering_a.where("h = 0").select(*keys, "beta")
    zero = F.lit(0.0)
    return a.select(*keys, F.least(zero, "beta").alias("impact_low"), F.greatest(zero, "beta").alias("impact_high"))


def premium_regression(df: DataFrame, keys: Keys, time: str, level: str, premium: str, h: int, lags: int) -> DataFrame:
    """Annualised h-month change on the premium, tested against 0 and against 1."""
    d = targets(df, keys, time, level, [premium], [h]).withColumn("_dep", F.col("y") * 1200 / h)
    fit = ols_hac(d, keys, time, "_dep", [premium], lags)
    b, se = F.col("beta")[1], F.col("se")[1]
    return fit.select(*keys, "n", b.alias("slope"), se.alias("se"), (b / se).alias("t_vs_0"), ((b - 1) / se).alias("t_vs_1"), "r2")


def spread_tests(df: DataFrame, keys: Keys, time: str, level: str, spread: str, driver: str, lags: int) -> DataFrame:
    """Next month's move on the spread, alone and given next month's driver move."""
    w = ordered(keys, time)
    step = lambda c: (F.lead(c).over(w) - F.col(c)) * 100
    d = df.withColumns({"_next": step(level), "_drv": step(driver)}).dropna(subset=["_next", "_drv", spread])
    one = ols_hac(d, keys, time, "_next", [spread], lags)
    two = ols_hac(d, keys, time, "_next", [spread, "_drv"], lags)
    a = one.select(*keys, "n", F.col("beta")[1].alias("coef"), F.col("t")[1].alias("t"))
    return a.join(two.select(*keys, F.col("beta")[1].alias("coef_given_driver"), F.col("t")[1].alias("t_given_driver")), list(keys))


def latest_against_history(df: DataFrame, keys: Keys, time: str, spot: str, premium: str, months: int) -> DataFrame:
    """Implied forward from the latest premium, and where the latest premium stands in its history."""
    known = df.where(F.col(premium).isNotNull())
    g = known.groupBy(*keys).agg(F.max(time).alias("month"), F.max_by(premium, time).alias("premium"),
                                 F.avg(premium).alias("mean"), F.stddev_samp(premium).alias("sd"))
    s = df.where(F.col(spot).isNotNull()).groupBy(*keys).agg(F.max_by(spot, time).alias("spot"))
    rank = known.join(g.select(*keys, F.col("premium").alias("_last")), list(keys)).groupBy(*keys).agg(
        (F.avg((F.col(premium) <= F.col("_last")).cast("double")) * 100).alias("percentile"))
    d = g.join(s, list(keys)).join(rank, list(keys))
    return d.withColumn("forward", F.col("spot") * (1 + F.col("premium") * months / 1200))


def elasticity(df: DataFrame, keys: Keys, time: str, quantity: str, price: str, lags: int) -> DataFrame:
    """Log-log slope in first differences and in levels, on common dates; one row per form."""
    w = ordered(keys, time)
    d = df.select(*keys, time, F.log(quantity).alias("lq"), F.log(price).alias("lp"))
    d = d.withColumns({"dq": F.col("lq") - F.lag("lq").over(w), "dp": F.col("lp") - F.lag("lp").over(w)}).dropna()
    forms = F.array(F.struct(F.lit("differences").alias("form"), F.col("dq").alias("y"), F.col("dp").alias("x")),
                    F.struct(F.lit("levels").alias("form"), F.col("lq").alias("y"), F.col("lp").alias("x")))
    fit = ols_hac(d.select(*keys, time, F.inline(forms)), [*keys, "form"], time, "y", ["x"], lags)
    return fit.select(*keys, "form", "n", F.col("beta")[1].alias("slope"), F.col("se")[1].alias("se"), "r2")


def error_correction(df: DataFrame, keys: Keys, time: str, level: str, gap: str, drivers: Sequence[str], horizons: Sequence[int],
                     lags: int, prob: str | None = None) -> DataFrame:
    """h-month change on the gap and the drivers' changes; adjustment speed and half-life.

    With ``prob`` the gap is split by a state probability and both speeds are returned. The speed of
    a state that has no weight in any row, or of a gap that is always zero, is NULL."""
    w = ordered(keys, time)
    d = df.withColumns({f"_d_{c}": F.col(c) - F.lag(c).over(w) for c in drivers})
    split = ["_calm", "_stress"] if prob else [gap]
    if prob:
        d = d.withColumns({"_calm": F.col(gap) * (1 - F.col(prob)), "_stress": F.col(gap) * F.col(prob)})
    xs = [*split, *[f"_d_{c}" for c in drivers]]
    t = targets(d, keys, time, level, xs, horizons)
    fit = ols_hac(t, [*keys, "h"], time, "y", xs, F.col("h"), max_lag=max(horizons))
    half = lambda b: F.when((b < 0) & (b > -1), ratio(F.log(F.lit(0.5)), F.log(1 + b)))
    b = [F.when(identified(i), F.col("beta")[i]) for i in range(3)]
    cols = [b[1].alias("speed"), F.col("t")[1].alias("speed_t"), half(b[1]).alias("half_life"), "r2"]
    if prob:
        cols += [b[2].alias("speed_stress"), F.col("t")[2].alias("speed_stress_t")]
    return fit.select(*keys, "h", "n", *cols)
