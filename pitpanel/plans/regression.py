"""Regression and inference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions.columns import r6
from pitpanel.operators import features as ft
from pitpanel.operators import flows as fl
from pitpanel.operators import regression as rg
from pitpanel.plans.calendar import E
from pitpanel.plans.features import FLOW, RGRID, flow_table, rgrid
from pitpanel.plans.forecast import comp_table, enough
from pitpanel.plans.registry import query
from pitpanel.plans.sql import COMP, GRID, NM, REGS, hac_slope, mean_test_cte, rnd, shown, with_
from pitpanel.session import settled

BASE = [NM, GRID, REGS, RGRID, FLOW]
XS = ["qty", "disc", "tax", "d_v"]


def flow_once(spark, sf):
    """The flow frame, written once: the fits below read it several times."""
    return settled(flow_table(spark, sf))


def comp_once(spark, sf):
    return settled(comp_table(spark, sf))


def out(d, *cols, keep=("entity",)):
    return d.select(*keep, *[r6(c).alias(c) for c in cols])


@query("ols_one_regressor", "G1", with_(*BASE) + f"""
, f AS (SELECT entity, count(*) AS n, regr_slope(move, d_v) AS b, regr_intercept(move, d_v) AS a, regr_r2(move, d_v) AS r2,
   sqrt((regr_syy(move, d_v) - regr_slope(move, d_v) ** 2 * regr_sxx(move, d_v)) / (count(*) - 2) / regr_sxx(move, d_v)) AS se FROM flow GROUP BY 1 HAVING count(*) > 2)
SELECT entity, n, {rnd('a', 'const')}, {rnd('b', 'coef')}, {rnd('se', 'se')}, {rnd('b / se', 't')}, {rnd('r2', 'r2')} FROM f""")
def _(spark, sf):
    f = rg.ols(flow_table(spark, sf), E, "move", ["d_v"])
    b = lambda c, i: F.col(c)[i]
    d = f.select("entity", "n", b("beta", 0).alias("const"), b("beta", 1).alias("coef"), b("se", 1).alias("se"), b("t", 1).alias("t"), "r2")
    return out(d, "const", "coef", "se", "t", "r2", keep=("entity", "n"))


@query("ols_many_regressors", "G1")
def _(spark, sf):
    f = rg.ols(flow_table(spark, sf), E, "move", XS)
    return out(rg.terms(f, E, ["const", *XS]), "coef", "se", "t", "p", "r2", keep=("entity", "n", "term"))


@query("hac_one_regressor", "G2", with_(*BASE, hac_slope("hs", "flow", "move", "d_v", 3)) + f"""
SELECT entity, n, {rnd('const', 'const')}, {rnd('slope', 'coef')}, {rnd('se', 'se')}, {rnd('slope / se', 't')}, {rnd('r2', 'r2')} FROM hs""")
def _(spark, sf):
    f = rg.ols_hac(flow_once(spark, sf), E, "ref_month", "move", ["d_v"], 3)
    d = f.select("entity", "n", F.col("beta")[0].alias("const"), F.col("beta")[1].alias("coef"), F.col("se")[1].alias("se"), F.col("t")[1].alias("t"), "r2")
    return out(d, "const", "coef", "se", "t", "r2", keep=("entity", "n"))


@query("hac_many_regressors", "G2")
def _(spark, sf):
    f = rg.ols_hac(flow_once(spark, sf), E, "ref_month", "move", XS, 3)
    return out(rg.terms(f, E, ["const", *XS]), "coef", "se", "t", "p", "r2", keep=("entity", "n", "term"))


@query("clustered_pooled_slope", "G3", with_(*BASE) + f"""
, d AS (SELECT entity, move - avg(move) OVER (PARTITION BY entity) AS y, d_v - avg(d_v) OVER (PARTITION BY entity) AS x FROM flow),
 f AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n, count(DISTINCT entity) AS g FROM d),
 s AS (SELECT entity, sum(x * (y - b * x)) AS s FROM d CROSS JOIN f GROUP BY 1),
 v AS (SELECT sqrt(sum(s * s)) AS q FROM s)
SELECT n, g AS clusters, {rnd('b', 'coef')}, {rnd('q / sxx * sqrt(CAST(g AS DOUBLE) / (g - 1) * (n - 1) / (n - 1))', 'se')} FROM f CROSS JOIN v""")
def _(spark, sf):
    d = ft.demean(flow_once(spark, sf), E, ["move", "d_v"], 1)
    f = rg.ols_clustered(d, [], "entity", "move_dm", ["d_v_dm"], intercept=False)
    return f.select("n", "clusters", r6(F.col("beta")[0]).alias("coef"), r6(F.col("se")[0]).alias("se"))


@query("clustered_pooled_many", "G3")
def _(spark, sf):
    d = ft.demean(flow_once(spark, sf), E, ["move", *XS], 10)
    f = rg.ols_clustered(d, [], "entity", "move_dm", [f"{x}_dm" for x in XS], intercept=False)
    return out(rg.terms(f, [], XS, keep=("n", "clusters")), "coef", "se", "t", "p", keep=("n", "clusters", "term"))


@query("mean_with_long_run_variance", "G4", with_(*BASE, mean_test_cte("mt", "flow", "move", "entity", "3")) + f"""
SELECT entity, n, {rnd('mean', 'mean')}, {rnd('(mean / t) ** 2', 'var_of_mean')}, {rnd('t', 't')} FROM mt""")
def _(spark, sf):
    return out(rg.mean_test(flow_table(spark, sf), E, "ref_month", "move", 3), "mean", "var_of_mean", "t", keep=("entity", "n"))


@query("contributions", "G5", with_(*BASE) + f"""
, f AS (SELECT entity, regr_slope(move, d_v) AS b, regr_intercept(move, d_v) AS a FROM flow GROUP BY 1 HAVING count(*) > 2)
SELECT entity, ref_month, {rnd('move', 'move')}, {rnd('b * d_v', 'from_d_v')}, {rnd('a', 'drift')}, {rnd('move - a - b * d_v', 'residual')} FROM flow JOIN f USING (entity)""")
def _(spark, sf):
    t = flow_once(spark, sf)
    d = rg.contributions(t, rg.ols(t, E, "move", ["d_v"]), E, "move", ["d_v"])
    return out(d, "move", "from_d_v", "drift", "residual", keep=("entity", "ref_month"))


@query("contributions_many", "G5")
def _(spark, sf):
    t = flow_once(spark, sf)
    d = rg.contributions(t, rg.ols(t, E, "move", XS), E, "move", XS)
    return out(d, "move", *[f"from_{x}" for x in XS], "drift", "residual", keep=("entity", "ref_month"))


@query("window_attribution", "G6", with_(*BASE) + f"""
, b AS (SELECT flow.*, m AS months, row_number() OVER (PARTITION BY entity, m ORDER BY ref_month DESC) AS back FROM flow CROSS JOIN (VALUES (3), (12)) w(m)),
 f AS (SELECT entity, months, 'full' AS fit, regr_slope(move, d_v) AS b, regr_intercept(move, d_v) AS a FROM b GROUP BY 1, 2 HAVING count(*) > 2
   UNION ALL SELECT entity, months, 'outside', regr_slope(move, d_v), regr_intercept(move, d_v) FROM b WHERE back > months GROUP BY 1, 2 HAVING count(*) > 2)
SELECT b.entity, b.months, fit, min(ref_month) AS start, max(ref_month) AS "end", {rnd('sum(move)', 'actual')}, {rnd('sum(a)', 'drift')}, {rnd('sum(f.b * d_v)', 'from_d_v')},
 {rnd('sum(move) - sum(a) - sum(f.b * d_v)', 'residual')} FROM b JOIN f ON f.entity = b.entity AND f.months = b.months WHERE back <= b.months GROUP BY 1, 2, 3""")
def _(spark, sf):
    d = rg.window_attribution(flow_once(spark, sf), E, "ref_month", "move", ["d_v"], [3, 12])
    return out(d, "actual", "drift", "from_d_v", "residual", keep=("entity", "months", "fit", "start", "end"))


@query("lead_lag_direction", "G7")
def _(spark, sf):
    d = fl.direction_tests(flow_once(spark, sf), E, "ref_month", "move", "qty", "d_v", 3)
    return out(d, *[f"{n}_{s}" for n in ("flow_to_move", "move_to_flow") for s in ("coef", "t", "p")], keep=("entity", "reading"))


def reactions(t):
    return fl.reaction(t, E, "ref_month", "move", ["qty", "disc", "d_v"], "qty", "tax", 3)


@query("policy_reaction", "G8")
def _(spark, sf):
    return out(reactions(flow_once(spark, sf)), "on_move", "on_move_t", "on_flow", "on_flow_t", "reaction_r2", "naive_coef", "naive_t", "price", keep=("entity", "n"))


@query("absorbed_pressure", "G8")
def _(spark, sf):
    t = flow_once(spark, sf)
    d = fl.absorbed_pressure(t, reactions(t), E, "ref_month", "move", "tax", [3, 12])
    return out(d, "net_sold", "actual", "absorbed", "pressure", "absorbed_share", keep=("entity", "months", "start", "end"))


LAGGED = ["move", "qty", "disc"]


def shocked(spark, sf, before):
    return fl.shock(flow_once(spark, sf), E, "ref_month", "qty", before, LAGGED, 2)


@query("flow_shock", "G9")
def _(spark, sf):
    return out(shocked(spark, sf, ["disc", "tax"]), "shock", keep=("entity", "ref_month"))


@query("local_projections", "G10")
def _(spark, sf):
    d = fl.local_projections(settled(shocked(spark, sf, ["disc", "tax"])), E, "ref_month", "move", "shock", ["disc", "tax"], LAGGED, 2, 3)
    return out(d, "beta", "se", "t", keep=("entity", "h", "n"))


@query("two_stage_least_squares", "G11")
def _(spark, sf):
    d = rg.two_stage(flow_once(spark, sf), E, "ref_month", "move", "qty", ["disc", "tax"], ["d_v"], 3)
    return out(d, "beta", "se", "t", "first_stage_f", "hansen_j", "j_p", "first_disc", "first_tax", keep=("entity", "n"))


@query("impact_bounds", "G12")
def _(spark, sf):
    a = fl.local_projections(settled(shocked(spark, sf, ["disc", "tax"])), E, "ref_month", "move", "shock", ["disc", "tax"], LAGGED, 2, 0)
    return out(fl.impact_bounds(a, E), "impact_low", "impact_high")


PREM = """pr AS (SELECT entity, ref_month, level, v / n AS prem FROM comp), pt AS (SELECT c.entity, c.ref_month, c.prem, (d.level - c.level) * 1200 / 3 AS dep FROM pr c
  LEFT JOIN pr d ON d.entity = c.entity AND d.ref_month = CAST(c.ref_month + INTERVAL 3 MONTH AS DATE))"""


def premium(spark, sf):
    return comp_once(spark, sf).withColumn("prem", F.col("v") / F.col("n"))


@query("premium_regression", "G13", with_(NM, GRID, COMP, PREM, hac_slope("hs", "pt", "dep", "prem", 6)) + f"""
SELECT entity, n, {rnd('slope', 'slope')}, {rnd('se', 'se')}, {rnd('slope / se', 't_vs_0')}, {rnd('(slope - 1) / se', 't_vs_1')}, {rnd('r2', 'r2')} FROM hs""")
def _(spark, sf):
    return out(fl.premium_regression(premium(spark, sf), E, "ref_month", "level", "prem", 3, 6), "slope", "se", "t_vs_0", "t_vs_1", "r2", keep=("entity", "n"))


def removed(name: str, src: str, cols: str, control: str, keep: str = "") -> str:
    """CTE with each column's residual on a constant and the control (same names)."""
    res = ", ".join(f"{c} - regr_intercept({c}, {control}) OVER e - regr_slope({c}, {control}) OVER e * {control} AS {c}" for c in cols.split())
    return f"{name} AS (SELECT entity, ref_month, {res}{keep} FROM {src} WINDOW e AS (PARTITION BY entity))"


SPREAD = """sp AS (SELECT * FROM (SELECT entity, ref_month, v / n AS prem, (lead(level) OVER o - level) * 100 AS nxt, (lead(ln(v)) OVER o - ln(v)) * 100 AS drv FROM comp
  WINDOW o AS (PARTITION BY entity ORDER BY ref_month)) WHERE prem IS NOT NULL AND nxt IS NOT NULL AND drv IS NOT NULL)"""


@query("spread_predictive_test", "G14", with_(NM, GRID, COMP, SPREAD, hac_slope("a", "sp", "nxt", "prem", 6), removed("rs", "sp", "nxt prem", "drv"), hac_slope("b", "rs", "nxt", "prem", 6)) + f"""
SELECT a.entity, a.n, {shown('a.slope', 'coef', 'a.n')}, {shown('a.slope / a.se', 't', 'a.n')}, {shown('b.slope', 'coef_given_driver', 'a.n')}, {shown('b.slope / b.se', 't_given_driver', 'a.n')} FROM a JOIN b ON b.entity = a.entity WHERE a.n > 3""")
def _(spark, sf):
    d = premium(spark, sf).withColumn("lv", F.log("v"))
    d = enough(fl.spread_tests(d, E, "ref_month", "level", "prem", "lv", 6), "n", "coef", "t", "coef_given_driver", "t_given_driver")
    return out(d, "coef", "t", "coef_given_driver", "t_given_driver", keep=("entity", "n"))


@query("implied_forward", "G15", with_(NM, GRID, COMP) + f"""
, k AS (SELECT entity, ref_month, v / n AS prem FROM comp WHERE v IS NOT NULL), l AS (SELECT entity, max(ref_month) AS month, max_by(prem, ref_month) AS last FROM k GROUP BY 1),
 s AS (SELECT entity, max_by(p, ref_month) AS spot FROM comp WHERE p IS NOT NULL GROUP BY 1)
SELECT k.entity, month, {rnd('last', 'premium')}, {rnd('spot', 'spot')}, {rnd('spot * (1 + last * 3 / 1200)', 'forward')}, {rnd('avg(prem)', 'mean')}, {rnd('stddev_samp(prem)', 'sd')},
 {rnd('avg(CASE WHEN prem <= last THEN 1.0 ELSE 0.0 END) * 100', 'percentile')} FROM k JOIN l ON l.entity = k.entity JOIN s ON s.entity = k.entity GROUP BY k.entity, month, last, spot""")
def _(spark, sf):
    d = fl.latest_against_history(premium(spark, sf), E, "ref_month", "p", "prem", 3)
    return out(d, "premium", "spot", "forward", "mean", "sd", "percentile", keep=("entity", "month"))


ELAS = """el AS (SELECT * FROM (SELECT entity, ref_month, ln(qty) AS lq, ln(v) AS lp, ln(qty) - lag(ln(qty)) OVER o AS dq, ln(v) - lag(ln(v)) OVER o AS dp FROM rgrid
  WINDOW o AS (PARTITION BY entity ORDER BY ref_month)) WHERE lq IS NOT NULL AND lp IS NOT NULL AND dq IS NOT NULL AND dp IS NOT NULL)"""


@query("price_elasticity", "G16", with_(NM, GRID, REGS, RGRID, ELAS, hac_slope("d", "el", "dq", "dp", 4), hac_slope("l", "el", "lq", "lp", 4)) + f"""
SELECT entity, 'differences' AS form, n, {rnd('slope', 'slope')}, {rnd('se', 'se')}, {rnd('r2', 'r2')} FROM d
UNION ALL SELECT entity, 'levels', n, {rnd('slope', 'slope')}, {rnd('se', 'se')}, {rnd('r2', 'r2')} FROM l""")
def _(spark, sf):
    return out(fl.elasticity(rgrid(spark, sf), E, "ref_month", "qty", "v", 4), "slope", "se", "r2", keep=("entity", "form", "n"))


ECM = [NM, GRID, COMP] + [x for h in (1, 3) for x in (
    f"""e{h} AS (SELECT * FROM (SELECT c.entity, c.ref_month, c.ect, d.level - c.level AS y, ln(c.v) - lag(ln(c.v)) OVER (PARTITION BY c.entity ORDER BY c.ref_month) AS dv FROM comp c
  LEFT JOIN comp d ON d.entity = c.entity AND d.ref_month = CAST(c.ref_month + INTERVAL {h} MONTH AS DATE)) WHERE ect IS NOT NULL AND y IS NOT NULL AND dv IS NOT NULL)""",
    removed(f"r{h}", f"e{h}", "y ect", "dv"), hac_slope(f"s{h}", f"r{h}", "y", "ect", h),
    f"t{h} AS (SELECT entity, regr_syy(y, y) AS syy FROM e{h} GROUP BY 1)", f"u{h} AS (SELECT entity, regr_syy(y, ect) AS syy FROM r{h} GROUP BY 1)")]
ECM_ROW = "SELECT s{h}.entity, {h} AS h, n, " + ", ".join([shown("slope", "speed"), shown("slope / se", "speed_t"),
    shown("CASE WHEN slope < 0 AND slope > -1 THEN ln(0.5::DOUBLE) / ln(1 + slope) END", "half_life"), shown("1 - u{h}.syy * (1 - r2) / t{h}.syy", "r2")]) + \
    " FROM s{h} JOIN t{h} ON t{h}.entity = s{h}.entity JOIN u{h} ON u{h}.entity = s{h}.entity WHERE n > 3"


@query("error_correction", "G17", with_(*ECM) + " UNION ALL ".join(ECM_ROW.replace("{h}", str(h)) for h in (1, 3)))
def _(spark, sf):
    d = fl.error_correction(comp_once(spark, sf).withColumn("lv", F.log("v")), E, "ref_month", "level", "ect", ["lv"], [1, 3], 3)
    d = enough(d, "n", "speed", "speed_t", "half_life", "r2")
    return out(d, "speed", "speed_t", "half_life", "r2", keep=("entity", "h", "n"))


@query("error_correction_by_state", "G17")
def _(spark, sf):
    c = comp_once(spark, sf).withColumns({"lv": F.log("v"), "prob": 1 / (1 + F.exp(-(F.col("n") - 7.5) / 3))})
    d = fl.error_correction(c, E, "ref_month", "level", "ect", ["lv"], [1, 3], 3, "prob")
    return out(d, "speed", "speed_t", "speed_stress", "speed_stress_t", "r2", keep=("entity", "h", "n"))
