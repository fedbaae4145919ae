"""Nonlinear variant, cointegration and regime queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions.columns import ordered, past, r6, whole
from pitpanel.functions.tails import p_normal_upper
from pitpanel.operators import anchor as an
from pitpanel.operators import cointegration as co
from pitpanel.operators import forecast as fc
from pitpanel.operators import nonlinear as nl
from pitpanel.operators import regimes as rm
from pitpanel.operators.features import balanced_panel, two_factor_state
from pitpanel.operators.regression import mean_test
from pitpanel.plans.anchor import ONE_SET, POOLED, QUARTERS, XS, quarter_panel
from pitpanel.plans.calendar import E, grid
from pitpanel.plans.forecast import HORIZONS, MIN_TRAIN, comp_table, enough, p_values
from pitpanel.plans.gaps import panel_once
from pitpanel.plans.inputs import daily_events, table
from pitpanel.plans.registry import query
from pitpanel.plans.sql import COMP, DAILY, GRID, NM, mean_test_cte, ols_cte, rnd, shown, with_
from pitpanel.session import settled

QUANTILES = [round(0.15 + 0.05 * i, 2) for i in range(15)]
RATIOS = [1e-5, 1e-4, 1e-3, 1e-2, 1e-1]


def out(d, *cols, keep=("entity", "h", "ref_month")):
    return d.select(*keep, *[r6(c).alias(c) for c in cols])


def origin_table(spark, sf, horizons=HORIZONS):
    return nl.origins(comp_table(spark, sf), E, "ref_month", "level", "ect", list(horizons), MIN_TRAIN)


@query("threshold_forecasts", "H9")
def _(spark, sf):
    d = nl.threshold_forecasts(origin_table(spark, sf), ["entity", "h"], "ref_month", QUANTILES)
    return out(d, "f_drift", "f_model", "slope", "slope_outside", "c")


@query("cubic_forecasts", "H10")
def _(spark, sf):
    d = nl.cubic_forecasts(comp_table(spark, sf), E, "ref_month", "level", "ect", HORIZONS, MIN_TRAIN)
    return out(d, "f_drift", "f_model", "slope", "cubic")


@query("drifting_coefficient_forecasts", "H11")
def _(spark, sf):
    d = nl.drifting_forecasts(origin_table(spark, sf), ["entity", "h"], "ref_month", RATIOS)
    return out(d, "f_drift", "f_model", "slope", "q")


@query("variant_score_table", "H12")
def _(spark, sf):
    c = settled(comp_table(spark, sf))
    f = nl.variant_forecasts(c, E, "ref_month", "level", "ect", HORIZONS, MIN_TRAIN, QUANTILES, RATIOS, 36)
    d = fc.score_card(f, ["entity", "variant", "h"], "ref_month")
    return out(d, "rmse_drift", "rmse_model", "rmse_ratio", "oos_r2", keep=("entity", "variant", "h", "n_oos"))


# ---- unit roots and cointegration
UR = """ur AS (SELECT * FROM (SELECT entity, ref_month, ect - lag(ect) OVER o AS chg, lag(ect) OVER o AS lev FROM (SELECT * FROM comp WHERE ect IS NOT NULL) WINDOW o AS (PARTITION BY entity ORDER BY ref_month)) WHERE chg IS NOT NULL)"""


@query("unit_root_no_lags", "I1", with_(NM, GRID, COMP, UR) + f"""
, f AS (SELECT entity, count(*) AS n, sum(lev * chg) / sum(lev * lev) AS b, sum(lev * lev) AS sxx, sum(chg * chg) - sum(lev * chg) ** 2 / sum(lev * lev) AS ssr FROM ur GROUP BY 1)
SELECT entity, n, {rnd('b / sqrt(ssr / (n - 1) / sxx)', 'stat')} FROM f""")
def _(spark, sf):
    return out(co.unit_root(comp_table(spark, sf), E, "ref_month", "ect", 0), "stat", keep=("entity", "n"))


@query("unit_root_lagged", "I1")
def _(spark, sf):
    return out(co.unit_root(comp_table(spark, sf), E, "ref_month", "ect", 2, intercept=True), "stat", keep=("entity", "n"))


def quarters_once(spark, sf):
    return settled(quarter_panel(panel_once(spark, sf)))


@query("residual_cointegration", "I2")
def _(spark, sf):
    d = co.residual_cointegration(quarters_once(spark, sf), E, "quarter", "lp", ["lv", "disc"])
    return out(d, "stat", "p", "crit_1", "crit_5", "crit_10", keep=("entity", "n", "lag", "cointegrated"))


def system(spark, sf):
    m = settled(panel_once(spark, sf).select("entity", "ref_month", F.log("p").alias("lp"), F.log("v").alias("lv")))
    return m, co.system_rank(m, E, "ref_month", ["lp", "lv"], 3)


@query("system_rank", "I3")
def _(spark, sf):
    _m, s = system(spark, sf)
    return s.select("entity", "n", "k_diff", "rank", r6(F.col("trace")[0]).alias("trace_0"), r6(F.col("trace")[1]).alias("trace_1"), r6(F.col("vector")[1]).alias("vector_lv"))


@query("adjustment_speeds", "I14")
def _(spark, sf):
    m, s = system(spark, sf)
    return out(co.adjustment_speeds(m, settled(s), E, "ref_month", ["lp", "lv"]), "speed", "t", keep=("entity", "equation", "n"))


def pooled_roots(spark, sf):
    """Unit-root tests of each entity's residuals of the pooled dynamic fit."""
    q = quarters_once(spark, sf)
    fit, effects = an.pooled_fit(q, [], "entity", "quarter", "lp", XS, 1)
    res = an.residuals(q, settled(fit), effects, [], "entity", "quarter", "lp", XS, 1)
    return co.pooled_residual_roots(settled(res), "entity", "quarter", len(XS) + 1)


@query("pooled_residual_roots", "I4", with_(*QUARTERS, ONE_SET, *POOLED, """pr AS (SELECT sn.entity, quarter, lp - b0 * lv - b1 * disc - alpha AS e, n_obs FROM sn JOIN fe ON fe.entity = sn.entity WHERE n_obs >= 10),
 p1 AS (SELECT *, e - lag(e) OVER o AS c, lag(e) OVER o AS l FROM pr WINDOW o AS (PARTITION BY entity ORDER BY quarter)),
 p2 AS (SELECT * FROM (SELECT *, lag(c) OVER (PARTITION BY entity ORDER BY quarter) AS k FROM p1) WHERE k IS NOT NULL)""", ols_cte("ur", "p2", "entity", "c", ["k", "l"], "n_obs")) + f"""
SELECT entity, any_value(n_obs) AS n_obs, {rnd('any_value(zy / sqrt(zz * ssr / (n - 2)))', 'stat')} FROM ur WHERE n > 2 GROUP BY 1""")
def _(spark, sf):
    return out(pooled_roots(spark, sf), "stat", keep=("entity", "n_obs"))


@query("fisher_combination", "I4")
def _(spark, sf):
    return out(co.fisher(pooled_roots(spark, sf), [], "p"), "stat", "share_rejecting", "p", keep=("n",))


@query("fisher_statistic", "I4", f"""
WITH pv AS (SELECT p_brand, percent_rank() OVER (ORDER BY p_retailprice) * 0.2 + 0.0001 AS p FROM part)
SELECT p_brand, count(*) AS n, {rnd('sum(-2 * ln(p))', 'stat')}, {rnd('avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END)', 'share_rejecting')} FROM pv GROUP BY 1""")
def _(spark, sf):
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand")
    return out(co.fisher(p_values(spark, sf).join(brands, "id"), ["p_brand"], "p"), "stat", "share_rejecting", keep=("p_brand", "n"))


# quarters that every entity has; then, by (rep, entity), the residual's unit-root sums with one lag removed and the
# error-correction sums with all other terms removed; rep 0 is the data
BALANCED = """qp AS (SELECT * FROM (SELECT entity, CAST(date_trunc('quarter', ref_month) AS DATE) AS quarter, ln(avg(p)) AS lp, ln(sum(v)) AS lv FROM grid GROUP BY entity, date_trunc('quarter', ref_month))
   WHERE lp IS NOT NULL AND lv IS NOT NULL),
 cm AS (SELECT quarter FROM qp GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT entity) FROM qp)),
 bp AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY quarter) - 1 AS i FROM qp WHERE quarter IN (SELECT quarter FROM cm) AND (SELECT count(*) FROM cm) >= 10)"""
PARTS = ",\n ".join([
    ols_cte("lr", "sim", "rep, entity", "y", ["1.0", "x"], "t"),
    """d1 AS (SELECT rep, entity, t, e - lag(e) OVER o AS c, lag(e) OVER o AS l FROM lr WINDOW o AS (PARTITION BY rep, entity ORDER BY t)),
 d2 AS (SELECT * FROM (SELECT *, lag(c) OVER (PARTITION BY rep, entity ORDER BY t) AS k FROM d1) WHERE k IS NOT NULL)""",
    ols_cte("ur", "d2", "rep, entity", "c", ["k", "l"]),
    """up AS (SELECT rep, entity, any_value(n) AS n, any_value(zz) AS zz, any_value(zy) AS zy, any_value(ssr) + any_value(zy) ** 2 / any_value(zz) AS yy FROM ur GROUP BY 1, 2),
 us AS (SELECT rep, count(*) AS entities, avg(zy / sqrt(zz * (yy - zy * zy / zz) / (n - 2))) AS group_stat,
   sum(zy) / sum(zz) / sqrt((sum(yy) - sum(zy) ** 2 / sum(zz)) / (sum(n) - 1 - count(*)) / sum(zz)) AS panel_stat FROM up GROUP BY 1),
 e1 AS (SELECT rep, entity, t, y - lag(y) OVER o AS dy, x - lag(x) OVER o AS dx, lag(y) OVER o AS ly, lag(x) OVER o AS lx FROM sim WINDOW o AS (PARTITION BY rep, entity ORDER BY t)),
 e2 AS (SELECT * FROM (SELECT *, lag(dy) OVER o AS ldy, lag(dx) OVER o AS ldx FROM e1 WINDOW o AS (PARTITION BY rep, entity ORDER BY t)) WHERE ldy IS NOT NULL)""",
    ols_cte("ec", "e2", "rep, entity", "dy", ["1.0", "lx", "ldy", "dx", "ldx", "ly"]),
    """ep AS (SELECT rep, entity, any_value(n) AS n, any_value(zz) AS zz, any_value(zy) AS zy, any_value(ssr) / (any_value(n) - 6) AS s2 FROM ec GROUP BY 1, 2),
 es AS (SELECT rep, CASE WHEN min(n) - 6 >= 6 THEN avg(zy / sqrt(zz * s2)) END AS ec_group_stat, CASE WHEN min(n) - 6 >= 6 THEN sum(zy) / sum(zz) / sqrt(avg(s2) / sum(zz)) END AS ec_panel_stat FROM ep GROUP BY 1)""",
])
REAL = "sim AS (SELECT 0 AS rep, entity, i AS t, lp AS y, lv AS x FROM bp)"
REPS = 999
# the changes' own model, periods drawn once for all entities, paths rebuilt along them
NULL_PATHS = ",\n ".join([
    """n1 AS (SELECT entity, i, lp - lag(lp) OVER o AS dy, lv - lag(lv) OVER o AS dx FROM bp WINDOW o AS (PARTITION BY entity ORDER BY i)),
 n2 AS (SELECT * FROM (SELECT *, lag(dy) OVER o AS ldy, lag(dx) OVER o AS ldx FROM n1 WINDOW o AS (PARTITION BY entity ORDER BY i)) WHERE ldy IS NOT NULL)""",
    ols_cte("nf", "n2", "entity", "dy", ["1.0", "ldy", "dx", "ldx"], "i, dx"),
    f"""ns AS (SELECT entity, i - 2 AS src, dx, e - avg(e) OVER (PARTITION BY entity) AS shock, b0, b1, b2, b3 FROM nf),
 dr AS MATERIALIZED (SELECT rep, s, CAST(floor((CAST(('0x' || substr(md5('13|period|' || rep || '|' || s), 1, 8)) AS UBIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE * k) AS BIGINT) AS src
   FROM range(1, {REPS} + 1) r(rep), (SELECT max(i) - 1 AS k FROM bp), LATERAL range(0, k) q(s)),
 pt AS (SELECT rep, n1.entity, -1 AS s, n1.dy, n1.dx, bp.lp + n1.dy AS y, bp.lv + n1.dx AS x FROM n1 JOIN bp ON bp.entity = n1.entity AND bp.i = 0, range(1, {REPS} + 1) r(rep) WHERE n1.i = 1
  UNION ALL SELECT p.rep, p.entity, p.s + 1, b0 + b1 * p.dy + b2 * n.dx + b3 * p.dx + n.shock, n.dx, p.y + b0 + b1 * p.dy + b2 * n.dx + b3 * p.dx + n.shock, p.x + n.dx
   FROM pt p JOIN dr ON dr.rep = p.rep AND dr.s = p.s + 1 JOIN ns n ON n.entity = p.entity AND n.src = dr.src),
 sim AS MATERIALIZED (SELECT 0 AS rep, entity, i AS t, lp AS y, lv AS x FROM bp UNION ALL SELECT rep, entity, s + 2, y, x FROM pt
  UNION ALL SELECT rep, entity, 0, lp, lv FROM bp, range(1, {REPS} + 1) r(rep) WHERE i = 0)""",
])


def common_quarters(spark, sf):
    return balanced_panel(quarters_once(spark, sf), "entity", "quarter", ["lp", "lv"])


@query("residual_panel_tests", "I5", with_(NM, GRID, BALANCED, REAL, PARTS) + f"""
SELECT count(*) AS entities, {rnd('any_value(group_stat)', 'group_stat')}, {rnd('any_value(panel_stat)', 'panel_stat')} FROM us, (SELECT DISTINCT entity FROM bp)""")
def _(spark, sf):
    return out(co.residual_panel_tests(common_quarters(spark, sf), [], "entity", "quarter", "lp", ["lv"]), "group_stat", "panel_stat", keep=("entities",))


@query("error_correction_panel_tests", "I6", with_(NM, GRID, BALANCED, REAL, PARTS) + f"""
SELECT {rnd('max(ec_group_stat)', 'ec_group_stat')}, {rnd('max(ec_panel_stat)', 'ec_panel_stat')} FROM es""")
def _(spark, sf):
    return out(co.error_correction_panel_tests(common_quarters(spark, sf), [], "entity", "quarter", "lp", ["lv"]), "ec_group_stat", "ec_panel_stat", keep=())


@query("panel_bootstrap_test", "I7", with_(NM, GRID, BALANCED, NULL_PATHS, PARTS).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, st AS (SELECT * FROM us JOIN es USING (rep)), ok AS (SELECT * FROM st WHERE rep = 0 AND group_stat IS NOT NULL AND panel_stat IS NOT NULL AND ec_group_stat IS NOT NULL AND ec_panel_stat IS NOT NULL),
 pv AS (SELECT """ + ", ".join(f"(1 + count(*) FILTER (b.{x} <= ok.{x})) / {REPS + 1}.0::DOUBLE AS p_{x}" for x in co.STATISTICS) + f""" FROM ok JOIN st b ON b.rep > 0 GROUP BY ok.rep)
SELECT (SELECT count(DISTINCT entity) FROM qp) AS entities, (SELECT count(*) FROM cm) AS periods, ok.rep IS NOT NULL AS testable, """ + ", ".join(f"{rnd(x, x)}, {rnd(f'p_{x}', f'p_{x}')}" for x in co.STATISTICS) + """
FROM (SELECT 1) LEFT JOIN ok ON true LEFT JOIN pv ON true""")
def _(spark, sf):
    d = co.panel_test(quarters_once(spark, sf), "entity", "quarter", "lp", ["lv"], REPS, 13)
    return out(d, *co.STATISTICS, *[f"p_{s}" for s in co.STATISTICS], keep=("entities", "periods", "testable"))


CANDIDATES = ["lv", "disc", "tax", "lq", "ln"]


def quarter_measures(panel):
    """Log price with the candidates that may explain it: log volume, discount, tax, log quantity, log orders."""
    return panel.groupBy("entity", F.trunc("ref_month", "QUARTER").alias("quarter")).agg(
        F.log(F.avg("p")).alias("lp"), F.log(F.sum("v")).alias("lv"), (F.avg("disc") * 10).alias("disc"), (F.avg("tax") * 10).alias("tax"),
        F.log(F.sum("qty")).alias("lq"), F.log(F.sum("n").cast("double")).alias("ln"))


@query("specification_family_tests", "I9")
def _(spark, sf):
    d = co.family_tests(settled(quarter_measures(panel_once(spark, sf))), "entity", "quarter", "lp", CANDIDATES, "lv", REPS, 13, "group_stat")
    return out(d, "group_stat", "p", "p_holm", "p_bh", keep=("spec", "entities", "periods", "testable"))


KPSS = [NM, GRID, COMP, "kd AS (SELECT entity, ref_month, ect - avg(ect) OVER (PARTITION BY entity) AS e FROM comp WHERE ect IS NOT NULL)",
        "kc AS (SELECT *, sum(e) OVER (PARTITION BY entity ORDER BY ref_month) AS c, row_number() OVER (PARTITION BY entity ORDER BY ref_month) AS rn FROM kd)",
        "kl AS (SELECT a.entity, sum(CASE WHEN a.rn = b.rn THEN 1.0 ELSE 2 * (1 - (a.rn - b.rn) / 5.0) END * a.e * b.e) AS q FROM kc a JOIN kc b ON b.entity = a.entity AND b.rn <= a.rn AND a.rn - b.rn <= 4 GROUP BY 1)"]


@query("level_stationarity", "I13", with_(*KPSS) + f"SELECT kc.entity, count(*) AS n, {rnd('sum(c * c) / (count(*) * any_value(q))', 'stat')} FROM kc JOIN kl ON kl.entity = kc.entity GROUP BY 1")
def _(spark, sf):
    return out(co.level_stationarity(comp_table(spark, sf), E, "ref_month", "ect", 4), "stat", keep=("entity", "n"))


@query("stationarity_screen", "I13")
def _(spark, sf):
    d = co.stationarity_screen(settled(comp_table(spark, sf)), E, "ref_month", "ect", 4)
    return out(d, "unit_root_stat", "unit_root_p", "level_stat", keep=("entity", "form", "n", "verdict"))


# ---- regimes
def returns(spark, sf):
    r = 100 * (F.log("p") - F.log(F.lag("p").over(ordered(E, "ref_month"))))
    return grid(spark, sf).withColumn("ret", r)


def given(d):
    """Fixed parameters from each entity's own spread: calm and stress standard deviations."""
    sd, mean = F.stddev_samp("ret").over(whole(E)), F.avg("ret").over(whole(E))
    return d.withColumns({"m0": mean, "m1": mean, "s0": 0.6 * sd, "s1": 1.5 * sd, "p00": F.lit(0.95), "p11": F.lit(0.85)})


def fold_sql(p00: str, p11: str) -> str:
    """The filter as a recursive query over each series' rows; p00 and p11 may use z, the driver."""
    prior = "(f.f * n.p11 + (1 - f.f) * (1 - n.p00))"
    dens = lambda k: f"exp(-0.5 * ((ret - m) / ({k} * s)) ** 2) / ({k} * s * 2.5066282746310002::DOUBLE)"
    return with_(NM, GRID).replace("WITH ", "WITH RECURSIVE ", 1) + f""", lg AS (SELECT *, 100 * (ln(p) - ln(lag(p) OVER o)) AS ret, lag(v) OVER o AS vl FROM grid WINDOW o AS (PARTITION BY entity ORDER BY ref_month)),
 zz AS (SELECT *, coalesce((vl - avg(vl) OVER b) / nullif(stddev_samp(vl) OVER b, 0), 0) AS z FROM lg WINDOW b AS (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 st AS (SELECT entity, ref_month, ret, z, avg(ret) OVER w AS m, stddev_samp(ret) OVER w AS s, row_number() OVER (PARTITION BY entity ORDER BY ref_month) AS rn FROM zz WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY entity)),
 dn AS (SELECT entity, ref_month, rn, {p00} AS p00, {p11} AS p11, {dens('0.6')} AS d0, {dens('1.5')} AS d1 FROM st),
 fl AS (SELECT entity, rn, ref_month, prior, prior * d1 + (1 - prior) * d0 AS dens, prior * d1 / (prior * d1 + (1 - prior) * d0) AS f
   FROM (SELECT *, (1 - p00) / (2 - p00 - p11) * p11 + (1 - (1 - p00) / (2 - p00 - p11)) * (1 - p00) AS prior FROM dn WHERE rn = 1)
  UNION ALL SELECT n.entity, n.rn, n.ref_month, {prior}, {prior} * n.d1 + (1 - {prior}) * n.d0, {prior} * n.d1 / ({prior} * n.d1 + (1 - {prior}) * n.d0)
   FROM fl f JOIN dn n ON n.entity = f.entity AND n.rn = f.rn + 1)"""


CONSTANT = fold_sql("0.95::DOUBLE", "0.85::DOUBLE")
MOVING = fold_sql("1 / (1 + exp(-(2.9 - 0.4 * z)))", "1 / (1 + exp(-(1.7 + 0.3 * z)))")


@query("filtered_state_probability", "J1", CONSTANT + f"""
SELECT entity, ref_month, {rnd('f', 'p_filtered')}, {rnd('prior', 'p_predicted')} FROM fl""")
def _(spark, sf):
    return out(rm.filtered(given(returns(spark, sf)), E, "ref_month", "ret"), "p_filtered", "p_predicted", keep=("entity", "ref_month"))


@query("state_refit_realtime", "J2")
def _(spark, sf):
    d = settled(returns(spark, sf).select("entity", "ref_month", "ret"))
    par = settled(rm.refits(d, E, "ref_month", "ret", 48, 12))
    return out(rm.realtime(d, par, E, "ref_month", "ret"), "p_filtered", keep=("entity", "ref_month", "origin"))


SMOOTH = """, nx AS (SELECT entity, rn, ref_month, f, lead(prior) OVER (PARTITION BY entity ORDER BY rn) AS nxt FROM fl),
 sm AS (SELECT entity, rn, ref_month, f AS sp FROM nx WHERE nxt IS NULL
  UNION ALL SELECT n.entity, n.rn, n.ref_month, n.f * (0.85::DOUBLE * s.sp / n.nxt + (1 - 0.85::DOUBLE) * (1 - s.sp) / (1 - n.nxt)) FROM sm s JOIN nx n ON n.entity = s.entity AND n.rn = s.rn - 1)"""


@query("smoothed_state_probability", "J4", CONSTANT + SMOOTH + f"SELECT entity, ref_month, {rnd('sp', 'p_smoothed')} FROM sm")
def _(spark, sf):
    d = given(returns(spark, sf))
    f = rm.filtered(d, E, "ref_month", "ret").withColumns({"p00": F.lit(0.95), "p11": F.lit(0.85)})
    return out(rm.smoothed(f, E, "ref_month"), "p_smoothed", keep=("entity", "ref_month"))


def driven(spark, sf):
    """Transitions moved by a lagged, standardised driver (supplied parameters)."""
    d = given(returns(spark, sf))
    lag = F.lag("v").over(ordered(E, "ref_month"))
    d = d.withColumn("_v", lag)
    before = past(E, "ref_month", -1)
    z = F.coalesce((F.col("_v") - F.avg("_v").over(before)) / F.stddev_samp("_v").over(before), F.lit(0.0))
    z = F.when(F.isnan(z), 0.0).otherwise(z)
    logit = lambda a, b: 1 / (1 + F.exp(-(a + b * z)))
    return d.withColumns({"p00": logit(2.9, -0.4), "p11": logit(1.7, 0.3)})


@query("predictive_density", "J5", MOVING + f"""
SELECT entity, ref_month, {rnd('prior', 'p_predicted')}, {rnd('ln(dens)', 'log_score')} FROM fl""")
def _(spark, sf):
    f = rm.filtered(driven(spark, sf), E, "ref_month", "ret")
    return out(f.withColumn("log_score", F.log("density")), "p_predicted", "log_score", keep=("entity", "ref_month"))


@query("log_score_difference", "H18")
def _(spark, sf):
    score = lambda d, n: rm.filtered(d, E, "ref_month", "ret").select("entity", "ref_month", F.log("density").alias(n))
    j = score(driven(spark, sf), "a").join(score(given(returns(spark, sf)), "b"), ["entity", "ref_month"])
    m = mean_test(j.withColumn("d", F.col("a") - F.col("b")), E, "ref_month", "d", 3)
    return out(m.withColumn("p", p_normal_upper("t")), "mean", "t", "p", keep=("entity", "n"))


MIX = """mx AS (SELECT entity, ref_month, ret, avg(ret) OVER w AS m, stddev_samp(ret) OVER w AS s FROM (SELECT entity, ref_month, 100 * (ln(p) - ln(lag(p) OVER (PARTITION BY entity ORDER BY ref_month))) AS ret FROM grid) WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY entity)),
 sd AS (SELECT entity, ref_month, ln(0.5 * exp(-0.5 * ((ret - m) / (0.6 * s)) ** 2) / (0.6 * s * 2.5066282746310002::DOUBLE) + 0.5 * exp(-0.5 * ((ret - m) / (1.5 * s)) ** 2) / (1.5 * s * 2.5066282746310002::DOUBLE))
   - ln(exp(-0.5 * ((ret - m) / s) ** 2) / (s * 2.5066282746310002::DOUBLE)) AS d FROM mx)"""


@query("mixture_score_difference", "H18", with_(NM, GRID, MIX, mean_test_cte("mt", "sd", "d", "entity", "3")) + f"SELECT entity, n, {shown('mean', 'mean')}, {shown('t', 't')} FROM mt")
def _(spark, sf):
    d = returns(spark, sf).where("ret is not null")
    m, s = F.avg("ret").over(whole(E)), F.stddev_samp("ret").over(whole(E))
    d = d.withColumns({"m": m, "s": s})
    dens = lambda k: rm._density(F.col("ret"), F.col("m"), k * F.col("s"))
    d = d.withColumn("d", F.log(0.5 * dens(0.6) + 0.5 * dens(1.5)) - F.log(dens(1.0)))
    return out(enough(mean_test(d, E, "ref_month", "d", 3), "n", "mean", "t"), "mean", "t", keep=("entity", "n"))


TRANS = """st AS (SELECT event_type, day, CAST(CASE WHEN value > avg(value) OVER (PARTITION BY event_type) THEN 1 ELSE 0 END AS INT) AS s FROM daily),
 tr AS (SELECT *, lag(s) OVER (PARTITION BY event_type ORDER BY day) AS pv FROM st),
 c AS (SELECT event_type, count(*) FILTER (pv = 0 AND s = 0) AS n00, count(*) FILTER (pv = 0 AND s = 1) AS n01, count(*) FILTER (pv = 1 AND s = 0) AS n10, count(*) FILTER (pv = 1 AND s = 1) AS n11, max_by(s, day) AS now FROM tr GROUP BY 1),
 q AS (SELECT *, n00 / (n00 + n01) AS p00, n11 / (n10 + n11) AS p11, (1 - n00 / (n00 + n01)) / (2 - n00 / (n00 + n01) - n11 / (n10 + n11)) AS steady FROM c)"""


@query("transition_forecast", "J3", with_(DAILY, TRANS) + f"""
SELECT event_type, now, {rnd('p00', 'p00')}, {rnd('p11', 'p11')}, {rnd('steady', 'steady')}, {rnd('1 / (1 - p00)', 'duration_0')}, {rnd('1 / (1 - p11)', 'duration_1')},
 {rnd('steady + (now - steady) * power(p00 + p11 - 1, 1)', 'p_1')}, {rnd('steady + (now - steady) * power(p00 + p11 - 1, 3)', 'p_3')}, {rnd('steady + (now - steady) * power(p00 + p11 - 1, 6)', 'p_6')},
 {rnd('steady + (now - steady) * power(p00 + p11 - 1, 12)', 'p_12')} FROM q""")
def _(spark, sf):
    d = daily_events(spark, sf).withColumn("s", (F.col("value") > F.avg("value").over(whole(["event_type"]))).cast("int"))
    t = rm.transition_forecast(d, ["event_type"], "day", "s", [1, 3, 6, 12])
    return out(t, "p00", "p11", "steady", "duration_0", "duration_1", "p_1", "p_3", "p_6", "p_12", keep=("event_type", "now"))


@query("outcome_by_state", "J6", with_(NM, GRID) + f"""
, m AS (SELECT *, 100 * (ln(p) - ln(lag(p) OVER o)) AS ret, CASE WHEN count(v) OVER b >= 24 THEN quantile_cont(v, 0.5) OVER b END AS ma, CASE WHEN count(p) OVER b >= 24 THEN quantile_cont(p, 0.5) OVER b END AS mb FROM grid
   WINDOW o AS (PARTITION BY entity ORDER BY ref_month), b AS (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 s AS (SELECT entity, ret, 'A' || CASE WHEN v > ma THEN 'Hi' ELSE 'Lo' END || '_B' || CASE WHEN p > mb THEN 'Hi' ELSE 'Lo' END AS state FROM m WHERE ma IS NOT NULL AND mb IS NOT NULL)
SELECT entity, state, count(*) AS n, {rnd('avg(ret)', 'mean')}, {rnd('stddev_samp(ret)', 'sd')}, {rnd('min(ret)', 'min')}, {rnd('max(ret)', 'max')} FROM s WHERE ret IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    d = two_factor_state(returns(spark, sf), E, "ref_month", "v", "p", 24)
    return out(rm.by_state(d, E, "state", "ret"), "mean", "sd", "min", "max", keep=("entity", "state", "n"))
