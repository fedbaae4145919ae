"""Gap, norm, band and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions.arrays import with_percentiles
from pitpanel.functions.columns import past, r6
from pitpanel.operators import calendar as cal
from pitpanel.operators import gaps as gp
from pitpanel.operators.forecast import targets
from pitpanel.plans.calendar import E
from pitpanel.plans.features import RGRID, rgrid
from pitpanel.plans.forecast import comp_table
from pitpanel.plans.registry import query
from pitpanel.plans.sql import COMP, GRID, NM, REGS, rnd, target_cte, with_
from pitpanel.session import settled

# Fixed settings of the gap model.
P = {"window": 4, "carry": 2, "eta_x": 0.46, "eta_m": 0.25, "income_share": 0.5, "fallback": -0.16, "cyclical": -0.3564,
     "fixed": -2.0, "static": -2.5, "norm_months": 24, "years": 2, "spread": 0.5, "draws": 2000, "seed": 7}


def out(d, *cols, keep=("entity", "quarter")):
    return d.select(*keep, *[r6(c).alias(c) for c in cols])


def panel_once(spark, sf):
    """The monthly panel on a complete calendar, written once: every step below reads it."""
    return settled(rgrid(spark, sf))


def quarter_base(panel):
    """Quarterly balance sheet of each entity; the latest gross flows are not out everywhere."""
    q = panel.groupBy("entity", F.trunc("ref_month", "QUARTER").alias("quarter")).agg(
        F.sum("v").alias("sv"), F.sum("qty").alias("sq"), F.sum("disc").alias("sd"), F.sum("tax").alias("st"), F.count("tax").alias("ct"),
        F.sum("n").cast("double").alias("sn"), F.avg("p").alias("price"))
    late = (F.col("entity") % 3 == 0) & (F.col("quarter") >= F.lit("2001-01-01").cast("date"))
    return q.select(
        "entity", "quarter", F.add_months("quarter", 6).alias("available"), "price",
        F.when(~late, F.col("sv")).alias("ex"), F.when(~late, F.col("sq") * 10).alias("im"), (F.col("sd") * 20 - 3).alias("inc"),
        (F.col("sv") - F.col("sq") * 10).alias("balance"), (F.col("sn") * 10).alias("base"),
        F.when(F.col("ct") == 3, F.col("st") * 40).alias("bill"), (F.col("sq") * 5).alias("stock"),
        F.when((F.col("entity") % 5 != 0) | (F.col("quarter") < F.lit("2000-10-01").cast("date")), F.col("sv") * 0.02 - F.col("sq") * 0.3).alias("financing"),
        (100 * (F.col("price") / 247 - 1)).alias("cycle"),
        F.when((F.col("entity") % 6 != 0) | (F.col("quarter") < F.lit("2000-04-01").cast("date")), (F.col("sd") / 0.15 - 1) * 10).alias("partner_cycle"))


QB = """qb AS (SELECT entity, quarter, CAST(quarter + INTERVAL 6 MONTH AS DATE) AS available, price,
   CASE WHEN NOT (entity % 3 = 0 AND quarter >= DATE '2001-01-01') THEN sv END AS ex, CASE WHEN NOT (entity % 3 = 0 AND quarter >= DATE '2001-01-01') THEN sq * 10 END AS im,
   sd * 20 - 3 AS inc, sv - sq * 10 AS balance, sn * 10 AS base, CASE WHEN ct = 3 THEN st * 40 END AS bill, sq * 5 AS stock,
   CASE WHEN entity % 5 <> 0 OR quarter < DATE '2000-10-01' THEN sv * 0.02 - sq * 0.3 END AS financing, 100 * (price / 247 - 1) AS cycle,
   CASE WHEN entity % 6 <> 0 OR quarter < DATE '2000-04-01' THEN (sd / 0.15 - 1) * 10 END AS partner_cycle
 FROM (SELECT entity, CAST(date_trunc('quarter', ref_month) AS DATE) AS quarter, sum(v) AS sv, sum(qty) AS sq, sum(disc) AS sd, sum(tax) AS st, count(tax) AS ct,
   CAST(sum(n) AS DOUBLE) AS sn, avg(p) AS price FROM rgrid GROUP BY entity, date_trunc('quarter', ref_month))),
 qs0 AS (SELECT *, CASE WHEN count(base) OVER w = 4 THEN avg(base) OVER w END AS base_w, CASE WHEN count(ex) OVER w = 4 THEN sum(ex) OVER w END AS rx,
   CASE WHEN count(im) OVER w = 4 THEN sum(im) OVER w END AS ri, CASE WHEN count(inc) OVER w = 4 THEN sum(inc) OVER w END AS rc,
   CASE WHEN count(balance) OVER w = 4 THEN sum(balance) OVER w END AS rb, CASE WHEN count(bill) OVER w = 4 THEN sum(bill) OVER w END AS rl,
   CASE WHEN count(financing) OVER w = 4 THEN sum(financing) OVER w END AS rf
   FROM qb WINDOW w AS (PARTITION BY entity ORDER BY quarter ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
 qs1 AS (SELECT *, rb / base_w * 100 AS balance_pct, rx / base_w * 100 AS mx, ri / base_w * 100 AS mi, rc / base_w * 100 AS mc, rl / base_w * 100 AS bill_pct, rf / base_w * 100 AS financing_pct,
   cycle - partner_cycle AS rel, stock / base AS ns FROM qs0),
 qs2 AS (SELECT *, last_value(mx IGNORE NULLS) OVER c AS ex_pct, last_value(mi IGNORE NULLS) OVER c AS im_pct, last_value(mc IGNORE NULLS) OVER c AS inc_pct,
   last_value(rel IGNORE NULLS) OVER c AS relative_cycle, last_value(ns IGNORE NULLS) OVER c AS stock_share,
   power(base_w / lag(base_w, 8) OVER (PARTITION BY entity ORDER BY quarter), 0.5) - 1 AS growth
   FROM qs1 WINDOW c AS (PARTITION BY entity ORDER BY quarter ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
 qs3 AS (SELECT *, -(0.46 * ex_pct + 0.25 * im_pct) / 100 - 0.5 * coalesce(inc_pct, 0) / 100 AS own FROM qs2),
 qs AS (SELECT *, CASE WHEN mx IS NOT NULL THEN 'measured' WHEN own IS NOT NULL THEN 'carried' ELSE 'fallback' END AS response_source, coalesce(own, -0.16) AS response FROM qs3),
 pm AS (SELECT entity, ref_month, CASE WHEN count(p) OVER a = 12 THEN avg(p) OVER a END AS m12, CASE WHEN count(p) OVER b = 24 THEN avg(p) OVER b END AS m24 FROM nm
   WINDOW a AS (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), b AS (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
 qp AS (SELECT qs.*, m12 AS price_paid, m24 AS price_norm, bill_pct * (1 - m24 / m12) AS price_adjustment FROM qs
   ASOF LEFT JOIN pm ON pm.entity = qs.entity AND pm.ref_month <= CAST(qs.quarter + INTERVAL 2 MONTH AS DATE)),
 qc AS (SELECT *, -0.3564 * relative_cycle AS cyclical, balance_pct + coalesce(price_adjustment, 0) - coalesce(-0.3564 * relative_cycle, 0) AS underlying FROM qp),
 np0 AS (SELECT entity, make_date(CAST(year(ref_month) AS INT) + 1, 7, 1) AS av, -2 - avg(p) / 1000 AS norm, 0.3 + avg(p) / 1000 AS norm_se FROM nm WHERE p IS NOT NULL GROUP BY entity, year(ref_month)),
 np1 AS (SELECT entity, min_by(norm, av) AS f, min_by(norm_se, av) AS fs FROM np0 GROUP BY 1),
 qn AS (SELECT qc.*, coalesce(np0.norm, np1.f) AS norm_path, coalesce(np0.norm_se, np1.fs) AS norm_se, CASE WHEN np0.norm IS NULL THEN 'backcast' ELSE 'published' END AS norm_source,
   stock_share * growth / (1 + growth) * 100 AS norm_stock, -2.0::DOUBLE AS norm_fixed, -2.5::DOUBLE AS norm_static
   FROM qc ASOF LEFT JOIN np0 ON np0.entity = qc.entity AND np0.av <= qc.available JOIN np1 ON np1.entity = qc.entity),
 qg AS (SELECT *, -(underlying - norm_path) / response AS gap, -(underlying - norm_path) / response AS gap_path, -(underlying - norm_fixed) / response AS gap_fixed,
   -(underlying - norm_stock) / response AS gap_stock, -(underlying - norm_static) / response AS gap_static FROM qn)"""
BASE = [NM, GRID, REGS, RGRID, QB]
WITH = with_(*BASE)


def shares(panel):
    return gp.shares_and_response(quarter_base(panel), E, P["window"], P["carry"], P["eta_x"], P["eta_m"], P["income_share"], P["fallback"])


def adjusted(panel):
    q = gp.price_adjustment(shares(panel), panel.select("entity", "ref_month", "p"), E, "p", P["window"], P["norm_months"])
    return gp.cyclical_adjustment(q, E, P["carry"], P["cyclical"])


def norm_path(panel):
    y = panel.where(F.col("p").isNotNull()).groupBy("entity", F.year("ref_month").alias("year")).agg(F.avg("p").alias("m"))
    return y.select("entity", F.make_date(F.col("year") + 1, F.lit(7), F.lit(1)).alias("available_norm"), (-2 - F.col("m") / 1000).alias("norm"),
                    (0.3 + F.col("m") / 1000).alias("norm_se"))


def gapped(panel):
    q = gp.norms(adjusted(panel), norm_path(panel), E, P["fixed"], P["static"], P["years"], P["carry"])
    return gp.gap_per_norm(q, E, ["path", "fixed", "stock", "static"], "path")


def banded(panel):
    return gp.band(gapped(panel), panel.sparkSession, P["seed"], P["draws"], P["eta_x"], P["eta_m"], P["spread"], [0.1, 0.5, 0.9])


@query("shares_and_response", "F4", WITH + f"""
SELECT entity, quarter, {rnd('balance_pct', 'balance_pct')}, {rnd('ex_pct', 'ex_pct')}, {rnd('im_pct', 'im_pct')}, {rnd('inc_pct', 'inc_pct')}, {rnd('response', 'response')}, response_source FROM qs""")
def _(spark, sf):
    return out(shares(panel_once(spark, sf)), "balance_pct", "ex_pct", "im_pct", "inc_pct", "response", keep=("entity", "quarter", "response_source"))


@query("price_adjustment", "F5", WITH + f"""
SELECT entity, quarter, {rnd('price_paid', 'price_paid')}, {rnd('price_norm', 'price_norm')}, {rnd('bill_pct', 'bill_pct')}, {rnd('price_adjustment', 'price_adjustment')} FROM qp""")
def _(spark, sf):
    return out(adjusted(panel_once(spark, sf)), "price_paid", "price_norm", "bill_pct", "price_adjustment")


@query("cyclical_adjustment", "F6", WITH + f"""
SELECT entity, quarter, {rnd('relative_cycle', 'relative_cycle')}, {rnd('cyclical', 'cyclical')}, {rnd('underlying', 'underlying')} FROM qc""")
def _(spark, sf):
    return out(adjusted(panel_once(spark, sf)), "relative_cycle", "cyclical", "underlying")


@query("norm_alternatives", "F7", WITH + f"""
SELECT entity, quarter, norm_source, {rnd('norm_path', 'norm_path')}, {rnd('norm_se', 'norm_se')}, {rnd('norm_fixed', 'norm_fixed')}, {rnd('norm_static', 'norm_static')},
 {rnd('growth', 'growth')}, {rnd('norm_stock', 'norm_stock')} FROM qn""")
def _(spark, sf):
    return out(gapped(panel_once(spark, sf)), "norm_path", "norm_se", "norm_fixed", "norm_static", "growth", "norm_stock", keep=("entity", "quarter", "norm_source"))


@query("gap_per_norm", "F8", WITH + f"""
SELECT entity, quarter, {rnd('gap', 'gap')}, {rnd('gap_fixed', 'gap_fixed')}, {rnd('gap_stock', 'gap_stock')}, {rnd('gap_static', 'gap_static')}, {rnd('price / (1 + gap / 100)', 'fair_price')} FROM qg""")
def _(spark, sf):
    return out(gapped(panel_once(spark, sf)), "gap", "gap_fixed", "gap_stock", "gap_static", "fair_price")


@query("financing_norm", "F9", WITH + f"""
, f AS (SELECT *, CASE WHEN financing_pct IS NULL THEN NULL WHEN financing_pct > 0 THEN -financing_pct ELSE 0.0 END AS nf FROM qc)
SELECT entity, quarter, {rnd('financing_pct', 'financing_pct')}, {rnd('nf', 'norm_financing')}, {rnd('-(underlying - nf) / response', 'gap_financing')} FROM f""")
def _(spark, sf):
    return out(gp.financing_norm(adjusted(panel_once(spark, sf)), E, P["window"]), "financing_pct", "norm_financing", "gap_financing")


def u_sql(stream: str, seed: int = 7) -> str:
    return f"((CAST(('0x' || substr(md5('{seed}|{stream}|' || CAST(d AS VARCHAR)), 1, 8)) AS UBIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def z_sql(stream: str, seed: int = 7) -> str:
    return f"(sqrt(-2.0 * ln({u_sql(stream + ':r', seed)})) * cos(6.283185307179586::DOUBLE * {u_sql(stream + ':a', seed)}))"


DRAWS = f"""dr AS (SELECT d, {z_sql('z_norm')} AS zn, {u_sql('u_x')} AS ux, {u_sql('u_m')} AS um, {u_sql('u_share')} AS us, {u_sql('u_back')} AS ub FROM generate_series(1, {P['draws']}) g(d)),
 dg AS (SELECT entity, quarter, d, -(underlying - (norm_path + norm_se * zn)) / coalesce(
   -(0.46::DOUBLE * (1 - 0.5::DOUBLE + 2 * 0.5::DOUBLE * ux) * ex_pct + 0.25::DOUBLE * (1 - 0.5::DOUBLE + 2 * 0.5::DOUBLE * um) * im_pct) / 100 - us * coalesce(inc_pct, 0) / 100,
   response * (1 - 0.5::DOUBLE + 2 * 0.5::DOUBLE * ub)) AS g FROM qg CROSS JOIN dr),
 bd AS (SELECT entity, quarter, quantile_cont(g, 0.1) AS g10, quantile_cont(g, 0.5) AS g50, quantile_cont(g, 0.9) AS g90 FROM dg GROUP BY 1, 2)"""


@query("monte_carlo_band", "F10", with_(*BASE, DRAWS) + f"SELECT entity, quarter, {rnd('g10', 'gap_p10')}, {rnd('g50', 'gap_p50')}, {rnd('g90', 'gap_p90')} FROM bd")
def _(spark, sf):
    return out(banded(panel_once(spark, sf)), "gap_p10", "gap_p50", "gap_p90")


@query("monthly_gap_view", "F11", with_(*BASE, DRAWS) + f"""
, fx AS (SELECT qg.*, g10, g90 FROM qg JOIN bd ON bd.entity = qg.entity AND bd.quarter = qg.quarter WHERE gap IS NOT NULL)
SELECT grid.entity, grid.ref_month, fx.quarter, {rnd('ln(CASE WHEN 1 + fx.gap / 100 > 0 THEN 1 + fx.gap / 100 END)', 'gap_log')}, {rnd('grid.p / CASE WHEN 1 + fx.gap / 100 > 0 THEN 1 + fx.gap / 100 END', 'fair')},
 {rnd('grid.p / CASE WHEN 1 + g90 / 100 > 0 THEN 1 + g90 / 100 END', 'fair_strong')}, {rnd('grid.p / CASE WHEN 1 + g10 / 100 > 0 THEN 1 + g10 / 100 END', 'fair_weak')}
FROM grid ASOF LEFT JOIN fx ON fx.entity = grid.entity AND fx.available <= grid.ref_month""")
def _(spark, sf):
    panel = panel_once(spark, sf)
    d = gp.monthly_view(banded(panel), panel.select("entity", "ref_month", "p"), E, "p", ["gap_p10", "gap_p90"], "gap_p10", "gap_p90")
    return out(d, "gap_log", "fair", "fair_strong", "fair_weak", keep=("entity", "ref_month", "quarter"))


WIDE = """wb AS (SELECT *, gap_a - 0.02 - n / 100.0 AS a_lo, gap_a + 0.03 + n / 150.0 AS a_hi, gap_b - 0.01 - n / 200.0 AS b_lo, gap_b + 0.015 + n / 100.0 AS b_hi FROM comp)"""


def component_bands(spark, sf):
    n = F.col("n")
    return comp_table(spark, sf).withColumns({
        "gap_a_lo": F.col("gap_a") - 0.02 - n / 100.0, "gap_a_hi": F.col("gap_a") + 0.03 + n / 150.0,
        "gap_b_lo": F.col("gap_b") - 0.01 - n / 200.0, "gap_b_hi": F.col("gap_b") + 0.015 + n / 100.0})


@query("composite_gap", "F12", with_(NM, GRID, COMP, WIDE) + f"""
SELECT entity, ref_month, {rnd('ect', 'ect')}, {rnd('p * exp(-ect)', 'fair')}, {rnd('(exp(ect) - 1) * 100', 'misalignment_pct')}, {rnd('CASE WHEN ect IS NOT NULL THEN 0.5 * a_lo + 0.5 * b_lo END', 'ect_lo')},
 {rnd('CASE WHEN ect IS NOT NULL THEN 0.5 * a_hi + 0.5 * b_hi END', 'ect_hi')}, {rnd('CASE WHEN ect IS NOT NULL THEN p * exp(-(0.5 * a_hi + 0.5 * b_hi)) END', 'fair_strong')} FROM wb""")
def _(spark, sf):
    d = gp.composite(component_bands(spark, sf), "gap_a", "gap_b", 0.5, 0.5, "p", bands=True)
    return out(d, "ect", "fair", "misalignment_pct", "ect_lo", "ect_hi", "fair_strong", keep=("entity", "ref_month"))


@query("composite_fallback", "F33", with_(NM, GRID, COMP) + f"""
, f AS (SELECT entity, ref_month, p, p * exp(-gap_a) AS fa, CASE WHEN month(ref_month) <> 6 THEN p * exp(-gap_b) END AS fb FROM comp),
 g AS (SELECT *, coalesce((fa + fb) / 2, fa, fb) AS fair FROM f)
SELECT entity, ref_month, {rnd('fair', 'fair')}, {rnd('ln(p / fair)', 'gap_log')} FROM g""")
def _(spark, sf):
    d = comp_table(spark, sf).withColumns({"fa": F.col("p") * F.exp(-F.col("gap_a")),
                                           "fb": F.when(F.month("ref_month") != 6, F.col("p") * F.exp(-F.col("gap_b")))})
    return out(gp.composite_fallback(d, "fa", "fb", "p"), "fair", "gap_log", keep=("entity", "ref_month"))


@query("coefficient_path_range", "F20", with_(NM, GRID, COMP, target_cte("tg", "comp", "ect", "(3)")) + f"""
, h AS (SELECT entity, ref_month, CASE WHEN count(*) OVER o >= 24 THEN regr_slope(y, x) OVER o END AS b FROM tg WHERE x IS NOT NULL AND y IS NOT NULL WINDOW o AS (PARTITION BY entity ORDER BY ref_month))
SELECT entity, {rnd('min(b)', 'min')}, {rnd('max(b)', 'max')}, min(ref_month) AS first_estimate, count(*) AS n_estimates, {rnd('max_by(b, ref_month)', 'last')} FROM h WHERE b IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    t = targets(comp_table(spark, sf), E, "ref_month", "level", ["ect"], [3]).dropna(subset=["y", "ect"])
    w = past(E, "ref_month")
    t = t.withColumn("slope", F.when(F.count("*").over(w) >= 24, F.regr_slope("y", "ect").over(w)))
    return out(gp.coefficient_range(t, E, "ref_month", "slope"), "min", "max", "last", keep=("entity", "first_estimate", "n_estimates"))


# Ex-post outcome x: log of v against its centred mean; band around the real-time mid point.
CORR = """cb AS (SELECT entity, ref_month, CAST(year(ref_month) AS INT) AS yr, x, mid, mid - 0.1 - n / 100.0 AS lo, mid + 0.15 + n / 80.0 AS hi FROM (
   SELECT entity, ref_month, n, ect AS mid, CASE WHEN count(v) OVER o = 9 THEN ln(v / avg(v) OVER o) END AS x FROM comp WINDOW o AS (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))),
 cd AS (SELECT * FROM cb WHERE x IS NOT NULL AND mid IS NOT NULL)"""


def corridor_base(spark, sf):
    w = cal.ordered(E, "ref_month").rowsBetween(-4, 4)
    x = F.when(F.count("v").over(w) == 9, F.log(F.col("v") / F.avg("v").over(w)))
    d = comp_table(spark, sf).select("entity", "ref_month", F.year("ref_month").alias("year"), x.alias("x"), F.col("ect").alias("mid"), "n")
    return d.withColumns({"lo": F.col("mid") - 0.1 - F.col("n") / 100.0, "hi": F.col("mid") + 0.15 + F.col("n") / 80.0})


def known(d):
    return d.where("x is not null and mid is not null")


COVER = f"""count(*) AS n, {rnd('avg(CASE WHEN x >= lo AND x <= hi THEN 1.0 ELSE 0.0 END)', 'coverage')}, {rnd('avg(CASE WHEN x < lo THEN 1.0 ELSE 0.0 END)', 'below')},
 {rnd('avg(CASE WHEN x > hi THEN 1.0 ELSE 0.0 END)', 'above')}, {rnd('quantile_cont((exp(hi) - exp(lo)) * 100, 0.5)', 'median_width_pct')}"""


@query("band_coverage", "F23", with_(NM, GRID, COMP, CORR) + f"SELECT entity, {COVER} FROM cd GROUP BY 1")
def _(spark, sf):
    d = gp.coverage(corridor_base(spark, sf), E, "x", "lo", "hi")
    return out(d, "coverage", "below", "above", "median_width_pct", keep=("entity", "n"))


def fit_sql(name: str, src: str, by: str) -> str:
    return f"""{name}_h AS (SELECT *, avg(x - mid) OVER (PARTITION BY {by}) AS sh FROM {src}),
 {name}_s AS (SELECT {by}, sh, CASE WHEN x >= mid + sh THEN (x - (mid + sh)) / (hi - mid) ELSE (mid + sh - x) / (mid - lo) END AS s FROM {name}_h),
 {name}_r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY s) AS rk, count(*) OVER (PARTITION BY {by}) AS m FROM {name}_s),
 {name} AS (SELECT {by}, max(m) AS n_scores, max(sh) AS shift, max(s) FILTER (rk = least(m, CAST(ceil((m + 1) * 0.8::DOUBLE) AS BIGINT))) AS scale FROM {name}_r GROUP BY {by})"""


@query("conformal_scale", "F24", with_(NM, GRID, COMP, CORR, fit_sql("ft", "cd", "entity")) + f"SELECT entity, CAST(n_scores AS INT) AS n_scores, {rnd('shift', 'shift')}, {rnd('scale', 'scale')} FROM ft")
def _(spark, sf):
    return out(gp.conformal_fit(known(corridor_base(spark, sf)), E, 0.8, True), "shift", "scale", keep=("entity", "n_scores"))


@query("apply_calibration", "F25", with_(NM, GRID, COMP, CORR, fit_sql("ft", "cd", "entity")) + f"""
SELECT cb.entity, ref_month, {rnd('mid + shift - scale * (mid - lo)', 'lo_cal')}, {rnd('mid + shift + scale * (hi - mid)', 'hi_cal')} FROM cb JOIN ft ON ft.entity = cb.entity""")
def _(spark, sf):
    b = settled(corridor_base(spark, sf))
    return out(gp.apply_calibration(b.join(gp.conformal_fit(known(b), E, 0.8, True), E)), "lo_cal", "hi_cal", keep=("entity", "ref_month"))


@query("leave_year_out_calibration", "F26", with_(NM, GRID, COMP, CORR, "ho AS (SELECT cd.*, g.yr AS held FROM cd JOIN (SELECT DISTINCT yr FROM cd) g ON g.yr <> cd.yr)",
                                                  fit_sql("ft", "ho", "entity, held")) + f"""
SELECT cd.entity, ref_month, {rnd('mid + shift - scale * (mid - lo)', 'lo_cal')}, {rnd('mid + shift + scale * (hi - mid)', 'hi_cal')} FROM cd LEFT JOIN ft ON ft.entity = cd.entity AND ft.held = cd.yr""")
def _(spark, sf):
    d = gp.leave_group_out(known(corridor_base(spark, sf)), E, "year", 0.8, True)
    return out(d, "lo_cal", "hi_cal", keep=("entity", "ref_month"))


# every year of the corridor becomes public in the July after it
PUB_SQL = "pb AS (SELECT DISTINCT yr, make_date(yr + 1, 7, 1) AS public FROM cd)"


@query("published_years_calibration", "F26", with_(NM, GRID, COMP, CORR, PUB_SQL,
       "st AS (SELECT a.public, b.yr FROM pb a JOIN pb b ON b.public <= a.public WHERE (SELECT count(*) FROM pb c WHERE c.public <= a.public) >= 3)",
       "mm AS (SELECT cd.*, st.public FROM cd JOIN st ON st.yr = cd.yr)", fit_sql("ft", "mm", "entity, public")) + f"""
SELECT cb.entity, cb.ref_month, CAST(n_scores AS INT) AS n_scores, {rnd('mid + shift - scale * (mid - lo)', 'lo_cal')}, {rnd('mid + shift + scale * (hi - mid)', 'hi_cal')}
FROM cb ASOF LEFT JOIN ft ON ft.entity = cb.entity AND ft.public <= cb.ref_month""")
def _(spark, sf):
    b = settled(corridor_base(spark, sf))
    pub = known(b).select("year").distinct().withColumn("public", F.make_date(F.col("year") + 1, F.lit(7), F.lit(1)))
    d = gp.published_calibration(known(b), b, pub, E, "year", 0.8, True, 3)
    return out(d, "lo_cal", "hi_cal", keep=("entity", "ref_month", "n_scores"))


@query("adopt_corridor", "F27", with_(NM, GRID, COMP, WIDE, CORR) + f"""
, j AS (SELECT wb.entity, wb.ref_month, p, CASE WHEN ect IS NOT NULL THEN 0.5 * a_lo + 0.5 * b_lo END AS lo0, CASE WHEN ect IS NOT NULL THEN 0.5 * a_hi + 0.5 * b_hi END AS hi0,
  CASE WHEN wb.ref_month >= DATE '1998-01-01' THEN lo END AS lo1, CASE WHEN wb.ref_month >= DATE '1998-01-01' THEN hi END AS hi1 FROM wb JOIN cb ON cb.entity = wb.entity AND cb.ref_month = wb.ref_month)
SELECT entity, ref_month, {rnd('coalesce(lo1, lo0)', 'ect_lo')}, {rnd('coalesce(hi1, hi0)', 'ect_hi')}, {rnd('lo0', 'ect_lo_prev')}, {rnd('p * exp(-coalesce(hi1, hi0))', 'fair_strong')},
 {rnd('p * exp(-coalesce(lo1, lo0))', 'fair_weak')} FROM j""")
def _(spark, sf):
    old = gp.composite(component_bands(spark, sf), "gap_a", "gap_b", 0.5, 0.5, "p", bands=True)
    new = F.col("ref_month") >= F.lit("1998-01-01").cast("date")
    d = old.withColumns({"new_lo": F.when(new, F.col("ect") - 0.1 - F.col("n") / 100.0), "new_hi": F.when(new, F.col("ect") + 0.15 + F.col("n") / 80.0)})
    return out(gp.adopt(d, {"ect_lo": "new_lo", "ect_hi": "new_hi"}, "p"), "ect_lo", "ect_hi", "ect_lo_prev", "fair_strong", "fair_weak", keep=("entity", "ref_month"))


@query("probability_positive", "F28", with_(*BASE, DRAWS) + f"""
SELECT dg.entity, dg.quarter, {rnd('avg(CASE WHEN g50 + 0.05 + 1.3 * (g - g50) > 0 THEN 1.0 ELSE 0.0 END)', 'p_positive')} FROM dg JOIN bd ON bd.entity = dg.entity AND bd.quarter = dg.quarter
WHERE g IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    d = banded(panel_once(spark, sf)).where("gap is not null")
    return d.select("entity", "quarter", r6(gp.probability_positive("gap_draws", F.col("gap_p50"), F.lit(0.05), F.lit(1.3))).alias("p_positive"))


@query("inverse_variance_weights", "F29", with_(NM, GRID, COMP, WIDE) + f"""
, w AS (SELECT entity, ref_month, ((a_hi - a_lo) / (2 * 1.2816)) ** 2 AS va, ((b_hi - b_lo) / (2 * 1.2816)) ** 2 AS vb FROM wb)
SELECT entity, ref_month, {rnd('(1 / va) / (1 / va + 1 / vb)', 'weight')} FROM w""")
def _(spark, sf):
    return component_bands(spark, sf).select("entity", "ref_month", r6(gp.inverse_variance_weight("gap_a", "gap_b")).alias("weight"))


SCENARIOS = [(b, n, p) for b in (-1.0, 0.0, 1.0) for n in (-0.5, 0.5) for p in (-5.0, 5.0)]
SCEN_SQL = "sc(balance_shift, norm_shift, price_pct) AS (VALUES " + ", ".join(f"({b}::DOUBLE, {n}::DOUBLE, {p}::DOUBLE)" for b, n, p in SCENARIOS) + ")"


@query("what_if_grid", "F32", with_(*BASE, SCEN_SQL) + f"""
, l AS (SELECT entity, max(quarter) AS quarter FROM qg WHERE gap IS NOT NULL GROUP BY 1),
 s AS (SELECT qg.entity, qg.quarter, price, sc.*, -(underlying + balance_shift - norm_path - norm_shift) / response AS g FROM qg JOIN l ON l.entity = qg.entity AND l.quarter = qg.quarter CROSS JOIN sc)
SELECT entity, quarter, balance_shift, norm_shift, price_pct, {rnd('g', 'scenario_gap')}, {rnd('price * (1 + price_pct / 100) / (1 + g / 100)', 'scenario_fair')} FROM s""")
def _(spark, sf):
    q = gapped(panel_once(spark, sf)).where("gap is not null")
    row = F.max_by(F.struct("quarter", "price", "underlying", "norm_central", "response"), "quarter").alias("r")
    latest = q.groupBy("entity").agg(row).select("entity", "r.*")
    cells = spark.createDataFrame(SCENARIOS, "balance_shift double, norm_shift double, price_pct double")
    d = gp.what_if(latest, cells)
    return out(d, "scenario_gap", "scenario_fair", keep=("entity", "quarter", "balance_shift", "norm_shift", "price_pct"))


# Joint corridor: draws of the gap model mixed with draws of a second component under drawn weights.
JOINT = f"""wt AS (SELECT entity, date_trunc('quarter', ref_month)::DATE AS quarter, max_by(ect, ref_month) AS e2, max_by(n, ref_month) AS n2 FROM comp WHERE ect IS NOT NULL GROUP BY 1, 2),
 dj AS (SELECT dg.entity, dg.quarter, dg.d, ln(1 + g / 100) AS gf, e2 + 0.05::DOUBLE * {z_sql('z_two', 23)} AS gr, [0.5::DOUBLE, 0.25::DOUBLE, 1.0 / (1.0 + n2)][CAST(floor({u_sql('scheme', 23)} * 3) AS INT) + 1] AS w
   FROM dg JOIN wt ON wt.entity = dg.entity AND wt.quarter = dg.quarter WHERE g IS NOT NULL)"""


@query("joint_corridor", "F21", with_(*BASE, COMP, DRAWS, JOINT) + f"""
, m AS (SELECT entity, quarter, w * gr + (1 - w) * gf AS g FROM dj)
SELECT entity, quarter, {rnd('quantile_cont(g, 0.1)', 'lo')}, {rnd('quantile_cont(g, 0.5)', 'mid')}, {rnd('quantile_cont(g, 0.9)', 'hi')} FROM m GROUP BY 1, 2""")
def _(spark, sf):
    q = banded(panel_once(spark, sf)).where("gap is not null").withColumn("draws_b", F.transform("gap_draws", lambda g: F.log(1 + g / 100)))
    two = comp_table(spark, sf).where("ect is not null").groupBy("entity", F.trunc("ref_month", "QUARTER").alias("quarter")).agg(
        F.max_by("ect", "ref_month").alias("e2"), F.max_by("n", "ref_month").alias("n2"))
    q = q.join(two, ["entity", "quarter"])
    q = q.join(F.broadcast(gp.draw_table(spark, 23, P["draws"], ["z_two"], ["scheme"])))       # one row
    q = q.withColumns({
        "draws_a": F.transform("z_two", lambda z: F.col("e2") + 0.05 * z),
        "weights": F.array(F.lit(0.5), F.lit(0.25), 1.0 / (1.0 + F.col("n2"))),
        "picks": F.transform("scheme", lambda u: F.floor(u * 3).cast("int"))})
    q = q.withColumn("joint", gp.combine_draws(q, "draws_a", "draws_b", "weights", "picks"))
    return out(with_percentiles(q, "joint", {"lo": 0.1, "mid": 0.5, "hi": 0.9}), "lo", "mid", "hi")
