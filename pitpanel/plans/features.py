"""Derived-measure and cross-section queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions.columns import r6
from pitpanel.operators import asof as pit
from pitpanel.operators import calendar as cal
from pitpanel.operators import crosssection as xs
from pitpanel.operators import features as ft
from pitpanel.plans.calendar import E, TWO_GRID, grid, two_grid
from pitpanel.plans.inputs import long_panel, monthly_panel, regressor_panel, releases, table
from pitpanel.plans.pointintime import ANNUAL, NOWCAST, PIT, annual_total, pit_table
from pitpanel.plans.registry import query
from pitpanel.plans.sql import GRID, LONG, NM, REGS, REL, TWO, rnd, with_
from pitpanel.session import settled

OW = "WINDOW o AS (PARTITION BY entity ORDER BY ref_month)"


def out(d, *cols, keep=("entity", "ref_month")):
    return d.select(*keep, *[r6(c).alias(c) for c in cols])


@query("derived_measures", "E1", with_(NM, PIT) + f"""
SELECT entity, info_month, {rnd('ln(v)', 'log_v')}, {rnd('ln(p)', 'log_p')}, {rnd('v - p', 'spread')}, {rnd('v / n', 'cover')}, {rnd('p / v', 'share')} FROM pit""")
def _(spark, sf):
    d = ft.derived_measures(pit_table(spark, sf), ["v", "p"], {"spread": ("v", "p")}, {"cover": ("v", "n"), "share": ("p", "v")})
    return out(d, "log_v", "log_p", "spread", "cover", "share", keep=("entity", "info_month"))


@query("annualised_share_of_base", "E2", with_(NM, ANNUAL, NOWCAST) + f"""
, j AS (SELECT t.entity, t.ref_month, t.v, np.value * power(g, ((year(ref_month) - np.year) * 12 + month(ref_month) - 7) / 12.0) AS base
   FROM (SELECT *, CAST(ref_month + INTERVAL 2 MONTH AS DATE) AS info FROM nm) t ASOF LEFT JOIN np ON np.entity = t.entity AND np.public <= t.info)
SELECT entity, ref_month, {rnd('v * 12 / base * 100', 'pct')} FROM j""")
def _(spark, sf):
    t = monthly_panel(spark, sf).select("entity", "ref_month", "v", F.col("ref_month").alias("target"), F.add_months("ref_month", 2).alias("info"))
    j = pit.nowcast(annual_total(spark, sf), t, E, "value", 7, 3)
    return j.select("entity", "ref_month", r6(ft.annualised_pct("v", "nowcast", 12)).alias("pct"))


@query("wide_assembly", "E3", with_(NM, LONG) + f"""
SELECT entity, ref_month, {rnd("max(value) FILTER (series_id = 'v')", 'v')}, {rnd("max(value) FILTER (series_id = 'p')", 'p')}, {rnd("max(value) FILTER (series_id = 'n')", 'n')}
FROM lng GROUP BY 1, 2""")
def _(spark, sf):
    return out(ft.wide(long_panel(spark, sf), E, "ref_month", ["v", "p", "n"]), "v", "p", "n")


@query("flow_plus_stock_change", "E4", with_(NM, GRID) + f"SELECT entity, ref_month, {rnd('v + p - lag(p) OVER o', 'x')} FROM grid {OW}")
def _(spark, sf):
    return grid(spark, sf).select("entity", "ref_month", r6(ft.flow_plus_stock_change(E, "ref_month", "v", "p")).alias("x"))


@query("lagged_regression_inputs", "E6", with_(NM, GRID, ANNUAL) + f"""
, x AS (SELECT entity, ref_month, ln(p) AS lp, ln(lag(v, 1) OVER o) - ln(lag(n, 1) OVER o) AS rel, p - lag(p, 12) OVER o AS rate FROM grid {OW}),
 f AS (SELECT *, last_value(rel IGNORE NULLS) OVER (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rel2 FROM x)
SELECT f.entity, f.ref_month, {rnd('lp - rel2', 'q')}, {rnd('rel2', 'rel_price')}, {rnd('rate', 'rate')}, {rnd('ln(a.value)', 'log_annual')}
FROM f ASOF LEFT JOIN (SELECT entity, CAST(make_date(year, 12, 1) + INTERVAL 7 MONTH AS DATE) AS public, value FROM an) a ON a.entity = f.entity AND a.public <= f.ref_month""")
def _(spark, sf):
    g = grid(spark, sf)
    w = ft.ordered(E, "ref_month")
    x = g.select("entity", "ref_month", F.log("p").alias("lp"), (F.log(F.lag("v").over(w)) - F.log(F.lag("n").over(w))).alias("rel"),
                 (F.col("p") - F.lag("p", 12).over(w)).alias("rate"))
    x = x.withColumn("rel", cal.carry_forward(x, E, "ref_month", "rel", 2)).withColumn("at", F.col("ref_month"))
    annual = annual_total(spark, sf).withColumn("public", F.add_months(F.make_date("year", F.lit(12), F.lit(1)), 7))
    j = pit.asof(x, annual, E, "at", "public", ["value"])
    return j.select("entity", "ref_month", r6(F.col("lp") - F.col("rel")).alias("q"), r6("rel").alias("rel_price"), r6("rate").alias("rate"),
                    r6(F.log("value")).alias("log_annual"))


RGRID = """rgrid AS (SELECT g.entity, g.ref_month, r.v, r.n, r.p, r.qty, r.disc, r.tax FROM grid g LEFT JOIN regs r ON r.entity = g.entity AND r.ref_month = g.ref_month)"""


def rgrid(spark, sf):
    """The regressor panel on a complete calendar."""
    return cal.spine(regressor_panel(spark, sf), E, "ref_month", ["v", "n", "p", "qty", "disc", "tax"])


FLOW = f"""fx AS (SELECT entity, ref_month, ln(p / lag(p) OVER o) * 100 AS move, qty / 10 AS qty, disc * 100 AS disc, tax * 100 AS tax, ln(v / lag(v) OVER o) * 100 AS d_v FROM rgrid {OW}),
 flow AS (SELECT * FROM fx WHERE move IS NOT NULL AND qty IS NOT NULL AND disc IS NOT NULL AND tax IS NOT NULL AND d_v IS NOT NULL)"""


def flow_table(spark, sf):
    """move, qty, disc, tax, d_v: the monthly frame of the flow regressions."""
    return ft.flow_frame(rgrid(spark, sf), E, "ref_month", "p", {"qty": 10.0, "disc": 0.01, "tax": 0.01}, ["v"])


@query("flow_frame", "E7", with_(NM, GRID, REGS, RGRID, FLOW) + f"""
SELECT entity, ref_month, {rnd('move', 'move')}, {rnd('qty', 'qty')}, {rnd('disc', 'disc')}, {rnd('tax', 'tax')}, {rnd('d_v', 'd_v')} FROM flow""")
def _(spark, sf):
    return out(flow_table(spark, sf), "move", "qty", "disc", "tax", "d_v")


@query("standardised_drivers", "E8", with_(NM, GRID) + f"""
, l AS (SELECT entity, ref_month, lag(v) OVER o AS v_lag, lag(p) OVER o AS p_lag FROM grid {OW})
SELECT entity, ref_month, {rnd('v_lag', 'v_lag')}, {rnd('p_lag', 'p_lag')},
 {rnd('(v_lag - avg(v_lag) OVER b) / CASE WHEN stddev_samp(v_lag) OVER b = 0 THEN 1.0 ELSE stddev_samp(v_lag) OVER b END', 'v_z')},
 {rnd('(p_lag - avg(p_lag) OVER b) / CASE WHEN stddev_samp(p_lag) OVER b = 0 THEN 1.0 ELSE stddev_samp(p_lag) OVER b END', 'p_z')} FROM l
WINDOW b AS (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    return out(ft.standardise_past(grid(spark, sf), E, "ref_month", ["v", "p"]), "v_lag", "p_lag", "v_z", "p_z")


@query("lag_lead_design", "E9", with_(NM, GRID) + f"""
, d AS (SELECT *, v - lag(v) OVER o AS dv FROM grid {OW})
SELECT entity, ref_month, {rnd('lag(p, 1) OVER o', 'p_l1')}, {rnd('lag(p, 2) OVER o', 'p_l2')}, {rnd('lag(dv) OVER o', 'd_v_m1')}, {rnd('dv', 'd_v_p0')}, {rnd('lead(dv) OVER o', 'd_v_p1')} FROM d {OW}""")
def _(spark, sf):
    d = ft.lag_matrix(grid(spark, sf), E, "ref_month", ["p"], 2)
    d, _ = ft.dynamic_terms(d, E, "ref_month", ["v"], 1)
    return out(d, "p_l1", "p_l2", "d_v_m1", "d_v_p0", "d_v_p1")


@query("within_entity_demeaning", "E10", with_(NM) + f"""
SELECT entity, ref_month, {rnd('ln(v) - avg(ln(v)) OVER w', 'lv_dm')}, {rnd('ln(p) - avg(ln(p)) OVER w', 'lp_dm')} FROM nm
WINDOW w AS (PARTITION BY entity) QUALIFY count(*) OVER w >= 5""")
def _(spark, sf):
    d = monthly_panel(spark, sf).withColumn("lv", F.log("v")).withColumn("lp", F.log("p"))
    return out(ft.demean(d, E, ["lv", "lp"], 5), "lv_dm", "lp_dm")


@query("balanced_panel", "E11", with_(NM) + f"""
, c AS (SELECT ref_month, count(DISTINCT entity) AS k FROM nm GROUP BY 1), g AS (SELECT ref_month FROM c WHERE k = (SELECT count(DISTINCT entity) FROM nm))
SELECT entity, ref_month, {rnd('v', 'v')}, {rnd('p', 'p')} FROM nm WHERE ref_month IN (SELECT ref_month FROM g) AND (SELECT count(*) FROM g) >= 10""")
def _(spark, sf):
    return out(ft.balanced_panel(monthly_panel(spark, sf), "entity", "ref_month", ["v", "p"]), "v", "p")


@query("two_factor_state", "E12", with_(NM, GRID) + f"""
, m AS (SELECT *, CASE WHEN count(v) OVER b >= 24 THEN quantile_cont(v, 0.5) OVER b END AS ma, CASE WHEN count(p) OVER b >= 24 THEN quantile_cont(p, 0.5) OVER b END AS mb FROM grid
   WINDOW b AS (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT entity, ref_month, {rnd('ma', 'median_a')}, {rnd('mb', 'median_b')}, CASE WHEN ma IS NOT NULL AND mb IS NOT NULL
  THEN 'A' || CASE WHEN v > ma THEN 'Hi' ELSE 'Lo' END || '_B' || CASE WHEN p > mb THEN 'Hi' ELSE 'Lo' END END AS state FROM m""")
def _(spark, sf):
    d = ft.two_factor_state(grid(spark, sf), E, "ref_month", "v", "p", 24)
    return d.select("entity", "ref_month", r6("median_a").alias("median_a"), r6("median_b").alias("median_b"), "state")


@query("assessment_sign_convention", "E14", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {rnd('l_extendedprice / 1009.0 / nullif(l_discount, 0)', 'implied_gap')}, {rnd('-l_tax', 'own_tax')}, {rnd('-l_quantity', 'own_quantity')} FROM lineitem""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / 1009.0).alias("gap"),
                                             F.col("l_discount").alias("slope"), F.col("l_tax").alias("tax"), F.col("l_quantity").alias("quantity"))
    return out(ft.own_sign(li, "gap", "slope", ["tax", "quantity"]), "implied_gap", "own_tax", "own_quantity", keep=("l_orderkey", "l_linenumber", "l_partkey"))


@query("monthly_returns", "E15", with_(NM, GRID) + f"SELECT entity, ref_month, {rnd('ln(p / lag(p) OVER o) * 100', 'ret')} FROM grid {OW}")
def _(spark, sf):
    return grid(spark, sf).select("entity", "ref_month", r6(ft.log_return(E, "ref_month", "p")).alias("ret"))


@query("smoothed_legacy_set", "E16", with_(NM, GRID) + f"""
, y AS (SELECT *, (p / lag(p, 12) OVER o - 1) * 100 AS py, (n / CAST(lag(n, 12) OVER o AS DOUBLE) - 1) * 100 AS ny FROM grid {OW})
SELECT entity, ref_month, {rnd('avg(v) OVER (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 'v_mean3')},
 {rnd('avg(v) OVER (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)', 'v_mean12')},
 {rnd('(v / lag(v, 12) OVER o - 1) * 100', 'v_yoy')}, {rnd('py', 'p_yoy')}, {rnd('ny', 'n_yoy')}, {rnd('py - ny', 'justified')} FROM y {OW}""")
def _(spark, sf):
    d = ft.smoothed_set(grid(spark, sf).withColumn("n", F.col("n").cast("double")), E, "ref_month", "v", "p", "n")
    return out(d, "v_mean3", "v_mean12", "v_yoy", "p_yoy", "n_yoy", "justified")


# ---- cross-sections: gap of v (ours) and of p (the benchmark) against their trailing means
GAPS = """gaps AS (SELECT entity, ref_month,
  CASE WHEN count(v) OVER o = 12 THEN 100 * ln(v / avg(v) OVER o) END AS gap, CASE WHEN count(p) OVER o = 12 THEN 100 * ln(p / avg(p) OVER o) END AS bench
  FROM grid WINDOW o AS (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""


def gap_table(spark, sf):
    g = grid(spark, sf)
    gap = lambda c: 100 * F.log(F.col(c) / cal.trailing_full(E, "ref_month", c, 12))
    return g.select("entity", "ref_month", gap("v").alias("gap"), gap("p").alias("bench"))


@query("latest_cross_section", "K1", with_(NM, GRID, GAPS) + f"""
, l AS (SELECT * FROM gaps WHERE gap IS NOT NULL AND ref_month = (SELECT max(ref_month) FROM gaps WHERE gap IS NOT NULL)),
 r AS (SELECT *, rank() OVER (ORDER BY gap DESC) AS rank FROM l)
SELECT entity, ref_month, {rnd('gap', 'gap')}, rank, (SELECT rank FROM r WHERE entity = 7) AS focus_rank, {rnd('(SELECT quantile_cont(gap, 0.5) FROM l)', 'median')}, (SELECT count(*) FROM l) AS n FROM r""")
def _(spark, sf):
    d = xs.latest_cross_section(settled(gap_table(spark, sf)), "entity", "ref_month", "gap", 7)
    return d.withColumn("gap", r6("gap")).withColumn("median", r6("median"))


# Fixed settings: entity, label, windows before and after, expected direction.
EPISODES = [(1, "spring 1998", "1997-01-01", "1997-12-01", "1998-04-01", "1999-03-01", 1.0),
            (7, "early 1999", "1997-06-01", "1998-06-01", "1999-01-01", "1999-12-01", -1.0),
            (12, "year 2000", "1998-01-01", "1999-06-01", "2000-01-01", "2000-12-01", 1.0),
            (12, "rebound", "2000-01-01", "2000-06-01", "2000-09-01", "2001-06-01", -1.0)]
EPISODES_SQL = "ep(entity, label, bf, bt, af, at_, direction) AS (VALUES " + ", ".join(
    f"({e}, '{lab}', DATE '{a}', DATE '{b}', DATE '{c}', DATE '{d}', {s})" for e, lab, a, b, c, d, s in EPISODES) + ")"


@query("episode_check", "K2", with_(NM, GRID, GAPS, EPISODES_SQL) + f"""
, m AS (SELECT entity, label, CAST(direction AS DOUBLE) AS direction, avg(gap) FILTER (ref_month BETWEEN bf AND bt) AS b, avg(gap) FILTER (ref_month BETWEEN af AND at_) AS a FROM gaps JOIN ep USING (entity) GROUP BY 1, 2, 3)
SELECT entity, label, direction, {rnd('b', 'before_mean')}, {rnd('a', 'after_mean')}, {rnd('a - b', 'change')}, sign(a - b) = direction AS as_expected FROM m""")
def _(spark, sf):
    spec = spark.createDataFrame(EPISODES, "entity int, label string, before_from string, before_to string, after_from string, after_to string, direction double")
    spec = spec.withColumns({c: F.to_date(c) for c in ("before_from", "before_to", "after_from", "after_to")})
    d = xs.episodes(gap_table(spark, sf), spec, "entity", "ref_month", "gap")
    return d.select("entity", "label", "direction", r6("before_mean").alias("before_mean"), r6("after_mean").alias("after_mean"),
                    r6("change").alias("change"), "as_expected")


@query("year_average_melt", "K3", with_(NM, GRID, GAPS) + f"""
SELECT entity, CAST(year(ref_month) AS INT) AS year, {rnd('avg(gap)', 'gap')} FROM gaps WHERE gap IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return xs.year_average(gap_table(spark, sf), "entity", "ref_month", "gap").withColumn("gap", r6("gap"))


@query("rank_agreement", "K4", with_(NM, GRID, GAPS) + f"""
, y AS (SELECT entity, year(ref_month) AS yr, avg(gap) AS g, avg(bench) AS b FROM gaps WHERE gap IS NOT NULL AND bench IS NOT NULL GROUP BY 1, 2),
 r AS (SELECT *, rank() OVER (PARTITION BY yr ORDER BY g) AS r1, rank() OVER (PARTITION BY yr ORDER BY b) AS r2, g - avg(g) OVER (PARTITION BY entity) AS d1, b - avg(b) OVER (PARTITION BY entity) AS d2 FROM y),
 t AS (SELECT yr, CASE WHEN NOT isnan(corr(r1, r2)) THEN corr(r1, r2) END AS c FROM r GROUP BY 1)
SELECT count(*) AS n, {rnd('corr(g, b)', 'pooled_corr')}, {rnd('corr(d1, d2)', 'within_corr')}, {rnd('avg(CASE WHEN sign(g) = sign(b) THEN 1.0 ELSE 0.0 END)', 'same_sign')},
 {rnd('(SELECT avg(c) FROM t)', 'mean_rank_corr')}, {rnd('(SELECT min(c) FROM t)', 'min_rank_corr')} FROM r""")
def _(spark, sf):
    y = gap_table(spark, sf).where("gap is not null and bench is not null").groupBy("entity", F.year("ref_month").alias("year")).agg(
        F.avg("gap").alias("gap"), F.avg("bench").alias("bench"))
    d = xs.rank_agreement(settled(y), "entity", "year", "gap", "bench")
    return out(d, "pooled_corr", "within_corr", "same_sign", "mean_rank_corr", "min_rank_corr", keep=("n",))


@query("event_year_and_publication", "K5", with_(NM, GRID, GAPS, REL) + f"""
, ev AS (SELECT entity, CAST(year(ref_month) AS INT) AS year, min(realtime_start) AS published FROM rel WHERE month(ref_month) = 12 GROUP BY 1, 2),
 k AS (SELECT * FROM gaps WHERE gap IS NOT NULL),
 yr AS (SELECT entity, year(ref_month) AS year, avg(gap) AS m FROM k GROUP BY 1, 2)
SELECT ev.entity, ev.year, ev.published, k.ref_month AS fact_time, {rnd('k.gap', 'at_publication')}, {rnd('yr.m', 'year_mean')} FROM ev
ASOF LEFT JOIN k ON k.entity = ev.entity AND k.ref_month <= ev.published LEFT JOIN yr ON yr.entity = ev.entity AND yr.year = ev.year""")
def _(spark, sf):
    rel = releases(spark, sf).where(F.month("ref_month") == 12)
    ev = rel.groupBy("entity", F.year("ref_month").alias("year")).agg(F.min("realtime_start").alias("published"))
    d = xs.event_readings(gap_table(spark, sf), ev, "entity", "ref_month", "gap")
    return out(d, "at_publication", "year_mean", keep=("entity", "year", "published", "fact_time"))


@query("benchmark_agreement", "K6", with_(NM, GRID, GAPS) + f"""
, y AS (SELECT entity, year(ref_month) AS yr, avg(gap) AS g_year, max_by(gap, ref_month) AS g_last, avg(bench) AS b_year, max_by(bench, ref_month) AS b_last FROM gaps
   WHERE gap IS NOT NULL AND bench IS NOT NULL GROUP BY 1, 2),
 l AS (SELECT entity, 'year' AS timing, g_year AS x, b_year AS z FROM y UNION ALL SELECT entity, 'last', g_last, b_last FROM y)
SELECT entity, timing, count(*) AS n, {rnd('CASE WHEN count(*) >= 3 THEN corr(x, z) END', 'corr')}, {rnd('CASE WHEN count(*) >= 3 THEN avg(CASE WHEN sign(x) = sign(z) THEN 1.0 ELSE 0.0 END) END', 'same_sign')},
 {rnd('CASE WHEN count(*) >= 3 THEN avg(x - z) END', 'mean_diff')}, {rnd('CASE WHEN count(*) >= 3 THEN avg(abs(x - z)) END', 'mean_abs_diff')} FROM l GROUP BY 1, 2""")
def _(spark, sf):
    g = gap_table(spark, sf).where("gap is not null and bench is not null")
    y = g.groupBy("entity", F.year("ref_month").alias("year")).agg(
        F.avg("gap").alias("x_year"), F.max_by("gap", "ref_month").alias("x_last"), F.avg("bench").alias("z_year"), F.max_by("bench", "ref_month").alias("z_last"))
    pairs = F.array(*[F.struct(F.lit(t).alias("timing"), F.col(f"x_{t}").alias("x"), F.col(f"z_{t}").alias("z")) for t in ("year", "last")])
    d = xs.agreement(y.select("entity", F.inline(pairs)), ["entity", "timing"], "x", "z")
    return out(d, "corr", "same_sign", "mean_diff", "mean_abs_diff", keep=("entity", "timing", "n"))


@query("correlation_screen", "K7", with_(NM, GRID, REGS, RGRID) + f"""
, d AS (SELECT *, p - lag(p) OVER o AS dy, v - lag(v) OVER o AS dv, qty - lag(qty) OVER o AS dq, disc - lag(disc) OVER o AS dd, tax - lag(tax) OVER o AS dt FROM rgrid {OW}),
 l AS (SELECT entity, 'v' AS driver, p, dy, v AS x, dv AS dx FROM d UNION ALL SELECT entity, 'qty', p, dy, qty, dq FROM d UNION ALL SELECT entity, 'disc', p, dy, disc, dd FROM d UNION ALL SELECT entity, 'tax', p, dy, tax, dt FROM d)
SELECT entity, driver, {rnd('corr(p, x)', 'corr_levels')}, {rnd('corr(dy, dx)', 'corr_changes')} FROM l GROUP BY 1, 2""")
def _(spark, sf):
    d = xs.correlation_screen(rgrid(spark, sf), E, "ref_month", "p", ["v", "qty", "disc", "tax"])
    return out(d, "corr_levels", "corr_changes", keep=("entity", "driver"))


@query("latest_model_readings", "K8", with_(NM, TWO, TWO_GRID) + f"""
, l AS (SELECT entity, ref_month, 'a' AS model, a AS value FROM tg UNION ALL SELECT entity, ref_month, 'b', b FROM tg)
SELECT entity, model, max(ref_month) AS as_of, {rnd('max_by(value, ref_month)', 'value')} FROM l WHERE value IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return xs.latest_readings(two_grid(spark, sf), E, "ref_month", ["a", "b"]).withColumn("value", r6("value"))
