"""Trend and anchor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions.arrays import with_percentiles
from pitpanel.functions.columns import r6
from pitpanel.operators import anchor as an
from pitpanel.operators import trend as tr
from pitpanel.operators.gaps import combine_draws, draw_table
from pitpanel.plans.calendar import E
from pitpanel.plans.gaps import P, banded, gapped, panel_once
from pitpanel.plans.registry import query
from pitpanel.plans.sql import GRID, NM, REGS, ols_cte, rnd, trend_cte, with_
from pitpanel.session import settled

XS = ["lv", "disc"]


def out(d, *cols, keep=("entity", "ref_month")):
    return d.select(*keep, *[r6(c).alias(c) for c in cols])


def recursive(*parts):
    return with_(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


@query("one_sided_trend", "F1", recursive(NM, GRID, trend_cte("tr", "grid", "ref_month", "p", 129600)) + f"""
SELECT g.entity, g.ref_month, {rnd('p', 'p')}, {rnd('CASE WHEN rn >= 36 THEN trend END', 'trend')} FROM grid g LEFT JOIN tr ON tr.entity = g.entity AND tr.ref_month = g.ref_month""")
def _(spark, sf):
    d = tr.one_sided_trend(panel_once(spark, sf).select("entity", "ref_month", "p"), E, "ref_month", "p", 129600.0, 36)
    return out(d, "p", "trend")


@query("two_sided_trend", "F2", recursive(NM, GRID, trend_cte("tr", "grid", "ref_month", "p", 129600, True)) + f"""
SELECT g.entity, g.ref_month, {rnd('p', 'p')}, {rnd('trend', 'trend_expost')} FROM grid g LEFT JOIN tr ON tr.entity = g.entity AND tr.ref_month = g.ref_month""")
def _(spark, sf):
    d = tr.two_sided_trend(panel_once(spark, sf).select("entity", "ref_month", "p"), E, "ref_month", "p", 129600.0)
    return out(d, "p", "trend_expost")


@query("trend_gap", "F3", recursive(NM, GRID, trend_cte("tr", "grid", "ref_month", "v", 129600)) + f"""
, j AS (SELECT g.*, CASE WHEN rn >= 36 THEN trend END AS trend FROM grid g LEFT JOIN tr ON tr.entity = g.entity AND tr.ref_month = g.ref_month)
SELECT entity, ref_month, {rnd('trend', 'trend')}, {rnd('ln(trend) - ln(v)', 'gap_log')}, {rnd('(trend / v - 1) * 100', 'misalignment_pct')}, {rnd('p * exp(ln(v) - ln(trend))', 'fair')} FROM j""")
def _(spark, sf):
    d = tr.trend_gap(panel_once(spark, sf).select("entity", "ref_month", "v", "p"), E, "ref_month", "v", "p", 129600.0, 36)
    return out(d, "trend", "gap_log", "misalignment_pct", "fair")


CYCLE = [REGS, "rg AS (SELECT g.entity, g.ref_month, g.v, g.p, r.qty FROM grid g LEFT JOIN regs r ON r.entity = g.entity AND r.ref_month = g.ref_month)",
         "cq AS (SELECT entity, CAST(date_trunc('quarter', ref_month) AS DATE) AS quarter, sum(v) AS own, sum(qty) AS pa, avg(p) AS pb FROM rg GROUP BY 1, 2)",
         "cl AS (SELECT *, CASE WHEN count(own) OVER o = 4 THEN ln(sum(own) OVER o) END AS lo, ln(pa) AS la, ln(pb) AS lb FROM cq WINDOW o AS (PARTITION BY entity ORDER BY quarter ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))",
         *[trend_cte(n, "cl", "quarter", c, 1600) for n, c in (("tw", "lo"), ("ta", "la"), ("tb", "lb"))]]


@query("cyclical_gaps", "E5", recursive(NM, GRID, *CYCLE) + f"""
, g AS (SELECT cl.entity, cl.quarter, (lo - t.trend) * 100 AS own_gap, (la - a.trend) * 100 AS ga, (lb - b.trend) * 100 AS gb FROM cl
   LEFT JOIN tw t ON t.entity = cl.entity AND t.quarter = cl.quarter AND t.rn >= 10 LEFT JOIN ta a ON a.entity = cl.entity AND a.quarter = cl.quarter AND a.rn >= 10
   LEFT JOIN tb b ON b.entity = cl.entity AND b.quarter = cl.quarter AND b.rn >= 10),
 m AS (SELECT *, CASE WHEN ga IS NOT NULL AND gb IS NOT NULL THEN (ga + gb) / 2 ELSE coalesce(ga, gb) END AS x FROM g)
SELECT entity, quarter, {rnd('own_gap', 'own_gap')}, {rnd('CASE WHEN count(x) OVER o = 4 THEN avg(x) OVER o END', 'partner_gap')} FROM m WINDOW o AS (PARTITION BY entity ORDER BY quarter ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    q = panel_once(spark, sf).groupBy("entity", F.trunc("ref_month", "QUARTER").alias("quarter")).agg(
        F.sum("v").alias("own"), F.sum("qty").alias("pa"), F.avg("p").alias("pb"))
    d = tr.cyclical_gaps(q, E, "own", ["pa", "pb"], 1600.0, 10)
    return out(d, "own_gap", "partner_gap", keep=("entity", "quarter"))


def quarter_panel(panel):
    """Estimation panel: log price on log volume and the mean discount, public four months later."""
    q = panel.groupBy("entity", F.trunc("ref_month", "QUARTER").alias("quarter")).agg(
        F.log(F.avg("p")).alias("lp"), F.log(F.sum("v")).alias("lv"), (F.avg("disc") * 10).alias("disc"))
    return q.withColumn("available", F.add_months("quarter", 4))


# the pooled dynamic regression under every information set, each set with its own rows; info is one date without sets
QUARTERS = [NM, GRID, REGS, """rg AS (SELECT g.entity, g.ref_month, g.v, g.p, r.disc FROM grid g LEFT JOIN regs r ON r.entity = g.entity AND r.ref_month = g.ref_month),
 qa AS (SELECT *, CAST(quarter + INTERVAL 4 MONTH AS DATE) AS available FROM (SELECT entity, CAST(date_trunc('quarter', ref_month) AS DATE) AS quarter, ln(avg(p)) AS lp, ln(sum(v)) AS lv, avg(disc) * 10 AS disc
   FROM rg GROUP BY entity, date_trunc('quarter', ref_month)))"""]
EVERY_SET = "si AS (SELECT info, qa.* FROM qa JOIN (SELECT DISTINCT available AS info FROM qa) ON available <= info QUALIFY count(DISTINCT quarter) OVER (PARTITION BY info) >= 12)"
ONE_SET = "si AS (SELECT 0 AS info, * FROM qa)"
TERMS = [f"d_{c}_{j}" for c in XS for j in ("m", "0", "p")]
POOLED = ["""sd AS (SELECT *, lv - lag(lv) OVER o AS d_lv_0, disc - lag(disc) OVER o AS d_disc_0 FROM si WHERE lp IS NOT NULL AND lv IS NOT NULL AND disc IS NOT NULL WINDOW o AS (PARTITION BY info, entity ORDER BY quarter)),
 sl AS (SELECT *, lag(d_lv_0) OVER o AS d_lv_m, lead(d_lv_0) OVER o AS d_lv_p, lag(d_disc_0) OVER o AS d_disc_m, lead(d_disc_0) OVER o AS d_disc_p FROM sd WINDOW o AS (PARTITION BY info, entity ORDER BY quarter)),
 sn AS (SELECT * FROM (SELECT * FROM sl WHERE """ + " AND ".join(f"{t} IS NOT NULL" for t in TERMS) + """) QUALIFY count(*) OVER (PARTITION BY info, entity) >= 5),
 sm AS (SELECT info, entity, quarter, lp, lv, disc, """ + ", ".join(f"{c} - avg({c}) OVER w AS {c}_w" for c in ["lp", *XS, *TERMS]) + " FROM sn WINDOW w AS (PARTITION BY info, entity))",
          ols_cte("sf", "sm", "info", "lp_w", [f"{c}_w" for c in [*XS, *TERMS]], "entity, lp, lv, disc"),
          "fe AS (SELECT info, entity, any_value(n) AS n, any_value(b0) AS b0, any_value(b1) AS b1, avg(lp - b0 * lv - b1 * disc) AS alpha, stddev_samp(lp - b0 * lv - b1 * disc) / sqrt(count(*)) AS alpha_se, count(*) AS n_obs FROM sf WHERE n > 8 GROUP BY 1, 2)"]


def fit_all(panel):
    return an.pooled_fit(quarter_panel(panel), [], "entity", "quarter", "lp", XS, 1)


@query("pooled_dynamic_fit", "F13")
def _(spark, sf):
    fit, _e = fit_all(panel_once(spark, sf))
    return fit.select("n", "clusters", F.posexplode(F.arrays_zip("b", "t")).alias("i", "x")).select(
        "n", "clusters", F.element_at(F.array(*[F.lit(x) for x in XS]), F.col("i") + 1).alias("term"), r6("x.b").alias("coef"), r6("x.t").alias("t"))


@query("pooled_entity_effects", "F13", with_(*QUARTERS, ONE_SET, *POOLED) + f"SELECT entity, n_obs, {rnd('alpha', 'alpha')}, {rnd('alpha_se', 'alpha_se')} FROM fe")
def _(spark, sf):
    return out(fit_all(panel_once(spark, sf))[1], "alpha", "alpha_se", keep=("entity", "n_obs"))


def set_fits(panel):
    q = settled(quarter_panel(panel))
    fit, eff = an.expanding_pooled_fit(q, "entity", "quarter", "available", "lp", XS, 1, 12)
    return q, settled(fit), eff


@query("reestimation_history", "F14", with_(*QUARTERS, EVERY_SET, *POOLED) + f"SELECT DISTINCT info, n, {rnd('b0', 'lv')}, {rnd('b1', 'disc')} FROM fe")
def _(spark, sf):
    _q, fit, _e = set_fits(panel_once(spark, sf))
    return fit.select("info", "n", *[r6(F.col("b")[i]).alias(x) for i, x in enumerate(XS)])


def month_levels(panel):
    return panel.select("entity", F.add_months("ref_month", 1).alias("ref_month"), F.log("p").alias("level")).where("level is not null")


def peer_gaps(panel):
    q, fit, eff = set_fits(panel)
    return an.anchor_gaps(month_levels(panel), q, fit, eff, "entity", XS, "available")


@query("peer_gaps", "F15", with_(*QUARTERS, EVERY_SET, *POOLED) + f"""
, mo AS (SELECT entity, CAST(ref_month + INTERVAL 1 MONTH AS DATE) AS ref_month, ln(p) AS level FROM grid WHERE p IS NOT NULL),
 st AS (SELECT m.entity, m.ref_month, m.level, f.info, f.alpha + f.b0 * q.lv + f.b1 * q.disc AS star FROM mo m ASOF JOIN fe f ON f.entity = m.entity AND f.info <= m.ref_month
   ASOF JOIN qa q ON q.entity = m.entity AND q.available <= m.ref_month)
SELECT entity, ref_month, info, {rnd('star', 'star')}, {rnd('star - level', 'gap_log')}, {rnd('(exp(star - level) - 1) * 100', 'misalignment_pct')} FROM st WHERE star - level IS NOT NULL""")
def _(spark, sf):
    return out(peer_gaps(panel_once(spark, sf)).where("gap_log is not null"), "star", "gap_log", "misalignment_pct", keep=("entity", "ref_month", "info"))


@query("parameter_band", "F16")
def _(spark, sf):
    g = settled(peer_gaps(panel_once(spark, sf)))
    return out(an.parameter_band(g, XS, 13, 2000, [0.1, 0.9]), "gap_log", "gap_p10", "gap_p90")


DRAWS = 300


def bootstrap_draws(q):
    return an.cluster_bootstrap(q, "entity", "quarter", "lp", XS, 1, DRAWS, 14, 3)


@query("cluster_bootstrap", "F17")
def _(spark, sf):
    d = bootstrap_draws(settled(quarter_panel(panel_once(spark, sf))))
    return d.select("entity", "draw", r6(F.col("b")[0]).alias("slope_lv"), r6(F.col("b")[1]).alias("slope_disc"), r6("alpha").alias("alpha"))


def month_gap_draws(panel):
    """Every month's anchor gap under each bootstrap draw, from the latest published regressors and the latest level."""
    q = settled(quarter_panel(panel))
    m = an.asof(month_levels(panel).withColumn("_at", F.col("ref_month")), q.select("entity", "available", *XS), E, "_at", "available", XS).drop("_at", "fact_time")
    return an.gap_draws(m, settled(bootstrap_draws(q)), "entity", XS, "level").where("draws[0] IS NOT NULL")


@query("bootstrap_gap_band", "F17")
def _(spark, sf):
    d = with_percentiles(month_gap_draws(panel_once(spark, sf)), "draws", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return out(d, "level", "p10", "p50", "p90")


@query("bootstrap_corridor", "F21")
def _(spark, sf):
    """Draws of the norm-based gap mixed with the anchor's bootstrap draws under drawn weights: equal, anchor only, by inverse spread."""
    panel = panel_once(spark, sf)
    two = month_gap_draws(panel)
    one = banded(panel).where("gap IS NOT NULL").withColumn("draws_b", F.transform("gap_draws", lambda g: F.log(F.when(g > -100, 1 + g / 100))))
    d = an.asof(two.withColumn("_at", F.col("ref_month")), one.select("entity", "available", "draws_b"), E, "_at", "available", ["draws_b"]).where("draws_b IS NOT NULL")
    d = d.join(F.broadcast(draw_table(spark, 23, P["draws"], [], ["anchor", "scheme"])))          # one row
    spread = lambda c: F.aggregate(F.filter(c, lambda v: v.isNotNull()), F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
                                   lambda a, v: F.struct((a["n"] + 1).alias("n"), (a["s"] + v).alias("s"), (a["q"] + v * v).alias("q")),
                                   lambda a: a["q"] / a["n"] - (a["s"] / a["n"]) * (a["s"] / a["n"]))
    d = d.withColumns({"_va": spread("draws"), "_vb": spread("draws_b")}).withColumns({
        "draws_a": F.transform("anchor", lambda u: F.get(F.col("draws"), F.floor(u * DRAWS).cast("int"))),
        "weights": F.array(F.lit(0.5), F.lit(1.0), F.coalesce(F.try_divide(F.col("_vb"), F.col("_va") + F.col("_vb")), F.lit(0.5))),
        "picks": F.transform("scheme", lambda u: F.floor(u * 3).cast("int"))})
    d = d.withColumn("joint", combine_draws(d, "draws_a", "draws_b", "weights", "picks"))
    return out(with_percentiles(d, "joint", {"lo": 0.1, "mid": 0.5, "hi": 0.9}), "lo", "mid", "hi")


@query("entity_anchor", "F18")
def _(spark, sf):
    panel = panel_once(spark, sf)
    q = settled(quarter_panel(panel))
    fits = an.entity_fits(q, E, "quarter", "lp", XS, 1, 18, 1, 4)
    fits = fits.withColumn("origin", F.add_months("origin", 4))          # a quarter is public four months later
    x = q.select("entity", F.col("available").alias("at"), *XS)
    m = an.asof(month_levels(panel).withColumn("_at", F.col("ref_month")), x, E, "_at", "at", XS).drop("_at", "fact_time")
    d = an.entity_gaps(m, fits, E, "ref_month", "level", XS)
    return out(d.where("gap_log is not null"), "star", "gap_log")


@query("behavioural_anchor", "F19")
def _(spark, sf):
    m = settled(panel_once(spark, sf).select("entity", "ref_month", F.log("p").alias("q"), F.log("v").alias("lv"), (F.col("tax") * 10).alias("tax")))
    fits = an.entity_fits(m, E, "ref_month", "q", ["lv", "tax"], 1, 48, 6, 6)
    d = m
    for x in ("lv", "tax"):
        d = tr.one_sided_trend(d, E, "ref_month", x, 129600.0, 36).withColumnRenamed("trend", f"{x}_perm")
    d = an.entity_gaps(d, fits, E, "ref_month", "q", ["lv", "tax"], ["lv_perm", "tax_perm"])
    return out(d.where("gap_log is not null"), "star", "gap_log", "gap_log_total", keep=("entity", "ref_month", "origin"))


@query("expost_gap", "F22")
def _(spark, sf):
    panel = panel_once(spark, sf)
    q = settled(quarter_panel(panel))
    fit, eff = an.pooled_fit(q, [], "entity", "quarter", "lp", XS, 1)
    finals = eff.crossJoin(F.broadcast(fit.select("b")))                 # one row
    g = gapped(panel).where("gap is not null")
    # the norm published a year later, applied to the quarter's own balance
    later = g.select("entity", "quarter", F.lead("norm_path", 4).over(an.whole(E).orderBy("quarter")).alias("norm_later"), "underlying", "response")
    other = F.log(1 - (F.col("underlying") - F.col("norm_later")) / F.col("response") / 100)
    later = later.select("entity", "quarter", other.alias("gap_other")).where("gap_other is not null")
    months = panel.select("entity", "ref_month", F.trunc("ref_month", "QUARTER").alias("quarter"), F.log("p").alias("level")).where("level is not null")
    d = an.expost_gaps(months.join(q.drop("available", "lp"), ["entity", "quarter"]), finals, "entity", XS, later)
    return out(d, "gap_anchor", "gap_other", "gap_expost")
