"""Forecast and score queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitpanel.functions.columns import r6
from pitpanel.functions.tails import p_chi2_upper, p_normal_upper, p_t_two
from pitpanel.operators import breaks as br
from pitpanel.operators import calendar as cal
from pitpanel.operators import forecast as fc
from pitpanel.operators import gaps as gp
from pitpanel.operators import regression as rg
from pitpanel.operators import scan
from pitpanel.plans.calendar import E, grid
from pitpanel.plans.inputs import table
from pitpanel.plans.registry import query
from pitpanel.plans.sql import COMP, GRID, LEAST, NM, forecast_cte, mean_test_cte, rnd, shown, target_cte, with_
from pitpanel.session import settled

HORIZONS = [1, 3, 6, 12]
H_SQL = "(1), (3), (6), (12)"
MIN_TRAIN = 24


def out(d, *cols, keep=("entity", "h")):
    return d.select(*keep, *[r6(c).alias(c) for c in cols])


def comp_table(spark, sf):
    """level, gap_a, gap_b and their composite per month."""
    g = grid(spark, sf)
    gap = lambda c: F.log(F.col(c) / cal.trailing_full(E, "ref_month", c, 12))
    d = g.withColumns({"level": F.log("p"), "gap_a": gap("v"), "gap_b": gap("p")})
    return gp.composite(d, "gap_a", "gap_b", 0.5, 0.5, "p")


def fc_table(spark, sf, x="ect", horizons=HORIZONS, window=None):
    return fc.forecasts(comp_table(spark, sf), E, "ref_month", "level", x, horizons, MIN_TRAIN, window)


BASE = [NM, GRID, COMP, target_cte("tg", "comp", "ect", H_SQL), forecast_cte("fc", "tg", MIN_TRAIN)]
WITH = with_(*BASE)

def enough(d, n, *cols):
    """Statistics of fewer than LEAST observations are NULL; the row stays with its count."""
    return d.withColumns({c: F.when(F.col(n) >= LEAST, F.col(c)) for c in cols})


SCORES = f"""count(y) AS n_oos, CASE WHEN count(y) >= 12 THEN min(ref_month) FILTER (y IS NOT NULL) END AS first, CASE WHEN count(y) >= 12 THEN max(ref_month) FILTER (y IS NOT NULL) END AS last,
 {shown('sqrt(avg(y * y))', 'rmse_zero', 'count(y)')}, {shown('sqrt(avg((y - f_drift) ** 2))', 'rmse_drift', 'count(y)')}, {shown('sqrt(avg((y - f_model) ** 2))', 'rmse_model', 'count(y)')},
 {shown('sqrt(avg((y - f_model) ** 2)) / sqrt(avg((y - f_drift) ** 2))', 'rmse_ratio', 'count(y)')},
 {shown('1 - sum((y - f_model) ** 2) / sum((y - f_drift) ** 2)', 'oos_r2', 'count(y)')}, {shown('avg(CASE WHEN sign(f_model) = sign(y) THEN 1.0 ELSE 0.0 END) FILTER (y IS NOT NULL)', 'hit_rate', 'count(y)')},
 {shown('avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) FILTER (y IS NOT NULL)', 'naive_hit_rate', 'count(y)')},
 {shown('avg(CASE WHEN sign(f_model - f_drift) = sign(y - f_drift) THEN 1.0 ELSE 0.0 END) FILTER (y IS NOT NULL)', 'hit_rate_excess', 'count(y)')},
 {shown('avg(CASE WHEN f_model < 0 THEN 1.0 ELSE 0.0 END) FILTER (y IS NOT NULL)', 'share_down', 'count(y)')},
 {shown('min(slope)', 'slope_min', 'count(y)')}, {shown('max(slope)', 'slope_max', 'count(y)')}, {shown('max_by(slope, ref_month)', 'slope_last', 'count(y)')}"""
CARD = ["rmse_zero", "rmse_drift", "rmse_model", "rmse_ratio", "oos_r2", "hit_rate", "naive_hit_rate", "hit_rate_excess", "share_down",
        "slope_min", "slope_max", "slope_last"]


@query("expanding_forecasts", "H1", WITH + f"""
SELECT entity, h, ref_month, {rnd('x', 'x')}, {rnd('y', 'y')}, {rnd('f_drift', 'f_drift')}, {rnd('f_model', 'f_model')}, {rnd('slope', 'slope')}, n_train FROM fc""")
def _(spark, sf):
    return out(fc_table(spark, sf), "x", "y", "f_drift", "f_model", "slope", keep=("entity", "h", "ref_month", "n_train"))


@query("forecast_score_card", "H2", WITH + f"SELECT entity, h, {SCORES} FROM fc GROUP BY 1, 2")
def _(spark, sf):
    d = fc.score_card(fc_table(spark, sf), ["entity", "h"], "ref_month")
    return out(d, *CARD, keep=("entity", "h", "n_oos", "first", "last"))


# The whole chain on what was public: lag one month, carry two, partial 12-month norm, log gaps,
# composite, 3-month forecasts, scores.
PUBLIC = """pub AS (SELECT entity, CAST(ref_month + INTERVAL 1 MONTH AS DATE) AS ref_month, last_value(v IGNORE NULLS) OVER c AS v, last_value(p IGNORE NULLS) OVER c AS p FROM grid
   WINDOW c AS (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
 pcomp AS (SELECT entity, ref_month, ln(p) AS level, CASE WHEN count(v) OVER o >= 6 AND count(p) OVER o >= 6 THEN 0.5 * ln(v / avg(v) OVER o) + 0.5 * ln(p / avg(p) OVER o) END AS ect FROM pub
   WINDOW o AS (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""


@query("public_score_card", "B8 B9 B31 F12 H1 H2", with_(NM, GRID, PUBLIC, target_cte("tg", "pcomp", "ect", "(3)"), forecast_cte("fc", "tg", MIN_TRAIN)) +
       f"SELECT entity, h, {SCORES} FROM fc GROUP BY 1, 2")
def _(spark, sf):
    g = grid(spark, sf)
    known = g.select("entity", F.add_months("ref_month", 1).alias("ref_month"), *[cal.carry_forward(g, E, "ref_month", c, 2).alias(c) for c in ("v", "p")])
    gap = lambda c: F.log(F.col(c) / cal.trailing_partial(E, "ref_month", c, 12, 6))
    d = known.withColumns({"level": F.log("p"), "gap_a": gap("v"), "gap_b": gap("p")})
    d = gp.composite(d, "gap_a", "gap_b", 0.5, 0.5, "p")
    f = fc.forecasts(d, E, "ref_month", "level", "ect", [3], MIN_TRAIN)
    s = fc.score_card(f, ["entity", "h"], "ref_month")
    return out(s, *CARD, keep=("entity", "h", "n_oos", "first", "last"))


ADJ = "ad AS (SELECT *, (y - f_drift) ** 2 - ((y - f_model) ** 2 - (f_drift - f_model) ** 2) AS adj, (y - f_drift) ** 2 - (y - f_model) ** 2 AS loss FROM fc)"


@query("clark_west", "H3", with_(*BASE, ADJ, mean_test_cte("mt", "ad", "adj")) + f"SELECT entity, h, n, {shown('t', 'stat')} FROM mt")
def _(spark, sf):
    d = fc.clark_west(fc_table(spark, sf), ["entity", "h"], "ref_month", 12)
    return out(enough(d, "n", "stat"), "stat", keep=("entity", "h", "n"))


@query("diebold_mariano", "H4", with_(*BASE, ADJ, mean_test_cte("mt", "ad", "loss")) + f"""
SELECT entity, h, n, {shown('t * sqrt((n + 1 - 2 * h + h * (h - 1) / CAST(n AS DOUBLE)) / n)', 'stat')} FROM mt""")
def _(spark, sf):
    d = fc.diebold_mariano(fc_table(spark, sf), ["entity", "h"], "ref_month", 12)
    return out(enough(d, "n", "stat"), "stat", keep=("entity", "h", "n"))


@query("forecast_test_pvalues", "H3 H4")
def _(spark, sf):
    f = settled(fc_table(spark, sf))
    by = ["entity", "h"]
    cw = fc.clark_west(f, by, "ref_month", 12).select(*by, "n", p_normal_upper("stat").alias("clark_west_p"))
    dm = fc.diebold_mariano(f, by, "ref_month", 12).select(*by, p_t_two("stat", F.col("n") - 1.0).alias("diebold_mariano_p"))
    return out(cw.join(dm, by).where("n >= 12"), "clark_west_p", "diebold_mariano_p", keep=("entity", "h", "n"))


@query("overlap_robust_slope", "H5", with_(NM, GRID, COMP) + f"""
, d AS (SELECT entity, ref_month, level, ect AS x, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY entity) AS nn, lead(level) OVER w - level AS r
   FROM comp WHERE level IS NOT NULL AND ect IS NOT NULL WINDOW w AS (PARTITION BY entity ORDER BY ref_month)),
 e AS (SELECT *, r - avg(r) OVER (PARTITION BY entity) AS eps FROM d),
 z AS (SELECT a.entity, k.h, a.i, a.x, a.nn, a.eps, f.level - a.level AS y, (SELECT sum(b.x) FROM d b WHERE b.entity = a.entity AND b.i BETWEEN a.i - k.h + 1 AND a.i) AS sx
   FROM e a CROSS JOIN (VALUES (3), (12)) k(h) LEFT JOIN d f ON f.entity = a.entity AND f.i = a.i + k.h),
 g AS (SELECT entity, h, count(y) AS n, regr_slope(y, x) AS beta, regr_intercept(y, x) AS const, avg(x) FILTER (y IS NOT NULL) AS m1, avg(x * x) FILTER (y IS NOT NULL) AS m2,
   avg(eps * eps * h * h) FILTER (i >= h - 1 AND i < nn - 1) AS s11, avg(eps * eps * h * sx) FILTER (i >= h - 1 AND i < nn - 1) AS s12, avg(eps * eps * sx * sx) FILTER (i >= h - 1 AND i < nn - 1) AS s22 FROM z GROUP BY 1, 2),
 v AS (SELECT *, sqrt((m1 * m1 * s11 - 2 * m1 * s12 + s22) / ((m2 - m1 * m1) ** 2) / n) AS se FROM g)
SELECT entity, h, n, {rnd('beta', 'beta')}, {rnd('const', 'const')}, {rnd('se', 'se')}, {rnd('beta / se', 't')} FROM v""")
def _(spark, sf):
    return out(fc.overlap_robust_slope(comp_table(spark, sf), E, "ref_month", "level", "ect", [3, 12]), "beta", "const", "se", "t", keep=("entity", "h", "n"))


@query("non_overlapping_slopes", "H6", with_(NM, GRID, COMP) + f"""
, c AS (SELECT entity, ref_month, level, ect AS x, row_number() OVER (PARTITION BY entity ORDER BY ref_month) AS i FROM comp WHERE level IS NOT NULL AND ect IS NOT NULL),
 t AS (SELECT a.entity, k.h, a.x, f.level - a.level AS y, (a.i - 1) % k.h AS off FROM c a CROSS JOIN (VALUES (3), (6)) k(h) JOIN c f ON f.entity = a.entity AND f.i = a.i + k.h),
 p AS (SELECT entity, h, off, count(*) AS n, regr_slope(y, x) AS b, regr_slope(y, x) / sqrt((regr_syy(y, x) - regr_slope(y, x) ** 2 * regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS t FROM t GROUP BY 1, 2, 3 HAVING count(*) >= 8)
SELECT entity, h, {rnd('quantile_cont(b, 0.5)', 'beta_median')}, {rnd('min(b)', 'beta_min')}, {rnd('max(b)', 'beta_max')}, {rnd('quantile_cont(t, 0.5)', 't_median')}, count(*) AS offsets FROM p GROUP BY 1, 2""")
def _(spark, sf):
    d = fc.non_overlapping_slopes(comp_table(spark, sf), E, "ref_month", "level", "ect", [3, 6]).where("offsets > 0")
    return out(d, "beta_median", "beta_min", "beta_max", "t_median", keep=("entity", "h", "offsets"))


@query("state_conditional_slope", "H7")
def _(spark, sf):
    d = settled(comp_table(spark, sf)).withColumn("prob", 1 / (1 + F.exp(-(F.col("n") - 7.5) / 3)))
    fit = fc.state_conditional(d, E, "ref_month", "level", "ect", "prob", 3)
    return out(rg.terms(fit, E, ["const", "x_calm", "x_stress"]), "coef", "se", "t", "p", "r2", keep=("entity", "n", "term"))


@query("current_forecast", "H8", with_(NM, GRID, COMP, target_cte("tg", "comp", "ect", H_SQL)) + f"""
, u AS (SELECT *, row_number() OVER (PARTITION BY entity, h ORDER BY ref_month DESC) AS back FROM tg WHERE x IS NOT NULL AND y IS NOT NULL),
 f AS (SELECT entity, h, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, min(ref_month) AS train_from, max(ref_month) AS train_to FROM u WHERE back <= 36 GROUP BY 1, 2),
 m AS (SELECT entity, h, avg(y) AS drift FROM u GROUP BY 1, 2),
 l AS (SELECT entity, h, max(ref_month) AS as_of, max_by(x, ref_month) AS x FROM tg WHERE x IS NOT NULL GROUP BY 1, 2)
SELECT f.entity, f.h, as_of, train_from, train_to, {rnd('l.x', 'x')}, {rnd('b', 'slope')}, {rnd('a + b * l.x', 'forecast')}, {rnd('drift', 'drift_only')}
FROM f JOIN m USING (entity, h) JOIN l USING (entity, h)""")
def _(spark, sf):
    d = fc.current_forecast(comp_table(spark, sf), E, "ref_month", "level", "ect", HORIZONS, 36).where("train_from is not null")
    return out(d, "x", "slope", "forecast", "drift_only", keep=("entity", "h", "as_of", "train_from", "train_to"))


WINDOWS = [24, 30, 36, 42, 48]


@query("rolling_window_sweep", "H16", with_(NM, GRID, COMP, target_cte("tg", "comp", "ect", H_SQL)) + f"""
, pr AS (SELECT o.entity, o.h, o.ref_month, o.x, o.y, t.x AS tx, t.y AS ty, row_number() OVER (PARTITION BY o.entity, o.h, o.ref_month ORDER BY t.ref_month DESC) AS back, count(*) OVER (PARTITION BY o.entity, o.h, o.ref_month) AS k
   FROM tg o JOIN tg t ON t.entity = o.entity AND t.h = o.h AND t.x IS NOT NULL AND t.y IS NOT NULL AND CAST(t.ref_month + INTERVAL 1 MONTH * t.h AS DATE) <= o.ref_month WHERE o.x IS NOT NULL),
 f AS (SELECT entity, h, ref_month, w, x, y, avg(ty) AS f0, regr_intercept(ty, tx) FILTER (back <= w) + regr_slope(ty, tx) FILTER (back <= w) * x AS f1 FROM pr CROSS JOIN (VALUES {", ".join(f"({w})" for w in WINDOWS)}) q(w) WHERE k >= 24 GROUP BY 1, 2, 3, 4, 5, 6),
 s AS (SELECT entity, h, w, count(y) AS n, CASE WHEN count(y) >= 12 THEN sqrt(avg((y - f1) ** 2)) / sqrt(avg((y - f0) ** 2)) END AS ratio FROM f GROUP BY 1, 2, 3)
SELECT entity, h, w AS "window", n AS n_oos, {rnd('ratio', 'rmse_ratio')}, {rnd('quantile_cont(ratio, 0.5) OVER (PARTITION BY entity, h)', 'median_ratio')} FROM s""")
def _(spark, sf):
    c = settled(comp_table(spark, sf))
    runs = None
    for w in WINDOWS:
        s = fc.score_card(fc.forecasts(c, E, "ref_month", "level", "ect", HORIZONS, MIN_TRAIN, w), ["entity", "h"], "ref_month")
        s = s.select("entity", "h", F.lit(w).alias("window"), "n_oos", "rmse_ratio")
        runs = s if runs is None else runs.unionByName(s)
    runs = runs.withColumn("median_ratio", F.percentile("rmse_ratio", F.lit(0.5)).over(Window.partitionBy("entity", "h")))
    return out(runs, "rmse_ratio", "median_ratio", keep=("entity", "h", "window", "n_oos"))


SCHEMES = {"equal": (0.5, 0.5), "a_only": (1.0, 0.0), "b_only": (0.0, 1.0)}
SCHEME_SQL = """sc AS (SELECT s.scheme, CAST(c.entity AS VARCHAR) || '/' || s.scheme AS entity, c.ref_month, c.level, s.wa * gap_a + (1 - s.wa) * gap_b AS x
  FROM comp c CROSS JOIN (VALUES ('equal', 0.5::DOUBLE), ('a_only', 1.0::DOUBLE), ('b_only', 0.0::DOUBLE)) s(scheme, wa))"""


def scheme_forecasts(spark, sf):
    c = comp_table(spark, sf)
    cells = F.array(*[F.struct(F.lit(n).alias("scheme"), (F.lit(wa) * F.col("gap_a") + (1 - F.lit(wa)) * F.col("gap_b")).alias("x"))
                      for n, (wa, _) in SCHEMES.items()])
    d = c.select("entity", "ref_month", "level", F.inline(cells))
    return fc.forecasts(d, ["entity", "scheme"], "ref_month", "level", "x", [3, 12], MIN_TRAIN)


SCHEME_BASE = [NM, GRID, COMP, SCHEME_SQL, target_cte("tg", "sc", "x", "(3), (12)"), forecast_cte("fc", "tg", MIN_TRAIN), ADJ, mean_test_cte("mt", "ad", "adj"),
               "ev AS (SELECT entity, h, count(y) AS n_oos, sqrt(avg((y - f_model) ** 2)) / sqrt(avg((y - f_drift) ** 2)) AS rmse_ratio FROM fc GROUP BY 1, 2)",
               "sv AS (SELECT CAST(split_part(ev.entity, '/', 1) AS INT) AS entity, split_part(ev.entity, '/', 2) AS scheme, ev.h, n_oos, CASE WHEN n_oos >= 12 THEN rmse_ratio END AS rmse_ratio, CASE WHEN n_oos >= 12 THEN mt.t END AS cw FROM ev LEFT JOIN mt ON mt.entity = ev.entity AND mt.h = ev.h)"]


def scheme_scores(spark, sf):
    f = settled(scheme_forecasts(spark, sf))
    by = ["entity", "scheme", "h"]
    s = fc.score_card(f, by, "ref_month").select(*by, "n_oos", "rmse_ratio")
    return enough(s.join(fc.clark_west(f, by, "ref_month", 12).select(*by, F.col("stat").alias("cw")), by, "left"), "n_oos", "cw")


@query("weight_scheme_scores", "F31", with_(*SCHEME_BASE) + f"SELECT entity, scheme, h, n_oos, {rnd('rmse_ratio', 'rmse_ratio')}, {rnd('cw', 'cw')} FROM sv")
def _(spark, sf):
    return out(scheme_scores(spark, sf), "rmse_ratio", "cw", keep=("entity", "scheme", "h", "n_oos"))


@query("preset_decision_rule", "H17", with_(*SCHEME_BASE) + """
, r AS (SELECT a.*, b.rmse_ratio AS l0, b.cw AS c0 FROM sv a JOIN sv b ON b.entity = a.entity AND b.h = a.h AND b.scheme = 'equal'),
 k AS (SELECT *, scheme <> 'equal' AND l0 - rmse_ratio >= 0.01 AND -cw < -c0 AS better FROM r)
SELECT entity, h, coalesce(min_by(scheme, struct_pack(l := rmse_ratio, s := scheme)) FILTER (better), 'equal') AS choice, count(*) FILTER (better) AS candidates FROM k GROUP BY 1, 2""")
def _(spark, sf):
    # a lower one-sided p is a higher statistic
    s = scheme_scores(spark, sf).withColumn("neg_cw", -F.col("cw"))
    return fc.choose(s, ["entity", "h"], "scheme", "equal", "rmse_ratio", "neg_cw", 0.01)


@query("performance_weights", "F30", with_(*SCHEME_BASE[:6]) + f"""
, er AS (SELECT CAST(split_part(entity, '/', 1) AS INT) AS entity, split_part(entity, '/', 2) AS scheme, CAST(ref_month + INTERVAL 3 MONTH AS DATE) AS known, (y - f_model) ** 2 AS se FROM fc WHERE h = 3 AND y IS NOT NULL),
 w AS (SELECT c.entity, c.ref_month, count(*) FILTER (scheme = 'a_only') AS na, count(*) FILTER (scheme = 'b_only') AS nb, avg(se) FILTER (scheme = 'a_only') AS ma, avg(se) FILTER (scheme = 'b_only') AS mb
   FROM comp c LEFT JOIN er ON er.entity = c.entity AND er.known <= c.ref_month WHERE c.ect IS NOT NULL GROUP BY 1, 2)
SELECT entity, ref_month, {rnd('CASE WHEN na >= 12 AND nb >= 12 THEN (1 / ma) / (1 / ma + 1 / mb) ELSE 0.5 END', 'weight')} FROM w""")
def _(spark, sf):
    f = scheme_forecasts(spark, sf).where("h = 3 and y is not null and scheme <> 'equal'")
    err = f.select("entity", F.add_months("ref_month", 3).alias("known_month"), F.substring("scheme", 1, 1).alias("component"),
                   ((F.col("y") - F.col("f_model")) * (F.col("y") - F.col("f_model"))).alias("se"))
    months = comp_table(spark, sf).where("ect is not null").select("entity", "ref_month")
    return gp.performance_weight(err, months, E, 12).select("entity", "ref_month", r6("weight").alias("weight"))


@query("log_likelihood_table", "H20", with_(NM, GRID, COMP, target_cte("tg", "comp", "ect", "(3)")) + f"""
, f AS (SELECT entity, count(*) AS n, regr_syy(y, x) AS s0, regr_syy(y, x) - regr_slope(y, x) ** 2 * regr_sxx(y, x) AS s1 FROM tg WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1 HAVING count(*) > 2),
 l AS (SELECT entity, n, 'constant' AS model, 2 AS k, -n / 2.0 * (ln(2 * pi() * s0 / n) + 1) AS ll, s0, s0 AS s FROM f UNION ALL SELECT entity, n, 'gap', 3, -n / 2.0 * (ln(2 * pi() * s1 / n) + 1), s0, s1 FROM f)
SELECT entity, n, model, k, {rnd('ll', 'loglik')}, {rnd('2 * k - 2 * ll', 'aic')}, {rnd('k * ln(n) - 2 * ll', 'bic')}, {rnd('n * ln(s0 / s)', 'lr')} FROM l""")
def _(spark, sf):
    return out(likelihoods(spark, sf), "loglik", "aic", "bic", "lr", keep=("entity", "n", "model", "k"))


def likelihoods(spark, sf):
    t = fc.targets(comp_table(spark, sf), E, "ref_month", "level", ["ect"], [3])
    both = settled(t.dropna(subset=["y", "ect"]))
    null, alt = rg.ols(both, E, "y", []).where("n > 2"), rg.ols(both, E, "y", ["ect"])
    rows = [d.select("entity", "n", F.lit(name).alias("model"), "k", "ssr") for name, d in (("constant", null), ("gap", alt))]
    return br.likelihood_table(rows[0].unionByName(rows[1]), E, "constant")


@query("likelihood_ratio_pvalues", "H20")
def _(spark, sf):
    d = likelihoods(spark, sf).where("model <> 'constant'")
    return out(d.withColumn("lr_p", p_chi2_upper(F.col("lr"), F.lit(1.0))), "lr", "lr_p", keep=("entity", "model"))


@query("directional_evaluation", "H21", WITH + f"""
, d AS (SELECT *, rank() OVER (PARTITION BY entity, h ORDER BY y) AS r1, rank() OVER (PARTITION BY entity, h ORDER BY f_model) AS r2, sign(f_model) * y AS ret FROM fc WHERE y IS NOT NULL),
 c AS (SELECT *, sum(ret) OVER (PARTITION BY entity, h ORDER BY ref_month) AS cum FROM d)
SELECT entity, h, count(*) AS n, {shown('avg(CASE WHEN sign(f_model) = sign(y) THEN 1.0 ELSE 0.0 END)', 'hit_rate', 'count(*)')}, {shown('corr(y, f_model)', 'pearson', 'count(*)')}, {shown('corr(r1, r2)', 'spearman', 'count(*)')},
 {shown('avg(ret)', 'mean_return', 'count(*)')}, {shown('max_by(cum, ref_month)', 'total_return', 'count(*)')}, {shown('min(cum)', 'worst_total', 'count(*)')}, {shown('avg(ret) / stddev_samp(ret) * sqrt(12)', 'information_ratio', 'count(*)')} FROM c GROUP BY 1, 2""")
def _(spark, sf):
    d = fc.directional_scores(fc_table(spark, sf), ["entity", "h"], "ref_month")
    d = enough(d, "n", "hit_rate", "pearson", "spearman", "mean_return", "total_return", "worst_total", "information_ratio")
    return out(d, "hit_rate", "pearson", "spearman", "mean_return", "total_return", "worst_total", "information_ratio", keep=("entity", "h", "n"))


@query("accuracy_by_year", "H22", WITH + f"""
SELECT entity, h, CAST(year(ref_month) AS INT) AS year, count(*) AS n, {rnd('sqrt(avg((y - f_model) ** 2))', 'rmse_model')}, {rnd('sqrt(avg((y - f_drift) ** 2))', 'rmse_drift')},
 {rnd('avg(abs(y - f_model))', 'mae_model')}, {rnd('avg(CASE WHEN sign(f_model) = sign(y) THEN 1.0 ELSE 0.0 END)', 'hit_rate')} FROM fc WHERE y IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, sf):
    d = fc_table(spark, sf).where("y is not null").groupBy("entity", "h", F.year("ref_month").alias("year")).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("y") - F.col("f_model"), 2))).alias("rmse_model"),
        F.sqrt(F.avg(F.pow(F.col("y") - F.col("f_drift"), 2))).alias("rmse_drift"), F.avg(F.abs(F.col("y") - F.col("f_model"))).alias("mae_model"),
        F.avg((F.signum("f_model") == F.signum("y")).cast("double")).alias("hit_rate"))
    return out(d, "rmse_model", "rmse_drift", "mae_model", "hit_rate", keep=("entity", "h", "year", "n"))


@query("sup_wald_break", "H13", with_(NM, GRID, COMP, target_cte("tg", "comp", "ect", "(3)")) + f"""
, d AS (SELECT entity, ref_month, x, y, row_number() OVER (PARTITION BY entity ORDER BY ref_month) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM tg WHERE x IS NOT NULL AND y IS NOT NULL),
 s0 AS (SELECT entity, regr_syy(y, x) - coalesce(regr_sxy(y, x) ** 2 / nullif(regr_sxx(y, x), 0), 0) AS ssr0 FROM d GROUP BY 1),
 c AS (SELECT a.entity, a.i AS j, a.ref_month, a.n,
   regr_syy(b.y, b.x) FILTER (b.i < a.i) - coalesce(regr_sxy(b.y, b.x) FILTER (b.i < a.i) ** 2 / nullif(regr_sxx(b.y, b.x) FILTER (b.i < a.i), 0), 0)
   + regr_syy(b.y, b.x) FILTER (b.i >= a.i) - coalesce(regr_sxy(b.y, b.x) FILTER (b.i >= a.i) ** 2 / nullif(regr_sxx(b.y, b.x) FILTER (b.i >= a.i), 0), 0) AS ssr1
   FROM d a JOIN d b ON b.entity = a.entity WHERE a.i >= CAST(floor(a.n * 0.15::DOUBLE) AS INT) AND a.i < CAST(floor(a.n * 0.85::DOUBLE) AS INT) GROUP BY 1, 2, 3, 4),
 f AS (SELECT c.*, (ssr0 - ssr1) / 2 / (ssr1 / (n - 4)) AS F FROM c JOIN s0 USING (entity))
SELECT l.entity, l.n, {shown('max(F)', 'stat', 'l.n')}, CASE WHEN l.n >= 12 THEN arg_max(ref_month, F) END AS at FROM (SELECT DISTINCT entity, n FROM d) l LEFT JOIN f ON f.entity = l.entity GROUP BY 1, 2""")
def _(spark, sf):
    t = fc.targets(comp_table(spark, sf), E, "ref_month", "level", ["ect"], [3])
    return enough(br.sup_wald(t, E, "ref_month", "y", "ect"), "n", "stat", "at").select("entity", "n", r6("stat").alias("stat"), "at")


@query("sup_wald_mean_break", "H13", with_(NM, GRID, COMP) + f"""
, d AS (SELECT entity, ref_month, gap_a AS y, row_number() OVER (PARTITION BY entity ORDER BY ref_month) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM comp WHERE gap_a IS NOT NULL),
 s0 AS (SELECT entity, var_pop(y) * count(*) AS ssr0 FROM d GROUP BY 1),
 c AS (SELECT a.entity, a.i AS j, a.ref_month, a.n, var_pop(b.y) FILTER (b.i < a.i) * count(*) FILTER (b.i < a.i) + var_pop(b.y) FILTER (b.i >= a.i) * count(*) FILTER (b.i >= a.i) AS ssr1
   FROM d a JOIN d b ON b.entity = a.entity WHERE a.i >= CAST(floor(a.n * 0.15::DOUBLE) AS INT) AND a.i < CAST(floor(a.n * 0.85::DOUBLE) AS INT) GROUP BY 1, 2, 3, 4),
 f AS (SELECT c.*, (ssr0 - ssr1) / 1 / (ssr1 / (n - 2)) AS F FROM c JOIN s0 USING (entity))
SELECT l.entity, l.n, {shown('max(F)', 'stat', 'l.n')}, CASE WHEN l.n >= 12 THEN arg_max(ref_month, F) END AS at FROM (SELECT DISTINCT entity, n FROM d) l LEFT JOIN f ON f.entity = l.entity GROUP BY 1, 2""")
def _(spark, sf):
    d = br.sup_wald(comp_table(spark, sf), E, "ref_month", "gap_a", None)
    return enough(d, "n", "stat", "at").select("entity", "n", r6("stat").alias("stat"), "at")


@query("break_bootstrap", "H14")
def _(spark, sf):
    t = fc.targets(comp_table(spark, sf), E, "ref_month", "level", ["ect"], [3])
    d = br.break_test(t, E, "ref_month", "y", "ect", reps=199, block=12, seed=29)
    return out(d, "stat", "p", "before_const", "before_slope", "after_const", "after_slope", keep=("entity", "n", "at"))


@query("sequential_breaks", "H15")
def _(spark, sf):
    d = br.sequential_breaks(comp_table(spark, sf), E, "ref_month", "gap_a", None, reps=199, block=6, seed=29, at_least=60, level=0.05)
    return out(d, "stat", "p", keep=("entity", "step", "n", "at"))


# ---- ranks over whole tables
@query("auc_from_ranks", "H19", f"""
WITH s AS (SELECT l.quality AS event, d.n_chars AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
 r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s)
SELECT sum(event)::BIGINT AS positives, sum(1 - event)::BIGINT AS negatives,
 {rnd('(sum(CASE WHEN event = 1 THEN rk END) - sum(event) * (sum(event) + 1) / 2.0) / (sum(event) * sum(1 - event))', 'auc')} FROM r""")
def _(spark, sf):
    s = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return br.auc(s, "n_chars", "quality").withColumn("auc", r6("auc"))


PV = """pv AS (SELECT p_partkey AS id, percent_rank() OVER (ORDER BY p_retailprice) * 0.2 + 0.0001 AS p FROM part)"""


def p_values(spark, sf):
    """percent_rank of the retail price, without a global window."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_retailprice")
    r = scan.add_before(scan.by_value(part, "p_retailprice", n=F.count("*")), "p_retailprice", ["n"])
    rank = r.select("p_retailprice", (F.col("n_before").cast("double") / (F.col("n_total") - 1) * 0.2 + 0.0001).alias("p"))
    return part.join(rank, "p_retailprice").select("id", "p")


@query("holm_adjustment", "I10", with_(PV) + f"""
, o AS (SELECT id, p, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS m FROM pv)
SELECT id, {rnd('p', 'p')}, {rnd('max(least(1.0, (m - i) * p)) OVER (ORDER BY p)', 'p_holm')} FROM o""")
def _(spark, sf):
    return br.holm(p_values(spark, sf), "p").select("id", r6("p").alias("p"), r6("p_holm").alias("p_holm"))


@query("benjamini_hochberg", "I11", with_(PV) + f"""
, o AS (SELECT id, p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS i, count(*) OVER () AS m FROM pv)
SELECT id, {rnd('p', 'p')}, {rnd('least(1.0, min(p * m / i) OVER (ORDER BY p DESC))', 'p_bh')} FROM o""")
def _(spark, sf):
    return br.benjamini_hochberg(p_values(spark, sf), "p").select("id", r6("p").alias("p"), r6("p_bh").alias("p_bh"))
