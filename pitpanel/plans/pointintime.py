"""Point-in-time, bitemporal and vintage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions.columns import r6
from pitpanel.operators import asof as pit
from pitpanel.operators import calendar as cal
from pitpanel.operators import splice as sp
from pitpanel.plans.calendar import TWO_GRID, E, grid, two_grid
from pitpanel.plans.inputs import long_panel, monthly_panel, releases, two_sources
from pitpanel.plans.registry import query
from pitpanel.plans.sql import GRID, LONG, NM, REL, TWO, rnd, with_
from pitpanel.session import settled

# Fixed settings: series, months until public, months a late print may be carried.
SETTINGS = [("v", 1, 2), ("p", 2, 2), ("n", 0, 0)]
SETTINGS_SQL = "st(series_id, lag, carry) AS (VALUES ('v', 1, 2), ('p', 2, 2), ('n', 0, 0))"


def settings(spark):
    return spark.createDataFrame(SETTINGS, "series_id string, lag int, carry int")


def pit_table(spark, sf):
    return pit.information_set(long_panel(spark, sf), settings(spark), E, ["v", "p", "n"], "n")


# each series shifted by its lag, cut at the last month of n, carried at most two months
PIT = """pw AS (
  SELECT g.entity, g.info_month, lv.v, lp.p, ln_.n FROM (
    SELECT entity, CAST(unnest(generate_series(min(m), max(e), INTERVAL 1 MONTH)) AS DATE) AS info_month
    FROM (SELECT entity, min(ref_month) AS m, max(ref_month) AS e FROM nm GROUP BY 1) GROUP BY 1) g
  LEFT JOIN (SELECT entity, CAST(ref_month + INTERVAL 1 MONTH AS DATE) AS im, v FROM nm) lv ON lv.entity = g.entity AND lv.im = g.info_month
  LEFT JOIN (SELECT entity, CAST(ref_month + INTERVAL 2 MONTH AS DATE) AS im, p FROM nm) lp ON lp.entity = g.entity AND lp.im = g.info_month
  LEFT JOIN (SELECT entity, ref_month AS im, CAST(n AS DOUBLE) AS n FROM nm) ln_ ON ln_.entity = g.entity AND ln_.im = g.info_month),
pit AS (SELECT entity, info_month,
  last_value(v IGNORE NULLS) OVER o AS v, last_value(p IGNORE NULLS) OVER o AS p, n FROM pw
  WINDOW o AS (PARTITION BY entity ORDER BY info_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""


@query("point_in_time_table", "C1", with_(NM, PIT) + f"""
SELECT entity, info_month, {rnd('v', 'v')}, {rnd('p', 'p')}, {rnd('n', 'n')}, {rnd('ln(v)', 'log_v')}, {rnd('ln(p)', 'log_p')},
  {rnd('v / n', 'cover')} FROM pit""")
def _(spark, sf):
    t = pit_table(spark, sf)
    return t.select("entity", "info_month", r6("v").alias("v"), r6("p").alias("p"), r6("n").alias("n"),
                    r6(F.log("v")).alias("log_v"), r6(F.log("p")).alias("log_p"), r6(F.col("v") / F.col("n")).alias("cover"))


ANNUAL = """an AS (SELECT entity, CAST(year(ref_month) AS INT) AS year, sum(v) AS value FROM nm GROUP BY 1, 2)"""
# growth over the last (at most) three years among the published ones, at each release
NOWCAST = """ng AS (SELECT entity, year, CAST(make_date(year, 12, 1) + INTERVAL 7 MONTH AS DATE) AS public, value,
    row_number() OVER w AS rn, value / first_value(value) OVER (PARTITION BY entity ORDER BY year ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS gr
    FROM an WINDOW w AS (PARTITION BY entity ORDER BY year)),
 np AS (SELECT *, CASE WHEN rn > 1 THEN power(gr, 1.0 / least(rn - 1, 3)) END AS g FROM ng)"""


def annual_total(spark, sf):
    return monthly_panel(spark, sf).groupBy("entity", F.year("ref_month").alias("year")).agg(F.sum("v").alias("value"))


@query("annual_nowcast", "C9", with_(NM, ANNUAL, NOWCAST) + f"""
SELECT t.entity, t.target, t.info, np.year, {rnd('np.value * power(g, ((year(t.target) - np.year) * 12 + month(t.target) - 7) / 12.0)', 'nowcast')}
FROM (SELECT entity, ref_month AS target, CAST(ref_month + INTERVAL 2 MONTH AS DATE) AS info FROM nm) t
ASOF LEFT JOIN np ON np.entity = t.entity AND np.public <= t.info""")
def _(spark, sf):
    targets = monthly_panel(spark, sf).select("entity", F.col("ref_month").alias("target"), F.add_months("ref_month", 2).alias("info"))
    return pit.nowcast(annual_total(spark, sf), targets, E, "value", 7, 3).withColumn("nowcast", r6("nowcast"))


QT = """qt AS (SELECT entity, CAST(date_trunc('quarter', ref_month) AS DATE) AS quarter, sum(v) AS flow, avg(p) AS price,
   CAST(date_trunc('quarter', ref_month) + INTERVAL 6 MONTH AS DATE) AS available FROM nm GROUP BY entity, date_trunc('quarter', ref_month))"""


def quarters(spark, sf):
    nm = monthly_panel(spark, sf).withColumnRenamed("v", "flow").withColumnRenamed("p", "price")
    return pit.quarterly_with_availability(nm, E, "ref_month", "flow", "price", 6)


@query("quarterly_availability", "C2", with_(NM, ANNUAL, NOWCAST, QT) + f"""
, j AS (SELECT qt.*, np.value * power(g, ((year(quarter + INTERVAL 1 MONTH) - np.year) * 12 + month(quarter + INTERVAL 1 MONTH) - 7) / 12.0) AS base
   FROM qt ASOF LEFT JOIN np ON np.entity = qt.entity AND np.public <= qt.available)
SELECT entity, quarter, available, {rnd('flow', 'flow')}, {rnd('price', 'price')}, {rnd('base', 'base')}, {rnd('flow * 4 / base * 100', 'pct_of_base')} FROM j""")
def _(spark, sf):
    q = quarters(spark, sf).withColumn("target", F.add_months("quarter", 1)).withColumn("info", F.col("available"))
    j = pit.nowcast(annual_total(spark, sf), q, E, "value", 7, 3)
    return j.select("entity", "quarter", "available", r6("flow").alias("flow"), r6("price").alias("price"),
                    r6("nowcast").alias("base"), r6(F.col("flow") * 4 / F.col("nowcast") * 100).alias("pct_of_base"))


FIRSTQ = """fr AS (SELECT entity, ref_month, min(realtime_start) AS released, min_by(value, realtime_start) AS value FROM rel GROUP BY 1, 2),
 fq AS (SELECT entity, CAST(date_trunc('quarter', ref_month) AS DATE) AS quarter, CAST(date_trunc('month', max(released)) AS DATE) AS available, sum(value) AS value FROM fr GROUP BY 1, 2)"""


def first_quarters(spark, sf):
    fr = pit.first_release(releases(spark, sf), E)
    return fr.groupBy("entity", F.trunc("ref_month", "QUARTER").alias("quarter")).agg(
        F.trunc(F.max("released"), "MM").alias("available"), F.sum("value").alias("value"))


@query("latest_public_quarter", "C3", with_(NM, GRID, REL, FIRSTQ) + f"""
, d AS (SELECT entity, available, max(quarter) AS quarter, max_by(value, quarter) AS value FROM fq GROUP BY 1, 2)
SELECT grid.entity, grid.ref_month, d.quarter, {rnd('d.value', 'value')} FROM grid ASOF LEFT JOIN d ON d.entity = grid.entity AND d.available <= grid.ref_month""")
def _(spark, sf):
    facts = first_quarters(spark, sf).withColumn("rank", F.unix_date("quarter"))
    probes = grid(spark, sf).select("entity", "ref_month", F.col("ref_month").alias("at"))
    j = pit.asof(probes, facts, E, "at", "available", ["quarter", "value"], order="rank")
    return j.select("entity", "ref_month", "quarter", r6("value").alias("value"))


@query("asof_with_backcast", "C4", with_(NM, GRID, REL, FIRSTQ) + f"""
, d AS (SELECT entity, available, max_by(value, quarter) AS value FROM fq GROUP BY 1, 2),
 f AS (SELECT entity, min_by(value, available) AS first FROM d GROUP BY 1)
SELECT grid.entity, grid.ref_month, {rnd('coalesce(d.value, f.first)', 'norm')},
  CASE WHEN d.value IS NULL THEN 'backcast' ELSE 'published' END AS label
FROM grid ASOF LEFT JOIN d ON d.entity = grid.entity AND d.available <= grid.ref_month JOIN f ON f.entity = grid.entity""")
def _(spark, sf):
    facts = first_quarters(spark, sf).groupBy("entity", "available").agg(F.max_by("value", "quarter").alias("value"))
    probes = grid(spark, sf).select("entity", "ref_month", F.col("ref_month").alias("at"))
    j = pit.asof(probes, facts, E, "at", "available", ["value"], first_if_none=True)
    return j.select("entity", "ref_month", r6("value").alias("norm"),
                    F.when(F.col("backcast"), "backcast").otherwise("published").alias("label"))


KNOWN = """kn AS (SELECT entity, ref_month, t.info_month, max_by(value, realtime_start) AS value FROM rel
  JOIN (SELECT CAST(unnest(generate_series((SELECT date_trunc('month', min(realtime_start)) FROM rel), (SELECT date_trunc('month', max(realtime_start)) FROM rel), INTERVAL 1 MONTH)) AS DATE) AS info_month) t
  ON realtime_start <= last_day(t.info_month) GROUP BY 1, 2, 3)"""


def known(rel):
    return pit.known_each_month(rel, E)


@query("series_as_known", "C5", with_(REL, KNOWN) + f"SELECT entity, ref_month, info_month, {rnd('value', 'value')} FROM kn")
def _(spark, sf):
    return known(releases(spark, sf)).withColumn("value", r6("value"))


YOY = """lt AS (SELECT entity, info_month, max(ref_month) AS ref_month FROM kn GROUP BY 1, 2),
 yo AS (SELECT lt.entity, lt.info_month, lt.ref_month, (a.value / b.value - 1) * 100 AS yoy FROM lt
  JOIN kn a ON a.entity = lt.entity AND a.info_month = lt.info_month AND a.ref_month = lt.ref_month
  LEFT JOIN kn b ON b.entity = lt.entity AND b.info_month = lt.info_month AND b.ref_month = CAST(lt.ref_month - INTERVAL 12 MONTH AS DATE))"""


@query("yoy_as_known", "C6", with_(REL, KNOWN, YOY) + f"SELECT entity, info_month, ref_month, {rnd('yoy', 'yoy')} FROM yo")
def _(spark, sf):
    return pit.yoy_as_known(known(releases(spark, sf)), E).withColumn("yoy", r6("yoy"))


@query("first_release", "C7", with_(REL, FIRSTQ) + f"SELECT entity, ref_month, released, {rnd('value', 'value')} FROM fr")
def _(spark, sf):
    return pit.first_release(releases(spark, sf), E).withColumn("value", r6("value"))


@query("realtime_vs_revised", "C8", with_(REL, KNOWN, YOY) + f"""
, fin AS (SELECT entity, ref_month, max_by(value, realtime_start) AS value FROM rel GROUP BY 1, 2),
 rv AS (SELECT a.entity, CAST(a.ref_month + INTERVAL 1 MONTH AS DATE) AS info_month, (a.value / b.value - 1) * 100 AS yoy FROM fin a
   JOIN fin b ON b.entity = a.entity AND b.ref_month = CAST(a.ref_month - INTERVAL 12 MONTH AS DATE))
SELECT yo.entity, count(*) AS n, min(yo.info_month) AS first, {rnd('avg(abs(yo.yoy - rv.yoy))', 'mean_abs')}, {rnd('max(abs(yo.yoy - rv.yoy))', 'max_abs')}
FROM yo JOIN rv ON rv.entity = yo.entity AND rv.info_month = yo.info_month WHERE yo.yoy IS NOT NULL AND rv.yoy IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    rel = settled(releases(spark, sf))
    rt = pit.yoy_as_known(known(rel), E)
    final = cal.spine(pit.last_release(rel, E), E, "ref_month", ["value"])
    rev = final.select("entity", F.add_months("ref_month", 1).alias("info_month"), sp.year_on_year(E, "ref_month", "value").alias("revised"))
    d = rt.join(rev, ["entity", "info_month"]).where("yoy is not null and revised is not null")
    gap = F.abs(F.col("yoy") - F.col("revised"))
    return d.groupBy("entity").agg(F.count("*").alias("n"), F.min("info_month").alias("first"),
                                   r6(F.avg(gap)).alias("mean_abs"), r6(F.max(gap)).alias("max_abs"))


INFOS = ["1998-07-01", "1999-07-01", "2000-07-01", "2001-07-01"]
ANNUAL_LAGS = [("v", 1), ("p", 7), ("n", 18)]


@query("annual_panel_as_public", "C10", with_(NM, LONG) + f"""
, y AS (SELECT entity, series_id, CAST(year(ref_month) AS INT) AS year, avg(value) AS value FROM lng GROUP BY 1, 2, 3 HAVING count(value) >= 12),
 r AS (SELECT y.*, t.info FROM y JOIN (VALUES ('v', 1), ('p', 7), ('n', 18)) l(series_id, lag) USING (series_id)
   JOIN (VALUES (DATE '1998-07-01'), (DATE '1999-07-01'), (DATE '2000-07-01'), (DATE '2001-07-01')) t(info)
   ON make_date(year, 12, 1) + INTERVAL 1 MONTH * lag <= t.info)
SELECT info, entity, year, {rnd("max(CASE WHEN series_id = 'v' THEN value END)", 'v')}, {rnd("max(CASE WHEN series_id = 'p' THEN value END)", 'p')},
  {rnd("max(CASE WHEN series_id = 'n' THEN value END)", 'n')} FROM r GROUP BY 1, 2, 3""")
def _(spark, sf):
    y = cal.year_mean(long_panel(spark, sf), ["entity", "series_id"], "ref_month", "value", 12)
    lags = spark.createDataFrame(ANNUAL_LAGS, "series_id string, lag int")
    return pit.annual_panel_at(y, lags, E, INFOS, ["v", "p", "n"]).select(
        "info", "entity", "year", *[r6(c).alias(c) for c in ("v", "p", "n")])


@query("quarterly_set_as_assembled", "C11", with_(NM, ANNUAL, QT) + f"""
, q AS (SELECT entity, CAST(date_trunc('quarter', ref_month) AS DATE) AS quarter, CASE WHEN count(p) = 3 THEN ln(avg(p)) END AS log_level
   FROM nm WHERE ref_month + INTERVAL 1 MONTH <= DATE '2000-06-01' GROUP BY 1, 2),
 pts AS (SELECT entity, make_date(year, 7, 1) AS t, value FROM an WHERE make_date(year, 12, 1) + INTERVAL 7 MONTH <= DATE '2000-06-01'),
 a AS (SELECT q.entity, q.quarter, max(p.t) AS t0, max_by(p.value, p.t) AS v0 FROM q LEFT JOIN pts p ON p.entity = q.entity AND p.t <= q.quarter GROUP BY 1, 2),
 b AS (SELECT a.*, n.t AS t1, n.value AS v1 FROM a ASOF LEFT JOIN pts n ON n.entity = a.entity AND n.t >= a.quarter),
 s AS (SELECT entity, quarter, flow / price AS ratio FROM qt WHERE available <= DATE '2000-06-01')
SELECT q.entity, q.quarter, {rnd('log_level', 'log_level')},
  {rnd("ln(CASE WHEN t0 IS NULL THEN NULL WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (CAST(datediff('day', t0, b.quarter) AS DOUBLE) / datediff('day', t0, t1)) END)", 'log_annual')},
  {rnd('last_value(ratio IGNORE NULLS) OVER (PARTITION BY q.entity ORDER BY q.quarter)', 'ratio')}
FROM q LEFT JOIN b ON b.entity = q.entity AND b.quarter = q.quarter LEFT JOIN s ON s.entity = q.entity AND s.quarter = q.quarter""")
def _(spark, sf):
    monthly = monthly_panel(spark, sf).select("entity", "ref_month", F.col("p").alias("value"))
    stock = quarters(spark, sf).select("entity", "quarter", "available", (F.col("flow") / F.col("price")).alias("ratio"))
    d = pit.quarterly_set_at(monthly, annual_total(spark, sf), stock, E, F.lit("2000-06-01").cast("date"), 1, 7)
    return d.select("entity", "quarter", *[r6(c).alias(c) for c in ("log_level", "log_annual", "ratio")])


@query("latest_published_values", "C12", with_(NM, GRID) + f"""
SELECT entity, {rnd('max_by(v, ref_month) FILTER (v IS NOT NULL AND month(ref_month) <= 6)', 'v')},
  {rnd('max_by(p, ref_month) FILTER (p IS NOT NULL AND month(ref_month) <= 3)', 'p')} FROM grid GROUP BY 1""")
def _(spark, sf):
    m = F.month("ref_month")
    d = grid(spark, sf).select("entity", "ref_month", F.when(m <= 6, F.col("v")).alias("v"), F.when(m <= 3, F.col("p")).alias("p"))
    return pit.latest_published(d, E, "ref_month", ["v", "p"]).select("entity", r6("v").alias("v"), r6("p").alias("p"))


# The model run that vintages are compared with: log gap to the trailing 12-month mean.
def gap_run(series, keys=E):
    g = cal.spine(series, keys, "ref_month", ["value"])
    norm = cal.trailing_full(keys, "ref_month", "value", 12)
    return g.withColumn("_norm", norm).withColumn("gap", 100 * F.log(F.col("value") / F.col("_norm"))).select(
        *keys, "ref_month", "value", "gap", F.log("value").alias("level"), F.log("_norm").alias("norm"))


MERGED = """, e AS (SELECT entity, max(CASE WHEN a IS NOT NULL THEN ref_month END) ea, max(CASE WHEN b IS NOT NULL THEN ref_month END) eb FROM tg GROUP BY 1),
 m AS (SELECT tg.entity, ref_month, eb, CASE WHEN coalesce(eb > ea, eb IS NOT NULL) THEN coalesce(b, a) ELSE coalesce(a, b) END AS late_,
        CASE WHEN coalesce(eb > ea, eb IS NOT NULL) THEN coalesce(a, b) ELSE coalesce(b, a) END AS early_ FROM tg JOIN e USING (entity)),
 g AS (SELECT *, CASE WHEN count(late_) OVER o = 12 THEN avg(late_) OVER o END AS nl, CASE WHEN count(early_) OVER o = 12 THEN avg(early_) OVER o END AS ne
   FROM m WINDOW o AS (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
 c AS (SELECT entity, ref_month, eb, 100 * ln(late_ / nl) AS gl, 100 * ln(early_ / ne) AS ge, ln(late_) - ln(early_) AS dlev, ln(nl) - ln(ne) AS dnorm FROM g
   WHERE late_ IS NOT NULL AND nl IS NOT NULL AND early_ IS NOT NULL AND ne IS NOT NULL)"""
COMPARE = f"""count(*) AS n_months, CAST(sum(CASE WHEN abs(gl - ge) > 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS n_changed, {rnd('avg(abs(gl - ge))', 'mean_abs')},
  {rnd('max(abs(gl - ge))', 'max_abs')}, arg_max(ref_month, abs(gl - ge)) AS max_month, max(ref_month) AS last_month,
  {rnd('max_by(gl - ge, ref_month)', 'last_diff')}, {rnd('avg(abs(dlev))', 'mean_abs_level')}, {rnd('avg(abs(dnorm))', 'mean_abs_norm')}"""


def revision_runs(two):
    return [gap_run(sp.merge_vintages(two, E, "ref_month", "a", "b", later_wins=w)) for w in (True, False)]


def rounded(d, skip=("entity", "n_months", "n_changed", "max_month", "last_month")):
    return d.select(*[c if c in skip else r6(c).alias(c) for c in d.columns])


@query("vintage_comparison", "C13", with_(NM, TWO, TWO_GRID) + MERGED + f"SELECT entity, {COMPARE} FROM c GROUP BY 1")
def _(spark, sf):
    current, early = revision_runs(settled(two_sources(spark, sf)))
    return rounded(pit.compare_runs(current, early, E, "ref_month", "gap", ["level", "norm"]))


@query("revision_effect", "C14", with_(NM, TWO, TWO_GRID) + MERGED + f"SELECT entity, {COMPARE} FROM c WHERE ref_month <= eb + INTERVAL 3 MONTH GROUP BY 1")
def _(spark, sf):
    two = settled(two_sources(spark, sf))
    current, early = revision_runs(two)
    ends = two.where("b is not null").groupBy("entity").agg(F.add_months(F.max("ref_month"), 3).alias("until"))
    cut = lambda d: d.join(ends, "entity").where(F.col("ref_month") <= F.col("until")).drop("until")
    return rounded(pit.compare_runs(cut(current), early, E, "ref_month", "gap", ["level", "norm"]))


SNAPSHOTS = ["1998-12-31", "1999-12-31", "2000-12-31"]


@query("vintage_replay", "C15", with_(REL) + f"""
, s AS (SELECT t.snapshot, entity, ref_month, max_by(value, realtime_start) AS value FROM rel
   JOIN (VALUES (DATE '1998-12-31'), (DATE '1999-12-31'), (DATE '2000-12-31')) t(snapshot) ON realtime_start <= t.snapshot GROUP BY 1, 2, 3),
 g AS (SELECT x.snapshot, x.entity, x.ref_month, s.value FROM (SELECT snapshot, entity,
     CAST(unnest(generate_series(min(ref_month), max(ref_month), INTERVAL 1 MONTH)) AS DATE) AS ref_month FROM s GROUP BY 1, 2) x
   LEFT JOIN s ON s.snapshot = x.snapshot AND s.entity = x.entity AND s.ref_month = x.ref_month),
 n AS (SELECT *, CASE WHEN count(value) OVER o = 12 THEN avg(value) OVER o END AS norm FROM g
   WINDOW o AS (PARTITION BY snapshot, entity ORDER BY ref_month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT snapshot, entity, ref_month, {rnd('value', 'value')}, {rnd('100 * ln(value / norm)', 'gap')} FROM n""")
def _(spark, sf):
    s = pit.at_snapshots(releases(spark, sf), E, SNAPSHOTS)
    return gap_run(s, ["snapshot", "entity"]).select("snapshot", "entity", "ref_month", r6("value").alias("value"), r6("gap").alias("gap"))


@query("due_date_checks", "C16", with_(NM, LONG) + """
, e AS (SELECT entity, series_id, max(ref_month) AS last_month FROM lng WHERE entity % 5 <> 0 OR ref_month < DATE '2001-03-01' GROUP BY 1, 2),
 x AS (SELECT *, CAST(DATE '2001-08-01' - INTERVAL 1 MONTH AS DATE) AS expected FROM e)
SELECT entity, series_id, last_month, expected, last_month < expected AS overdue, datediff('month', last_month, expected) > 3 AS stale FROM x""")
def _(spark, sf):
    late = long_panel(spark, sf).where((F.col("entity") % 5 != 0) | (F.col("ref_month") < F.lit("2001-03-01").cast("date")))
    return pit.due_checks(late, ["entity", "series_id"], "ref_month", "value", F.lit("2001-08-15").cast("date"), 13, 3)


@query("series_freshness", "C17", with_(NM, LONG) + f"""
SELECT entity, series_id, min(ref_month) AS first, max(ref_month) AS last, count(*) AS n, {rnd('max_by(value, ref_month)', 'last_value')}
FROM lng WHERE value IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return pit.series_ends(long_panel(spark, sf), ["entity", "series_id"], "ref_month", "value").withColumn(
        "last_value", r6("last_value"))
