"""Calendar and splice queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.functions.columns import r6
from pitpanel.operators import calendar as cal
from pitpanel.operators import splice as sp
from pitpanel.plans.inputs import daily_events, long_panel, monthly_panel, table, two_sources
from pitpanel.plans.registry import query
from pitpanel.plans.sql import DAILY, GRID, LONG, NM, TWO, rnd, with_

E = ["entity"]

# Fixed settings: months until a series is public, by series.
LAGS = [("v", 1), ("p", 2), ("n", 0)]
# Fixed settings: how a daily series collapses to months.
MONTHLY_RULES = [("click", "last"), ("purchase", "mean"), ("error", "last")]


def lag_table(spark):
    return spark.createDataFrame(LAGS, "series_id string, lag int")


LAG_SQL = "lags(series_id, lag) AS (VALUES ('v', 1), ('p', 2), ('n', 0))"


def grid(spark, sf) -> DataFrame:
    """The monthly panel on a complete calendar per entity."""
    return cal.spine(monthly_panel(spark, sf), E, "ref_month", ["v", "n", "p"])


def two_grid(spark, sf) -> DataFrame:
    return cal.spine(two_sources(spark, sf), E, "ref_month", ["a", "b"])


TWO_GRID = """tg AS (
  SELECT s.entity, s.ref_month, two.a, two.b FROM (
    SELECT entity, CAST(unnest(generate_series(min(ref_month), max(ref_month), INTERVAL 1 MONTH)) AS DATE) AS ref_month
    FROM two GROUP BY entity) s LEFT JOIN two ON two.entity = s.entity AND two.ref_month = s.ref_month)"""


@query("downsample_by_rule", "B1", with_(DAILY) + f"""
SELECT event_type, CAST(date_trunc('month', day) AS DATE) AS ref_month,
  CASE WHEN event_type IN ('click', 'error') THEN 'last' ELSE 'mean' END AS how,
  {rnd("CASE WHEN event_type IN ('click', 'error') THEN max_by(value, day) ELSE avg(value) END", 'value')}
FROM daily GROUP BY 1, 2""")
def _(spark, sf):
    rules = spark.createDataFrame(MONTHLY_RULES, "event_type string, how string")
    d = cal.downsample(daily_events(spark, sf), ["event_type"], "day", "value", rules)
    return d.withColumn("value", r6("value"))


@query("finished_period_mean", "B2", with_(DAILY) + f"""
SELECT event_type, CAST(date_trunc('week', day) AS DATE) AS period, {rnd('avg(value)', 'mean')}, count(value) AS "count"
FROM daily WHERE day < date_trunc('week', (SELECT max(day) FROM daily)) GROUP BY 1, 2""")
def _(spark, sf):
    # the events span one month, so the finished period here is the week
    d = daily_events(spark, sf)
    today = table(spark, sf, "events").agg(F.max(F.to_date("ts")).alias("today"))   # one row
    weeks = cal.finished_periods(d.crossJoin(F.broadcast(today)), ["event_type"], "day", "value", F.col("today"), "WEEK")
    return weeks.withColumn("mean", r6("mean"))


@query("finished_quarter_mean", "B2", with_(NM) + f"""
SELECT entity, CAST(date_trunc('quarter', ref_month) AS DATE) AS period, {rnd('avg(v)', 'mean')}, count(v) AS "count"
FROM nm WHERE ref_month < date_trunc('quarter', DATE '2001-03-15') GROUP BY 1, 2""")
def _(spark, sf):
    return cal.finished_periods(monthly_panel(spark, sf), E, "ref_month", "v", F.lit("2001-03-15").cast("date"),
                                "QUARTER").withColumn("mean", r6("mean"))


@query("week_to_month_last", "B3", with_(DAILY) + f"""
SELECT event_type, CAST(date_trunc('month', day) AS DATE) AS ref_month, {rnd('max_by(value, day)', 'value')}
FROM daily WHERE dayofweek(day) = 5 GROUP BY 1, 2""")
def _(spark, sf):
    weekly = daily_events(spark, sf).where(F.dayofweek("day") == 6)
    return cal.month_last(weekly, ["event_type"], "day", "value").withColumn("value", r6("value"))


@query("quarter_mean_complete", "B4", with_(NM) + f"""
SELECT entity, CAST(date_trunc('quarter', ref_month) AS DATE) AS quarter, {rnd('avg(v)', 'v')}, count(v) AS months
FROM nm GROUP BY 1, 2 HAVING count(v) >= 3""")
def _(spark, sf):
    return cal.quarter_mean(monthly_panel(spark, sf), E, "ref_month", "v", 3).withColumn("v", r6("v"))


@query("year_mean_complete", "B5", with_(NM) + f"""
SELECT entity, CAST(year(ref_month) AS INTEGER) AS year, {rnd('avg(v)', 'v')}, count(v) AS months
FROM nm GROUP BY 1, 2 HAVING count(v) >= 12""")
def _(spark, sf):
    return cal.year_mean(monthly_panel(spark, sf), E, "ref_month", "v", 12).withColumn("v", r6("v"))


@query("calendar_spine", "B6", with_(NM, GRID) + f"SELECT entity, ref_month, {rnd('v', 'v')}, n FROM grid")
def _(spark, sf):
    return grid(spark, sf).select("entity", "ref_month", r6("v").alias("v"), "n")


@query("missing_periods", "B7", with_(NM, GRID) + "SELECT entity, ref_month AS missing FROM grid WHERE v IS NULL")
def _(spark, sf):
    return cal.missing_periods(monthly_panel(spark, sf), E, "ref_month", "v")


@query("publication_lag_shift", "B8", with_(NM, LONG, LAG_SQL) + f"""
SELECT entity, series_id, ref_month, {rnd('value', 'value')},
  CAST(ref_month + INTERVAL 1 MONTH * lag AS DATE) AS info_month FROM lng JOIN lags USING (series_id)""")
def _(spark, sf):
    return cal.publication_lag(long_panel(spark, sf), lag_table(spark), "series_id", "ref_month").withColumn(
        "value", r6("value"))


@query("bounded_carry_forward", "B9", with_(NM, GRID) + f"""
SELECT entity, ref_month, {rnd('last_value(v IGNORE NULLS) OVER (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 'v')}
FROM grid""")
def _(spark, sf):
    g = grid(spark, sf)
    return g.select("entity", "ref_month", r6(cal.carry_forward(g, E, "ref_month", "v", 2)).alias("v"))


# every seventh month of b is blanked so there are gaps to fill
HOLES = """h AS (SELECT entity, ref_month, a, CASE WHEN month(ref_month) <> 5 THEN b END AS b FROM tg)"""


def holes(spark, sf):
    return two_grid(spark, sf).withColumn("b", F.when(F.month("ref_month") != 5, F.col("b")))


@query("fill_inside_only", "B10", with_(NM, TWO, TWO_GRID, HOLES) + f"""
, k AS (SELECT *, min(CASE WHEN b IS NOT NULL THEN ref_month END) OVER (PARTITION BY entity) lo,
        max(CASE WHEN b IS NOT NULL THEN ref_month END) OVER (PARTITION BY entity) hi FROM h)
SELECT entity, ref_month, {rnd('CASE WHEN b IS NULL AND a IS NOT NULL AND ref_month > lo AND ref_month < hi THEN a ELSE b END', 'b')},
  b IS NULL AND a IS NOT NULL AND ref_month > lo AND ref_month < hi AS was_filled FROM k""")
def _(spark, sf):
    return cal.fill_inside(holes(spark, sf), E, "ref_month", "b", "a").select(
        "entity", "ref_month", r6("b").alias("b"), "was_filled")


@query("fill_gaps_and_tail", "B11", with_(NM, TWO, TWO_GRID, HOLES) + f"""
, f AS (SELECT entity, min(ref_month) AS first FROM h WHERE b IS NOT NULL GROUP BY 1)
SELECT entity, ref_month, {rnd('b', 'value')}, 'base' AS origin FROM h WHERE b IS NOT NULL
UNION ALL SELECT h.entity, ref_month, {rnd('a', 'value')}, 'other' FROM h JOIN f ON f.entity = h.entity
WHERE b IS NULL AND a IS NOT NULL AND ref_month > first""")
def _(spark, sf):
    h = holes(spark, sf)
    return cal.fill_union(h.select("entity", "ref_month", F.col("b").alias("value")),
                          h.select("entity", "ref_month", F.col("a").alias("value")),
                          E, "ref_month", "value").withColumn("value", r6("value"))


@query("patch_rescaled", "B12", with_(NM, TWO, TWO_GRID, HOLES) + f"""
, c AS (SELECT entity, ref_month, b / a AS r, row_number() OVER (PARTITION BY entity ORDER BY ref_month) k
        FROM h WHERE a IS NOT NULL AND b IS NOT NULL),
  m AS (SELECT entity, ref_month, avg(r) OVER (PARTITION BY entity ORDER BY k ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) mr FROM c),
  e AS (SELECT entity, min(ref_month) lo, max(ref_month) hi FROM h WHERE b IS NOT NULL GROUP BY 1),
  j AS (SELECT h.entity, h.ref_month, h.a, h.b, e.lo, e.hi, m.mr FROM h JOIN e ON e.entity = h.entity
        ASOF LEFT JOIN m ON m.entity = h.entity AND m.ref_month <= h.ref_month)
SELECT entity, ref_month, {rnd('CASE WHEN b IS NULL AND a IS NOT NULL AND ref_month > lo AND mr IS NOT NULL THEN a * mr ELSE b END', 'value')},
  CASE WHEN b IS NULL AND a IS NOT NULL AND ref_month > lo AND mr IS NOT NULL
       THEN CASE WHEN ref_month > hi THEN 'extended' ELSE 'filled' END END AS patch FROM j""")
def _(spark, sf):
    return sp.patch_rescaled(holes(spark, sf), E, "ref_month", "b", "a", 12).select(
        "entity", "ref_month", r6("value").alias("value"), "patch")


MERGE_SQL = """, e AS (SELECT entity, max(CASE WHEN a IS NOT NULL THEN ref_month END) ea,
  max(CASE WHEN b IS NOT NULL THEN ref_month END) eb FROM two GROUP BY 1),
 w AS (SELECT two.*, coalesce(eb > ea, eb IS NOT NULL) AS bn FROM two JOIN e USING (entity))"""


@query("merge_two_vintages", "B13", with_(NM, TWO) + MERGE_SQL + f"""
SELECT entity, ref_month, CASE WHEN bn THEN 'b' ELSE 'a' END AS newer,
  {rnd('CASE WHEN bn THEN coalesce(b, a) ELSE coalesce(a, b) END', 'later_wins')},
  {rnd('CASE WHEN bn THEN coalesce(a, b) ELSE coalesce(b, a) END', 'earlier_wins')} FROM w""")
def _(spark, sf):
    two = two_sources(spark, sf)
    late = sp.merge_vintages(two, E, "ref_month", "a", "b").withColumnRenamed("value", "later")
    both = sp.merge_vintages(late, E, "ref_month", "a", "b", later_wins=False)
    return both.select("entity", "ref_month", "newer", r6("later").alias("later_wins"), r6("value").alias("earlier_wins"))


@query("recent_window_override", "B14", with_(NM, TWO) + f"""
, e AS (SELECT entity, CAST(max(CASE WHEN b IS NOT NULL THEN ref_month END) - INTERVAL 24 MONTH AS DATE) AS st FROM two GROUP BY 1),
 r AS (SELECT two.entity, ref_month, b AS old, CASE WHEN st IS NULL OR ref_month > st THEN a END AS rec FROM two JOIN e USING (entity)),
 w AS (SELECT *, max(CASE WHEN old IS NOT NULL THEN ref_month END) OVER (PARTITION BY entity) eo,
       max(CASE WHEN rec IS NOT NULL THEN ref_month END) OVER (PARTITION BY entity) er FROM r)
SELECT * FROM (SELECT entity, ref_month, {rnd('CASE WHEN coalesce(eo > er, eo IS NOT NULL) THEN coalesce(old, rec) ELSE coalesce(rec, old) END', 'value')} FROM w)
WHERE value IS NOT NULL""")
def _(spark, sf):
    return sp.recent_override(two_sources(spark, sf), E, "ref_month", "b", "a", 24).select(
        "entity", "ref_month", r6("value").alias("value"))


# the primary starts late: only from 1997-01
LATE = "lt AS (SELECT entity, ref_month, b, CASE WHEN ref_month >= DATE '1997-01-01' THEN a END AS a FROM two)"


def late(spark, sf):
    return two_sources(spark, sf).withColumn("a", F.when(F.col("ref_month") >= F.lit("1997-01-01").cast("date"), F.col("a")))


@query("splice_backward", "B15", with_(NM, TWO, LATE) + f"""
, c AS (SELECT entity, a / b AS r, row_number() OVER (PARTITION BY entity ORDER BY ref_month) k FROM lt WHERE a IS NOT NULL AND b IS NOT NULL),
 q AS (SELECT entity, avg(r) AS ratio FROM c WHERE k <= 12 GROUP BY 1),
 s AS (SELECT entity, min(ref_month) AS st FROM lt WHERE a IS NOT NULL GROUP BY 1)
SELECT lt.entity, ref_month, {rnd('ratio', 'ratio')}, ratio IS NOT NULL AS spliceable,
  {rnd('CASE WHEN ref_month < st THEN b * ratio ELSE a END', 'value')}
FROM lt LEFT JOIN q ON q.entity = lt.entity LEFT JOIN s ON s.entity = lt.entity""")
def _(spark, sf):
    return sp.splice_back(late(spark, sf), E, "ref_month", "a", "b", 12).select(
        "entity", "ref_month", r6("ratio").alias("ratio"), "spliceable", r6("value").alias("value"))


@query("splice_forward", "B16", with_(NM, TWO) + f"""
, q AS (SELECT entity, avg(b / a) AS ratio, stddev_pop(b / a) AS sd, max(CASE WHEN b IS NOT NULL THEN ref_month END) AS en FROM two GROUP BY 1)
SELECT two.entity, ref_month, {rnd('ratio', 'ratio')}, {rnd('sd', 'ratio_sd')},
  {rnd('CASE WHEN ref_month > en THEN a * ratio ELSE b END', 'value')} FROM two JOIN q ON q.entity = two.entity""")
def _(spark, sf):
    return sp.splice_forward(two_sources(spark, sf), E, "ref_month", "b", "a").select(
        "entity", "ref_month", r6("ratio").alias("ratio"), r6("ratio_sd").alias("ratio_sd"), r6("value").alias("value"))


# Three bases of one series: the newest from 1999, one for 1997-1999, the oldest to 1997.
BASES = [("new", "1999-01-01", "2100-01-01", 1.0), ("mid", "1997-01-01", "1999-12-31", 0.8), ("old", "1900-01-01", "1997-12-31", 0.5)]


@query("successive_rebase", "B17", with_(NM) + f"""
, b AS (SELECT entity, ref_month, 1 AS k, 'new' AS base, v AS value FROM nm WHERE ref_month >= DATE '1999-01-01'
  UNION ALL SELECT entity, ref_month, 2, 'mid', v * 0.8::DOUBLE FROM nm WHERE ref_month BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'
  UNION ALL SELECT entity, ref_month, 3, 'old', v * 0.5::DOUBLE FROM nm WHERE ref_month <= DATE '1997-12-31'),
 l AS (SELECT o.entity, o.k, min_by(w.value / o.value, o.ref_month) AS f FROM b o JOIN b w ON w.entity = o.entity AND w.ref_month = o.ref_month AND w.k = o.k - 1 GROUP BY 1, 2),
 fac AS (SELECT x.entity, x.k, CASE x.k WHEN 1 THEN 1.0 WHEN 2 THEN l2.f ELSE l2.f * l3.f END AS factor,
   CASE x.k WHEN 1 THEN NULL ELSE (SELECT min(ref_month) FROM b WHERE b.entity = x.entity AND b.k < x.k) END AS nf
   FROM (SELECT DISTINCT entity, k FROM b) x LEFT JOIN l l2 ON l2.entity = x.entity AND l2.k = 2 LEFT JOIN l l3 ON l3.entity = x.entity AND l3.k = 3)
SELECT b.entity, b.ref_month, b.base, {rnd('factor', 'factor')}, {rnd('value * factor', 'value')}
FROM b JOIN fac ON fac.entity = b.entity AND fac.k = b.k WHERE factor IS NOT NULL AND (nf IS NULL OR ref_month < nf)""")
def _(spark, sf):
    nm = monthly_panel(spark, sf)
    parts = F.array(*[F.when(F.col("ref_month").between(F.lit(a).cast("date"), F.lit(b).cast("date")),
                             F.struct(F.lit(name).alias("base"), (F.col("v") * k).alias("value")))
                      for name, a, b, k in BASES])
    d = nm.select("entity", "ref_month", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("x")).select(
        "entity", "ref_month", "x.base", "x.value")
    return sp.rebase(d, E, "ref_month", "base", "value", [b[0] for b in BASES]).withColumn(
        "factor", r6("factor")).withColumn("value", r6("value"))


CHAIN = "ch AS (SELECT entity, ref_month, a, b, CASE WHEN ref_month BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' THEN b END AS level FROM tg)"


def chain_input(spark, sf):
    inside = F.col("ref_month").between(F.lit("1997-01-01").cast("date"), F.lit("1999-12-31").cast("date"))
    return two_grid(spark, sf).withColumn("level", F.when(inside, F.col("b")))


@query("chain_link_forward", "B18 B20", with_(NM, TWO, TWO_GRID, CHAIN) + f"""
, s AS (SELECT *, max(CASE WHEN level IS NOT NULL THEN ref_month END) OVER (PARTITION BY entity) en,
   ln(a / lag(a) OVER (PARTITION BY entity ORDER BY ref_month)) st FROM ch),
 r AS (SELECT *, max(CASE WHEN ref_month > en AND st IS NULL THEN 1 ELSE 0 END) OVER o AS gap,
   sum(CASE WHEN ref_month > en THEN st END) OVER o AS run,
   max(CASE WHEN ref_month = en THEN level END) OVER (PARTITION BY entity) AS base FROM s
   WINDOW o AS (PARTITION BY entity ORDER BY ref_month))
SELECT entity, ref_month, {rnd('CASE WHEN ref_month > en THEN CASE WHEN gap = 0 THEN base * exp(run) END ELSE level END', 'value')},
  CASE WHEN ref_month > en THEN 'chained' ELSE 'level' END AS label FROM r""")
def _(spark, sf):
    return sp.chain_forward(chain_input(spark, sf), E, "ref_month", "level", "a").select(
        "entity", "ref_month", r6("value").alias("value"), "label")


@query("chain_link_backward", "B19", with_(NM, TWO, TWO_GRID, CHAIN) + f"""
, s AS (SELECT *, min(CASE WHEN level IS NOT NULL THEN ref_month END) OVER (PARTITION BY entity) st0,
   ln(a / lead(a) OVER (PARTITION BY entity ORDER BY ref_month)) st FROM ch),
 r AS (SELECT *, max(CASE WHEN ref_month < st0 AND st IS NULL THEN 1 ELSE 0 END) OVER o AS gap,
   sum(CASE WHEN ref_month < st0 THEN st END) OVER o AS run,
   max(CASE WHEN ref_month = st0 THEN level END) OVER (PARTITION BY entity) AS base FROM s
   WINDOW o AS (PARTITION BY entity ORDER BY ref_month DESC))
SELECT entity, ref_month, {rnd('CASE WHEN ref_month < st0 THEN CASE WHEN gap = 0 THEN base * exp(run) END ELSE level END', 'value')},
  CASE WHEN ref_month < st0 THEN 'chained' ELSE 'level' END AS label FROM r""")
def _(spark, sf):
    return sp.chain_backward(chain_input(spark, sf), E, "ref_month", "level", "a").select(
        "entity", "ref_month", r6("value").alias("value"), "label")


@query("segment_ranges", "B20", with_(NM, TWO) + """
SELECT entity, CASE WHEN ref_month < DATE '1997-01-01' THEN 'early' WHEN b IS NOT NULL THEN 'both' ELSE 'late' END AS label,
  min(ref_month) AS first, max(ref_month) AS last, count(*) AS n FROM two GROUP BY 1, 2""")
def _(spark, sf):
    label = (F.when(F.col("ref_month") < F.lit("1997-01-01").cast("date"), "early")
             .when(F.col("b").isNotNull(), "both").otherwise("late"))
    return sp.segments(two_sources(spark, sf).withColumn("label", label), E, "ref_month", "label")


@query("yoy_cascade", "B21", with_(NM, TWO, TWO_GRID) + f"""
, y AS (SELECT entity, ref_month, (b / lag(b, 12) OVER o - 1) * 100 AS yb, (a / lag(a, 12) OVER o - 1) * 100 AS ya
  FROM tg WINDOW o AS (PARTITION BY entity ORDER BY ref_month))
SELECT entity, ref_month, {rnd('yb', 'first_choice')}, {rnd('coalesce(yb, ya)', 'yoy')} FROM y""")
def _(spark, sf):
    g = two_grid(spark, sf)
    ya, yb = sp.year_on_year(E, "ref_month", "a"), sp.year_on_year(E, "ref_month", "b")
    return g.select("entity", "ref_month", r6(yb).alias("first_choice"), r6(F.coalesce(yb, ya)).alias("yoy"))


@query("annual_to_quarters", "B22", with_(NM) + f"""
, an AS (SELECT entity, make_date(CAST(year(ref_month) AS INT), 7, 1) AS t, sum(v) AS value FROM nm GROUP BY entity, year(ref_month)
   HAVING make_date(CAST(year(ref_month) AS INT), 12, 1) + INTERVAL 7 MONTH <= DATE '2001-01-01'),
 q AS (SELECT DISTINCT entity, CAST(date_trunc('quarter', ref_month) AS DATE) AS quarter FROM nm),
 j AS (SELECT q.entity, quarter, max(a.t) AS t0, max_by(a.value, a.t) AS v0 FROM q LEFT JOIN an a ON a.entity = q.entity AND a.t <= quarter GROUP BY 1, 2),
 k AS (SELECT j.entity, j.quarter, t0, v0, min(a.t) AS t1, min_by(a.value, a.t) AS v1 FROM j LEFT JOIN an a ON a.entity = j.entity AND a.t >= quarter GROUP BY 1, 2, 3, 4)
SELECT entity, quarter, {rnd('CASE WHEN t0 IS NULL THEN NULL WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (CAST(datediff(chr(100)||chr(97)||chr(121), t0, quarter) AS DOUBLE) / datediff(chr(100)||chr(97)||chr(121), t0, t1)) END', 'value')} FROM k"""
       .replace("chr(100)||chr(97)||chr(121)", "'day'"))
def _(spark, sf):
    nm = monthly_panel(spark, sf)
    annual = nm.groupBy("entity", F.year("ref_month").alias("year")).agg(F.sum("v").alias("value"))
    quarters = nm.select("entity", F.trunc("ref_month", "QUARTER").alias("quarter")).distinct()
    return cal.annual_to_quarters(annual, E, "value", F.lit("2001-01-01").cast("date"), 7, quarters).withColumn(
        "value", r6("value"))


INTERP = """ip AS (SELECT entity, ref_month, b, max(CASE WHEN b IS NOT NULL THEN ref_month END) OVER o AS t0,
  min(CASE WHEN b IS NOT NULL THEN ref_month END) OVER u AS t1, last_value(b IGNORE NULLS) OVER o AS v0, first_value(b IGNORE NULLS) OVER u AS v1
  FROM h WINDOW o AS (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  u AS (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("interpolate_inside", "B23", with_(NM, TWO, TWO_GRID, HOLES, INTERP) + f"""
SELECT entity, ref_month, {rnd("coalesce(b, v0 + (v1 - v0) * (CAST(datediff('month', t0, ref_month) AS DOUBLE) / datediff('month', t0, t1)))", 'b')},
  b IS NULL AND v0 IS NOT NULL AND v1 IS NOT NULL AS interpolated FROM ip""")
def _(spark, sf):
    return cal.interpolate_inside(holes(spark, sf), E, "ref_month", "b").select(
        "entity", "ref_month", r6("b").alias("b"), "interpolated")


@query("stock_backcast", "B24", with_(NM, GRID) + f"""
, st AS (SELECT entity, ref_month, v AS flow, CASE WHEN ref_month >= DATE '1999-01-01' AND month(ref_month) <> 4 THEN 100 + 2 * p END AS cur,
    CASE WHEN ref_month >= DATE '1998-01-01' AND month(ref_month) <> 2 AND month(ref_month) <> 4 THEN 100 + 3 * p END AS old FROM grid),
 c AS (SELECT *, coalesce(cur, old) AS s FROM st),
 i AS (SELECT *, max(CASE WHEN s IS NOT NULL THEN ref_month END) OVER o AS t0, min(CASE WHEN s IS NOT NULL THEN ref_month END) OVER u AS t1,
   last_value(s IGNORE NULLS) OVER o AS v0, first_value(s IGNORE NULLS) OVER u AS v1, min(CASE WHEN s IS NOT NULL THEN ref_month END) OVER (PARTITION BY entity) AS f
   FROM c WINDOW o AS (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
   u AS (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 b AS (SELECT x.entity, x.ref_month, sum(y.flow) AS fl, count(*) AS rows_, count(y.flow) AS have, max(CASE WHEN y.ref_month = y.f THEN y.s END) AS base
   FROM i x JOIN i y ON y.entity = x.entity AND x.ref_month < x.f AND y.ref_month > x.ref_month AND y.ref_month <= x.f GROUP BY 1, 2)
SELECT i.entity, i.ref_month, {rnd("CASE WHEN i.ref_month < f THEN CASE WHEN rows_ = have THEN base - fl END ELSE coalesce(s, v0 + (v1 - v0) * (CAST(datediff('month', t0, i.ref_month) AS DOUBLE) / datediff('month', t0, t1))) END", 'filled')},
  CASE WHEN cur IS NOT NULL THEN 'current' WHEN old IS NOT NULL THEN 'older' WHEN s IS NULL AND v0 IS NOT NULL AND v1 IS NOT NULL THEN 'interpolated'
       WHEN i.ref_month < f AND rows_ = have THEN 'cumulated flow' ELSE 'not yet published' END AS label
FROM i LEFT JOIN b ON b.entity = i.entity AND b.ref_month = i.ref_month""")
def _(spark, sf):
    g = grid(spark, sf)
    m = F.month("ref_month")
    since = lambda d: F.col("ref_month") >= F.lit(d).cast("date")
    st = g.select("entity", "ref_month", F.col("v").alias("flow"),
                  F.when(since("1999-01-01") & (m != 4), 100 + 2 * F.col("p")).alias("cur"),
                  F.when(since("1998-01-01") & (m != 2) & (m != 4), 100 + 3 * F.col("p")).alias("old"))
    return cal.backcast_stock(st, E, "ref_month", "cur", "old", "flow").select(
        "entity", "ref_month", r6("filled").alias("filled"), "label")


@query("fiscal_dating", "B25", """
SELECT event_id, CAST(year(ts) AS VARCHAR) || '-' || lpad(CAST((year(ts) + 1) % 100 AS VARCHAR), 2, '0') AS fy_label,
  CAST(event_id % 12 + 1 AS INTEGER) AS month,
  make_date(CAST(year(ts) + CASE WHEN event_id % 12 + 1 < 4 THEN 1 ELSE 0 END AS INT), CAST(event_id % 12 + 1 AS INT), 1) AS month_start FROM events""")
def _(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    label = F.concat_ws("-", F.year("ts"), F.lpad(((F.year("ts") + 1) % 100).cast("string"), 2, "0"))
    d = ev.select("event_id", label.alias("fy_label"), (F.col("event_id") % 12 + 1).cast("int").alias("month"))
    start = F.regexp_extract("fy_label", r"^(\d{4})-\d{2}$", 1).cast("int")
    return d.withColumn("month_start", cal.fiscal_date(start, F.col("month")))


@query("splice_seam_check", "B26", with_(NM, TWO, LATE) + f"""
, c AS (SELECT entity, a / b AS r, row_number() OVER (PARTITION BY entity ORDER BY ref_month) k FROM lt WHERE a IS NOT NULL AND b IS NOT NULL),
 q AS (SELECT entity, avg(r) AS ratio FROM c WHERE k <= 12 GROUP BY 1),
 s AS (SELECT entity, min(ref_month) AS seam FROM lt WHERE a IS NOT NULL GROUP BY 1),
 x AS (SELECT lt.entity, ref_month, seam, CASE WHEN ref_month < seam THEN b * ratio ELSE a END AS value FROM lt JOIN q USING (entity) JOIN s USING (entity)),
 y AS (SELECT *, ln(value / lag(value) OVER (PARTITION BY entity ORDER BY ref_month)) AS chg FROM x)
SELECT entity, seam, {rnd('chg', 'seam_change')} FROM y WHERE ref_month = seam""")
def _(spark, sf):
    d = late(spark, sf)
    seam = F.min(F.when(F.col("a").isNotNull(), F.col("ref_month"))).over(sp.whole(E))
    j = sp.splice_back(d.withColumn("seam", seam), E, "ref_month", "a", "b", 12)
    return sp.seam_change(j, E, "ref_month", "value", "seam").select("entity", "seam", r6("seam_change").alias("seam_change"))


@query("seam_concat_units", "B27", with_(NM, TWO, LATE) + f"""
, s AS (SELECT entity, min(ref_month) AS seam FROM lt WHERE a IS NOT NULL GROUP BY 1)
SELECT entity, ref_month, seam, {rnd('CASE WHEN seam IS NULL OR ref_month < seam THEN b * (10.0::DOUBLE / 83.0::DOUBLE) ELSE a END', 'value')}
FROM lt LEFT JOIN s USING (entity)""")
def _(spark, sf):
    return sp.seam_concat(late(spark, sf), E, "ref_month", "b", "a", F.lit(10.0) / F.lit(83.0)).select(
        "entity", "ref_month", "seam", r6("value").alias("value"))


@query("source_precedence", "B28", with_(NM, TWO, LATE) + f"""
, s AS (SELECT entity, min(CASE WHEN a IS NOT NULL THEN ref_month END) AS lo, max(CASE WHEN b IS NOT NULL THEN ref_month END) AS hb FROM lt GROUP BY 1)
SELECT entity, ref_month, {rnd('coalesce(a, CASE WHEN ref_month < lo THEN b END)', 'before_rule')},
  {rnd('coalesce(b, CASE WHEN ref_month > hb THEN a END)', 'after_rule')} FROM lt LEFT JOIN s USING (entity)""")
def _(spark, sf):
    d = sp.precedence(late(spark, sf), E, "ref_month", "a", "b", "before").withColumnRenamed("value", "before_rule")
    d = sp.precedence(d, E, "ref_month", "b", "a", "after").withColumnRenamed("value", "after_rule")
    return d.select("entity", "ref_month", r6("before_rule").alias("before_rule"), r6("after_rule").alias("after_rule"))


@query("trailing_norm_asof", "B29", with_(NM) + f"""
, w AS (SELECT entity, ref_month, count(v) OVER o AS k, avg(v) OVER o AS m FROM nm
   WINDOW o AS (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
 q AS (SELECT entity, CAST(max(ref_month) + INTERVAL 15 DAY AS DATE) AS at FROM nm GROUP BY entity, date_trunc('quarter', ref_month))
SELECT q.entity, q.at, {rnd('CASE WHEN k = 24 THEN m END', 'norm')} FROM q ASOF LEFT JOIN w ON w.entity = q.entity AND w.ref_month <= q.at""")
def _(spark, sf):
    nm = monthly_panel(spark, sf)
    probes = nm.groupBy("entity", F.trunc("ref_month", "QUARTER")).agg(F.date_add(F.max("ref_month"), 15).alias("at")).select("entity", "at")
    return cal.trailing_asof(nm, probes, E, "ref_month", "v", 24, "at").withColumn("norm", r6("norm"))


@query("trailing_full_window", "B30", with_(NM, GRID) + f"""
SELECT entity, ref_month, {rnd('CASE WHEN count(v) OVER o = 12 THEN sum(v) OVER o END', 'total')},
  {rnd('CASE WHEN count(v) OVER o = 12 THEN avg(v) OVER o END', 'mean')} FROM grid
WINDOW o AS (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    g = grid(spark, sf)
    return g.select("entity", "ref_month", r6(cal.trailing_full(E, "ref_month", "v", 12, "sum")).alias("total"),
                    r6(cal.trailing_full(E, "ref_month", "v", 12)).alias("mean"))


@query("trailing_partial_window", "B31", with_(NM, GRID) + f"""
SELECT entity, ref_month, {rnd('CASE WHEN count(v) OVER o >= 6 THEN avg(v) OVER o END', 'mean')} FROM grid
WINDOW o AS (PARTITION BY entity ORDER BY ref_month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    g = grid(spark, sf)
    return g.select("entity", "ref_month", r6(cal.trailing_partial(E, "ref_month", "v", 12, 6)).alias("mean"))


@query("annual_staircase", "B32", with_(NM, GRID) + f"""
, an AS (SELECT entity, year(ref_month) AS y, max_by(v, ref_month) AS value FROM nm WHERE year(ref_month) % 3 <> 0 GROUP BY 1, 2)
SELECT grid.entity, grid.ref_month, {rnd('an.value', 'value')} FROM grid
ASOF LEFT JOIN (SELECT entity, make_date(CAST(y AS INT), 1, 1) AS t, value FROM an) an ON an.entity = grid.entity AND an.t <= grid.ref_month""")
def _(spark, sf):
    g = grid(spark, sf)
    annual = (g.where("v is not null").select("entity", F.year("ref_month").alias("year"), F.col("v").alias("value"),
                                              F.col("ref_month").alias("seq")).where("year % 3 <> 0"))
    return cal.staircase(annual, E, "value", g.select("entity", "ref_month"), "ref_month").withColumn("value", r6("value"))
