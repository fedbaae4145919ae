"""Quality, reconciliation and refresh queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.functions.columns import r6
from pitpanel.operators import asof as pit
from pitpanel.operators import calendar as cal
from pitpanel.operators import quality as qc
from pitpanel.plans.calendar import HOLES, INTERP, TWO_GRID, E, grid, holes
from pitpanel.plans.inputs import monthly_panel, releases, table, two_sources
from pitpanel.plans.pointintime import gap_run
from pitpanel.plans.registry import query
from pitpanel.plans.sql import GRID, NM, REL, TWO, rnd, with_
from pitpanel.session import settled

# A text copy of the events as a source file would hold them: two date styles, some cells
# broken, one event in 41 repeated under the key of its neighbour.
DIRTY = """dirty AS (SELECT 'ev/' || event_type || '.csv' AS file,
  CAST(CASE WHEN event_id % 41 = 0 THEN event_id + 1 ELSE event_id END AS VARCHAR) AS id,
  CASE WHEN event_id % 97 = 0 THEN 'pending' WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%d-%m-%Y') END AS day,
  CASE WHEN event_id % 89 = 0 THEN 'x' ELSE CAST(value AS VARCHAR) END AS value FROM events)"""


def dirty(spark, sf):
    ev = table(spark, sf, "events")
    i = F.col("event_id")
    return ev.select(
        F.concat(F.lit("ev/"), "event_type", F.lit(".csv")).alias("file"),
        F.when(i % 41 == 0, i + 1).otherwise(i).cast("string").alias("id"),
        F.when(i % 97 == 0, "pending").when(i % 2 == 0, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.date_format("ts", "dd-MM-yyyy")).alias("day"),
        F.when(i % 89 == 0, "x").otherwise(F.col("value").cast("string")).alias("value"))


EVENT_RULE = qc.TableRule(("id", "day", "value"), ("id",), ("day",), ("value",), {"value": (1.0, 60.0)}, 2000)

CHECKS = """SELECT file, 'too few rows' AS problem, '*' AS field, n FROM (SELECT file, count(*) AS n FROM dirty GROUP BY 1) WHERE n < 2000
UNION ALL SELECT file, 'duplicate keys', 'id', n FROM (SELECT file, count(*) - count(DISTINCT id) AS n FROM dirty GROUP BY 1) WHERE n > 0
UNION ALL SELECT file, 'unparseable date', 'day', count(*) FROM dirty
  WHERE coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%d-%m-%Y')) IS NULL GROUP BY 1
UNION ALL SELECT file, 'not numeric', 'value', count(*) FROM dirty WHERE TRY_CAST(value AS DOUBLE) IS NULL GROUP BY 1
UNION ALL SELECT file, 'out of range', 'value', count(*) FROM dirty WHERE TRY_CAST(value AS DOUBLE) < 1 OR TRY_CAST(value AS DOUBLE) > 60 GROUP BY 1"""


@query("rule_validation", "D1", with_(DIRTY) + CHECKS)
def _(spark, sf):
    return qc.validate(dirty(spark, sf), EVENT_RULE, "file")


# Fixed settings: the first matching pattern decides.
RULES = [(1, r"^ev/click\.csv$", "wide", 0.0, 200.0), (2, r"^ev/.*\.csv$", "narrow", 1.0, 60.0), (3, r"\.csv$", "any", -1e9, 1e9)]


@query("rule_lookup_sweep", "D2", with_(DIRTY) + """
, m AS (SELECT file, CASE WHEN file = 'ev/click.csv' THEN 'wide' ELSE 'narrow' END AS rule, CASE WHEN file = 'ev/click.csv' THEN 0.0 ELSE 1.0 END AS lo,
   CASE WHEN file = 'ev/click.csv' THEN 200.0 ELSE 60.0 END AS hi, TRY_CAST(value AS DOUBLE) AS x FROM dirty)
SELECT file, rule, count(*) AS n, CAST(sum(CASE WHEN x < lo OR x > hi THEN 1 ELSE 0 END) AS BIGINT) AS out_of_range FROM m GROUP BY 1, 2""")
def _(spark, sf):
    d = dirty(spark, sf)
    rules = spark.createDataFrame(RULES, "priority int, pattern string, rule string, lo double, hi double")
    matched = qc.match_rules(d.select("file").distinct(), rules, "file")
    x = F.col("value").try_cast("double")
    return (d.join(matched, "file").groupBy("file", "rule")
            .agg(F.count("*").alias("n"), F.count_if((x < F.col("lo")) | (x > F.col("hi"))).alias("out_of_range")))


@query("two_source_reconciliation", "D3", with_(NM, TWO) + f"""
, e AS (SELECT entity, max(CASE WHEN a IS NOT NULL THEN ref_month END) ea, max(CASE WHEN b IS NOT NULL THEN ref_month END) eb FROM two GROUP BY 1),
 d AS (SELECT two.entity, ref_month, CASE WHEN eb > ea THEN 'b' ELSE 'a' END AS newer, CASE WHEN eb > ea THEN b ELSE a END AS nw, CASE WHEN eb > ea THEN a ELSE b END AS od
   FROM two JOIN e USING (entity) WHERE a IS NOT NULL AND b IS NOT NULL),
 r AS (SELECT *, abs(nw - od) / abs(od) AS rel, row_number() OVER (PARTITION BY entity ORDER BY ref_month DESC) AS back FROM d),
 k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY rel DESC, ref_month) AS rk FROM r)
SELECT entity, newer, count(*) AS overlap, {rnd('max(rel)', 'max_rel_diff')}, CAST(count(*) FILTER (rel > 0.5 AND back <= 24) AS BIGINT) AS n_revised,
  CAST(count(*) FILTER (rel > 0.5 AND back > 24) AS BIGINT) AS n_unexpected,
  coalesce(string_agg(strftime(ref_month, '%Y-%m'), ',' ORDER BY rk) FILTER (rk <= 3 AND rel > 0.5), '') AS worst FROM k GROUP BY 1, 2""")
def _(spark, sf):
    return qc.reconcile(two_sources(spark, sf), E, "ref_month", "a", "b", 0.5, 24).withColumn("max_rel_diff", r6("max_rel_diff"))


FLAT = """fl AS (SELECT entity, min(ref_month) AS first, max(ref_month) AS last, count(*) AS length, max(n) AS value FROM (
  SELECT *, sum(nw) OVER (PARTITION BY entity ORDER BY ref_month) AS run FROM (
    SELECT entity, ref_month, n, CASE WHEN n = lag(n) OVER (PARTITION BY entity ORDER BY ref_month) THEN 0 ELSE 1 END AS nw FROM nm))
  GROUP BY entity, run HAVING count(*) >= 2)"""


@query("flat_runs", "D4", with_(NM, FLAT) + """
SELECT * FROM fl WHERE NOT (entity IN (SELECT entity FROM fl GROUP BY 1 HAVING min(first) = fl.first) AND entity % 2 = 0)""".replace(
    "entity IN (SELECT entity FROM fl GROUP BY 1 HAVING min(first) = fl.first)", "first = (SELECT min(f2.first) FROM fl f2 WHERE f2.entity = fl.entity)"))
def _(spark, sf):
    nm = settled(monthly_panel(spark, sf))
    runs = qc.flat_runs(nm, E, "ref_month", "n", 2)
    # the verified list: the first run of every even entity
    verified = (runs.groupBy("entity").agg(F.min("first").alias("first"), F.min_by("last", "first").alias("last"))
                .where("entity % 2 = 0"))
    return qc.flat_runs(nm, E, "ref_month", "n", 2, verified)


@query("duplicate_policy", "D5", f"""
WITH g AS (SELECT event_type, user_id, CAST(ts AS DATE) AS day, max_by(value, struct_pack(ts := ts, event_id := event_id)) AS value,
  max(value) - min(value) AS spread, max(abs(value)) AS a, count(*) AS copies FROM events GROUP BY 1, 2, 3),
 s AS (SELECT event_type, greatest(max(a), 1.0) AS scale FROM g GROUP BY 1)
SELECT event_type, user_id, day, {rnd('value', 'value')}, copies, spread > 1e-9 * scale AS conflict FROM g JOIN s USING (event_type)""")
def _(spark, sf):
    ev = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    d = qc.collapse_duplicates(ev, ["event_type"], ["user_id", "day"], "value", ["ts", "event_id"])
    return d.withColumn("value", r6("value"))


@query("accounting_repair", "D6", f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS a, l_extendedprice * l_discount AS fair,
  CASE WHEN l_orderkey % 13 = 0 THEN l_extendedprice ELSE l_extendedprice * l_discount END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, {rnd('CASE WHEN abs(a - b - (a - fair)) > 1 THEN a - (a - fair) ELSE b END', 'b')},
  abs(a - b - (a - fair)) > 1 AS rebuilt FROM x""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    fair = F.col("l_extendedprice") * F.col("l_discount")
    d = li.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("a"),
                  F.when(F.col("l_orderkey") % 13 == 0, F.col("l_extendedprice")).otherwise(fair).alias("b"),
                  (F.col("l_extendedprice") - fair).alias("net"))
    return qc.repair_legs(d, "a", "b", "net", 1.0).select("l_orderkey", "l_linenumber", "l_partkey", r6("b").alias("b"), "rebuilt")


@query("control_cross_check", "D7", with_(NM, TWO, TWO_GRID, HOLES) + f"""
SELECT entity, ref_month, {rnd('coalesce(b, a)', 'value')}, a IS NOT NULL AND b IS NOT NULL AS compared,
  coalesce(abs(b - a) > 3, false) AS differs, b IS NULL AND a IS NOT NULL AS fallback FROM h""")
def _(spark, sf):
    return qc.control_check(holes(spark, sf), E, "ref_month", "b", "a", 3.0).withColumn("value", r6("value"))


@query("pairwise_agreement", "D8", with_(NM, TWO) + f"""
SELECT entity, count(*) AS n, min(ref_month) AS first, max(ref_month) AS last, {rnd('avg(a - b)', 'mean_gap')}, {rnd('avg(abs(a - b))', 'mean_abs_gap')},
  {rnd('corr(a, b)', 'corr')} FROM two WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    d = qc.pair_agreement(two_sources(spark, sf), E, "ref_month", "a", "b")
    return d.select("entity", "n", "first", "last", *[r6(c).alias(c) for c in ("mean_gap", "mean_abs_gap", "corr")])


# Two snapshots of the releases; the later one lost entity 3, months of entity 4, and entity 5 is new.
SNAP = """bf AS (SELECT entity, ref_month, max_by(value, realtime_start) AS value FROM rel WHERE realtime_start <= DATE '2000-03-31' AND entity <> 5 GROUP BY 1, 2),
 af AS (SELECT entity, ref_month, max_by(value, realtime_start) AS value FROM rel WHERE realtime_start <= DATE '2000-09-30' AND entity <> 3
   AND NOT (entity = 4 AND ref_month < DATE '1996-01-01') GROUP BY 1, 2)"""
DIFF = f"""j AS (SELECT coalesce(bf.entity, af.entity) AS entity, coalesce(bf.ref_month, af.ref_month) AS ref_month, bf.value AS b, af.value AS a,
   CASE WHEN bf.value IS NOT NULL AND af.value IS NOT NULL THEN abs(af.value - bf.value) / abs(bf.value) END AS rel_
   FROM bf FULL JOIN af ON af.entity = bf.entity AND af.ref_month = bf.ref_month),
 df AS (SELECT entity, count(b) AS rows_before, count(a) AS rows_after, CAST(count(*) FILTER (b IS NULL) AS BIGINT) AS new, CAST(count(*) FILTER (a IS NULL) AS BIGINT) AS lost,
   CAST(count(*) FILTER (rel_ > 1e-6) AS BIGINT) AS revised, min(CASE WHEN b IS NULL THEN ref_month END) AS new_first, max(CASE WHEN b IS NULL THEN ref_month END) AS new_last,
   max(CASE WHEN rel_ > 1e-6 THEN rel_ END) * 100 AS max_revision_pct, arg_max(ref_month, struct_pack(r := rel_, m := ref_month)) FILTER (rel_ > 1e-6) AS max_revision_at FROM j GROUP BY 1)"""
STATUS = "CASE WHEN rows_before = 0 THEN 'new series' WHEN rows_after = 0 THEN 'removed series' WHEN new + lost + revised > 0 THEN 'changed' ELSE 'unchanged' END AS status"


def snapshots(spark, sf):
    rel = settled(releases(spark, sf))
    cut = lambda d, day: pit.last_release(d.where(F.col("realtime_start") <= F.lit(day).cast("date")), E)
    gone = (F.col("entity") == 4) & (F.col("ref_month") < F.lit("1996-01-01").cast("date"))
    return cut(rel.where("entity <> 5"), "2000-03-31"), cut(rel.where("entity <> 3").where(~gone), "2000-09-30")


@query("snapshot_diff", "D9", with_(REL, SNAP, DIFF) + f"""
SELECT entity, rows_before, rows_after, new, lost, revised, new_first, new_last, {rnd('max_revision_pct', 'max_revision_pct')}, max_revision_at, {STATUS} FROM df""")
def _(spark, sf):
    before, after = snapshots(spark, sf)
    return qc.diff_snapshots(before, after, E, "ref_month", "value").withColumn("max_revision_pct", r6("max_revision_pct"))


@query("quality_gates", "D10", with_(REL, SNAP, DIFF) + f"""
, mv AS (SELECT af.*, ln(value / lag(value) OVER (PARTITION BY entity ORDER BY ref_month)) AS st FROM af)
SELECT entity, 'hard' AS severity, 'lost history' AS gate, CAST(NULL AS DATE) AS at, {rnd('CAST(lost AS DOUBLE)', 'size')} FROM df WHERE lost > 0
UNION ALL SELECT entity, 'soft', 'revised', max_revision_at, {rnd('max_revision_pct', 'size')} FROM df WHERE revised > 0
UNION ALL SELECT mv.entity, 'hard', 'jump', mv.ref_month, {rnd('st', 'size')} FROM mv JOIN df ON df.entity = mv.entity WHERE new > 0 AND ref_month >= new_first AND abs(st) > 0.8""")
def _(spark, sf):
    before, after = snapshots(spark, sf)
    d = qc.diff_snapshots(before, after, E, "ref_month", "value")
    return qc.gates(d, after, E, "ref_month", "value", 0.8).withColumn("size", r6("size"))


# Fixed settings: jump limits of single series, the day of the refresh, the day of the month at which the month before comes out.
LIMITS, TODAY, RELEASE_DAY = [(1, 0.3), (4, 1.5), (7, 0.2)], "2000-09-12", 13
TEXT_RULE = qc.TableRule(("ref_month", "value"), ("ref_month",), ("ref_month",), ("value",))


@query("refresh_gates", "D10", with_(REL, SNAP, DIFF, NM, TWO) + f"""
, mv AS (SELECT af.*, ln(value / lag(value) OVER (PARTITION BY entity ORDER BY ref_month)) AS st FROM af),
 lim(entity, l) AS (VALUES {', '.join(f'({e}, {x})' for e, x in LIMITS)}),
 e AS (SELECT entity, max(CASE WHEN a IS NOT NULL THEN ref_month END) ea, max(CASE WHEN b IS NOT NULL THEN ref_month END) eb FROM two GROUP BY 1),
 r AS (SELECT two.entity, abs(CASE WHEN eb > ea THEN (b - a) / a ELSE (a - b) / b END) AS rel, row_number() OVER (PARTITION BY two.entity ORDER BY ref_month DESC) AS back
   FROM two JOIN e USING (entity) WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT entity, 'hard' AS severity, 'lost history' AS gate, CAST(NULL AS DATE) AS at, {rnd('CAST(lost AS DOUBLE)', 'size')} FROM df WHERE lost > 0
UNION ALL SELECT entity, 'soft', 'revised', max_revision_at, {rnd('max_revision_pct', 'size')} FROM df WHERE revised > 0
UNION ALL SELECT mv.entity, 'hard', 'jump', mv.ref_month, {rnd('st', 'size')} FROM mv JOIN df ON df.entity = mv.entity LEFT JOIN lim ON lim.entity = mv.entity
  WHERE new > 0 AND ref_month >= new_first AND abs(st) > coalesce(l, 0.8)
UNION ALL SELECT entity, 'hard', 'schema: not numeric value', NULL, {rnd('CAST(count(*) AS DOUBLE)', 'size')} FROM af WHERE entity % 6 = 0 AND year(ref_month) = 1997 GROUP BY 1
UNION ALL SELECT entity, 'soft', 'late', max(ref_month), {rnd("CAST(date_diff('month', max(ref_month), DATE '2000-07-01') AS DOUBLE)", 'size')} FROM af GROUP BY 1 HAVING max(ref_month) < DATE '2000-07-01'
UNION ALL SELECT entity, 'soft', 'sources disagree', NULL, {rnd('CAST(count(*) AS DOUBLE)', 'size')} FROM r WHERE rel > 0.5 AND back > 24 GROUP BY 1""")
def _(spark, sf):
    before, after = snapshots(spark, sf)
    after = settled(after)
    diffs = settled(qc.diff_snapshots(before, after, E, "ref_month", "value"))
    broken = (F.col("entity") % 6 == 0) & (F.year("ref_month") == 1997)
    cells = after.select("entity", F.date_format("ref_month", "yyyy-MM-dd").alias("ref_month"), F.when(broken, "n.a.").otherwise(F.col("value").cast("string")).alias("value"))
    found = [qc.gates(diffs, after, E, "ref_month", "value", 0.8, spark.createDataFrame(LIMITS, "entity int, limit double")),
             qc.schema_gate(qc.validate(cells, TEXT_RULE, "entity"), E), qc.due_gate(after, E, "ref_month", "value", F.to_date(F.lit(TODAY)), RELEASE_DAY),
             qc.reconcile_gate(qc.reconcile(two_sources(spark, sf), E, "ref_month", "a", "b", 0.5, 24), E)]
    return reduce(DataFrame.unionByName, found).withColumn("size", r6("size"))


@query("headline_change", "D11", with_(REL, SNAP) + f"""
, f(run, entity, ref_month, value) AS (SELECT 'o', * FROM bf UNION ALL SELECT 'n', * FROM af),
 g AS (SELECT x.run, x.entity, x.ref_month, f.value FROM (SELECT run, entity, CAST(unnest(generate_series(min(ref_month), max(ref_month), INTERVAL 1 MONTH)) AS DATE) AS ref_month FROM f GROUP BY 1, 2) x
   LEFT JOIN f ON f.run = x.run AND f.entity = x.entity AND f.ref_month = x.ref_month),
 n AS (SELECT *, CASE WHEN count(value) OVER o = 12 THEN avg(value) OVER o END AS norm FROM g WINDOW o AS (PARTITION BY run, entity ORDER BY ref_month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
 l AS (SELECT run, entity, max(ref_month) AS m, max_by(100 * ln(value / norm), ref_month) AS gap, max_by(ln(value), ref_month) AS lev, max_by(ln(norm), ref_month) AS nrm
   FROM n WHERE value IS NOT NULL AND norm IS NOT NULL GROUP BY 1, 2)
SELECT a.entity, b.m AS previous_asof, a.m AS asof, {rnd('a.gap - b.gap', 'change')}, {rnd('(a.lev - b.lev) * 0.75', 'from_level')}, {rnd('(a.nrm - b.nrm) * 0.25', 'from_norm')}
FROM l a JOIN l b ON a.entity = b.entity AND a.run = 'n' AND b.run = 'o'""")
def _(spark, sf):
    before, after = snapshots(spark, sf)
    d = qc.headline_change(gap_run(before), gap_run(after), E, "ref_month", "gap", {"level": 3.0, "norm": 1.0})
    return d.select("entity", "previous_asof", "asof", *[r6(c).alias(c) for c in ("change", "from_level", "from_norm")])


# Fixed settings: name prefix -> what a reader calls the source.
GROUPS = [("series/1", "teens"), ("series/2", "twenties"), ("series/12", "twelve"), ("series/7", "seven")]


@query("change_rollup_by_source", "D12", with_(REL, SNAP, DIFF) + f"""
, nmd AS (SELECT *, 'series/' || entity AS name FROM df),
 lb AS (SELECT *, CASE WHEN starts_with(name, 'series/12') THEN 'twelve' WHEN starts_with(name, 'series/1') THEN 'teens'
   WHEN starts_with(name, 'series/2') THEN 'twenties' WHEN starts_with(name, 'series/7') THEN 'seven' ELSE name END AS label FROM nmd)
SELECT label, CAST(sum(new) AS BIGINT) AS new, CAST(sum(revised) AS BIGINT) AS revised, max(new_last) AS "to", {rnd('max(max_revision_pct)', 'largest_pct')},
  arg_max(max_revision_at, struct_pack(p := max_revision_pct, n := name)) FILTER (max_revision_pct IS NOT NULL) AS largest_at FROM lb GROUP BY 1""")
def _(spark, sf):
    before, after = snapshots(spark, sf)
    d = qc.diff_snapshots(before, after, E, "ref_month", "value").withColumn("name", F.concat(F.lit("series/"), F.col("entity").cast("string")))
    groups = spark.createDataFrame(GROUPS, "prefix string, label string")
    return qc.rollup_by_prefix(d, groups, "name").withColumn("largest_pct", r6("largest_pct"))


@query("warning_rows", "D14", with_(NM, GRID, FLAT) + """
, e AS (SELECT entity, max(ref_month) AS m FROM nm GROUP BY 1)
SELECT entity, 'gap' AS code, strftime(min(ref_month), '%Y-%m') AS detail, count(*) AS size FROM grid WHERE v IS NULL GROUP BY 1
UNION ALL SELECT entity, 'stale', strftime(m, '%Y-%m'), datediff('month', m, DATE '2001-12-01') FROM e WHERE datediff('month', m, DATE '2001-12-01') > 3
UNION ALL SELECT entity, 'flat', strftime(first, '%Y-%m'), length FROM fl""")
def _(spark, sf):
    return qc.warnings(settled(monthly_panel(spark, sf)), E, "ref_month", "n", F.lit("2001-12-10").cast("date"), 3, 2)


@query("null_count_interpolate", "D15", with_(NM, TWO, TWO_GRID, HOLES, INTERP) + f"""
, c AS (SELECT entity, count(*) FILTER (b IS NULL AND ref_month BETWEEN DATE '1996-01-01' AND DATE '1999-12-01') AS nulls FROM h GROUP BY 1),
 f AS (SELECT ip.entity, ref_month, nulls, CASE WHEN nulls > 0 THEN coalesce(b, v0 + (v1 - v0) * (CAST(datediff('month', t0, ref_month) AS DOUBLE) / datediff('month', t0, t1))) ELSE b END AS b
   FROM ip JOIN c ON c.entity = ip.entity)
SELECT entity, ref_month, nulls, {rnd('b', 'b')}, {rnd('ln(b)', 'log_value')}, {rnd('ln(b) - lag(ln(b), 12) OVER (PARTITION BY entity ORDER BY ref_month)', 'yearly_change')} FROM f""")
def _(spark, sf):
    d = qc.nulls_then_interpolate(holes(spark, sf), E, "ref_month", "b", F.lit("1996-01-01").cast("date"), F.lit("1999-12-01").cast("date"))
    return d.select("entity", "ref_month", "nulls", r6("b").alias("b"), r6("log_value").alias("log_value"), r6("yearly_change").alias("yearly_change"))
