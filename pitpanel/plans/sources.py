"""Scan, reshape and sink queries. Landed files are written by Spark from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pitpanel.functions.columns import cents, r6
from pitpanel.plans.calendar import E, grid
from pitpanel.plans.inputs import UNIT, long_panel, monthly_panel, regressor_panel, releases, table
from pitpanel.plans.quality import DIRTY, dirty
from pitpanel.plans.registry import query
from pitpanel.plans.sql import GRID, LONG, NM, REGS, REL, rnd, with_
from pitpanel.session import checkpoint_dir, settled
from pitpanel.sources import scans as sc
from pitpanel.sources import sheets as sh
from pitpanel.sources import sinks as sk


def landing(spark) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"


@query("observation_scan", "A1", with_(NM, LONG) + f"SELECT series_id || '-' || entity AS series_id, ref_month, {rnd('value', 'value')} FROM lng")
def _(spark, sf):
    path = landing(spark)
    d = long_panel(spark, sf).select(F.concat_ws("-", "series_id", F.col("entity").cast("string")).alias("series_id"),
                                     F.date_format("ref_month", "yyyy-MM-dd").alias("date"), "value")
    d.repartition("series_id").write.partitionBy("series_id").option("header", True).csv(path)
    return sc.scan_observations(spark, path).withColumn("value", r6("value"))


@query("country_year_scan", "A2", with_(NM, LONG) + f"""
SELECT 'C' || entity AS country, CAST(year(ref_month) AS INT) AS year, series_id AS indicator, {rnd('avg(value)', 'value')} FROM lng GROUP BY 1, 2, 3""")
def _(spark, sf):
    path = landing(spark)
    d = long_panel(spark, sf).groupBy(F.concat(F.lit("C"), F.col("entity").cast("string")).alias("country"), F.year("ref_month").alias("year"),
                                      F.col("series_id").alias("indicator")).agg(F.avg("value").alias("value"))
    d.select("country", "year", "value", "indicator").write.partitionBy("indicator").option("header", True).csv(path)
    return sc.scan_country_years(spark, path).withColumn("value", r6("value"))


@query("wide_measure_scan", "A3", with_(NM, REGS) + f"""
, l AS (SELECT entity, ref_month, 'v' AS series_id, v AS value FROM regs UNION ALL SELECT entity, ref_month, 'p', p FROM regs UNION ALL SELECT entity, ref_month, 'qty', qty FROM regs
  UNION ALL SELECT entity, ref_month, 'disc', disc FROM regs UNION ALL SELECT entity, ref_month, 'tax', tax FROM regs)
SELECT entity, ref_month, series_id, {rnd('value', 'value')} FROM l WHERE value IS NOT NULL""")
def _(spark, sf):
    path = landing(spark)
    names = ["v", "p", "qty", "disc", "tax"]
    regressor_panel(spark, sf).select("entity", "ref_month", *names).write.option("header", True).csv(path)
    return sc.scan_wide(spark, path, "entity int, ref_month date", names).withColumn("value", r6("value"))


@query("release_scan", "A4", with_(REL) + f"SELECT entity, ref_month, realtime_start, {rnd('value', 'value')} FROM rel")
def _(spark, sf):
    path = landing(spark)
    rel = releases(spark, sf).select("ref_month", "realtime_start", "value", "entity")
    rel.repartition("entity").write.partitionBy("entity").option("header", True).csv(path)
    return sc.scan_releases(spark, path).withColumn("value", r6("value"))


@query("mixed_date_formats", "A5", with_(DIRTY) + """
SELECT file, CAST(coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%d-%m-%Y')) AS DATE) AS ref_date, TRY_CAST(value AS DOUBLE) AS value FROM dirty""")
def _(spark, sf):
    return sc.mixed_dates(dirty(spark, sf), "file", "day", "value")


def pages(spark, sf):
    """Event rows as JSON pages of 500 rows, landed as text and read back."""
    path = landing(spark)
    ev = table(spark, sf, "events")
    row = F.array(F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"), "event_type", F.col("value").cast("string"))
    names = F.array(*[F.lit(c) for c in ("id", "time_period", "event_type", "obs_value")])
    p = ev.groupBy(F.floor(F.col("event_id") / 500).alias("page")).agg(F.collect_list(row).alias("rows"))
    p.select(F.to_json(F.struct(names.alias("columns"), "rows")).alias("value")).write.text(path)
    return spark.read.schema("columns array<string>, rows array<array<string>>").json(path)


@query("json_pages_flatten", "A6", """
SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d') AS time_period, event_type, value AS obs_value FROM events""")
def _(spark, sf):
    d = sc.flatten_pages(pages(spark, sf), ["id", "time_period", "event_type", "obs_value"])
    return d.withColumn("obs_value", F.col("obs_value").cast("double"))


def dimension_rows(spark, sf):
    """time_period, priority, status and a text value per month, as a dimension-coded source has them."""
    o = table(spark, sf, "orders")
    total = (F.sum(cents("o_totalprice")).cast("double") / UNIT).cast("string")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM-01").alias("time_period"), F.col("o_orderpriority").alias("priority"),
                     F.col("o_orderstatus").alias("status")).agg(total.alias("obs_value"))


DIMS = """dm AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ref_month, o_orderpriority AS priority, o_orderstatus AS status,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 104729.0 AS v FROM orders GROUP BY 1, 2, 3)"""


@query("dimension_coded_series", "A7", with_(DIMS) + f"SELECT ref_month, {rnd('v * 0.37::DOUBLE', 'value')} FROM dm WHERE priority = '1-URGENT' AND status = 'F'")
def _(spark, sf):
    d = sc.dimension_series(dimension_rows(spark, sf), {"priority": "1-URGENT", "status": "F"}, "time_period", "obs_value", 0.37)
    return d.withColumn("value", r6("value"))


# Fixed settings: series, the dimension values that select its rows, scale, unit of its stamp.
CATALOGUE = [(f"{p[0]}{s}", {"priority": p, "status": s}, scale, "M") for p, scale in
             (("1-URGENT", 1.0), ("2-HIGH", 0.1), ("3-MEDIUM", 10.0), ("5-LOW", 0.37)) for s in ("F", "O", "P")]


@query("series_catalogue", "A8", with_(DIMS) + f"""
, c(priority, scale) AS (VALUES ('1-URGENT', 1.0::DOUBLE), ('2-HIGH', 0.1::DOUBLE), ('3-MEDIUM', 10.0::DOUBLE), ('5-LOW', 0.37::DOUBLE))
SELECT substr(dm.priority, 1, 1) || status AS series_id, ref_month, {rnd('v * scale', 'value')} FROM dm JOIN c USING (priority)""")
def _(spark, sf):
    cat = spark.createDataFrame(CATALOGUE, "series_id string, dims map<string,string>, scale double, unit string")
    d = sc.catalogue_series(dimension_rows(spark, sf), cat, ["priority", "status"], "time_period", "obs_value")
    return d.withColumn("value", r6("value"))


def text(c):
    """A number as a sheet prints it: grouped digits, a dash for zero."""
    return F.when(F.col(c) == 0, "-").otherwise(F.format_number(F.col(c), 4))


def month_sheet(spark, sf):
    """One tab per entity: a header row, then month rows (c1 name, c2 year, c3.. measures)."""
    nm = monthly_panel(spark, sf).withColumn("scaled", F.col("v") * 1000)
    body = nm.select(F.concat(F.lit("tab"), F.col("entity").cast("string")).alias("tab"), (F.unix_date("ref_month") + 10).alias("row_no"),
                     F.date_format("ref_month", "MMMM").alias("c1"), F.date_format("ref_month", "yyyy").alias("c2"), text("scaled").alias("c3"), text("p").alias("c4"))
    head = nm.select("entity").distinct().select(F.concat(F.lit("tab"), F.col("entity").cast("string")).alias("tab"), F.lit(1).alias("row_no"), F.lit("Month").alias("c1"),
                                                 F.lit("Year").alias("c2"), F.when(F.col("entity") != 4, "Total Amount").otherwise("Amount").alias("c3"), F.lit("Mean Price").alias("c4"))
    return head.unionByName(body)


@query("sheet_month_rows", "A9", with_(NM) + f"""
SELECT 'tab' || entity AS tab, ref_month, round(v * 1000, 4) + 0.0 AS amount, round(p, 4) + 0.0 AS price FROM nm WHERE entity <> 4""")
def _(spark, sf):
    return sh.month_rows(month_sheet(spark, sf), {"amount": "c3", "price": "c4"}, ["Total Amount", "Mean Price"])


@query("sheet_layout_problems", "A9", with_(NM) + "SELECT DISTINCT 'tab' || entity AS tab FROM nm WHERE entity = 4")
def _(spark, sf):
    return sh.unverified(month_sheet(spark, sf), ["c3", "c4"], ["Total Amount", "Mean Price"])


# Fixed settings: item -> signed codes and the column of the three it is read from.
ITEMS = [("net_amount", "1.A", 1.0, "net"), ("gross_in", "1.A", 1.0, "credit"), ("gross_out", "1.B", 1.0, "debit"), ("spread", "1.A", 1.0, "net"), ("spread", "1.B", -1.0, "net")]


def quarter_sheet(spark, sf):
    """A tab per entity and year: an Item header with the four quarters across, two filler rows,
    then one row per code with (credit, debit, net) triples."""
    q = monthly_panel(spark, sf).groupBy("entity", F.year("ref_month").alias("year"), F.quarter("ref_month").alias("q")).agg(
        F.sum("v").alias("v"), F.sum("p").alias("p"))
    tab = F.concat_ws("/", F.col("entity").cast("string"), F.col("year").cast("string")).alias("tab")
    label = F.element_at(F.array(*[F.lit(k) for k in sh.QUARTERS]), F.col("q"))
    head = q.groupBy("entity", "year").agg(F.map_from_entries(F.collect_list(F.struct("q", F.concat_ws(" ", label, F.col("year").cast("string")).alias("l")))).alias("m"))
    at = lambda i: [F.when(F.lit(j) == 0, F.col("m").getItem(i)).otherwise("").alias(f"c{2 + 3 * (i - 1) + j}") for j in range(3)]
    head = head.select(tab, F.lit(5).alias("row_no"), F.lit("Item").alias("c1"), *[c for i in range(1, 5) for c in at(i)])
    rows = None
    for n, (code, name) in enumerate((("1.A", "v"), ("1.B", "p"))):
        t = q.select("entity", "year", "q", F.format_number(F.col(name) * 3, 4).alias("x"), F.format_number(F.col(name) * 2, 4).alias("y"), F.format_number(name, 4).alias("z"))
        m = t.groupBy("entity", "year").agg(F.map_from_entries(F.collect_list(F.struct("q", F.struct("x", "y", "z").alias("s")))).alias("m"))
        cells = [F.col("m").getItem(i).getField(f).alias(f"c{2 + 3 * (i - 1) + j}") for i in range(1, 5) for j, f in enumerate("xyz")]
        body = m.select(tab, F.lit(20 + n).alias("row_no"), F.lit(f"{code} measure {name}").alias("c1"), *cells)
        rows = body if rows is None else rows.unionByName(body)
    return head.unionByName(rows)


@query("sheet_quarters_across", "A10", with_(NM) + """
, q AS (SELECT entity, year(ref_month) AS y, quarter(ref_month) AS k, sum(v) AS v, sum(p) AS p FROM nm GROUP BY 1, 2, 3),
 r AS (SELECT entity || '/' || y AS tab, make_date(CAST(y AS INT), CAST(k * 3 - 2 AS INT), 1) AS quarter, round(v, 4) AS vz, round(v * 3, 4) AS vx, round(p * 2, 4) AS py, round(p, 4) AS pz FROM q)
SELECT tab, quarter, 'net_amount' AS item, round(vz, 4) + 0.0 AS value FROM r UNION ALL SELECT tab, quarter, 'gross_in', round(vx, 4) + 0.0 FROM r
UNION ALL SELECT tab, quarter, 'gross_out', round(py, 4) + 0.0 FROM r UNION ALL SELECT tab, quarter, 'spread', round(vz - pz, 4) + 0.0 FROM r""")
def _(spark, sf):
    items = spark.createDataFrame(ITEMS, "item string, code string, sign double, measure string")
    return sh.quarter_columns(quarter_sheet(spark, sf), 13, items).withColumn("value", F.round("value", 4))


@query("sheet_index_rows", "A11", with_(NM) + """
SELECT 'tab' || entity AS tab, ref_month, round(p, 4) + 0.0 AS "index", CASE WHEN n > 5 THEN round(v, 4) + 0.0 END AS inflation, ref_month >= DATE '2001-06-01' AS provisional FROM nm""")
def _(spark, sf):
    nm = monthly_panel(spark, sf)
    tab = F.concat(F.lit("tab"), F.col("entity").cast("string")).alias("tab")
    flag = F.when(F.col("ref_month") >= F.lit("2001-06-01").cast("date"), " Provisional ").otherwise("final")
    row = lambda item, shift: nm.select(tab, (F.unix_date("ref_month") * 10 + shift).alias("row_no"), F.upper(F.date_format("ref_month", "MMM-yyyy")).alias("c1"),
                                        F.lit(item).alias("c2"), flag.alias("c3"), F.format_number(F.col("p") * (1 + (shift > 1)), 4).alias("c8"),
                                        F.when(F.col("n") > 5, F.round("v", 4).cast("string")).otherwise("").alias("c9"))
    head = nm.select("entity").distinct().select(tab, F.lit(1).alias("row_no"), F.lit("Base: 2024 = 100").alias("c1"), *[F.lit(None).cast("string").alias(c) for c in ("c2", "c3", "c8", "c9")])
    rows = head.unionByName(row("A) General Index", 1)).unionByName(row("A) General Index", 3)).unionByName(row("B) Food Index", 0))
    return sh.index_rows(rows, "c2", "A) General Index", "c8", "c9", "c3", ["2024 = 100"])


@query("sheet_fiscal_fill_down", "A12", with_(NM, GRID) + """
, q AS (SELECT entity, CAST(date_trunc('quarter', ref_month) AS DATE) AS quarter, sum(v) AS v FROM grid GROUP BY 1, 2),
 f AS (SELECT entity, min(quarter) AS f FROM q WHERE month(quarter) = 4 GROUP BY 1)
SELECT 'tab' || q.entity AS tab, quarter, round(v, 4) + 0.0 AS value FROM q JOIN f ON f.entity = q.entity WHERE quarter >= f""")
def _(spark, sf):
    q = grid(spark, sf).groupBy("entity", F.trunc("ref_month", "QUARTER").alias("quarter")).agg(F.sum("v").alias("v"))
    fy = F.year("quarter") - (F.month("quarter") < 4).cast("int")
    k = F.pmod(F.quarter("quarter") + 2, F.lit(4)) + 1
    label = F.concat_ws("-", fy.cast("string"), F.lpad(((fy + 1) % 100).cast("string"), 2, "0"))
    rows = q.select(F.concat(F.lit("tab"), F.col("entity").cast("string")).alias("tab"), F.unix_date("quarter").alias("row_no"),
                    F.when(k == 1, label).otherwise("").alias("c1"), F.concat(F.lit("Q"), k.cast("string")).alias("c2"), F.format_number("v", 4).alias("c3"))
    return sh.fiscal_quarter_rows(rows, "c3")


@query("text_number_cleanup", "A13", """
SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 0.0 WHEN event_id % 19 = 0 THEN NULL ELSE round(value * 100003, 2) + 0.0 END AS number FROM events""")
def _(spark, sf):
    i = F.col("event_id")
    shown = F.when(i % 17 == 0, " - ").when(i % 19 == 0, "n.a.").otherwise(F.format_number(F.col("value") * 100003, 2))
    return table(spark, sf, "events").select("event_id", sc.clean_number(shown).alias("number"))


# Fixed settings: printed name -> member code; two members are absent from the source.
MEMBERS = [(f"NATION_{i}", f"N{i:02d}") for i in range(0, 20)] + [("NATION_90", "N90"), ("NATION_91", "N91")]
MEMBER_SQL = "mb(n_name, code) AS (VALUES " + ", ".join(f"('{n}', '{c}')" for n, c in MEMBERS) + ")"


def named_years(spark, sf):
    y = monthly_panel(spark, sf).groupBy("entity", F.year("ref_month").alias("year")).agg(F.avg("v").alias("value"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("entity"), "n_name")
    return y.join(n, "entity").drop("entity")


def members(spark):
    return spark.createDataFrame(MEMBERS, "n_name string, code string")


@query("dimension_crosswalk", "A14", with_(NM, MEMBER_SQL) + f"""
, y AS (SELECT entity, CAST(year(ref_month) AS INT) AS year, avg(v) AS value FROM nm GROUP BY 1, 2)
SELECT code, year, {rnd('value * 100', 'value')} FROM y JOIN nation ON n_nationkey = entity JOIN mb ON mb.n_name = nation.n_name""")
def _(spark, sf):
    d, _missing = sc.crosswalk(named_years(spark, sf), members(spark), "n_name", 100.0)
    return d.select("code", "year", r6("value").alias("value"))


@query("crosswalk_absent_members", "A14", with_(MEMBER_SQL) + "SELECT code, n_name FROM mb WHERE n_name NOT IN (SELECT n_name FROM nation)")
def _(spark, sf):
    return sc.crosswalk(named_years(spark, sf), members(spark), "n_name", 100.0)[1].select("code", "n_name")


@query("run_table_sink", "A16", with_(NM) + f"SELECT 'run-1' AS run_id, entity, ref_month, {rnd('v', 'v')} FROM nm UNION ALL SELECT 'run-2', entity, ref_month, {rnd('p', 'v')} FROM nm")
def _(spark, sf):
    root = landing(spark)
    nm = settled(monthly_panel(spark, sf))
    sk.save_run({"panel": nm.select("entity", "ref_month", "v")}, root, "run-1")
    sk.save_run({"panel": nm.select("entity", "ref_month", F.col("p").alias("v"))}, root, "run-2")
    return spark.read.parquet(f"{root}/panel").select("run_id", "entity", "ref_month", r6("v").alias("v"))


@query("metric_rows", "A17", with_(NM, GRID) + f"""
, g AS (SELECT entity, avg(v) AS mean_v, stddev_samp(p) AS sd_p, CASE WHEN entity % 7 <> 0 THEN max(v) END AS max_v FROM grid GROUP BY 1)
SELECT 'panel' AS section, CAST(entity AS VARCHAR) AS key, metric, {rnd('value', 'value')} FROM (SELECT entity, 'mean_v' AS metric, mean_v AS value FROM g UNION ALL SELECT entity, 'sd_p', sd_p FROM g UNION ALL SELECT entity, 'max_v', max_v FROM g)""")
def _(spark, sf):
    return sk.metric_rows(summary(spark, sf), "panel", E, ["mean_v", "sd_p", "max_v"]).withColumn("value", r6("value"))


def summary(spark, sf):
    return monthly_panel(spark, sf).groupBy("entity").agg(F.avg("v").alias("mean_v"), F.stddev_samp("p").alias("sd_p"),
                                                          F.when(F.col("entity") % 7 != 0, F.max("v")).otherwise(float("nan")).alias("max_v"))


@query("metrics_json", "A17")
def _(spark, sf):
    return sk.metrics_json(sk.metric_rows(summary(spark, sf), "panel", E, ["mean_v", "sd_p", "max_v"]).withColumn("value", r6("value")))


@query("file_inventory", "A18")
def _(spark, sf):
    return sc.file_inventory(spark, f"{sf}/*.parquet")


@query("inventory_verify", "A19", """
WITH k AS (SELECT l_orderkey, CASE WHEN l_orderkey % 11 = 0 THEN 'removed' WHEN l_orderkey % 13 = 0 THEN 'added' WHEN l_orderkey % 17 = 0 THEN 'changed' END AS state FROM (SELECT DISTINCT l_orderkey FROM lineitem))
SELECT l_orderkey, state FROM k WHERE state IS NOT NULL""")
def _(spark, sf):
    k = F.col("l_orderkey")
    inv = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sha2(F.sum(cents("l_extendedprice")).cast("string"), 256).alias("digest"))
    before = inv.where((k % 13 != 0) | (k % 11 == 0))
    after = inv.where(k % 11 != 0).withColumn("digest", F.when(k % 17 == 0, F.sha2("digest", 256)).otherwise(F.col("digest")))
    return sc.verify_inventory(before, after, ["l_orderkey"], "digest")


@query("publish_latest", "A21", with_(NM) + f"""
SELECT '2001-05' AS as_of, entity, {rnd('sum(v)', 'v')} FROM nm WHERE ref_month <= DATE '2001-05-01' GROUP BY entity
UNION ALL SELECT a, entity, {rnd('sum(v)', 'v')} FROM nm CROSS JOIN (VALUES ('2001-06'), ('latest')) t(a) WHERE ref_month <= DATE '2001-06-01' GROUP BY a, entity""")
def _(spark, sf):
    path = landing(spark)
    nm = settled(monthly_panel(spark, sf))
    for as_of in ("2001-05", "2001-06"):
        upto = nm.where(F.col("ref_month") <= F.to_date(F.lit(as_of + "-01"))).groupBy("entity").agg(r6(F.sum("v")).alias("v"))
        sk.publish(upto, path, as_of)
    return spark.read.schema("entity int, v double, as_of string").parquet(path)
