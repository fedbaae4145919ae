"""Gated refresh, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions.columns import r6
from pitpanel.plans.calendar import E
from pitpanel.plans.inputs import table
from pitpanel.operators import quality as qc
from pitpanel.plans.quality import DIFF, SNAP, snapshots
from pitpanel.plans.registry import query
from pitpanel.plans.sources import landing
from pitpanel.plans.sql import REL, rnd, with_
from pitpanel.streaming.refresh import Measure, current_table, judged_groups, judged_rows, partition_gate, promote, refresh_groups, refresh_stream, refresh_table


@query("gated_refresh", "D13", with_(REL, SNAP, DIFF) + f"""
, mv AS (SELECT af.*, ln(value / lag(value) OVER (PARTITION BY entity ORDER BY ref_month)) AS st FROM af),
 bad AS (SELECT entity FROM df WHERE lost > 0 UNION SELECT mv.entity FROM mv JOIN df ON df.entity = mv.entity WHERE new > 0 AND ref_month >= new_first AND abs(st) > 3.0)
SELECT entity, ref_month, {rnd('value', 'value')}, 'new' AS version FROM af WHERE entity NOT IN (SELECT entity FROM bad)
UNION ALL SELECT entity, ref_month, {rnd('value', 'value')}, 'kept' FROM bf WHERE entity IN (SELECT entity FROM bad)""")
def _(spark, sf):
    before, after = snapshots(spark, sf)
    return promote(before, after, E, "ref_month", "value", 3.0).withColumn("value", r6("value"))


GATED = """g AS (SELECT event_type, CAST(ts AS DATE) AS day, CASE WHEN NOT max(value) < 260 THEN 'range' WHEN NOT count(*) >= 60 THEN 'rows' END AS failed FROM events GROUP BY 1, 2)"""


def run_stream(spark, sf):
    root = landing(spark)
    gate = partition_gate(["event_type", "day"], {"range": F.max("value") < 260, "rows": F.count("*") >= 60})
    schema = table(spark, sf, "events").schema
    refresh_stream(spark, f"{sf}/events*.parquet", schema, lambda b: b.withColumn("day", F.to_date("ts")), gate, ["event_type", "day"],
                   f"{root}/staging", f"{root}/judged", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/judged")


@query("streaming_refresh_accepted", "D13", with_(GATED) + f"""
SELECT event_id, e.event_type, g.day, {rnd('value', 'value')} FROM events e JOIN g ON g.event_type = e.event_type AND g.day = CAST(e.ts AS DATE) WHERE failed IS NULL""")
def _(spark, sf):
    return run_stream(spark, sf).where("failed IS NULL").select("event_id", "event_type", "day", r6("value").alias("value"))


@query("streaming_refresh_quarantine", "D13", with_(GATED) + """
SELECT g.event_type, g.day, failed, count(*) AS n FROM events e JOIN g ON g.event_type = e.event_type AND g.day = CAST(e.ts AS DATE) WHERE failed IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, sf):
    d = run_stream(spark, sf).where("failed IS NOT NULL")
    return d.groupBy("event_type", "day", "failed").agg(F.count("*").alias("n"))


@query("refresh_transaction", "D13", with_(REL, SNAP, DIFF) + f"""
, mv AS (SELECT af.*, ln(value / lag(value) OVER (PARTITION BY entity ORDER BY ref_month)) AS st FROM af),
 bad AS (SELECT entity FROM df WHERE lost > 0 UNION SELECT mv.entity FROM mv JOIN df ON df.entity = mv.entity WHERE new > 0 AND ref_month >= new_first AND abs(st) > 3.0)
SELECT entity, ref_month, {rnd('value', 'value')} FROM af WHERE entity NOT IN (SELECT entity FROM bad)
UNION ALL SELECT entity, ref_month, {rnd('value', 'value')} FROM bf WHERE entity IN (SELECT entity FROM bad)""")
def _(spark, sf):
    # the later snapshot lost history and is refused as a whole; with the failed series kept it passes
    root = landing(spark)
    before, after = snapshots(spark, sf)
    gate = lambda old, new: qc.gates(qc.diff_snapshots(old, new, E, "ref_month", "value"), new, E, "ref_month", "value", 3.0)
    for fetch in (lambda: before, lambda: after, lambda: promote(before, after, E, "ref_month", "value", 3.0).drop("version")):
        refresh_table(spark, root, fetch, gate)
    return current_table(spark, root).select("entity", "ref_month", r6("value").alias("value"))


def run_groups(spark, sf):
    """The events in two deliveries, the second run merging into the state of the first."""
    root, day = landing(spark), F.to_date("ts")
    ev = table(spark, sf, "events")
    measures = {"top": Measure(F.max("value"), "max"), "n": Measure(F.count("*"), "sum"), "total": Measure(F.sum(F.col("value").cast("decimal(20,6)")), "sum")}
    for part in (ev.where("event_id % 3 > 0"), ev.where("event_id % 3 = 0")):
        part.write.mode("append").parquet(f"{root}/in")
        refresh_groups(spark, f"{root}/in", ev.schema, lambda b: b.withColumn("day", day), measures, {"range": F.col("top") < 260, "rows": F.col("n") >= 60},
                       ["event_type", "day"], f"{root}/table")
    return f"{root}/table"


@query("incremental_refresh_groups", "D13", with_(GATED) + f"""
SELECT e.event_type, g.day, count(*) AS n, {rnd('max(value)', 'top')}, {rnd('CAST(sum(CAST(value AS DECIMAL(20,6))) AS DOUBLE)', 'total')}, any_value(failed) AS failed
FROM events e JOIN g ON g.event_type = e.event_type AND g.day = CAST(e.ts AS DATE) GROUP BY 1, 2""")
def _(spark, sf):
    d = judged_groups(spark, run_groups(spark, sf))
    return d.select("event_type", "day", "n", r6("top").alias("top"), r6(F.col("total").cast("double")).alias("total"), "failed")


@query("incremental_refresh_rows", "D13", with_(GATED) + f"""
SELECT event_id, e.event_type, g.day, {rnd('value', 'value')}, failed FROM events e JOIN g ON g.event_type = e.event_type AND g.day = CAST(e.ts AS DATE)""")
def _(spark, sf):
    d = judged_rows(spark, run_groups(spark, sf), ["event_type", "day"])
    return d.select("event_id", "event_type", "day", r6("value").alias("value"), "failed")
