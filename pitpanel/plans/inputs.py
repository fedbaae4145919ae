"""The panels the queries run on, derived by Spark from the given tables.

Amounts are summed as exact decimals and expressed in units of a prime (``UNIT``), so that a
rounded result never sits on a rounding tie. Orders are summed per customer and month before
they meet the customer table: a customer with a third of all orders is one row per month by
then, and the join and the second sum move (customers x months) rows, not orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.functions.columns import cents, month_of, past

UNIT = 104729.0      # prime: see the module note
PRICE_UNIT = 1009.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _customer_months(spark: SparkSession, sf: str, keep: Column | None = None) -> DataFrame:
    o = table(spark, sf, "orders")
    if keep is not None:
        o = o.where(keep)
    return o.groupBy("o_custkey", month_of("o_orderdate").alias("ref_month")).agg(
        F.sum(cents("o_totalprice")).alias("amount"), F.count("*").alias("n"))


def monthly_panel(spark: SparkSession, sf: str, keep: Column | None = None) -> DataFrame:
    """entity (nation), ref_month, v (total), n (orders), p (mean order)."""
    cm = _customer_months(spark, sf, keep)
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    total = F.sum("amount").cast("double")
    return (cm.join(c, cm.o_custkey == c.c_custkey)
            .groupBy(F.col("c_nationkey").alias("entity"), "ref_month")
            .agg((total / UNIT).alias("v"), F.sum("n").alias("n"),
                 (total / F.sum("n") / PRICE_UNIT).alias("p")))


def regressor_panel(spark: SparkSession, sf: str) -> DataFrame:
    """monthly_panel plus line-item measures of the same orders: qty, disc, tax.

    Lines are summed per order, then orders are read once: one join by order, one sum per customer
    and month for all measures, one customer join."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(cents("l_quantity")).alias("qty"), F.sum(cents("l_discount")).alias("disc"),
        F.sum(cents("l_tax")).alias("tax"), F.count("*").alias("lines"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    per_customer = (o.join(li, o.o_orderkey == li.l_orderkey, "left")
                    .groupBy("o_custkey", month_of("o_orderdate").alias("ref_month"))
                    .agg(F.sum(cents("o_totalprice")).alias("amount"), F.count("*").alias("n"),
                         *[F.sum(c).alias(c) for c in ("qty", "disc", "tax", "lines")]))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    total, lines = F.sum("amount").cast("double"), F.sum("lines").cast("double")
    return (per_customer.join(c, per_customer.o_custkey == c.c_custkey)
            .groupBy(F.col("c_nationkey").alias("entity"), "ref_month")
            .agg((total / UNIT).alias("v"), F.sum("n").alias("n"), (total / F.sum("n") / PRICE_UNIT).alias("p"),
                 (F.sum("qty").cast("double") / 997.0).alias("qty"),
                 (F.sum("disc").cast("double") / lines).alias("disc"),
                 (F.sum("tax").cast("double") / lines).alias("tax")))


def long_panel(spark: SparkSession, sf: str) -> DataFrame:
    """entity, series_id in (v, n, p), ref_month, value."""
    nm = monthly_panel(spark, sf).withColumn("n", F.col("n").cast("double"))
    return nm.unpivot(["entity", "ref_month"], ["v", "n", "p"], "series_id", "value")


TWO_SOURCE_END = "2001-01-01"
TWO_SOURCE_SCALE = 1.07


def two_sources(spark: SparkSession, sf: str) -> DataFrame:
    """entity, ref_month, a (all orders), b (settled orders rescaled, an earlier end)."""
    cm = (table(spark, sf, "orders")
          .groupBy("o_custkey", month_of("o_orderdate").alias("ref_month"))
          .agg(F.sum(cents("o_totalprice")).alias("all_amount"),
               F.sum(F.when(F.col("o_orderstatus") != "P", cents("o_totalprice"))).alias("settled")))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    both = (cm.join(c, cm.o_custkey == c.c_custkey)
            .groupBy(F.col("c_nationkey").alias("entity"), "ref_month")
            .agg((F.sum("all_amount").cast("double") / UNIT).alias("a"),
                 (F.sum("settled").cast("double") / UNIT * TWO_SOURCE_SCALE).alias("b")))
    return both.withColumn("b", F.when(F.col("ref_month") < F.lit(TWO_SOURCE_END).cast("date"), F.col("b")))


def releases(spark: SparkSession, sf: str) -> DataFrame:
    """Bitemporal releases: entity, ref_month, realtime_start, value (running total by ship day).

    Lines that shipped before their order date are not releases. Lines meet their order in one
    shuffle by order key and are summed per customer and day before the next; the running window
    holds at most one row per day."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("realtime_start"), cents("l_extendedprice").alias("amount"))
    daily = (li.join(o, (li.l_orderkey == o.o_orderkey) & (F.col("realtime_start") >= F.to_date("o_orderdate")))
             .groupBy("o_custkey", month_of("o_orderdate").alias("ref_month"), "realtime_start")
             .agg(F.sum("amount").alias("amount")))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    per_day = (daily.join(c, daily.o_custkey == c.c_custkey)
               .groupBy(F.col("c_nationkey").alias("entity"), "ref_month", "realtime_start")
               .agg(F.sum("amount").alias("amount")))
    running = F.sum("amount").over(past(["entity", "ref_month"], "realtime_start"))
    return per_day.select("entity", "ref_month", "realtime_start", (running.cast("double") / UNIT).alias("value"))


def daily_events(spark: SparkSession, sf: str) -> DataFrame:
    """event_type, day, value (mean), n, last_value (latest by time, then id)."""
    ev = table(spark, sf, "events")
    total = F.sum(cents("value")).cast("double")
    return ev.groupBy("event_type", F.to_date("ts").alias("day")).agg(
        (total / F.count("*") / 7.0).alias("value"), F.count("*").alias("n"),
        (F.max_by("value", F.struct("ts", "event_id")) / 7.0).alias("last_value"))
