import datetime as dt

from pyspark.sql import functions as F

from pitpanel.operators import calendar as cal
from pitpanel.operators import splice as sp

D = lambda y, m, d=1: dt.date(y, m, d)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def make(spark, data, schema="k string, m date, v double"):
    return spark.createDataFrame(data, schema)


def test_spine_and_missing(spark):
    df = make(spark, [("a", D(2020, 1), 1.0), ("a", D(2020, 4), 4.0), ("b", D(2020, 2), 2.0)])
    s = cal.spine(df, ["k"], "m", ["v"]).orderBy("k", "m").collect()
    assert [(r.k, r.m.month, r.v) for r in s] == [("a", 1, 1.0), ("a", 2, None), ("a", 3, None), ("a", 4, 4.0), ("b", 2, 2.0)]
    assert rows(cal.missing_periods(df, ["k"], "m", "v"), "k", "missing") == [("a", D(2020, 2)), ("a", D(2020, 3))]


def test_carry_is_bounded(spark):
    df = make(spark, [("a", D(2020, i), 1.0 if i == 1 else None) for i in range(1, 6)])
    got = [r.c for r in df.withColumn("c", cal.carry_forward(df, ["k"], "m", "v", 2)).orderBy("m").collect()]
    assert got == [1.0, 1.0, 1.0, None, None]


def test_fiscal_date(spark):
    df = spark.createDataFrame([(2023, 4), (2023, 3)], "fy int, mon int").select(cal.fiscal_date(F.col("fy"), F.col("mon")).alias("d"))
    assert [r.d for r in df.collect()] == [D(2023, 4), D(2024, 3)]


def test_splice_back_scales_by_first_overlap(spark):
    data = [("a", D(2020, i), None if i < 3 else 10.0 * i, 1.0 * i) for i in range(1, 6)]
    df = spark.createDataFrame(data, "k string, m date, p double, b double")
    got = sp.splice_back(df, ["k"], "m", "p", "b", 2).orderBy("m").collect()
    assert [round(r.value, 9) for r in got] == [10.0, 20.0, 30.0, 40.0, 50.0] and got[0].spliceable


def test_splice_without_overlap_is_flagged(spark):
    df = spark.createDataFrame([("a", D(2020, 1), None, 1.0), ("a", D(2020, 2), 2.0, None)], "k string, m date, p double, b double")
    got = sp.splice_back(df, ["k"], "m", "p", "b", 12).orderBy("m").collect()
    assert not got[0].spliceable and got[0].value is None


def test_chain_forward_stops_at_a_gap(spark):
    g = [1.0, 2.0, 4.0, None, 8.0]
    data = [("a", D(2020, i + 1), 10.0 if i == 0 else None, g[i]) for i in range(5)]
    df = spark.createDataFrame(data, "k string, m date, l double, g double")
    got = [r.value for r in sp.chain_forward(df, ["k"], "m", "l", "g").orderBy("m").collect()]
    assert [None if v is None else round(v, 9) for v in got] == [10.0, 20.0, 40.0, None, None]


def test_annual_to_quarters_is_flat_after_and_null_before(spark):
    annual = spark.createDataFrame([("a", 2019, 100.0), ("a", 2020, 200.0)], "k string, year int, v double")
    q = spark.createDataFrame([("a", D(2019, 4)), ("a", D(2019, 7)), ("a", D(2020, 1)), ("a", D(2021, 1))], "k string, quarter date")
    got = {r.quarter: r.v for r in cal.annual_to_quarters(annual, ["k"], "v", F.lit(D(2022, 1)), 7, q).collect()}
    assert got[D(2019, 4)] is None and got[D(2019, 7)] == 100.0 and got[D(2021, 1)] == 200.0
    assert abs(got[D(2020, 1)] - (100 + 100 * 184 / 366)) < 1e-9


def test_vintage_tie_goes_to_the_first_source(spark):
    df = spark.createDataFrame([("k", D(2020, 1), 1.0, 9.0), ("k", D(2020, 2), None, 8.0), ("k", D(2020, 3), 3.0, 7.0)], "k string, m date, a double, b double")
    assert [r.value for r in sp.merge_vintages(df, ["k"], "m", "a", "b").orderBy("m").collect()] == [1.0, 8.0, 3.0]
