"""The inputs read each large table once and shuffle it once, whatever the optimizer could broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from pitpanel.plans import inputs
from pitpanel.sources import scans


def plan(spark, build):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return build(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


@pytest.mark.parametrize("build, by_order", [(inputs.releases, 2), (inputs.regressor_panel, 2)])
def test_one_scan_per_table_and_one_shuffle_by_order(spark, build, by_order):
    text = plan(spark, build)
    for t in ("lineitem", "orders", "customer"):
        assert len(re.findall(rf"FileScan[^\n]*/{t}\.parquet", text)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\([lo]_orderkey", text)) == by_order       # one a side
    assert "hashpartitioning(l_orderkey#" in text and not re.search(r"hashpartitioning\(l_orderkey#\d+L?, (day|realtime)", text)


def test_conflicting_duplicates_are_refused(spark):
    rows = [("2020-01-15", "1.5", "a"), ("2020-01-20", "1.5", "a"), ("2020-02-01", "2", "a")]
    build = lambda r: scans.dimension_series(spark.createDataFrame(r, "t string, v string, d string"), {"d": "a"}, "t", "v", 1.0)
    assert sorted(x.value for x in build(rows).collect()) == [1.5, 2.0]
    with pytest.raises(Exception, match="conflicting values at 2020-02-01"):
        build([*rows, ("2020-02-09", "3", "a")]).collect()


def test_series_folder_names_are_read_and_pruned(spark, tmp_path):
    df = spark.createDataFrame([("s 1", "2020-01-01", "1"), ("s2", "2020-01-01", "x")], "series_id string, date string, value string")
    df.write.partitionBy("series_id").option("header", True).csv(str(tmp_path / "obs"))
    d = scans.scan_observations(spark, str(tmp_path / "obs"))
    assert {(r.series_id, r.value) for r in d.collect()} == {("s 1", 1.0), ("s2", None)}
    assert "PartitionFilters: [isnotnull(series_id" in d.where(F.col("series_id") == "s2")._jdf.queryExecution().executedPlan().toString()


def test_inventory_tells_same_named_files_apart(spark, tmp_path):
    for folder, body in (("a", b"x\r\ny"), ("b", b"x\ny"), ("c", b"z")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "read.MD").write_bytes(body)
    got = {r.file: r.sha256 for r in scans.file_inventory(spark, str(tmp_path)).collect()}
    assert set(got) == {"a/read.MD", "b/read.MD", "c/read.MD"} and got["a/read.MD"] == got["b/read.MD"] != got["c/read.MD"]
