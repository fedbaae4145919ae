import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pitpanel.functions.arrays import percentile
from pitpanel.operators import breaks as br
from pitpanel.operators import scan
from pitpanel.streaming.refresh import partition_gate, refresh_stream


def test_prefix_sums_with_one_hot_value(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([np.full(4000, 7.0), rng.integers(0, 3000, 8000).astype(float)])
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    got = {r["x"]: (r["n_before"], r["n_total"]) for r in scan.add_before(scan.by_value(df, "x", n=F.count("*")), "x", ["n"]).collect()}
    s = np.sort(v)
    assert all(got[x] == (int(np.searchsorted(s, x)), len(v)) for x in np.unique(v))


def test_auc_holm_bh_against_brute_force(spark):
    rng = np.random.default_rng(4)
    score, event = rng.integers(0, 40, 500).astype(float), rng.integers(0, 2, 500)
    df = spark.createDataFrame(list(zip(score.tolist(), event.tolist())), "s double, e int")
    pos, neg = score[event == 1], score[event == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert br.auc(df, "s", "e").first()["auc"] == pytest.approx(want)
    p = np.round(rng.random(300) ** 3, 3) + 1e-4
    d = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "id int, p double")
    # from the definitions: over equal or smaller (Holm), equal or larger (Benjamini-Hochberg) p-values
    rank_low = np.array([(p < x).sum() for x in p])
    rank_high = np.array([(p <= x).sum() for x in p])
    h = np.array([max(min(1.0, (300 - rank_low[k]) * p[k]) for k in np.flatnonzero(p <= x)) for x in p])
    b = np.array([min(1.0, min(p[k] * 300 / rank_high[k] for k in np.flatnonzero(p >= x))) for x in p])
    gh = {r["id"]: r["p_holm"] for r in br.holm(d, "p").collect()}
    gb = {r["id"]: r["p_bh"] for r in br.benjamini_hochberg(d, "p").collect()}
    np.testing.assert_allclose([gh[i] for i in range(300)], h)
    np.testing.assert_allclose([gb[i] for i in range(300)], b)


def test_array_percentile_is_linear(spark):
    x = [3.0, 1.0, 10.0, None, 4.0]
    df = spark.createDataFrame([(x,)], "x array<double>")
    for p in (0.0, 0.1, 0.5, 0.77, 1.0):
        assert df.select(percentile(F.col("x"), p).alias("v")).first()["v"] == pytest.approx(np.quantile([1, 3, 4, 10], p))


SCHEMA = StructType([StructField("g", StringType()), StructField("v", LongType())])


def refresh(spark, root, rows, files, files_per_batch, checks):
    """Land rows in so many files, refresh, and return (g, v, failed) of all rows judged so far."""
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("append").parquet(str(root / "in"))
    refresh_stream(spark, str(root / "in"), SCHEMA, lambda b: b, partition_gate(["g"], checks), ["g"], str(root / "staged"), str(root / "judged"), str(root / "ckpt"), files_per_batch)
    return sorted(((r.g, r.v, r.failed) for r in spark.read.parquet(str(root / "judged")).collect()), key=str)


def test_stream_judges_whole_groups_and_continues(spark, tmp_path):
    checks = {"size": F.count("*") >= 2, "range": F.max("v") < 100}
    got = refresh(spark, tmp_path, [("a", 1), ("a", 2), ("b", 3), ("c", 500), ("c", 1), (None, 7), (None, 8)], 1, 100, checks)
    first = [("a", 1, None), ("a", 2, None), ("b", 3, "size"), ("c", 1, "range"), ("c", 500, "range"), (None, 7, None), (None, 8, None)]
    assert got == sorted(first, key=str)
    got = refresh(spark, tmp_path, [("b", 4), ("a", 900)], 1, 100, checks)          # both groups are judged anew, as a whole
    assert got == sorted([("a", 1, "range"), ("a", 2, "range"), ("a", 900, "range"), ("b", 3, None), ("b", 4, None), *first[3:]], key=str)


@pytest.mark.parametrize("files_per_batch", [1, 100])
def test_verdict_does_not_depend_on_batches(spark, tmp_path, files_per_batch):
    got = refresh(spark, tmp_path, [("a", i) for i in range(80)], 4, files_per_batch, {"size": F.count("*") >= 60})
    assert len(got) == 80 and {f for _, _, f in got} == {None}
