"""Refresh by merged measures, the table transaction, gates, streamed digests, catalogue look-up, ranks in large groups, lags by length."""

import datetime as dt
import hashlib
import io

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitpanel.operators import cointegration as co
from pitpanel.operators import crosssection as xs
from pitpanel.operators import quality as qc
from pitpanel.sources import scans
from pitpanel.streaming.refresh import Measure, current_table, judged_groups, judged_rows, refresh_groups, refresh_table

SCHEMA = "g string, v long"


def land(spark, root, rows, checks=None):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(root / "in"))
    measures = {"n": Measure(F.count("*"), "sum"), "top": Measure(F.max("v"), "max"), "low": Measure(F.min("v"), "min")}
    checks = checks or {"size": F.col("n") >= 2, "range": F.col("top") < 100}
    refresh_groups(spark, str(root / "in"), spark.createDataFrame([], SCHEMA).schema, lambda b: b, measures, checks, ["g"], str(root / "t"), 1)


def verdicts(spark, root):
    return {r.g: (r.n, r.low, r.top, r.failed) for r in judged_groups(spark, str(root / "t")).collect()}


def test_groups_merge_with_the_state_and_old_rows_are_not_read(spark, tmp_path):
    land(spark, tmp_path, [("a", 1), ("a", 2), ("b", 3), ("c", 500), ("c", 1), (None, 7), (None, 8)])
    first = {"a": (2, 1, 2, None), "b": (1, 3, 3, "size"), "c": (2, 1, 500, "range"), None: (2, 7, 8, None)}
    assert verdicts(spark, tmp_path) == first
    assert sorted((r.g, r.v, r.failed) for r in judged_rows(spark, str(tmp_path / "t"), ["g"]).where("g = 'c'").collect()) == [("c", 1, "range"), ("c", 500, "range")]
    old = next((tmp_path / "t" / "rows" / "batch_id=0").glob("*.parquet"))
    kept = old.read_bytes()
    old.write_bytes(b"not a table")                       # a run that read rows of an earlier batch would fail here
    land(spark, tmp_path, [("b", 4), ("a", 900), (None, -1), ("d", 5)])
    assert verdicts(spark, tmp_path) == {"a": (3, 1, 900, "range"), "b": (2, 3, 4, None), "c": (2, 1, 500, "range"), None: (3, -1, 8, None), "d": (1, 5, 5, "size")}
    old.write_bytes(kept)
    got = {(r.g, r.v): r.failed for r in judged_rows(spark, str(tmp_path / "t"), ["g"]).collect()}
    assert len(got) == 11 and got["a", 1] == "range" and got["b", 3] is None and got[None, 7] is None and got["d", 5] == "size"


def test_a_failed_run_keeps_the_state_and_is_caught_up(spark, tmp_path):
    land(spark, tmp_path, [("a", 1), ("a", 2)])
    broken = {"size": F.when(F.col("n") > 2, F.raise_error(F.lit("gate broke")).cast("boolean")).otherwise(True)}
    with pytest.raises(Exception, match="gate broke"):
        land(spark, tmp_path, [("a", 3), ("b", 4)], broken)
    assert verdicts(spark, tmp_path) == {"a": (2, 1, 2, None)}
    assert judged_rows(spark, str(tmp_path / "t"), ["g"]).count() == 2                # rows of the failed run are not shown
    land(spark, tmp_path, [("b", 5)])
    assert verdicts(spark, tmp_path) == {"a": (3, 1, 3, None), "b": (2, 4, 5, None)}
    assert judged_rows(spark, str(tmp_path / "t"), ["g"]).count() == 5


def test_refresh_table_keeps_the_old_table_on_failure(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = lambda *x: lambda: spark.createDataFrame(list(x), "k int, x double")
    lost = lambda old, new: old.join(new, "k", "left_anti").select(F.lit("hard").alias("severity"), F.lit("lost").alias("gate"))
    now = lambda: sorted(tuple(r) for r in current_table(spark, root).collect())
    assert current_table(spark, root) is None
    assert refresh_table(spark, root, rows((1, 1.0), (2, 2.0)), lost) == []
    assert [(r.gate, r.n) for r in refresh_table(spark, root, rows((1, 5.0)), lost)] == [("lost", 1)]
    assert now() == [(1, 1.0), (2, 2.0)]

    def broken():
        return spark.createDataFrame([(1, 1.0)], "k int, x double").select("k", F.raise_error(F.lit("network down")).cast("double").alias("x"))

    with pytest.raises(Exception, match="network down"):
        refresh_table(spark, root, broken, lost)
    assert now() == [(1, 1.0), (2, 2.0)]
    refresh_table(spark, root, rows((1, 1.0), (2, 2.5), (3, 3.0)), lost)
    assert now() == [(1, 1.0), (2, 2.5), (3, 3.0)]


@pytest.mark.parametrize("today, due", [("2026-10-01", "2026-08-01"), ("2026-10-13", "2026-09-01"), ("2026-01-05", "2025-11-01")])
def test_month_due(spark, today, due):
    assert spark.range(1).select(qc.month_due(F.to_date(F.lit(today)), 13).alias("m")).first().m == dt.date.fromisoformat(due)


def test_gates_take_a_limit_per_series(spark):
    month = [dt.date(2020, m, 1) for m in range(1, 13)]
    before = spark.createDataFrame([(e, m, 80.0) for e in (1, 2) for m in month[:-1]], "e int, m date, v double")
    after = spark.createDataFrame([(e, m, 80.0) for e in (1, 2) for m in month[:-1]] + [(1, month[-1], 120.0), (2, month[-1], 120.0)], "e int, m date, v double")
    d = qc.diff_snapshots(before, after, ["e"], "m", "v")
    one = qc.gates(d, after, ["e"], "m", "v", 0.5, spark.createDataFrame([(2, 0.2)], "e int, limit double")).collect()
    assert [(r.e, r.severity, r.gate, r.at) for r in one] == [(2, "hard", "jump", month[-1])]
    assert qc.gates(d, after, ["e"], "m", "v", 0.3).count() == 2
    late = qc.due_gate(after, ["e"], "m", "v", F.to_date(F.lit("2021-03-13")), 13).collect()
    assert [(r.e, r.gate, r.at, r["size"]) for r in sorted(late)] == [(1, "late", month[-1], 2.0), (2, "late", month[-1], 2.0)]
    bad = qc.validate(spark.createDataFrame([("a", "2020-01-01", "x"), ("a", "2020-02-01", "1")], "e string, m string, v string"), qc.TableRule(("m", "v"), ("m",), ("m",), ("v",)), "e")
    assert [(r.e, r.gate, r["size"]) for r in qc.schema_gate(bad, ["e"]).collect()] == [("a", "schema: not numeric v", 1.0)]


class Endless(io.RawIOBase):
    """So many bytes, made as they are read; no read may ask for more than one chunk."""

    def __init__(self, size):
        super().__init__()
        self.left, self.most = size, 0

    def read(self, n=-1):
        assert 0 < n <= scans.CHUNK
        n = min(n, self.left)
        self.left -= n
        return bytes(n)


def test_digest_of_a_file_above_two_gigabytes():
    size, whole = (2 << 30) + 12345, hashlib.sha256()
    for _ in range(size >> 20):
        whole.update(bytes(1 << 20))
    whole.update(bytes(size & ((1 << 20) - 1)))
    assert scans.stream_digest(Endless(size), False) == whole.hexdigest()


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 100])
def test_line_ends_across_chunks(chunk):
    body = b"a\r\nb\r\r\n\nc\r"
    assert scans.stream_digest(io.BytesIO(body), True, chunk) == hashlib.sha256(body.replace(b"\r\n", b"\n")).hexdigest()
    assert scans.stream_digest(io.BytesIO(body), False, chunk) == hashlib.sha256(body).hexdigest()
    assert scans.stream_digest(io.BytesIO(b""), True, chunk) == hashlib.sha256(b"").hexdigest()


def test_inventory_reads_no_content_cell(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.CSV").write_bytes(b"x\r\ny")
    (tmp_path / "sub" / "b c.bin").write_bytes(b"x\r\ny")
    d = scans.file_inventory(spark, str(tmp_path))
    assert {r.file: (r.length, r.sha256) for r in d.collect()} == {
        "a.CSV": (4, hashlib.sha256(b"x\ny").hexdigest()), "sub/b c.bin": (4, hashlib.sha256(b"x\r\ny").hexdigest())}
    assert "content" not in d._jdf.queryExecution().executedPlan().toString()


def test_catalogue_shapes(spark):
    rows = [("2020-01-15", "a", "x", "1"), ("2020-02-15", "a", "y", "2"), ("2020-03-15", "b", None, "3"), ("2020-04-15", None, "x", "4")]
    cat = [("a-any", {"p": "a"}, 1.0, "M"), ("a-x", {"p": "a", "q": "x"}, 10.0, "M"), ("x", {"q": "x"}, 1.0, "Q"), ("all", {}, 1.0, "Q"), ("none", {"other": "x"}, 1.0, "M")]
    cat = spark.createDataFrame(cat, "series_id string, dims map<string,string>, scale double, unit string")
    data = spark.createDataFrame(rows, "t string, p string, q string, v string")
    with pytest.raises(Exception, match="conflicting"):
        scans.catalogue_series(data, cat, ["p", "q"], "t", "v").collect()                   # "all" has three values in a quarter
    d = scans.catalogue_series(data, cat.where("series_id <> 'all'"), ["p", "q"], "t", "v")
    got = sorted((r.series_id, str(r.ref_month), r.value) for r in d.collect())
    assert got == [("a-any", "2020-01-01", 1.0), ("a-any", "2020-02-01", 2.0), ("a-x", "2020-01-01", 10.0), ("x", "2020-01-01", 1.0), ("x", "2020-04-01", 4.0)]
    assert "NestedLoop" not in d._jdf.queryExecution().executedPlan().toString()
    whole = scans.catalogue_series(data.where("p = 'b'"), cat.where("series_id = 'all'"), ["p", "q"], "t", "v").collect()
    assert [(r.series_id, r.value) for r in whole] == [("all", 3.0)]
    assert scans.catalogue_series(data, cat.where("series_id = 'none'"), ["p", "q"], "t", "v").count() == 0


def test_ranks_inside_large_groups(spark):
    rng = np.random.default_rng(8)
    p = pd.DataFrame({"t": rng.choice([1, 1, 1, 2, 3], 5000), "x": np.where(rng.random(5000) < 0.33, 0.0, rng.integers(-400, 400, 5000).astype(float))})
    got = {(r.t, r.x): (r["rank"], r.n_total) for r in xs.average_ranks(spark.createDataFrame(p), "x", ["t"], "rank").collect()}
    p["rank"], p["n"] = p.groupby("t").x.rank(), p.groupby("t").x.transform("size")
    assert len(got) == len(p.drop_duplicates(["t", "x"]))
    assert all(got[r.t, r.x] == (r["rank"], r.n) for _, r in p.drop_duplicates(["t", "x"]).iterrows())
    nulls = spark.createDataFrame([(None, 1.0), (None, 3.0), (None, 3.0), (1, 5.0)], "t int, x double")
    assert sorted(tuple(r) for r in xs.average_ranks(nulls, "x", ["t"], "rank").where("t IS NULL").collect()) == [(None, 1.0, 1.0, 3), (None, 3.0, 2.5, 3)]


def test_rank_agreement_and_cross_section(spark):
    rng = np.random.default_rng(9)
    p = pd.DataFrame([(e, t, float(rng.integers(-5, 6)), float(rng.integers(-5, 6))) for e in range(40) for t in range(4)] + [(0, 9, 1.0, 2.0)], columns=["e", "t", "a", "b"])
    r = xs.rank_agreement(spark.createDataFrame(p), "e", "t", "a", "b").first()
    by = [g.a.rank().corr(g.b.rank()) for t, g in p.groupby("t") if len(g) > 1]
    assert r.mean_rank_corr == pytest.approx(np.mean(by)) and r.min_rank_corr == pytest.approx(min(by))
    assert r.n == 161 and r.pooled_corr == pytest.approx(p.a.corr(p.b))
    for n in (1, 2, 7, 40):
        q = p[(p.t == 3) & (p.e < n)]
        d = xs.latest_cross_section(spark.createDataFrame(q), "e", "t", "a", 0).collect()
        assert len(d) == n and {x["median"] for x in d} == {q.a.median()}
        assert {x.e: x["rank"] for x in d} == q.set_index("e").a.rank(ascending=False, method="min").astype(int).to_dict()


@pytest.mark.parametrize("max_lag, intercept", [(3, False), (None, False), (2, True)])
def test_lag_by_length(spark, max_lag, intercept):
    """Lags from sums of squares with and without the level; series of unequal length have limits of their own."""
    rng = np.random.default_rng(10)
    series = {e: 0.3 * rng.normal(size=n).cumsum() + rng.normal(size=n) for e, n in enumerate((14, 30, 90))}
    df = spark.createDataFrame([(e, t, float(v)) for e, x in series.items() for t, v in enumerate(x)], "e int, t int, x double")
    got = {r.e: r for r in co.unit_root_best_lag(df, ["e"], "t", "x", max_lag, intercept).collect()}

    def rows(x, lag, start):
        dx = np.diff(x)
        at = np.arange(start, len(dx))
        return dx[at], x[at], np.column_stack([dx[at - k] for k in range(1, lag + 1)] + ([np.ones(len(at))] if intercept else []) + [np.zeros(len(at))])

    def left(y, Z):
        return y - Z @ np.linalg.pinv(Z) @ y

    for e, x in series.items():
        top = min(int(np.ceil(12 * (len(x) / 100) ** 0.25)), len(x) // 2 - 1) if max_lag is None else max_lag
        score = []
        for lag in range(top + 1):
            y, lev, Z = rows(x, lag, top)
            k = 1 + lag + intercept
            if len(y) > k:
                ssr = np.sum(left(y, np.column_stack([lev, Z])) ** 2)
                score.append((len(y) * np.log(ssr / len(y)) + 2 * k, lag))
        lag = min(score)[1]
        y, lev, Z = rows(x, lag, lag)
        ry, rl = left(y, Z), left(lev, Z)
        without, used = ry @ ry, (rl @ ry) ** 2 / (rl @ rl)
        t = np.sign(rl @ ry) * np.sqrt(used / ((without - used) / (len(y) - 1 - lag - intercept)))
        assert (got[e].lag, got[e].n) == (lag, len(y)) and got[e].stat == pytest.approx(t, rel=1e-7)


def test_surfaces_join_at_their_switch_point(spark):
    for m, (switch, *_rest) in co.P_SURFACE.items():
        d = spark.createDataFrame([(switch - 1e-9,), (switch + 1e-9,)], "s double").select(co.unit_root_p(F.col("s"), m).alias("p")).collect()
        assert abs(d[0].p - d[1].p) < 2e-3
        at_five = spark.createDataFrame([(co.CRITICAL[m]["5%"][0],)], "s double").select(co.unit_root_p(F.col("s"), m).alias("p")).first().p
        assert at_five == pytest.approx(0.05, abs=2e-3)
    with pytest.raises(ValueError, match="published"):
        co.unit_root_p(F.lit(0.0), 9)


def test_pooled_residual_roots_skip_short_entities(spark):
    rng = np.random.default_rng(3)
    rows = [(e, t, float(v)) for e, n in ((0, 9), (1, 10), (2, 60)) for t, v in enumerate(rng.normal(size=n))]
    got = {r.e: r for r in co.pooled_residual_roots(spark.createDataFrame(rows, "e int, t int, resid double"), "e", "t", 2).collect()}
    assert sorted(got) == [1, 2] and got[2].n_obs == 60 and got[2].p < 0.01
