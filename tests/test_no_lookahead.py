"""Nothing that happens after a date changes a reading dated on or before it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitpanel.operators import anchor as an
from pitpanel.operators import asof as pit
from pitpanel.operators import calendar as cal
from pitpanel.operators import features as ft
from pitpanel.operators import forecast as fc
from pitpanel.operators import nonlinear as nl
from pitpanel.operators import regimes as rm
from pitpanel.operators import trend as tr

E = ["entity"]
CUT = dt.date(2019, 6, 1)

OPS = {
    "carry": lambda d: d.withColumn("o", cal.carry_forward(d, E, "ref_month", "x", 2)),
    "trailing": lambda d: d.withColumn("o", cal.trailing_full(E, "ref_month", "x", 6)),
    "one_sided_trend": lambda d: tr.one_sided_trend(d, E, "ref_month", "level", 1600.0, 12),
    "state_label": lambda d: ft.two_factor_state(d, E, "ref_month", "x", "z", 12),
    "standardised": lambda d: ft.standardise_past(d, E, "ref_month", ["x", "z"]),
    "cubic": lambda d: nl.cubic_forecasts(d, E, "ref_month", "level", "x", [3], 24).drop("y"),
    "forecasts": lambda d: fc.forecasts(d, E, "ref_month", "level", "x", [1, 6], 24).drop("y"),
    "entity_anchor": lambda d: an.entity_gaps(d, an.entity_fits(d, E, "ref_month", "level", ["x"], 1, 36, 6, 3), E, "ref_month", "level", ["x"]).drop("b", "v"),
    "filtered": lambda d: rm.filtered(d.withColumns({k: F.lit(v) for k, v in (("m0", 0.0), ("m1", 0.0), ("s0", 0.5), ("s1", 1.5), ("p00", 0.9), ("p11", 0.8))}),
                                      E, "ref_month", "y"),
}


def upto(df):
    d = df.where(F.col("ref_month") <= F.lit(CUT))
    cols = sorted(d.columns)
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.select(*cols).collect()], key=str)


def shaken(d):
    late = F.col("ref_month") > F.lit(CUT)
    return d.withColumns({c: F.when(late, F.col(c) * 3 + 1).otherwise(F.col(c)) for c in ("level", "x", "z", "y")})


@pytest.mark.parametrize("name", OPS)
def test_past_readings_do_not_move(sdf, name):
    a, b = upto(OPS[name](sdf)), upto(OPS[name](shaken(sdf)))
    assert len(a) > 30 and a == b


def test_a_two_sided_trend_does_move(sdf):
    op = lambda d: tr.two_sided_trend(d, E, "ref_month", "level", 1600.0)
    assert upto(op(sdf)) != upto(op(shaken(sdf)))


def test_later_releases_do_not_change_what_was_known(spark):
    rows = [(1, dt.date(2020, 1, 1), dt.date(2020, 2, 10), 1.0), (1, dt.date(2020, 1, 1), dt.date(2020, 4, 10), 2.0), (1, dt.date(2020, 2, 1), dt.date(2020, 3, 10), 5.0), (2, dt.date(2020, 1, 1), dt.date(2020, 6, 1), 9.0)]
    known = lambda r: {(x.ref_month.month, x.info_month.month): x.value for x in
                       pit.known_each_month(spark.createDataFrame(r, "entity int, ref_month date, realtime_start date, value double"), E).where("entity = 1").collect()}
    k = known(rows)
    assert k[1, 2] == 1.0 and k[1, 3] == 1.0 and k[1, 4] == 2.0 and k[1, 6] == 2.0 and (2, 2) not in k and k[2, 3] == 5.0
    more = known(rows + [(1, dt.date(2020, 1, 1), dt.date(2020, 5, 9), 7.0)])
    assert all(more[m] == v for m, v in k.items() if m[1] <= 4) and more[1, 5] == 7.0


def test_results_do_not_depend_on_partitions(spark, sdf):
    a = upto(fc.forecasts(sdf, E, "ref_month", "level", "x", [3], 24))
    b = upto(fc.forecasts(sdf.repartition(13, "x"), E, "ref_month", "level", "x", [3], 24))
    assert a == b
