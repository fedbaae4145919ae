import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from pitpanel.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("pitpanel-tests")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "2")       # tiny tables: the time goes into starting tasks
    return s


@pytest.fixture(scope="session")
def panel():
    """Three entities, 72 months: level, x, z and a second driver, with known dependence."""
    rng = np.random.default_rng(5)
    rows = []
    for e in range(3):
        x, z = rng.normal(size=72).cumsum() * 0.1, rng.normal(size=72)
        level = 4 + 0.5 * x + 0.1 * rng.normal(size=72).cumsum()
        for t, m in enumerate(pd.date_range("2015-01-01", periods=72, freq="MS")):
            rows.append((e, m.date(), float(level[t]), float(x[t]), float(z[t]), float(0.8 * x[t] - 0.3 * z[t] + rng.normal())))
    return pd.DataFrame(rows, columns=["entity", "ref_month", "level", "x", "z", "y"])


@pytest.fixture(scope="session")
def sdf(spark, panel):
    return spark.createDataFrame(panel, "entity int, ref_month date, level double, x double, z double, y double").cache()


def series(panel, e=0):
    return panel[panel.entity == e].reset_index(drop=True)
