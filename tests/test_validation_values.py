"""The deflated ratio by numbers: the normal law by its integral, its inverse by halving."""

import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tidemark import catalogue
from tidemark.operators import validation
from tidemark.plans import backtests
from tidemark.plans.views import CTE

SMALL = "/root/testdata/sf0.001"


def below(x):
    """The normal law's share below x, by Simpson's rule from -12."""
    steps = 4000
    at = np.linspace(-12.0, max(min(x, 12.0), -12.0), steps + 1)
    y = np.exp(-at * at / 2) / math.sqrt(2 * math.pi)
    return float((at[1] - at[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()))


def where_below(p):
    low, high = -10.0, 10.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return low


def deflated(sr, trials, n, var, skew, kurt):
    euler = -sum(math.log(-math.log((i + 0.5) / 200_000)) for i in range(200_000)) / 200_000  # the mean of Gumbel's law
    best = math.sqrt(var) * ((1 - euler) * where_below(1 - 1 / trials) + euler * where_below(1 - 1 / (trials * math.e))) if trials > 1 else 0.0
    return below((sr - best) / math.sqrt((1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n - 1)))


ROWS = [(0.1, 1, 100, 0.01, 0.0, 3.0), (0.2, 10, 250, 0.004, -0.5, 5.0), (0.05, 200, 1000, 0.001, 0.3, 3.2), (-0.1, 5, 60, 0.02, 0.0, 3.0), (0.0, 2, 3, 0.5, 1.0, 1.0)]
WITHOUT = [(0.1, 3, 2, 0.01, 0.0, 3.0), (0.1, 3, 50, 0.0, 0.0, 3.0), (0.1, 0, 50, 0.1, 0.0, 3.0), (None, 3, 50, 0.1, 0.0, 3.0), (math.nan, 3, 50, 0.1, 0.0, 3.0), (2.0, 3, 50, 0.1, 3.0, 1.0)]


def test_deflated_ratio_by_numbers(spark):
    kinds = "i int, observed double, n_trials int, n_obs int, var_trials double, skew double, kurt double"
    got = {r["i"]: r["deflated"] for r in validation.deflated_sharpe(spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS + WITHOUT)], kinds)).collect()}
    for i, row in enumerate(ROWS):
        assert got[i] == pytest.approx(deflated(*row), abs=2e-5)
    assert all(got[len(ROWS) + i] is None for i in range(len(WITHOUT)))


def test_deflated_ratio_of_the_query(spark):
    c = duckdb.connect()
    for name in ("nation", "region", "lineitem", "part", "orders", "customer"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    series = defaultdict(list)
    for trial, ret in c.sql(CTE + ", " + backtests.TRIALS_ALL + " SELECT trial, ret FROM tr ORDER BY ALL").fetchall():
        if ret is not None:
            series[trial].append(ret)
    x = {k: np.array(v) for k, v in series.items()}
    moment = lambda v, p: float(((v - v.mean()) ** p).mean())
    ratio = {k: float(v.mean() / v.std(ddof=1)) for k, v in x.items() if len(v) > 1}
    var = float(np.var(list(ratio.values()), ddof=1))
    got = {r["trial"]: r for r in catalogue.QUERIES["val_deflated_sharpe"](spark, SMALL).collect()}
    assert set(got) >= set(x) and len(x) > 10
    n = len(got)
    for k in sorted(x)[::4]:
        v = x[k]
        wanted = deflated(ratio[k], n, len(v), var, moment(v, 3) / moment(v, 2) ** 1.5, moment(v, 4) / moment(v, 2) ** 2)
        assert got[k]["n_obs"] == len(v) and got[k]["n_trials"] == n and got[k]["deflated"] == pytest.approx(wanted, abs=2e-5)
