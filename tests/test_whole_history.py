"""Repair and adjustment over whole series."""

import datetime as dt
import math

from tidemark import catalogue
from tidemark.operators import pit

SMALL = "/root/testdata/sf0.001"


def test_repair_holds_where_the_product_of_jumps_overflows(spark):
    first = dt.date(2000, 1, 1)
    rows = [("X", first + dt.timedelta(days=i), 1.5 ** (i % 2) if i % 3 else 10.0 ** (i // 3 % 100)) for i in range(1500)]
    jumps = [b[2] / a[2] for a, b in zip(rows, rows[1:])]
    rises = [("Y", first + dt.timedelta(days=i), 2.0**i) for i in range(1000)] + [("Y", first + dt.timedelta(days=1000 + i), 2.0 ** (999 - 0.5 * i)) for i in range(1, 1000)]
    found = {(r["asset"], r["d"]): r["log_repaired"] for r in pit.repaired(spark.createDataFrame(rows + rises, "asset string, d date, close double")).collect()}
    for i, (asset, d, close) in enumerate(rows):
        want = math.log(close) + sum(math.log(j) for j in jumps[i:] if j < 0.6 or j > 1.4)
        assert math.isclose(found[asset, d], want, abs_tol=1e-6)
    assert math.isclose(found["Y", first], 999 * math.log(2), abs_tol=1e-6)


def test_every_date_is_adjusted_and_repaired(spark):
    for whole, cut in (("pipe_adjusted_prices_all", "pipe_adjusted_prices"), ("win_repair_all", "win_repair")):
        assert catalogue.QUERIES[whole](spark, SMALL).count() > catalogue.QUERIES[cut](spark, SMALL).count()
    assert catalogue.QUERIES["pipe_adjusted_prices_all"](spark, SMALL).count() == catalogue.QUERIES["jn_factor_range"](spark, SMALL).count()
