"""The sweep against single runs, and its plan against the number of configurations."""

import re

from tidemark.operators import rotation as ro
from tidemark.operators import sweep
from tidemark.plans import rotation as plans
from tidemark.plans.views import Tables

SMALL = "/root/testdata/sf0.001"


def test_each_run_of_the_sweep_is_the_single_run(spark):
    t = Tables(spark, SMALL)
    grids = plans.swept_grids(t)
    some = [("Weekly", 3, ro.MOMENTUM, "2-12", False), ("Monthly", 5, ro.INVERSE_VOLATILITY, "1", True), ("Weekly", 5, ro.CUSTOM, "1-3-6", True)]
    for f, n, w, k, r in some:
        configs = plans.configurations(t, (f,), (n,), (w,), (k,), (r,))
        how = ro.Rotation(plans.LOOKBACKS[k], n, w, frequency=f, risk_adjusted=r, cost_bps=10.0 if f == "Monthly" else 25.0, defensive=plans.defensive(t))
        one = {x["d"]: x for x in ro.backtest(grids.where(f"frequency = '{f}'").drop("frequency"), how).collect()}
        many = {x["d"]: x for x in sweep.sweep(grids, configs).collect()}
        assert one.keys() == many.keys() and len(one) > 20
        for d, x in one.items():
            assert all(abs(x[c] - many[d][c]) < 1e-9 for c in ("gross", "turnover", "cost", "net"))


def test_shuffles_dont_depend_on_the_number_of_configurations(spark):
    t = Tables(spark, SMALL)

    def exchanges(**how):
        plan = sweep.sweep(plans.swept_grids(t), plans.configurations(t, **how))._jdf.queryExecution().executedPlan().toString()
        return len(re.findall(r"\bExchange\b", plan.split("== Final Plan ==")[0]))

    four, many = exchanges(frequencies=("Monthly",), tops=(5,), lookbacks=("1",)), exchanges(tops=(1, 2, 3, 5), risk_adjusted=(False, True))
    assert four == many and four < 15


def test_nothing_to_run(spark):
    t = Tables(spark, SMALL)
    none = spark.createDataFrame([], sweep.CONFIG)
    assert sweep.sweep(plans.swept_grids(t), none).count() == 0
    assert sweep.sweep(plans.swept_grids(t).limit(0), plans.configurations(t)).count() == 0
