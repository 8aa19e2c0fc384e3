"""Backtest validation: purged splits, overfitting probability, deflated Sharpe ratios, capacity."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def sharpe(mean: Column, sd: Column, scale: Column, n: Column, per_year: int = 252) -> Column:
    """Annualised; null below two values or where the deviation is nothing but rounding of the largest value `scale`."""
    return F.when((n >= 2) & (sd > F.greatest(scale * 1e-12, F.lit(1e-15))), mean / sd * per_year**0.5)


def walk_forward(positions: DataFrame, n: int, splits: int, embargo: int) -> DataFrame:
    """positions(pos from 0) -> split, pos, role: train before the fold, test after the embargo."""
    fold = n // (splits + 1)
    k = F.explode(F.sequence(F.lit(1), F.lit(splits)))
    s = positions.select("pos", k.alias("split"))
    start = fold * F.col("split")
    role = F.when(F.col("pos") < start, "train").when((F.col("pos") >= start + embargo) & (F.col("pos") < F.least(start + embargo + fold, F.lit(n))), "test")
    return s.withColumn("role", role).where("role is not null").select("split", "pos", "role")


def combinatorial(spark: SparkSession, positions: DataFrame, n: int, groups: int, test: int, embargo: int) -> DataFrame:
    """positions -> split, pos, role over all choices of `test` groups; the last group takes the remainder; train keeps away from test by the embargo."""
    size = n // groups
    span = [(g * size, n if g == groups - 1 else (g + 1) * size) for g in range(groups)]
    rows = [(i, *span[g]) for i, chosen in enumerate(itertools.combinations(range(groups), test)) for g in chosen]
    spans = F.broadcast(spark.createDataFrame(rows, "split int, lo int, hi int").groupBy("split").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))  # C(groups, test) rows
    p = F.col("pos")
    at = positions.crossJoin(spans)
    inside = F.exists("spans", lambda s: (p >= s["lo"]) & (p < s["hi"]))
    near = F.exists("spans", lambda s: (p >= s["lo"] - embargo) & (p < s["hi"] + embargo))
    return at.withColumn("role", F.when(inside, "test").when(~near, "train")).where("role is not null").select("split", "pos", "role")


def overfitting(spark: SparkSession, trials: DataFrame, n: int, groups: int) -> DataFrame:
    """trials(trial, pos from 0, ret) -> one row: pbo, n_splits. Moments by trial and group, merged for each half of the groups; the remainder is dropped."""
    size = n // groups
    m = trials.where(F.col("pos") < size * groups).withColumn("g", F.floor(F.col("pos") / size).cast("int")).groupBy("trial", "g").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), (F.var_pop("ret") * F.count("ret")).alias("m2"), F.max(F.abs("ret")).alias("scale"))
    halves = [(i, g, g in set(c)) for i, c in enumerate(itertools.combinations(range(groups), groups // 2)) for g in range(groups)]
    sides = F.broadcast(spark.createDataFrame(halves, "split int, g int, inside boolean"))
    tot = m.join(sides, "g").groupBy("split", "inside", "trial").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum("m2").alias("within"), F.sum(F.col("n") * F.col("mean") ** 2).alias("between"), F.max("scale").alias("scale"))
    var = (F.col("within") + F.col("between") - F.col("n") * F.col("mean") ** 2) / (F.col("n") - 1)
    s = tot.withColumn("s", sharpe(F.col("mean"), F.sqrt(F.greatest(var, F.lit(0.0))), F.col("scale"), F.col("n"), 1))
    out = s.where("not inside").select("split", "trial", F.col("s").alias("out"))
    best = s.where("inside and s is not null").withColumn("rn", F.row_number().over(Window.partitionBy("split").orderBy(F.desc("s"), "trial"))).where("rn = 1").join(out, ["split", "trial"]).select("split", F.col("out").alias("mine"))
    share = out.where("out is not null").join(F.broadcast(best), "split").groupBy("split").agg(F.avg((F.col("out") < F.col("mine")).cast("double")).alias("rank"))
    return share.agg(F.avg((F.col("rank") < 0.5).cast("double")).alias("pbo"), F.count("*").alias("n_splits"))


def deflated_sharpe(rows: DataFrame) -> DataFrame:
    """rows(..., observed, n_trials, n_obs, var_trials, skew, kurt) with deflated: the chance that the ratio beats the best of n_trials by luck.

    Null where a figure is missing, for fewer than three observations, for ratios that don't vary, and where the spread isn't positive."""

    @F.pandas_udf("double")
    def chance(observed: pd.Series, trials: pd.Series, n: pd.Series, var: pd.Series, skew: pd.Series, kurt: pd.Series) -> pd.Series:
        z = NormalDist()

        def one(sr, k, n, v, s, q):
            if any(x is None or x != x for x in (sr, k, n, v, s, q)) or k < 1 or n < 3 or v <= 0:
                return None
            best = 0.0 if k == 1 else math.sqrt(v) * ((1 - EULER) * z.inv_cdf(1 - 1 / k) + EULER * z.inv_cdf(1 - 1 / (k * math.e)))
            spread = 1 - s * sr + (q - 1) / 4 * sr * sr
            return z.cdf((sr - best) * math.sqrt(n - 1) / math.sqrt(spread)) if spread > 0 else None

        return pd.Series([one(*x) for x in zip(observed, trials, n, var, skew, kurt)], dtype="float64")

    return rows.withColumn("deflated", chance(*[F.col(c).cast("double") for c in ("observed", "n_trials", "n_obs", "var_trials", "skew", "kurt")]))


def capacity(strategies: DataFrame, levels: list[float], cap: float = 0.05, coef: float = 0.1) -> DataFrame:
    """strategies(strategy, base_return, adv_value, turnover) at each capital level: participation, net_return, decay."""
    at = strategies.withColumn("capital", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    part = F.col("capital") * F.col("turnover") / 252 / F.col("adv_value")
    net = F.col("base_return") - coef * F.sqrt(F.least(part, F.lit(cap))) * F.col("turnover")
    return at.withColumn("participation", part).withColumn("net_return", net).withColumn("decay", F.col("base_return") - F.col("net_return"))
