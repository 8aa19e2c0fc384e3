"""Momentum rotation: scores, target weights, backtests and their summaries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import PERIODS_PER_YEAR, by_asset, change, dense, resample

EQUAL, MOMENTUM, INVERSE_VOLATILITY, CUSTOM = "Equal weight", "Momentum weight", "Inverse volatility", "Custom rank weights"


@dataclass(frozen=True)
class Rotation:
    """What a rotation run needs; weights of lookbacks are normalised to 1."""

    lookbacks: dict[int, float] = field(default_factory=lambda: {1: 0.5, 3: 0.3, 6: 0.2})
    top_n: int = 5
    weighting: str = EQUAL
    rank_weights: tuple[float, ...] = (0.4, 0.3, 0.2, 0.1)
    frequency: str = "Monthly"
    positive_only: bool = True
    risk_adjusted: bool = False
    volatility_window: int = 6
    cost_bps: float = 10.0
    defensive: str | None = None

    def __post_init__(self) -> None:
        if self.top_n < 1 or not self.lookbacks or min(self.lookbacks) < 1 or sum(self.lookbacks.values()) <= 0:
            raise ValueError("top_n and lookbacks must be positive")


def rolling_volatility(window: int, per_year: int) -> Column:
    """Annualised deviation of the last `window` returns in column `ret`; null unless all are there."""
    w = by_asset().rowsBetween(-(window - 1), 0)
    return F.when(F.count("ret").over(w) == window, F.stddev_samp("ret").over(w) * (per_year**0.5))


def scored(grid: DataFrame, how: Rotation) -> DataFrame:
    """grid with ret, vol and score: the weighted sum of the lookbacks' returns, null unless every one exists."""
    total = sum(how.lookbacks.values())
    score = F.lit(0.0)
    for k, w in how.lookbacks.items():
        score = score + change(k) * (w / total)
    out = grid.withColumn("ret", change(1)).withColumn("score", score).withColumn("vol", rolling_volatility(how.volatility_window, PERIODS_PER_YEAR[how.frequency]))
    return out.withColumn("score", F.try_divide("score", F.nullif("vol", F.lit(0.0)))) if how.risk_adjusted else out


def selected(scores: DataFrame, how: Rotation, keys: tuple = ("d",)) -> DataFrame:
    """The top_n scores of each date, ties in the order of `ord`, with rnk from 1."""
    kept = scores.where("score is not null and score > 0" if how.positive_only else "score is not null")
    return kept.withColumn("rnk", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "ord"))).where(F.col("rnk") <= how.top_n)


def target_weights(scores: DataFrame, how: Rotation, keys: tuple = ("d",)) -> DataFrame:
    """(*keys, asset, weight); dates on which nothing is selected hold the defensive asset, warm-up included."""
    day = Window.partitionBy(*keys)
    top = selected(scores, how, keys)
    equal = 1.0 / F.count("*").over(day)
    if how.weighting == EQUAL:
        weight = equal
    elif how.weighting == MOMENTUM:
        strength = F.greatest("score", F.lit(0.0))
        weight = strength / F.sum(strength).over(day)
    elif how.weighting == INVERSE_VOLATILITY:
        inverse = F.try_divide(F.lit(1.0), F.nullif("vol", F.lit(0.0)))
        some = F.sum(inverse).over(day)
        weight = F.when(some.isNull(), equal).otherwise(F.coalesce(inverse / some, F.lit(0.0)))
    elif how.weighting == CUSTOM:
        given = F.coalesce(F.get(F.array(*[F.lit(float(x)) for x in how.rank_weights]), F.col("rnk") - 1), F.lit(0.0))
        some = F.sum(given).over(day)
        weight = F.when(some > 0, given / some).otherwise(equal)
    else:
        raise ValueError(f"unknown weighting {how.weighting}")
    out = top.select(*keys, "asset", weight.alias("weight"))
    if how.defensive:
        bare = scores.select(*keys).distinct().join(top.select(*keys).distinct(), list(keys), "left_anti")
        out = out.unionByName(bare.select(*keys, F.lit(how.defensive).alias("asset"), F.lit(1.0).alias("weight")))
    return out


def backtest(grid: DataFrame, how: Rotation, candidates: list[str] | None = None) -> DataFrame:
    """grid(d, pos, asset, ord, close) -> d, pos, gross, turnover, cost, net. Targets set on a date earn the next date's return;
    half the change in weights pays cost_bps; the run starts one date after the first score."""
    all_scores = scored(grid, how)
    scores = all_scores.where(F.col("asset").isin(candidates)) if candidates is not None else all_scores
    if how.defensive:
        scores = scores.where(F.col("asset") != how.defensive)
    target = target_weights(scores, how)
    w = by_asset()
    held = all_scores.join(target, ["d", "asset"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    held = held.withColumn("deployed", F.lag("weight", 1, 0.0).over(w))
    held = held.withColumn("moved", F.abs(F.col("deployed") - F.lag("deployed", 1).over(w)))
    days = held.groupBy("d", "pos").agg(F.coalesce(F.sum(F.col("deployed") * F.col("ret")), F.lit(0.0)).alias("gross"), F.coalesce(F.sum("moved") / 2, F.lit(0.0)).alias("turnover"))
    first = scores.where("score is not null").agg((F.min("pos") + 1).alias("start"))
    cost = F.col("turnover") * (how.cost_bps / 10_000)
    return days.crossJoin(F.broadcast(first)).where(F.col("start").isNull() | (F.col("pos") >= F.col("start"))).select("d", "pos", "gross", "turnover", cost.alias("cost"), (F.col("gross") - cost).alias("net"))


def equity(returns: DataFrame, keys: tuple = (), order: str = "pos", ret: str = "net") -> DataFrame:
    """returns with equity (running product, null as 0) and drawdown (from the running peak). Each key is one series, in one task."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = returns.withColumn("equity", F.product(1 + F.coalesce(ret, F.lit(0.0))).over(w))
    return out.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def performance(returns: DataFrame, per_year: int, keys: tuple = (), order: str = "pos", ret: str = "net") -> DataFrame:
    """(*keys, n, cagr, volatility, sharpe, max_drawdown, win_rate); nulls dropped; no growth rate for a lost series, no ratio without deviation."""
    e = equity(returns.where(F.col(ret).isNotNull()), keys, order, ret)
    r = F.col(ret)
    agg = e.groupBy(*keys).agg(F.count("*").alias("n"), F.product(1 + r).alias("end"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), F.min("drawdown").alias("max_drawdown"), F.avg((r > 0).cast("double")).alias("win_rate"))
    cagr = F.when(F.col("end") > 0, F.pow(F.col("end"), F.lit(float(per_year)) / F.col("n")) - 1)
    return agg.select(*keys, "n", cagr.alias("cagr"), (F.col("sd") * per_year**0.5).alias("volatility"), (F.col("mean") / F.nullif("sd", F.lit(0.0)) * per_year**0.5).alias("sharpe"), "max_drawdown", "win_rate")


def panel(prices: DataFrame, assets: DataFrame, frequency: str) -> DataFrame:
    return dense(resample(prices, frequency), assets)
