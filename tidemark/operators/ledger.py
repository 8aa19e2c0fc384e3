"""Costs, fills, equity ledgers and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAX, DAY_TAX, COMMISSION_BPS, SLIPPAGE_BPS, IMPACT = 0.003, 0.0015, 14.25, 5.0, 0.1


def trade_cost(notional: Column, sells: Column, adv: Column, day_trade: Column | bool = False) -> Column:
    """Commission, tax on sales (halved for day trades), slippage, and impact with the root of the share of the day's volume."""
    n = F.abs(notional)
    tax = F.when(sells, F.when(F.lit(day_trade) if isinstance(day_trade, bool) else day_trade, DAY_TAX).otherwise(TAX)).otherwise(0.0)
    impact = F.when(adv > 0, n * IMPACT * F.sqrt(n / adv)).otherwise(0.0)
    return n * (COMMISSION_BPS / 1e4) + n * tax + n * (SLIPPAGE_BPS / 1e4) + impact


def fills(targets: DataFrame, bars: DataFrame, equity: float) -> DataFrame:
    """targets(run, d, pos, entity, weight), dense by run and entity -> fills where the target changed: run, d, entity, shares, price, cost.

    An entity without a bar on the day is skipped; it isn't tried again until its target changes.
    """
    w = Window.partitionBy("run", "entity").orderBy("pos")
    moved = targets.withColumn("delta", F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0))).where("abs(delta) > 1e-12")
    at = moved.join(bars.select("d", F.col("asset").alias("entity"), "close", "volume"), ["d", "entity"])
    notional = F.col("delta") * equity
    return at.select("run", "d", "entity", (notional / F.col("close")).alias("shares"), F.col("close").alias("price"), trade_cost(notional, F.col("delta") < 0, F.col("volume") * F.col("close")).alias("cost"))


def equity(fill_rows: DataFrame, grid: DataFrame, initial: float) -> DataFrame:
    """fills and grid(d, asset, pos, close) -> run, d, cash, value, equity; shares are marked at the last close."""
    runs = F.broadcast(fill_rows.select("run").distinct())
    cells = grid.select("d", "pos", F.col("asset").alias("entity"), "close").crossJoin(runs).join(fill_rows, ["run", "d", "entity"], "left")
    w = Window.partitionBy("run", "entity").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = cells.withColumn("held", F.coalesce(F.sum("shares").over(w), F.lit(0.0))).withColumn("mark", F.last(F.coalesce("close", "price"), ignorenulls=True).over(w))
    days = marked.groupBy("run", "d", "pos").agg(F.sum(F.coalesce(F.col("shares") * F.col("price") + F.col("cost"), F.lit(0.0))).alias("spent"), F.sum(F.col("held") * F.coalesce("mark", F.lit(0.0))).alias("value"))
    v = Window.partitionBy("run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = days.withColumn("cash", initial - F.sum("spent").over(v))
    return out.select("run", "d", "cash", "value", (F.col("cash") + F.col("value")).alias("equity"))


def attribution(returns: DataFrame) -> DataFrame:
    """returns(portfolio, ret, bench, cost, ideal) -> total, beta, market, cost, timing and alpha (what is left)."""
    g = returns.groupBy("portfolio").agg(
        (F.product(1 + F.col("ret")) - 1).alias("total"), (F.product(1 + F.col("bench")) - 1).alias("market_total"), F.coalesce(F.try_divide(F.covar_samp("ret", "bench"), F.nullif(F.var_samp("bench"), F.lit(0.0))), F.lit(0.0)).alias("beta"),
        F.sum("cost").alias("cost"), F.sum(F.col("ret") - F.col("ideal")).alias("timing"),
    )
    g = g.withColumn("market", F.col("beta") * F.col("market_total"))
    return g.select("portfolio", "total", "beta", "market", "cost", "timing", (F.col("total") - F.col("market") - F.col("cost") - F.col("timing")).alias("alpha"))
