"""Shared date grids: positional lags only mean something once every asset has a row for every date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIODS_PER_YEAR = {"Daily": 252, "Weekly": 52, "Monthly": 12}


def period_key(d: str | Column, frequency: str) -> Column:
    """The period of a date: itself, its Friday-ending week, or its month."""
    d = F.col(d) if isinstance(d, str) else d
    if frequency == "Daily":
        return d
    if frequency == "Weekly":
        return F.next_day(F.date_sub(d, 1), "Fri")
    if frequency == "Monthly":
        return F.trunc(d, "MM")
    raise ValueError(f"unknown frequency {frequency}")


def calendar(prices: DataFrame, frequency: str = "Daily") -> DataFrame:
    """d (the last date in each period over all assets), period and pos (from 1). The window has one row a date, whatever the number of assets."""
    dates = prices.where("close is not null").select("d").distinct().groupBy(period_key("d", frequency).alias("period")).agg(F.max("d").alias("d"))
    return dates.withColumn("pos", F.row_number().over(Window.orderBy("period")).cast("long"))


def resample(prices: DataFrame, frequency: str) -> DataFrame:
    """prices(d, asset, close) -> d, pos, asset, close: the last price that isn't null in each period, labelled by the period's last date."""
    cal = calendar(prices, frequency)
    kept = prices.where("close is not null").withColumn("period", period_key("d", frequency)).groupBy("period", "asset").agg(F.max_by("close", "d").alias("close"))
    return kept.join(cal, "period").select("d", "pos", "asset", "close")


def dense(sampled: DataFrame, assets: DataFrame) -> DataFrame:
    """A row for every date and asset; close is null where there is no price. assets is a dimension: dates times assets is the panel itself."""
    dates = sampled.select("d", "pos").distinct()
    return dates.crossJoin(F.broadcast(assets)).join(sampled.select("d", "asset", "close"), ["d", "asset"], "left")


def by_asset() -> Window:
    return Window.partitionBy("asset").orderBy("pos")


def change(k: int, price: str = "close") -> Column:
    """The return over k rows of the grid, without any fill."""
    return F.col(price) / F.lag(price, k).over(by_asset()) - 1


def forward_filled(price: str = "close", keys: tuple = ("asset",), order: str = "pos") -> Column:
    return F.last(price, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def compounded(x: Column, window) -> Column:
    """Running product of 1 + x."""
    return F.product(1 + x).over(window.rowsBetween(Window.unboundedPreceding, 0))


def panel_daily(prices: DataFrame, assets: DataFrame) -> DataFrame:
    """The dense daily grid: prices' dates times assets."""
    return dense(calendar(prices).select("d", "pos").join(prices.select("d", "asset", "close"), "d"), assets)
