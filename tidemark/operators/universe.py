"""Universes chosen from the security master and from catalogues of themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def from_master(master: DataFrame, markets: list[str] | None = None, asset_types: list[str] | None = None, industries: list[str] | None = None) -> DataFrame:
    """master(ticker, name, market, asset_type, industry) -> ticker, name with market and type, grp; an empty list chooses all."""
    out = master
    for column, wanted in (("market", markets), ("asset_type", asset_types), ("industry", industries)):
        out = out.where(F.col(column).isin(wanted)) if wanted else out
    return out.select("ticker", F.concat("name", F.lit(" ("), "market", F.lit("／"), "asset_type", F.lit(")")).alias("name"), F.col("industry").alias("grp"))


def from_industries(master: DataFrame, industries: list[str], most: int | None = None, stock: str = "stock") -> DataFrame:
    """Stocks of the industries, `most` of each at most: those of the most issued shares, ties by ticker."""
    kept = master.where(F.col("industry").isin(industries) & (F.col("asset_type") == stock))
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("industry").orderBy(F.desc_nulls_last("issued_shares"), "ticker")))
    kept = kept.where(F.col("place") <= most) if most is not None else kept
    return kept.select("ticker", F.concat("name", F.lit(" ("), "market", F.lit(")")).alias("name"), F.col("industry").alias("grp"), "place")


def from_themes(catalogue: DataFrame, master: DataFrame, themes: list[str]) -> DataFrame:
    """catalogue(theme, grp_ord, code, tick_ord) of the themes that the master knows by code: a ticker belongs to the first theme that has it."""
    both = catalogue.where(F.col("theme").isin(themes)).join(master.select("code", "ticker", "name", "market"), "code")
    first = F.row_number().over(Window.partitionBy("ticker").orderBy("grp_ord", "tick_ord"))
    return both.withColumn("first", first).where("first = 1").select("ticker", F.concat("name", F.lit(" ("), "market", F.lit(")")).alias("name"), F.col("theme").alias("grp"))
