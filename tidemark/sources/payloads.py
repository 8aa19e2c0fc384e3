"""Landed JSON payloads to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHART = "struct<chart:struct<result:array<struct<timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<bigint>>>,adjclose:array<struct<adjclose:array<double>>>>>>,error:string>>"


def parse_chart(payloads: DataFrame) -> DataFrame:
    """payloads(ticker, payload) -> ticker, d, open, high, low, close, volume, adj_close; bars that lack a price are skipped, a missing
    volume is 0, and a missing adjusted close is the close. Payloads with an error or without a result give no rows."""
    r = payloads.select("ticker", F.from_json("payload", CHART)["chart"].alias("chart")).where("chart.error is null").select("ticker", F.get("chart.result", F.lit(0)).alias("r"))
    q, adj = F.get("r.indicators.quote", F.lit(0)), F.get("r.indicators.adjclose", F.lit(0))["adjclose"]
    rows = r.select("ticker", F.posexplode("r.timestamp").alias("i", "ts"), q.alias("q"), adj.alias("adj"))
    at = lambda c: F.get(F.col(c), F.col("i"))
    bars = rows.select("ticker", F.timestamp_seconds("ts").cast("date").alias("d"), *[at(f"q.{c}").alias(c) for c in ("open", "high", "low", "close")], F.coalesce(at("q.volume"), F.lit(0).cast("long")).alias("volume"), at("adj").alias("adj"))
    return bars.dropna(subset=["open", "high", "low", "close"]).select("ticker", "d", "open", "high", "low", "close", "volume", F.coalesce("adj", "close").alias("adj_close"))
