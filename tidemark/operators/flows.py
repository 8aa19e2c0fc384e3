"""Institutional fund flows: values, security and industry signals, stages and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .groups import chosen, percent

INVESTORS = ("foreign", "trust", "dealer", "total")
#: Score weights, names of investors, and the action that goes with each stage.
SCORE_WEIGHTS = {"intensity_20": 40.0, "intensity_5": 30.0, "trust_20": 20.0, "return_20": 10.0}
NAMES = {"foreign": "外資", "trust": "投信", "dealer": "自營商"}
ACTIONS = {
    "早期轉入": "列入觀察，等待中期流量或價格確認",
    "資金累積＋價格確認": "優先研究領先股，分批而非追價",
    "資金累積、價格未確認": "等待價格轉強與流入廣度擴大",
    "漲勢仍在、資金減速": "不追價，提高停利或降低權重",
    "中期流入、短期轉弱": "保留觀察，等待短期資金回流",
    "資金撤出": "排除逆勢加碼，檢查既有部位風險",
    "觀察": "訊號不一致，暫不採取方向性動作",
}


def stage(short: Column, long: Column, ret: Column) -> Column:
    """The first stage whose signs fit; comparisons with null fit none."""
    return (
        F.when((short > 0) & (long <= 0), "早期轉入").when((short > 0) & (long > 0) & (ret > 0), "資金累積＋價格確認").when((short > 0) & (long > 0) & (ret <= 0), "資金累積、價格未確認")
        .when((short <= 0) & (long > 0) & (ret > 0), "漲勢仍在、資金減速").when((short <= 0) & (long > 0) & (ret <= 0), "中期流入、短期轉弱").when((short < 0) & (long < 0), "資金撤出").otherwise("觀察")
    )


def action(stage_: Column) -> Column:
    return chosen(stage_, ACTIONS, "觀察")


def rank_percent(x: Column, *partition: str) -> Column:
    """Average rank over the number of values; null and infinite count as one half."""
    x = F.when(F.abs(x) != float("inf"), x)
    w = Window.partitionBy(*partition)
    n = F.count(x).over(w)
    ties = F.count(x).over(Window.partitionBy(*partition, x))
    rank = F.rank().over(w.orderBy(x.asc_nulls_last()))
    return F.when(x.isNull(), 0.5).otherwise((rank + (ties - 1) / 2) / n)


def flow_score(weights: dict | None = None, *partition: str) -> Column:
    weights = {k: w for k, w in (weights or SCORE_WEIGHTS).items() if w > 0}
    score = F.lit(0.0)
    for k, w in weights.items():
        score = score + rank_percent(F.col(k), *partition) * w
    return 100 * score / sum(weights.values())


def flow_dates(flows: DataFrame, prices: DataFrame, long_window: int = 20) -> DataFrame:
    """d and back (1 is the last) of the last flow dates up to the last price date."""
    cutoff = F.broadcast(prices.agg(F.max("d").alias("cutoff")))
    dates = flows.select("d").distinct().crossJoin(cutoff).where("d <= cutoff").select("d")
    return dates.withColumn("back", F.row_number().over(Window.orderBy(F.desc("d")))).where(F.col("back") <= long_window)  # one row a date


def close_on(flow_days: DataFrame, prices: DataFrame) -> DataFrame:
    """d, back, asset, close on the flow dates, filled forward among these dates only."""
    grid = flow_days.crossJoin(F.broadcast(prices.select("asset").distinct())).join(prices.select("d", "asset", "close"), ["d", "asset"], "left")
    w = Window.partitionBy("asset").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn("close", F.last("close", ignorenulls=True).over(w))


def flow_values(flows: DataFrame, prices: DataFrame, long_window: int = 20) -> DataFrame:
    """Flows of the last dates of priced assets with close, back and each investor's net value."""
    days = F.broadcast(flow_dates(flows, prices, long_window))
    closes = close_on(days, prices).select("d", "asset", "close")
    kept = flows.join(days, "d").join(prices.select("asset").distinct(), "asset", "left_semi").join(closes, ["d", "asset"], "left")
    return kept.select("d", "asset", "back", "close", *[f"{i}_net" for i in INVESTORS], *[(F.col(f"{i}_net") * F.col("close")).alias(f"{i}_value") for i in INVESTORS])


def last_returns(prices: DataFrame, window: int = 20) -> DataFrame:
    """asset, last_close and return_20 over `window` rows of the shared grid, filled forward; one row an asset."""
    days = prices.select("d").distinct().withColumn("back", F.row_number().over(Window.orderBy(F.desc("d"))))  # one row a date
    ends = F.broadcast(days.where(F.col("back").isin(1, window + 1)))
    at = prices.where("close is not null").join(ends.select(F.col("d").alias("end"), "back"), F.col("d") <= F.col("end")).groupBy("asset").agg(
        F.max_by(F.when(F.col("back") == 1, F.col("close")), F.when(F.col("back") == 1, F.col("d"))).alias("last_close"), F.max_by(F.when(F.col("back") > 1, F.col("close")), F.when(F.col("back") > 1, F.col("d"))).alias("then")
    )
    return at.select("asset", "last_close", (F.col("last_close") / F.col("then") - 1).alias("return_20"))


def security_signals(flows: DataFrame, prices: DataFrame, master: DataFrame, long_window: int = 20, short_window: int = 5) -> DataFrame:
    v = flow_values(flows, prices, long_window)
    short = F.col("back") <= short_window
    sums = v.groupBy("asset").agg(
        *[F.coalesce(F.sum(f"{i}_value"), F.lit(0.0)).alias(f"{i}_20") for i in INVESTORS], F.sum("total_net").alias("shares_20"), F.sum("trust_net").alias("trust_shares_20"),
        F.coalesce(F.sum(F.when(short, F.col("total_value"))), F.lit(0.0)).alias("value_5"), F.coalesce(F.sum(F.when(short, F.col("total_net"))), F.lit(0.0)).alias("shares_5"),
    )
    m = master.dropDuplicates(["ticker"]).select(F.col("ticker").alias("asset"), "industry", "issued_shares")
    out = sums.join(F.broadcast(m), "asset", "left").join(last_returns(prices, long_window), "asset", "left")
    shares = F.nullif("issued_shares", F.lit(0.0))
    out = out.withColumns({"cap": F.col("issued_shares") * F.col("last_close"), "intensity_5": F.col("shares_5") / shares, "intensity_20": F.col("shares_20") / shares, "trust_20_intensity": F.col("trust_shares_20") / shares})
    scored = out.withColumnRenamed("trust_20", "trust_value_20").withColumnRenamed("trust_20_intensity", "trust_20")
    return scored.withColumn("score", flow_score()).withColumn("stage", stage(F.col("intensity_5"), F.col("intensity_20"), F.col("return_20")))


def industry_signals(securities: DataFrame) -> DataFrame:
    s = securities.where("industry is not null").withColumnRenamed("trust_value_20", "trust_v")
    w = Window.partitionBy("industry")
    s = s.withColumn("lead", F.row_number().over(w.orderBy(F.desc("score"), "asset"))).withColumn("size_rank", F.row_number().over(w.orderBy(F.desc(F.abs("total_20")), "asset")))
    size = F.abs("total_20")
    g = s.groupBy("industry").agg(
        F.count_distinct("asset").alias("constituents"), F.sum("value_5").alias("value_5"), F.sum("total_20").alias("value_20"), F.sum("foreign_20").alias("foreign_20"), F.sum("trust_v").alias("trust_v"), F.sum("dealer_20").alias("dealer_20"),
        F.sum("cap").alias("cap"), F.avg("return_20").alias("return_20"), F.avg((F.col("total_20") > 0).cast("double")).alias("breadth"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("lead") <= 3, F.struct("lead", "asset")))), lambda x: x["asset"]), "、").alias("leaders"),
        F.when(F.sum(size) > 0, F.sum(F.when(F.col("size_rank") <= 3, size)) / F.sum(size)).otherwise(0.0).alias("concentration"),
    )
    cap = F.nullif("cap", F.lit(0.0))
    g = g.withColumns({"intensity_5": F.col("value_5") / cap, "intensity_20": F.col("value_20") / cap, "trust_20": F.col("trust_v") / cap})
    g = g.withColumn("score", flow_score()).withColumn("stage", stage(F.col("intensity_5"), F.col("intensity_20"), F.col("return_20")))
    a, b, c = F.abs("foreign_20"), F.abs("trust_v"), F.abs("dealer_20")
    first = F.when((a >= b) & (a >= c), "foreign").when(b >= c, "trust").otherwise("dealer")
    g = g.withColumn("dominant", first).withColumn("dominant_value", F.when(first == "foreign", F.col("foreign_20")).when(first == "trust", F.col("trust_v")).otherwise(F.col("dealer_20")))
    g = g.withColumn("acceleration", F.col("value_5") - F.col("value_20") / 4).withColumn("action", action(F.col("stage")))
    up = F.col("return_20") > 0
    reason = F.concat(
        chosen(F.col("dominant"), NAMES), F.when(F.col("dominant_value") >= 0, "主導淨流入").otherwise("主導淨流出"), F.format_string("（20日 %+.1f億）；近5日相較20日均速", F.col("dominant_value") / 1e8),
        F.when(F.col("acceleration") > 0, "加速").otherwise("減速"), F.lit("；流入廣度 "), percent(F.col("breadth"), 0, False), F.lit("；前三大帶動標的占絕對流量 "), percent(F.col("concentration"), 0, False),
        F.when(up, "；價格已確認（20日 ").otherwise("；價格尚未確認（20日 "), percent(F.col("return_20")), F.lit("）。主要標的："), F.col("leaders"), F.lit("。"),
    )
    return g.withColumn("reason", reason)


def leadership(holdings: DataFrame, prices: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    """holdings(etf, holding_ticker, weight, ord) with each holding's composite return over its own rows, leadership (weight times
    composite) and rank in its fund; holdings whose history doesn't exceed the longest horizon have neither."""
    weights = weights or {21: 0.2, 63: 0.3, 126: 0.5}
    w = Window.partitionBy("asset")
    back = prices.where("close is not null").withColumn("back", F.row_number().over(w.orderBy(F.desc("d"))))
    wanted = back.where(F.col("back").isin(1, *[k + 1 for k in weights])).groupBy("asset").agg(*[F.max(F.when(F.col("back") == k, F.col("close"))).alias(f"c{k}") for k in (1, *[k + 1 for k in weights])])
    composite = F.lit(0.0)
    for k, x in weights.items():
        composite = composite + (F.col("c1") / F.col(f"c{k + 1}") - 1) * (x / sum(weights.values()))
    out = holdings.join(wanted.select(F.col("asset").alias("holding_ticker"), composite.alias("composite")), "holding_ticker", "left").withColumn("leadership", F.col("weight") * F.col("composite"))
    rank = F.row_number().over(Window.partitionBy("etf").orderBy(F.desc_nulls_last("leadership"), "ord"))
    return out.withColumn("rnk", F.when(F.col("leadership").isNotNull(), rank.cast("long")))
