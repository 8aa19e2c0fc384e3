"""Queries of the fund-flow radar and of ETF leadership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import flows as fl
from .registry import query, rounded
from .views import Tables

RANK = "(CASE WHEN {x} IS NULL THEN 0.5 ELSE (rank() OVER (ORDER BY {x}) + (count({x}) OVER (PARTITION BY {x}) - 1) / 2.0) / (count({x}) OVER ()) END)"
SCORE = "100 * (" + " + ".join(RANK.format(x=x) + f" * {w}" for x, w in fl.SCORE_WEIGHTS.items()) + ") / 100.0"
STAGE = """CASE WHEN intensity_5 > 0 AND intensity_20 <= 0 THEN '早期轉入' WHEN intensity_5 > 0 AND intensity_20 > 0 AND return_20 > 0 THEN '資金累積＋價格確認' WHEN intensity_5 > 0 AND intensity_20 > 0 AND return_20 <= 0 THEN '資金累積、價格未確認'
    WHEN intensity_5 <= 0 AND intensity_20 > 0 AND return_20 > 0 THEN '漲勢仍在、資金減速' WHEN intensity_5 <= 0 AND intensity_20 > 0 AND return_20 <= 0 THEN '中期流入、短期轉弱' WHEN intensity_5 < 0 AND intensity_20 < 0 THEN '資金撤出' ELSE '觀察' END"""
FLOW = f"""
fdates AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS back FROM (SELECT DISTINCT d FROM flows_daily WHERE d <= (SELECT max(d) FROM px_daily)) QUALIFY back <= 20),
fclose AS (SELECT f.d, f.back, a.asset, last_value(p.close IGNORE NULLS) OVER (PARTITION BY a.asset ORDER BY f.d ROWS UNBOUNDED PRECEDING) AS close FROM fdates f CROSS JOIN (SELECT DISTINCT asset FROM px_daily) a LEFT JOIN px_daily p ON p.d = f.d AND p.asset = a.asset),
vals AS (SELECT f.d, f.asset, c.back, c.close, foreign_net, trust_net, dealer_net, total_net, foreign_net * close AS foreign_value, trust_net * close AS trust_value, dealer_net * close AS dealer_value, total_net * close AS total_value FROM flows_daily f JOIN fclose c ON c.d = f.d AND c.asset = f.asset),
sums AS (
    SELECT asset, sum(foreign_value) AS foreign_20, sum(trust_value) AS trust_v, sum(dealer_value) AS dealer_20, sum(total_value) AS total_20, sum(total_net) AS shares_20, sum(trust_net) AS trust_shares,
        coalesce(sum(total_value) FILTER (back <= 5), 0) AS value_5, coalesce(sum(total_net) FILTER (back <= 5), 0) AS shares_5 FROM vals GROUP BY asset
),
gd AS (SELECT pos, asset, last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY pos ROWS UNBOUNDED PRECEDING) AS f FROM grid_day),
lastret AS (SELECT asset, max(f) FILTER (pos = n) AS last_close, max(f) FILTER (pos = n) / max(f) FILTER (pos = n - 20) - 1 AS return_20 FROM gd, (SELECT max(pos) AS n FROM cal_day) GROUP BY asset),
sec0 AS (SELECT s.*, m.industry, m.issued_shares, l.last_close, l.return_20, m.issued_shares * l.last_close AS cap, shares_5 / issued_shares AS intensity_5, shares_20 / issued_shares AS intensity_20, trust_shares / issued_shares AS trust_20 FROM sums s LEFT JOIN security_master m ON m.ticker = s.asset LEFT JOIN lastret l ON l.asset = s.asset),
sec AS (SELECT *, {SCORE} AS score, {STAGE} AS stage FROM sec0),
lead AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY score DESC, asset) AS lead, row_number() OVER (PARTITION BY industry ORDER BY abs(total_20) DESC, asset) AS size_rank FROM sec WHERE industry IS NOT NULL),
ind0 AS (
    SELECT industry, count(DISTINCT asset) AS constituents, sum(value_5) AS value_5, sum(total_20) AS value_20, sum(foreign_20) AS foreign_20, sum(trust_v) AS trust_v, sum(dealer_20) AS dealer_20, sum(cap) AS cap, avg(return_20) AS return_20,
        avg((total_20 > 0)::INTEGER) AS breadth, string_agg(asset, '、' ORDER BY lead) FILTER (lead <= 3) AS leaders, coalesce(sum(abs(total_20)) FILTER (size_rank <= 3) / nullif(sum(abs(total_20)), 0), 0) AS concentration FROM lead GROUP BY industry
),
ind1 AS (SELECT *, value_5 / cap AS intensity_5, value_20 / cap AS intensity_20, trust_v / cap AS trust_20 FROM ind0),
ind AS (
    SELECT *, {SCORE} AS score, {STAGE} AS stage, value_5 - value_20 / 4 AS acceleration,
        CASE WHEN abs(foreign_20) >= abs(trust_v) AND abs(foreign_20) >= abs(dealer_20) THEN 'foreign' WHEN abs(trust_v) >= abs(dealer_20) THEN 'trust' ELSE 'dealer' END AS dominant FROM ind1
),
indv AS (SELECT *, CASE dominant WHEN 'foreign' THEN foreign_20 WHEN 'trust' THEN trust_v ELSE dealer_20 END AS dominant_value FROM ind)
"""


def securities(t: Tables) -> DataFrame:
    return fl.security_signals(t.flows_daily, t.px_daily, t.security_master)


def industries(t: Tables) -> DataFrame:
    return fl.industry_signals(securities(t))


@query("SELECT d, asset, close, round(total_value, 4) AS total_value FROM vals", FLOW)
def jn_flow_close(t: Tables) -> DataFrame:
    return fl.flow_values(t.flows_daily, t.px_daily).select("d", "asset", "close", F.round("total_value", 4).alias("total_value"))


@query("SELECT d, asset, total_net FROM flows_daily WHERE asset IN (SELECT asset FROM px_month WHERE pos = (SELECT max(pos) FROM cal_month))")
def jn_semi_universe(t: Tables) -> DataFrame:
    from ..operators.grid import resample

    m = resample(t.px_daily, "Monthly")
    now = m.join(F.broadcast(m.agg(F.max("pos").alias("pos"))), "pos")
    return t.flows_daily.join(now.select("asset"), "asset", "left_semi").select("d", "asset", "total_net")


@query("SELECT f.d, f.asset, m.industry, m.issued_shares, f.total_net FROM flows_daily f LEFT JOIN security_master m ON m.ticker = f.asset")
def jn_master(t: Tables) -> DataFrame:
    m = t.security_master.dropDuplicates(["ticker"]).select(F.col("ticker").alias("asset"), "industry", "issued_shares")
    return t.flows_daily.join(F.broadcast(m), "asset", "left").select("d", "asset", "industry", "issued_shares", "total_net")


@query("SELECT asset, round(foreign_20, 2) AS foreign_20, round(trust_v, 2) AS trust_value_20, round(dealer_20, 2) AS dealer_20, round(total_20, 2) AS total_20, round(value_5, 2) AS value_5, shares_20, shares_5 FROM sums", FLOW)
def agg_flow_security(t: Tables) -> DataFrame:
    return rounded(securities(t).select("asset", "foreign_20", "trust_value_20", "dealer_20", "total_20", "value_5", "shares_20", "shares_5"), 2)


@query("SELECT asset, round(return_20, 6) AS return_20 FROM lastret WHERE asset IN (SELECT asset FROM px_daily)", FLOW)
def win_flow_return20(t: Tables) -> DataFrame:
    return rounded(fl.last_returns(t.px_daily).select("asset", "return_20"))


@query("SELECT asset, round(" + RANK.format(x="intensity_20") + ", 6) AS pct FROM sec0", FLOW)
def win_rank_pct(t: Tables) -> DataFrame:
    return rounded(securities(t).select("asset", fl.rank_percent(F.col("intensity_20")).alias("pct")))


@query("SELECT asset, stage FROM sec", FLOW)
def lbl_flow_stage(t: Tables) -> DataFrame:
    return securities(t).select("asset", "stage")


@query("SELECT industry, stage, CASE stage " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fl.ACTIONS.items()) + " END AS action FROM ind", FLOW)
def lbl_flow_action(t: Tables) -> DataFrame:
    return industries(t).select("industry", "stage", "action")


@query("""SELECT industry, CASE dominant WHEN 'foreign' THEN '外資' WHEN 'trust' THEN '投信' ELSE '自營商' END || CASE WHEN dominant_value >= 0 THEN '主導淨流入' ELSE '主導淨流出' END || '（20日 ' || printf('%+.1f', dominant_value / 1e8) || '億）；近5日相較20日均速' ||
    CASE WHEN acceleration > 0 THEN '加速' ELSE '減速' END || '；流入廣度 ' || printf('%.0f%%', round(100 * breadth, 0)) || '；前三大帶動標的占絕對流量 ' || printf('%.0f%%', round(100 * concentration, 0)) ||
    CASE WHEN return_20 > 0 THEN '；價格已確認（20日 ' ELSE '；價格尚未確認（20日 ' END || printf('%+.1f%%', round(100 * return_20, 1)) || '）。主要標的：' || leaders || '。' AS reason FROM indv""", FLOW)
def lbl_flow_reason(t: Tables) -> DataFrame:
    return industries(t).select("industry", "reason")


@query("SELECT industry, constituents, round(value_5, 2) AS value_5, round(value_20, 2) AS value_20, round(cap, 2) AS cap, round(return_20, 4) AS return_20, round(breadth, 4) AS breadth FROM ind", FLOW)
def agg_flow_industry(t: Tables) -> DataFrame:
    i = industries(t)
    return i.select("industry", "constituents", *[F.round(c, 2).alias(c) for c in ("value_5", "value_20", "cap")], *[F.round(c, 4).alias(c) for c in ("return_20", "breadth")])


@query("SELECT v.d, m.industry, round(sum(foreign_value), 2) AS foreign_value, round(sum(trust_value), 2) AS trust_value, round(sum(dealer_value), 2) AS dealer_value, round(sum(total_value), 2) AS total_value FROM vals v JOIN security_master m ON m.ticker = v.asset GROUP BY ALL", FLOW)
def agg_flow_daily(t: Tables) -> DataFrame:
    m = t.security_master.select(F.col("ticker").alias("asset"), "industry")
    v = fl.flow_values(t.flows_daily, t.px_daily).join(F.broadcast(m), "asset")
    return rounded(v.groupBy("d", "industry").agg(*[F.sum(f"{i}_value").alias(f"{i}_value") for i in fl.INVESTORS]), 2)


@query("SELECT industry, round(concentration, 6) AS concentration FROM ind", FLOW)
def agg_concentration(t: Tables) -> DataFrame:
    return rounded(industries(t).select("industry", "concentration"))


@query("SELECT industry, dominant, round(dominant_value, 2) AS dominant_value FROM indv", FLOW)
def agg_dominant(t: Tables) -> DataFrame:
    return rounded(industries(t).select("industry", "dominant", "dominant_value"), 2)


@query("SELECT industry, leaders FROM ind", FLOW)
def agg_leaders(t: Tables) -> DataFrame:
    return industries(t).select("industry", "leaders")


@query("SELECT industry, round(score, 6) AS score, stage, leaders, dominant, round(dominant_value, 2) AS dominant_value, round(acceleration, 2) AS acceleration, round(concentration, 6) AS concentration FROM indv ORDER BY score DESC", FLOW)
def pipe_fund_flow(t: Tables) -> DataFrame:
    return industries(t).orderBy(F.desc("score")).select("industry", F.round("score", 6).alias("score"), "stage", "leaders", "dominant", F.round("dominant_value", 2).alias("dominant_value"), F.round("acceleration", 2).alias("acceleration"), F.round("concentration", 6).alias("concentration"))


@query("""SELECT investor, industry, round(value / 1e8, 8) AS value FROM (SELECT industry, unnest(['foreign', 'trust', 'dealer']) AS investor, unnest([foreign_20, trust_v, dealer_20]) AS value FROM ind) WHERE value > 0""", FLOW)
def pipe_flow_views(t: Tables) -> DataFrame:
    edges = industries(t).unpivot(["industry"], ["foreign_20", "trust_v", "dealer_20"], "investor", "value").where("value > 0")
    return edges.select(F.regexp_replace("investor", "_.*", "").alias("investor"), "industry", F.round(F.col("value") / 1e8, 8).alias("value"))


@query("SELECT industry, round(value_20, 2) AS value_20 FROM ind ORDER BY value_20 DESC LIMIT 8", FLOW)
def top_flow_groups(t: Tables) -> DataFrame:
    return rounded(industries(t).orderBy(F.desc("value_20")).limit(8).select("industry", "value_20"), 2)


@query("SELECT asset, round(score, 6) AS score FROM sec ORDER BY score DESC, asset LIMIT 100", FLOW)
def top_flow_stocks(t: Tables) -> DataFrame:
    return rounded(securities(t).orderBy(F.desc("score"), "asset").limit(100).select("asset", "score"))


HOLD = """
hb AS (SELECT asset, close, row_number() OVER (PARTITION BY asset ORDER BY d DESC) AS back FROM px_daily WHERE close IS NOT NULL),
hc AS (SELECT asset, 0.0::DOUBLE + (max(close) FILTER (back = 1) / max(close) FILTER (back = 22) - 1) * 0.2 + (max(close) FILTER (back = 1) / max(close) FILTER (back = 64) - 1) * 0.3 + (max(close) FILTER (back = 1) / max(close) FILTER (back = 127) - 1) * 0.5 AS composite FROM hb GROUP BY asset),
hl AS (SELECT h.*, c.composite, h.weight * c.composite AS leadership FROM holdings h LEFT JOIN hc c ON c.asset = h.holding_ticker),
hr AS (SELECT *, CASE WHEN leadership IS NOT NULL THEN row_number() OVER (PARTITION BY etf ORDER BY leadership DESC NULLS LAST, ord) END AS rnk FROM hl)
"""


@query("SELECT etf, holding_ticker, weight, round(composite, 6) AS composite, round(leadership, 6) AS leadership, rnk FROM hr", HOLD)
def pipe_holdings(t: Tables) -> DataFrame:
    return rounded(fl.leadership(t.holdings, t.px_daily).select("etf", "holding_ticker", "weight", "composite", "leadership", "rnk"))


@query("SELECT etf, holding_ticker, rnk FROM hr WHERE rnk IS NOT NULL", HOLD)
def win_holding_rank(t: Tables) -> DataFrame:
    return fl.leadership(t.holdings, t.px_daily).where("rnk is not null").select("etf", "holding_ticker", "rnk")


@query("SELECT d, asset, round(total, 4) AS total FROM (SELECT d, asset, sum(total_net) OVER (PARTITION BY asset ORDER BY d RANGE BETWEEN INTERVAL 19 DAYS PRECEDING AND CURRENT ROW) AS total FROM flows_daily) WHERE total > 0 QUALIFY row_number() OVER (PARTITION BY d ORDER BY total DESC, asset) <= 5")
def win_flow_rank(t: Tables) -> DataFrame:
    w = Window.partitionBy("asset").orderBy(F.unix_date("d").cast("long")).rangeBetween(-19, 0)
    total = t.flows_daily.withColumn("total", F.sum("total_net").over(w)).where("total > 0")
    return rounded(total.withColumn("rnk", F.row_number().over(Window.partitionBy("d").orderBy(F.desc("total"), "asset"))).where("rnk <= 5").select("d", "asset", "total"), 4)
