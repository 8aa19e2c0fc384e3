"""Queries of features, fusion, portfolio and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import grid as g
from ..operators import risk as rk
from .registry import query, rounded
from .rotation import month_grid
from .views import Tables

NOW = "2024-06-30"


def daily(t: Tables) -> DataFrame:
    """Each asset's own bars, numbered."""
    return t.px_daily.withColumn("pos", F.row_number().over(Window.partitionBy("asset").orderBy("d")))


def daily_returns(t: Tables) -> DataFrame:
    return daily(t).withColumn("ret", g.change(1))


OWN = "own AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY d) AS pos, close / lag(close) OVER (PARTITION BY asset ORDER BY d) - 1 AS ret FROM px_daily)"
EWMA = OWN + """, ew AS (SELECT asset, ret, pow(1 - 2.0::DOUBLE / 21, row_number() OVER (PARTITION BY asset ORDER BY pos DESC) - 1) AS w FROM own WHERE ret IS NOT NULL),
em AS (SELECT asset, sum(w * ret) / sum(w) AS m FROM ew GROUP BY asset), ewma AS (SELECT e.asset, CASE WHEN count(*) >= 2 THEN sqrt(sum(w * (ret - m) * (ret - m)) / sum(w)) * sqrt(252) END AS ewma_vol FROM ew e JOIN em USING (asset) GROUP BY e.asset)"""


@query("SELECT asset, round(ewma_vol, 6) AS ewma_vol FROM ewma", EWMA)
def win_ewma_vol(t: Tables) -> DataFrame:
    return rounded(fe.ewma_volatility(daily_returns(t)))


@query("SELECT asset, CASE WHEN ewma_vol >= 0.4 THEN 'EXTREME' WHEN ewma_vol >= 0.25 THEN 'HIGH' WHEN ewma_vol <= 0.12 THEN 'LOW' ELSE 'NORMAL' END AS state FROM ewma", EWMA)
def win_vol_state(t: Tables) -> DataFrame:
    return fe.ewma_volatility(daily_returns(t)).select("asset", fe.volatility_state(F.col("ewma_vol")).alias("state"))


@query("""SELECT asset, round(sqrt((vn + k * vd + (1 - k) * rs) * 252), 6) AS yang_zhang FROM (SELECT asset, var_samp(ln(open / b)) AS vn, var_samp(ln(close / open)) AS vd, avg(ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)) AS rs,
    0.34 / (1.34 + (count(*) + 1.0::DOUBLE) / (count(*) - 1)) AS k FROM (SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY d) AS b FROM px_daily) WHERE b IS NOT NULL GROUP BY asset HAVING count(*) >= 2)""")
def win_yang_zhang(t: Tables) -> DataFrame:
    return rounded(fe.yang_zhang(daily(t)))


@query("SELECT asset, d, round(least(greatest(volume, lo), hi), 6) AS clipped FROM px_daily JOIN (SELECT asset, quantile_cont(volume, 0.01) AS lo, quantile_cont(volume, 0.99) AS hi FROM px_daily GROUP BY asset) USING (asset)")
def win_winsorize(t: Tables) -> DataFrame:
    return rounded(fe.winsorized(t.px_daily.withColumn("volume", F.col("volume").cast("double")), "asset", "volume").select("asset", "d", "clipped"))


@query("SELECT d, asset, round((close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0), 6) AS z FROM px_daily WINDOW w AS (PARTITION BY d)")
def win_zscore(t: Tables) -> DataFrame:
    return rounded(fe.zscores(t.px_daily, "d", "close").select("d", "asset", "z"))


@query("""SELECT d, asset, round(CASE WHEN n >= 3 THEN dm - coalesce(a + b * lc, 0) ELSE dm END, 5) AS neutral FROM (SELECT *, regr_slope(dm, lc) OVER w AS b, regr_intercept(dm, lc) OVER w AS a, count(*) OVER w AS n FROM (
    SELECT p.d, p.asset, close - avg(close) OVER (PARTITION BY p.d, grp) AS dm, ln(issued_shares * close) AS lc FROM px_daily p JOIN assets a ON a.asset = p.asset JOIN security_master m ON m.ticker = p.asset) WINDOW w AS (PARTITION BY d))""")
def win_neutralize(t: Tables) -> DataFrame:
    m = t.security_master.select(F.col("ticker").alias("asset"), F.col("industry").alias("grp"), "issued_shares")
    rows = t.px_daily.join(F.broadcast(m), "asset").select("d", "asset", "grp", (F.col("issued_shares") * F.col("close")).alias("cap"), F.col("close").alias("x"))
    return fe.neutralized(rows).select("d", "asset", F.round("neutral", 5).alias("neutral"))


TREND = OWN + """, tr AS (SELECT *, CASE WHEN count(close) OVER l = 60 AND avg(close) OVER s / avg(close) OVER l - 1 > 0.002 THEN 'UP' WHEN count(close) OVER l = 60 AND avg(close) OVER s / avg(close) OVER l - 1 < -0.002 THEN 'DOWN' ELSE 'RANGING' END AS trend
    FROM own WINDOW s AS (PARTITION BY asset ORDER BY pos ROWS 19 PRECEDING), l AS (PARTITION BY asset ORDER BY pos ROWS 59 PRECEDING))"""


@query("SELECT asset, d, trend FROM tr", TREND)
def win_trend(t: Tables) -> DataFrame:
    return fe.trend(daily(t), threshold=0.002).select("asset", "d", "trend")


@query("SELECT asset, d, CASE WHEN count(volume) OVER l = 60 AND avg(volume) OVER s / nullif(avg(volume) OVER l, 0) < 0.6 THEN 'STRESSED' ELSE 'NORMAL' END AS liquidity FROM own WINDOW s AS (PARTITION BY asset ORDER BY pos ROWS 4 PRECEDING), l AS (PARTITION BY asset ORDER BY pos ROWS 59 PRECEDING)", OWN)
def win_liquidity(t: Tables) -> DataFrame:
    return fe.liquidity(daily(t)).select("asset", "d", "liquidity")


@query("""SELECT asset, d, coalesce(last_value(CASE WHEN run >= 5 THEN trend END IGNORE NULLS) OVER w, first_value(trend) OVER w) AS effective FROM (
    SELECT *, row_number() OVER (PARTITION BY asset, trend, isl ORDER BY pos) AS run FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY pos) - row_number() OVER (PARTITION BY asset, trend ORDER BY pos) AS isl FROM tr)) WINDOW w AS (PARTITION BY asset ORDER BY pos ROWS UNBOUNDED PRECEDING)""", TREND)
def win_hysteresis(t: Tables) -> DataFrame:
    return fe.hysteresis(fe.trend(daily(t), threshold=0.002), "asset", "pos", "trend").select("asset", "d", "effective")


@query("SELECT asset, d, round(a / z - 1, 6) AS momentum FROM (SELECT *, lag(close, 21) OVER (PARTITION BY asset ORDER BY pos) AS a, lag(close, 251) OVER (PARTITION BY asset ORDER BY pos) AS z FROM own) WHERE a / z - 1 > 0 QUALIFY row_number() OVER (PARTITION BY d ORDER BY a / z - 1 DESC, asset) <= 5", OWN)
def win_mom_12_1(t: Tables) -> DataFrame:
    m = F.lag("close", 21).over(g.by_asset()) / F.lag("close", 251).over(g.by_asset()) - 1
    out = daily(t).withColumn("momentum", m).where("momentum > 0").withColumn("rnk", F.row_number().over(Window.partitionBy("d").orderBy(F.desc("momentum"), "asset")))
    return rounded(out.where("rnk <= 5").select("asset", "d", "momentum"))


@query("""SELECT asset, round(CASE WHEN n > 201 THEN a / z - 1 WHEN n > 41 THEN a / f - 1 END, 6) AS momentum FROM (SELECT asset, count(*) AS n, max(close) FILTER (back = 22) AS a, max(close) FILTER (back = 202) AS z, arg_min(close, pos) AS f FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY pos DESC) AS back FROM own) GROUP BY asset)""", OWN)
def win_mom_daily_run(t: Tables) -> DataFrame:
    b = daily(t).withColumn("back", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("pos"))))
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("close")))
    s = b.groupBy("asset").agg(F.count("*").alias("n"), at(22).alias("a"), at(202).alias("z"), F.min_by("close", "pos").alias("f"))
    return rounded(s.select("asset", F.when(F.col("n") > 201, F.col("a") / F.col("z") - 1).when(F.col("n") > 41, F.col("a") / F.col("f") - 1).alias("momentum")))


HALF = OWN + """, ou AS (SELECT asset, count(*) AS n, regr_slope(close - b, b) AS s FROM (SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY pos) AS b FROM own) GROUP BY asset),
hl AS (SELECT asset, CASE WHEN n >= 30 AND s < 0 AND s > -1 AND -ln(2) / ln(1 + s) <= n / 2.0 THEN -ln(2) / ln(1 + s) END AS half_life FROM ou)"""


@query("SELECT asset, round(half_life, 6) AS half_life FROM hl", HALF)
def stat_ou_half_life(t: Tables) -> DataFrame:
    return rounded(fe.half_life(daily(t)))


@query("SELECT asset, CAST(least(252, greatest(5, round_even(half_life * 2, 0))) AS INTEGER) AS win FROM hl WHERE half_life > 0", HALF)
def fn_window_from_half_life(t: Tables) -> DataFrame:
    return fe.half_life(daily(t)).select("asset", fe.window_from_half_life(F.col("half_life")).alias("win")).where("win is not null")


@query()
def stat_stationarity(t: Tables) -> DataFrame:
    return fe.stationarity(daily(t))


@query()
def udf_mean_reverting(t: Tables) -> DataFrame:
    h = fe.half_life(daily(t)).join(fe.stationarity(daily(t)), "asset")
    return h.select("asset", F.when(F.col("verdict") == "STATIONARY", F.col("half_life")).alias("half_life"))


@query("SELECT entity_id AS asset, d, round(avg(close) OVER (PARTITION BY entity_id ORDER BY d ROWS 19 PRECEDING), 6) AS value, true AS valid FROM (SELECT entity_id, trade_date AS d, arg_max(close, ingest_date) AS close FROM raw_prices WHERE ingest_date <= DATE '1999-06-30' GROUP BY ALL)")
def udf_feature_registry(t: Tables) -> DataFrame:
    registry = fe.Registry()

    def mean(rows: DataFrame, asof, window: int = 20) -> DataFrame:
        last = rows.groupBy("entity_id", "trade_date").agg(F.max_by("close", "ingest_date").alias("close"))
        return last.select(F.col("entity_id").alias("asset"), F.col("trade_date").alias("d"), F.avg("close").over(Window.partitionBy("entity_id").orderBy("trade_date").rowsBetween(1 - window, 0)).alias("value"))

    registry.register("mean_close", "1", mean, ("entity_id", "close"), 0.0, 1e9)
    import datetime

    return rounded(registry.compute("mean_close", "1", t.raw_prices, datetime.date(1999, 6, 30)))


MRET = "mr AS (SELECT asset, pos, coalesce(close / lag(close) OVER (PARTITION BY asset ORDER BY pos) - 1, 0) AS x FROM grid)"


def month_returns(t: Tables) -> DataFrame:
    return month_grid(t).select("asset", "pos", F.coalesce(g.change(1), F.lit(0.0)).alias("x"))


@query("SELECT a.asset AS a, b.asset AS b, round(corr(a.x, b.x), 6) AS corr FROM mr a JOIN mr b ON a.pos = b.pos AND a.asset < b.asset GROUP BY ALL", MRET)
def jn_pairwise(t: Tables) -> DataFrame:
    return rounded(fe.pair_correlations(month_returns(t)))


@query("SELECT round(avg(c), 6) AS mean_corr, count(*) AS pairs FROM (SELECT corr(a.x, b.x) AS c FROM mr a JOIN mr b ON a.pos = b.pos AND a.asset < b.asset GROUP BY a.asset, b.asset)", MRET)
def stat_xs_corr(t: Tables) -> DataFrame:
    return rounded(fe.pair_correlations(month_returns(t)).agg(F.avg("corr").alias("mean_corr"), F.count("*").alias("pairs")))


LW = MRET + """, lx AS (SELECT asset, pos, x - avg(x) OVER (PARTITION BY asset) AS x FROM mr), lT AS (SELECT count(DISTINCT pos) AS T FROM lx),
lc AS (SELECT a.asset AS a, b.asset AS b, sum(a.x * b.x) / (SELECT T FROM lT) AS cov FROM lx a JOIN lx b ON a.pos = b.pos GROUP BY ALL),
lf AS (SELECT *, CASE WHEN a = b THEN (SELECT avg(cov) FROM lc WHERE a = b) ELSE 0 END AS target FROM lc),
ld AS (SELECT greatest(0, least(1, (((SELECT sum(q * q) FROM (SELECT sum(x * x) AS q FROM lx GROUP BY pos)) - (SELECT T FROM lT) * sum(cov * cov)) / pow((SELECT T FROM lT), 2)) / sum(pow(cov - target, 2)))) AS delta FROM lf),
lw AS (SELECT a, b, cov, delta * target + (1 - delta) * cov AS shrunk, delta FROM lf, ld)"""


@query("SELECT a, b, round(cov, 9) AS cov, round(shrunk, 9) AS shrunk, round(delta, 6) AS delta FROM lw", LW)
def stat_ledoit_wolf(t: Tables) -> DataFrame:
    return rk.shrinkage(month_returns(t)).select("a", "b", F.round("cov", 9).alias("cov"), F.round("shrunk", 9).alias("shrunk"), F.round("delta", 6).alias("delta"))


@query("""SELECT asset, round(raw / sum(raw) OVER (), 6) AS weight FROM (SELECT l.a AS asset, 1 / (v.shrunk * sum(CASE WHEN l.a = l.b THEN 1 ELSE abs(l.shrunk / sqrt(v.shrunk * u.shrunk)) END)) AS raw
    FROM lw l JOIN lw v ON v.a = l.a AND v.b = l.a JOIN lw u ON u.a = l.b AND u.b = l.b GROUP BY l.a, v.shrunk)""", LW)
def stat_corr_weights(t: Tables) -> DataFrame:
    return rounded(rk.decorrelated_weights(rk.shrinkage(month_returns(t))))


SIG = """sg AS (SELECT s.*, 1.0::DOUBLE / count(*) OVER (PARTITION BY entity) AS base, CASE family WHEN 'momentum' THEN 1.2 WHEN 'mean_reversion' THEN 0.8 ELSE 1.0 END::DOUBLE AS multiplier, (epoch(TIMESTAMP '2024-06-30') - epoch(signal_time)) / 86400.0 AS age FROM signals s),
sd AS (SELECT *, CASE WHEN age < 0 THEN 0 WHEN age <= 60 THEN pow(0.5, age / 60) WHEN age >= 120 THEN 0 ELSE 0.5 * (1 - (age - 60) / 60) END AS decay FROM sg),
se AS (SELECT *, base * multiplier * confidence * decay AS effective FROM sd), sk AS (SELECT *, CASE WHEN effective < 0.05 * greatest(sum(effective) OVER (PARTITION BY entity), 1e-12) THEN 0 ELSE effective END AS kept FROM se)"""
REGIME = {"momentum": 1.2, "mean_reversion": 0.8}


def weighted_signals(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame(list(REGIME.items()), "family string, multiplier double")
    s = t.signals.join(F.broadcast(table), "family", "left").withColumn("multiplier", F.coalesce("multiplier", F.lit(1.0)))
    age = (F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("signal_time").cast("timestamp"))) / 86_400_000_000
    return s.withColumn("base", 1.0 / F.count("*").over(Window.partitionBy("entity"))).withColumn("decay", rk.decay(age, 60.0))


@query("SELECT entity, name, round(decay, 6) AS decay FROM sd", SIG)
def fn_half_life_decay(t: Tables) -> DataFrame:
    return rounded(weighted_signals(t).select("entity", "name", "decay"))


@query("SELECT entity, name, family, multiplier FROM sg", SIG)
def jn_signal_regime(t: Tables) -> DataFrame:
    return weighted_signals(t).select("entity", "name", "family", "multiplier")


@query("SELECT entity, round(coalesce(greatest(-1, least(1, sum(kept * score) / nullif(sum(kept), 0))), 0), 6) AS combined, count(*) FILTER (kept > 0) AS n_used, count(*) FILTER (kept = 0) AS n_dropped FROM sk GROUP BY entity", SIG)
def stat_fuse(t: Tables) -> DataFrame:
    return rounded(rk.fuse(weighted_signals(t)))


PORT = """p1 AS (SELECT *, score / sum(abs(score)) OVER (PARTITION BY portfolio) AS w0 FROM scores), p2 AS (SELECT *, greatest(-0.05, least(0.05, w0)) AS w1 FROM p1), p3 AS (SELECT *, sum(abs(w1)) OVER (PARTITION BY portfolio, sector) AS ins FROM p2),
p4 AS (SELECT *, CASE WHEN ins > 0.25 THEN w1 * (0.25 / ins) ELSE w1 END * 0.75 AS w3 FROM p3), p5 AS (SELECT *, sum(abs(w3)) OVER (PARTITION BY portfolio) AS gross FROM p4),
p6 AS (SELECT p.portfolio, p.entity, 0.9 * (CASE WHEN gross > 1 THEN w3 / gross ELSE w3 END) + 0.1 * coalesce(w.weight, 0) AS w5, abs(w1 - w0) > 1e-12 * greatest(abs(w1), abs(w0)) OR ins > 0.25 AS constrained FROM p5 p LEFT JOIN weights w ON w.portfolio = p.portfolio AND w.entity = p.entity),
built AS (SELECT portfolio, entity, CASE WHEN abs(w5) < 0.005 THEN 0 ELSE w5 END AS weight, constrained FROM p6)"""


def built(t: Tables) -> DataFrame:
    return rk.build(t.scores, t.weights, 0.2)


@query("SELECT portfolio, entity, round(weight, 6) AS weight, constrained FROM built", PORT)
def pipe_portfolio(t: Tables) -> DataFrame:
    return rounded(built(t))


@query("SELECT portfolio, round(sum(abs(coalesce(b.weight, 0) - coalesce(w.weight, 0))), 6) AS turnover FROM built b FULL JOIN weights w USING (portfolio, entity) GROUP BY portfolio", PORT)
def jn_turnover(t: Tables) -> DataFrame:
    return rounded(rk.turnover(built(t), t.weights))


EXPO = "wr AS (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY abs(weight) DESC, entity) AS rnk FROM weights), ex AS (SELECT portfolio, sum(abs(weight)) AS gross, sum(weight) AS net, sum(abs(weight)) FILTER (rnk <= 5) AS top5 FROM wr GROUP BY portfolio)"


@query("SELECT portfolio, round(gross, 6) AS gross, round(net, 6) AS net, round(top5, 6) AS top5 FROM ex", EXPO)
def agg_exposure(t: Tables) -> DataFrame:
    return rounded(rk.exposure(t.weights))


BREACH = EXPO + """, adv AS (SELECT asset AS entity, round(avg(volume * close), 2) AS adv_value FROM px_daily GROUP BY asset), br AS (
    SELECT portfolio, 'RESTRICTED' AS code, entity AS subject, weight AS observed, 0.0 AS lim FROM weights WHERE entity IN ('NATION_3', 'NATION_7') AND weight <> 0
    UNION ALL SELECT portfolio, 'POSITION', entity, abs(weight), 0.05 FROM weights WHERE abs(weight) > 0.05 UNION ALL SELECT portfolio, 'SECTOR', sector, abs(sum(weight)), 0.25 FROM weights GROUP BY portfolio, sector HAVING abs(sum(weight)) > 0.25
    UNION ALL SELECT portfolio, 'GROSS', NULL, gross, 1.0 FROM ex WHERE round(gross, 6) > 1.001 UNION ALL SELECT portfolio, 'NET', NULL, abs(net), 0.6 FROM ex WHERE abs(net) > 0.6 UNION ALL SELECT portfolio, 'TOP5', NULL, top5, 0.4 FROM ex WHERE top5 > 0.4
    UNION ALL SELECT portfolio, 'ADV', entity, 1e6 * abs(weight) / adv_value, 0.05 FROM weights JOIN adv USING (entity) WHERE adv_value > 0 AND 1e6 * abs(weight) / adv_value > 0.05)"""


def broken(t: Tables) -> DataFrame:
    adv = t.px_daily.groupBy(F.col("asset").alias("entity")).agg(F.round(F.avg(F.col("volume") * F.col("close")), 2).alias("adv_value"))
    return rk.breaches(t.weights, adv, 1e6, ["NATION_3", "NATION_7"], rk.Limits(gross=1.001))


@query("SELECT portfolio, code, subject, round(observed, 6) AS observed FROM br", BREACH)
def agg_pretrade(t: Tables) -> DataFrame:
    return rounded(broken(t).select("portfolio", "code", "subject", "observed"))


@query("SELECT portfolio, code, count(*) AS n, round(max(observed / nullif(lim, 0)), 6) AS worst FROM br GROUP BY ALL", BREACH.replace("gross, 1.0 FROM", "gross, 1.001 FROM"))
def agg_limit_usage(t: Tables) -> DataFrame:
    return rounded(broken(t).groupBy("portfolio", "code").agg(F.count("*").alias("n"), F.max(F.try_divide("observed", "limit")).alias("worst")))


CURVE = MRET + """, cv AS (SELECT asset AS run, pos, exp(sum(ln(1 + x)) OVER (PARTITION BY asset ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS equity FROM mr), dw AS (SELECT run, (max(equity) - arg_max(equity, pos)) / max(equity) AS drawdown FROM cv GROUP BY run),
tier AS (SELECT *, CASE WHEN drawdown >= 0.02 THEN 2 WHEN drawdown >= 0.01 THEN 1 ELSE 0 END AS mode, CASE WHEN drawdown >= 0.02 THEN 0 WHEN drawdown >= 0.01 THEN 0.5 ELSE 1 END AS multiplier FROM dw)"""


def tiers(t: Tables) -> DataFrame:
    w = Window.partitionBy("asset").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    curves = month_returns(t).select(F.col("asset").alias("run"), "pos", F.product(1 + F.col("x")).over(w).alias("equity"))
    return rk.drawdown_tier(curves, rk.Limits(reduce_at=0.01, close_at=0.02))


@query("SELECT run, round(drawdown, 6) AS drawdown, mode, multiplier::DOUBLE AS multiplier FROM tier", CURVE)
def agg_drawdown_tier(t: Tables) -> DataFrame:
    return rounded(tiers(t))


@query("SELECT max(mode) AS mode, min(multiplier)::DOUBLE AS multiplier FROM tier", CURVE)
def agg_mode_combine(t: Tables) -> DataFrame:
    return tiers(t).agg(F.max("mode").alias("mode"), F.min("multiplier").alias("multiplier"))


@query("SELECT asset, round(ewma_vol / 0.3, 6) AS ratio, CASE WHEN ewma_vol / 0.3 > 1.5 THEN 1 ELSE 0 END AS mode, round(CASE WHEN ewma_vol / 0.3 > 1.5 THEN greatest(0, least(1, 0.3 / ewma_vol)) ELSE 1 END, 6) AS multiplier FROM ewma", EWMA)
def agg_realized_vol(t: Tables) -> DataFrame:
    r = F.col("ewma_vol") / 0.3
    return rounded(fe.ewma_volatility(daily_returns(t)).select("asset", r.alias("ratio"), F.when(r > 1.5, 1).otherwise(0).alias("mode"), F.when(r > 1.5, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.3 / F.col("ewma_vol")))).otherwise(1.0).alias("multiplier")))


@query("SELECT asset, round(CASE WHEN ewma_vol > 0 THEN least(0.15 / ewma_vol, 1) ELSE 0 END, 6) AS scalar FROM ewma", EWMA)
def fn_vol_target(t: Tables) -> DataFrame:
    return rounded(fe.ewma_volatility(daily_returns(t)).select("asset", rk.vol_target(F.col("ewma_vol")).alias("scalar")))


@query("""SELECT entity, d, CASE WHEN n = 0 THEN 'NO_OPINION' WHEN sides > 1 AND strong > 1 THEN 'ESCALATED' WHEN sides > 1 THEN 'DOWNGRADED' ELSE 'ACCEPTED' END AS resolution, CASE WHEN sides = 1 THEN one ELSE 'FLAT' END AS direction, CASE WHEN sides = 1 AND weak = 0 THEN 'CONFIRM' ELSE 'RESEARCH_ONLY' END AS level FROM (
    SELECT entity, d, count(*) FILTER (direction <> 'FLAT') AS n, count(DISTINCT direction) FILTER (direction <> 'FLAT') AS sides, count(DISTINCT direction) FILTER (direction <> 'FLAT' AND confidence >= 0.7) AS strong, min(direction) FILTER (direction <> 'FLAT') AS one, count(*) FILTER (direction <> 'FLAT' AND confidence < 0.7) AS weak FROM opinions GROUP BY entity, d)""")
def agg_arbitrate(t: Tables) -> DataFrame:
    return rk.arbitrate(t.opinions, ["entity", "d"])


@query("SELECT entity, agent, round(max(n) / sum(n), 6) AS consistency, max(n) / sum(n) >= 0.67 AS passes FROM (SELECT entity, agent, direction, count(*) AS n FROM opinions GROUP BY ALL) GROUP BY ALL")
def agg_consistency(t: Tables) -> DataFrame:
    n = t.opinions.groupBy("entity", "agent", "direction").agg(F.count("*").alias("n")).groupBy("entity", "agent").agg((F.max("n") / F.sum("n")).alias("consistency"))
    return rounded(n.withColumn("passes", F.col("consistency") >= 0.67))
