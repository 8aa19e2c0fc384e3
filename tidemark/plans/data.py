"""Queries of the point-in-time layer and of the quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import grid as g
from ..operators import pit
from ..operators import quality as q
from ..sources import caches, landing
from .registry import query, rounded
from .views import Tables

ASOF = "1999-06-30"
LATEST = f"latest AS (SELECT * FROM raw_prices WHERE ingest_date <= DATE '{ASOF}' QUALIFY row_number() OVER (PARTITION BY entity_id, trade_date ORDER BY ingest_date DESC) = 1), known AS (SELECT * FROM corp_actions WHERE ingest_date <= DATE '{ASOF}')"


def latest(t: Tables) -> DataFrame:
    return pit.as_of(t.raw_prices, ASOF, ["entity_id", "trade_date"])


def known(t: Tables) -> DataFrame:
    return t.corp_actions.where(F.col("ingest_date") <= F.lit(ASOF).cast("date"))


@query("SELECT entity_id, trade_date, close, volume, ingest_date FROM latest", LATEST)
def jn_asof_raw(t: Tables) -> DataFrame:
    return latest(t).select("entity_id", "trade_date", "close", "volume", "ingest_date")


FACTORS = LATEST + """, factors AS (SELECT p.entity_id, p.trade_date, p.close, coalesce(product(a.factor), 1) AS factor, count(a.factor) AS n_actions, coalesce(min(a.confidence), 1) AS confidence
    FROM latest p LEFT JOIN known a ON a.entity_id = p.entity_id AND a.ex_date > p.trade_date GROUP BY ALL)"""


@query("SELECT entity_id, trade_date, round(factor, 6) AS factor, n_actions, confidence FROM factors", FACTORS)
def jn_factor_range(t: Tables) -> DataFrame:
    return rounded(pit.adjusted(latest(t), known(t)).select("entity_id", "trade_date", "factor", "n_actions", "confidence"))


@query("SELECT entity_id, trade_date, close, round(close * factor, 5) AS adjusted, n_actions FROM factors WHERE trade_date >= DATE '1997-01-01'", FACTORS)
def pipe_adjusted_prices(t: Tables) -> DataFrame:
    out = pit.adjusted(latest(t).where("trade_date >= date'1997-01-01'"), known(t))
    return out.select("entity_id", "trade_date", "close", F.round("adjusted", 5).alias("adjusted"), "n_actions")


@query("SELECT entity_id, trade_date, close, round(close * factor, 5) AS adjusted, n_actions FROM factors", FACTORS)
def pipe_adjusted_prices_all(t: Tables) -> DataFrame:
    """pipe_adjusted_prices over every date."""
    return pit.adjusted(latest(t), known(t)).select("entity_id", "trade_date", "close", F.round("adjusted", 5).alias("adjusted"), "n_actions")


FACTORS_ALL = f"""actions_all AS (SELECT n_name AS entity_id, CAST(o_orderdate AS DATE) AS ex_date, 0.9::DOUBLE + (o_orderkey::DOUBLE / 10 % 10) / 100 AS factor, 0.95::DOUBLE AS confidence
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT' AND CAST(o_orderdate AS DATE) + 30 <= DATE '{ASOF}'),
""" + LATEST + """, factors AS (SELECT p.entity_id, p.trade_date, p.close, coalesce(sum(ln(a.factor)), 0) AS log_factor, count(a.factor) AS n_actions, coalesce(min(a.confidence), 1) AS confidence
    FROM latest p LEFT JOIN actions_all a ON a.entity_id = p.entity_id AND a.ex_date > p.trade_date GROUP BY ALL)"""


def adjusted_by_all(t: Tables) -> DataFrame:
    return pit.adjusted(latest(t), t.corp_actions_all.where(F.col("ingest_date") <= F.lit(ASOF).cast("date")))


@query("SELECT entity_id, trade_date, round(log_factor, 6) AS log_factor, n_actions, confidence FROM factors", FACTORS_ALL)
def jn_factor_range_all(t: Tables) -> DataFrame:
    """jn_factor_range with every urgent order as an action; the logarithm, as products of many factors vanish."""
    return rounded(adjusted_by_all(t).select("entity_id", "trade_date", "log_factor", "n_actions", "confidence"))


@query("SELECT entity_id, trade_date, close, round(ln(close) + log_factor, 6) AS log_adjusted, n_actions FROM factors", FACTORS_ALL)
def pipe_adjusted_prices_all_actions(t: Tables) -> DataFrame:
    """pipe_adjusted_prices over every date, with every urgent order as an action."""
    return adjusted_by_all(t).select("entity_id", "trade_date", "close", F.round(F.log("close") + F.col("log_factor"), 6).alias("log_adjusted"), "n_actions")


UNI = """days AS (SELECT d, d AS asof FROM cal_month), uni AS (SELECT c.d, s.entity_id, s.state, s.state = 'TRADABLE' AS tradable FROM days c JOIN spans s ON s.valid_from <= c.d AND (s.valid_to IS NULL OR s.valid_to >= c.d) AND s.ingest_date <= c.asof
    QUALIFY row_number() OVER (PARTITION BY c.d, s.entity_id ORDER BY s.ingest_date DESC, s.valid_from DESC) = 1)"""


def universe(t: Tables) -> DataFrame:
    days = g.calendar(t.px_daily, "Monthly").select("d", F.col("d").alias("asof"))
    return pit.universe(t.spans, days)


@query("SELECT d, entity_id, state, tradable FROM uni", UNI)
def jn_interval_universe(t: Tables) -> DataFrame:
    return universe(t)


@query("SELECT d, count(*) AS members, count(*) FILTER (tradable) AS tradable FROM uni GROUP BY d", UNI)
def udf_universe_provider(t: Tables) -> DataFrame:
    return universe(t).groupBy("d").agg(F.count("*").alias("members"), F.count_if("tradable").alias("tradable"))


@query("SELECT entity_id, valid_from <= DATE '1998-01-01' AND (valid_to IS NULL OR valid_to >= DATE '1998-01-01') AS active FROM spans")
def flt_active_on(t: Tables) -> DataFrame:
    day = F.lit("1998-01-01").cast("date")
    return t.spans.select("entity_id", ((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day))).alias("active"))


@query("SELECT count(*) AS n, min(entity_id) AS first_entity FROM (SELECT * FROM raw_prices WHERE ingest_date > DATE '1999-06-30' AND trade_date <= DATE '1999-06-30')")
def flt_lookahead(t: Tables) -> DataFrame:
    late = t.raw_prices.where((F.col("ingest_date") > F.lit(ASOF).cast("date")) & (F.col("trade_date") <= F.lit(ASOF).cast("date")))
    return late.agg(F.count("*").alias("n"), F.min("entity_id").alias("first_entity"))


REPAIR = """rp AS (SELECT asset, d, close, close / lag(close) OVER (PARTITION BY asset ORDER BY d) AS ratio FROM px_noisy WHERE d < DATE '1996-01-01'),
    ev AS (SELECT *, CASE WHEN ratio > 0 AND (ratio < 0.6 OR ratio > 1.4) THEN ratio END AS event FROM rp)"""


@query("SELECT asset, d, close, round(ln(close) + coalesce(sum(ln(event)) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 6) AS log_repaired FROM ev", REPAIR)
def win_repair(t: Tables) -> DataFrame:
    return pit.repaired(t.px_noisy.where("d < date'1996-01-01'")).select("asset", "d", "close", F.round("log_repaired", 6).alias("log_repaired"))


REPAIR_ALL = """rp AS (SELECT asset, d, close, close / lag(close) OVER (PARTITION BY asset ORDER BY d) AS ratio FROM px_noisy),
    ev AS (SELECT *, CASE WHEN ratio > 0 AND (ratio < 0.6 OR ratio > 1.4) THEN ratio END AS event FROM rp)"""


@query("SELECT asset, d, close, round(ln(close) + coalesce(sum(ln(event)) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 6) AS log_repaired FROM ev", REPAIR_ALL)
def win_repair_all(t: Tables) -> DataFrame:
    """win_repair over every date."""
    return pit.repaired(t.px_noisy).select("asset", "d", "close", F.round("log_repaired", 6).alias("log_repaired"))


@query("""SELECT d, asset, coalesce(n.close, o.close) AS close FROM (SELECT d, asset, close FROM px_daily WHERE d < DATE '1999-01-01') o FULL JOIN (SELECT d, asset, CASE WHEN day(d) <> 7 THEN close + 1 END AS close FROM px_daily WHERE d >= DATE '1998-12-20') n USING (d, asset)""")
def sink_price_upsert(t: Tables) -> DataFrame:
    """Cell by cell the last price that isn't null, before gaps are filled and jumps repaired."""
    p = t.px_daily.select("d", "asset", "close")
    fresh = p.where("d >= date'1998-12-20'").withColumn("close", F.when(F.dayofmonth("d") != 7, F.col("close") + 1))
    return pit.upsert(p.where("d < date'1999-01-01'"), fresh, ["d", "asset"], "close")


def _sql_of_update(name: str, merged: str) -> str:
    """SQL of filling and repairing the merged prices."""
    return f"""
    m{name} AS ({merged}),
    g{name} AS (SELECT d, asset, close FROM (SELECT DISTINCT d FROM m{name}) CROSS JOIN (SELECT DISTINCT asset FROM m{name}) LEFT JOIN m{name} USING (d, asset)),
    f{name} AS (SELECT d, asset, last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY d ROWS UNBOUNDED PRECEDING) AS close FROM g{name}),
    r{name} AS (SELECT d, asset, close, close / lag(close) OVER (PARTITION BY asset ORDER BY d) AS ratio FROM f{name} WHERE close IS NOT NULL),
    e{name} AS (SELECT *, CASE WHEN ratio > 0 AND (ratio < 0.6 OR ratio > 1.4) THEN ratio END AS event FROM r{name}),
    c{name} AS (
        SELECT d, asset, close * exp(coalesce(sum(ln(event)) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS close FROM e{name}
    )"""


CACHED = ",".join((
    _sql_of_update("1", "SELECT d, asset, close FROM px_daily WHERE d < DATE '1999-01-01'"),
    _sql_of_update("2", """SELECT d, asset, coalesce(n.close, o.close) AS close FROM c1 AS o
        FULL JOIN (SELECT d, asset, CASE WHEN day(d) <> 7 THEN close + 1 END AS close FROM px_daily WHERE d >= DATE '1998-12-20') AS n USING (d, asset)"""),
))


@query("SELECT d, asset, round(ln(close), 6) AS log_close FROM c2", CACHED)
def sink_price_cache(t: Tables) -> DataFrame:
    """The cache after two updates, read back from its files: what was there, then later prices with an overlap and holes; filled and repaired each time."""
    p, path = t.px_daily.select("d", "asset", "close"), landing.folder(t.spark, "price-cache")
    fresh = p.where("d >= date'1998-12-20'").withColumn("close", F.when(F.dayofmonth("d") != 7, F.col("close") + 1))
    caches.update_prices(p.where("d < date'1999-01-01'"), path)
    caches.update_prices(fresh, path)
    return caches.read(t.spark, path).select("d", "asset", F.round(F.log("close"), 6).alias("log_close"))


@query("SELECT d, asset, total_net FROM flows_daily")
def sink_flow_cache(t: Tables) -> DataFrame:
    """The flows after three updates, the last of which has nothing new, read back from the table's files."""
    f, path = t.flows_daily.select("d", "asset", "total_net").withColumn("seq", F.lit(0)), landing.folder(t.spark, "flow-cache")
    for rows in (f.where("d < date'1998-01-01'"), f.where("d >= date'1997-06-01'"), f):
        caches.update_flows(rows, path)
    return caches.flows(t.spark, path, "d date, asset string, total_net double").select("d", "asset", "total_net")


@query("SELECT asset, min(d) AS valid_from, CASE WHEN max(d) < (SELECT max(d) FROM px_daily) THEN max(d) END AS valid_to FROM px_daily GROUP BY asset")
def agg_membership(t: Tables) -> DataFrame:
    return pit.membership(t.px_daily)


@query("""SELECT count(*) AS entities, count(*) FILTER (last < n) AS ended, count(*) FILTER (k = 20 AND lo = hi) AS constant_tail, count(*) FILTER (last < n) = 0 AS biased FROM (
    SELECT asset, n, max(pos) AS last, count(*) FILTER (pos > n - 20) AS k, min(close) FILTER (pos > n - 20) AS lo, max(close) FILTER (pos > n - 20) AS hi FROM grid_day, (SELECT max(pos) AS n FROM cal_day) WHERE close IS NOT NULL GROUP BY asset, n)""")
def agg_survivorship(t: Tables) -> DataFrame:
    return pit.survivorship(g.panel_daily(t.px_daily, t.assets))


@query("SELECT a.asset, count(p.close) AS n_obs, count(p.close) > 0 AS in_database, count(p.close) >= 252 AS ready FROM assets a LEFT JOIN px_daily p ON p.asset = a.asset GROUP BY a.asset")
def sink_coverage(t: Tables) -> DataFrame:
    n = t.px_daily.groupBy("asset").agg(F.count("close").alias("n"))
    out = t.assets.join(n, "asset", "left").withColumn("n_obs", F.coalesce("n", F.lit(0).cast("long")))
    return out.select("asset", "n_obs", (F.col("n_obs") > 0).alias("in_database"), (F.col("n_obs") >= 252).alias("ready"))


@query("SELECT d, asset FROM px_daily WHERE d < DATE '1996-01-01' EXCEPT SELECT d, asset FROM px_daily WHERE close < 930")
def set_except(t: Tables) -> DataFrame:
    return t.px_daily.where("d < date'1996-01-01'").select("d", "asset").join(t.px_daily.where("close < 930").select("d", "asset"), ["d", "asset"], "left_anti")


@query("SELECT asset FROM px_daily WHERE year(d) = 1996 INTERSECT SELECT asset FROM flows_daily WHERE total_net > 0")
def set_intersect(t: Tables) -> DataFrame:
    return t.px_daily.where("year(d) = 1996").select("asset").intersect(t.flows_daily.where("total_net > 0").select("asset"))


@query("SELECT asset AS ticker, 'nation' AS kind FROM assets UNION SELECT grp, 'region' FROM assets")
def set_catalogue(t: Tables) -> DataFrame:
    a = t.assets
    return a.select(F.col("asset").alias("ticker"), F.lit("nation").alias("kind")).union(a.select("grp", F.lit("region"))).distinct()


@query("SELECT d, asset, close FROM px_daily UNION ALL SELECT d, asset, close FROM px_noisy")
def set_union(t: Tables) -> DataFrame:
    return t.px_daily.select("d", "asset", "close").unionByName(t.px_noisy)


@query("SELECT entity_id, trade_date, close FROM raw_prices QUALIFY row_number() OVER (PARTITION BY entity_id, trade_date ORDER BY ingest_date DESC) = 1")
def set_dedupe_last(t: Tables) -> DataFrame:
    return pit.keep_last(t.raw_prices, ["entity_id", "trade_date"], "ingest_date").select("entity_id", "trade_date", "close")


@query("SELECT entity_id, trade_date, close FROM raw_prices QUALIFY row_number() OVER (PARTITION BY entity_id, trade_date ORDER BY ingest_date) = 1")
def set_dedupe_first(t: Tables) -> DataFrame:
    return pit.keep_last(t.raw_prices, ["entity_id", "trade_date"], "ingest_date", first=True).select("entity_id", "trade_date", "close")


@query("SELECT asset, 'negative_volume' AS code, d FROM bad_bars WHERE volume < 0 UNION ALL SELECT asset, 'bad_close', d FROM bad_bars WHERE close <= 0")
def flt_raw_sanity(t: Tables) -> DataFrame:
    return q.raw_sanity(t.bad_bars).select(F.col("entity_id").alias("asset"), "code", "d")


CONS = "cons AS (SELECT *, concat_ws(',', CASE WHEN high < low THEN 'high<low' END, CASE WHEN close < low OR close > high THEN 'close' END, CASE WHEN open < low OR open > high THEN 'open' END) AS problems FROM bad_bars)"


@query("SELECT asset, d, problems FROM cons WHERE problems <> ''", CONS)
def flt_consistency(t: Tables) -> DataFrame:
    return q.consistency(t.bad_bars).select(F.col("entity_id").alias("asset"), "d", "problems")


@query("SELECT entity_id, age FROM (SELECT entity_id, DATE '1999-06-30' - max(ingest_date) FILTER (ingest_date <= DATE '1999-06-30') AS age FROM raw_prices GROUP BY entity_id) WHERE age IS NULL OR age > 1")
def agg_freshness(t: Tables) -> DataFrame:
    return q.freshness(t.raw_prices.select("entity_id").distinct(), t.raw_prices, ASOF).select("entity_id", F.col("age").cast("long").alias("age"))


MISS = "miss AS (SELECT a.asset AS entity_id, c.d FROM (SELECT DISTINCT asset FROM px_daily) a CROSS JOIN cal_day c ANTI JOIN px_daily p ON p.asset = a.asset AND p.d = c.d)"


def sessions(t: Tables) -> DataFrame:
    return t.px_daily.select("d").distinct()


def daily_rows(t: Tables) -> DataFrame:
    return t.px_daily.select(F.col("asset").alias("entity_id"), F.col("d").alias("trade_date"))


@query("SELECT entity_id, d FROM miss", MISS)
def jn_missing_sessions(t: Tables) -> DataFrame:
    return q.missing_sessions(daily_rows(t), sessions(t))


@query("SELECT entity_id, count(*) AS missing, min(d) AS first_missing, round(count(*) / (SELECT count(*) FROM cal_day), 6) AS ratio FROM miss GROUP BY entity_id HAVING count(*) / (SELECT count(*) FROM cal_day) > 0.02", MISS)
def agg_completeness(t: Tables) -> DataFrame:
    return rounded(q.completeness(daily_rows(t), sessions(t)).select("entity_id", "missing", "first_missing", "ratio"))


@query("SELECT asset, d, round(abs(close / b - 1), 6) AS move FROM (SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY d) AS b FROM px_daily) WHERE b > 0 AND abs(close / b - 1) > 0.05")
def win_daily_move(t: Tables) -> DataFrame:
    return rounded(q.daily_moves(t.px_daily, 0.05).select(F.col("entity_id").alias("asset"), "d", "move"))


@query("SELECT asset, d FROM (SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY d) AS b FROM (SELECT asset, d, close, CASE WHEN day(d) = 3 THEN 0 ELSE volume END AS volume FROM px_daily)) WHERE volume = 0 AND close <> b")
def win_zero_volume(t: Tables) -> DataFrame:
    bars = t.px_daily.withColumn("volume", F.when(F.dayofmonth("d") == 3, F.lit(0).cast("long")).otherwise(F.col("volume")))
    return q.zero_volume(bars).select(F.col("entity_id").alias("asset"), "d")


PSI = """pb AS (SELECT asset AS feature, close AS x FROM px_daily WHERE d < DATE '1998-06-01'), pc AS (SELECT asset AS feature, close AS x FROM px_daily WHERE d >= DATE '1998-06-01'),
pr AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY feature) AS n FROM pb),
pe AS (SELECT w.feature, r.x AS edge FROM (SELECT feature, least(n - 1, CAST(round_even(k * n / 10.0, 0) AS BIGINT)) AS i FROM (SELECT feature, max(n) AS n FROM pr GROUP BY feature), range(1, 10) t(k)) w JOIN pr r ON r.feature = w.feature AND r.i = w.i),
pk AS (SELECT side, v.feature, (SELECT count(*) FROM pe WHERE pe.feature = v.feature AND edge < v.x) AS bucket FROM (SELECT 0 AS side, * FROM pb UNION ALL SELECT 1, * FROM pc) v),
pn AS (SELECT feature, bucket, count(*) FILTER (side = 0) AS b, count(*) FILTER (side = 1) AS c FROM pk GROUP BY ALL),
ps AS (SELECT feature, greatest(b / sum(b) OVER (PARTITION BY feature), 1e-6) AS b, greatest(coalesce(c / nullif(sum(c) OVER (PARTITION BY feature), 0), 0), 1e-6) AS c FROM pn),
psi AS (SELECT feature, sum((c - b) * ln(c / b)) AS psi FROM ps GROUP BY feature)"""


def stability(t: Tables) -> DataFrame:
    x = t.px_daily.select(F.col("asset").alias("feature"), F.col("close").alias("x"), "d")
    return q.psi(x.where("d < date'1998-06-01'").drop("d"), x.where("d >= date'1998-06-01'").drop("d"))


@query("SELECT feature, round(psi, 6) AS psi FROM psi", PSI)
def agg_psi(t: Tables) -> DataFrame:
    return rounded(stability(t))


@query("SELECT feature, round(psi, 6) AS psi, CASE WHEN psi > 0.5 THEN 'P0' ELSE 'P1' END AS severity, CASE WHEN psi > 0.5 THEN 'NO_TRADE' ELSE 'TRADABLE' END AS state FROM psi WHERE psi > 0.25", PSI)
def agg_drift(t: Tables) -> DataFrame:
    return rounded(q.drift(stability(t)))


GATE = CONS + """, gate AS (SELECT asset AS entity_id, 1 AS seq, 'NO_TRADE' AS state FROM bad_bars WHERE volume < 0 OR close <= 0 UNION ALL SELECT asset, 2, 'NO_TRADE' FROM cons WHERE problems <> ''
    UNION ALL SELECT asset, 3, 'TRADABLE' FROM (SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY d) AS b FROM bad_bars) WHERE b > 0 AND abs(close / b - 1) > 0.105)"""


def gate(t: Tables) -> DataFrame:
    rows = t.bad_bars
    cut = lambda df, seq: df.select("entity_id", "state", F.lit(seq).alias("seq"))
    return cut(q.raw_sanity(rows), 1).unionByName(cut(q.consistency(rows), 2)).unionByName(cut(q.daily_moves(rows, q.MOVE_LIMIT["TW"]).withColumn("state", F.lit("TRADABLE")), 3))


@query("SELECT a.asset AS entity_id, coalesce(arg_min(g.state, g.seq) FILTER (g.state <> 'TRADABLE'), 'TRADABLE') AS state FROM assets a LEFT JOIN gate g ON g.entity_id = a.asset GROUP BY a.asset", GATE)
def agg_state(t: Tables) -> DataFrame:
    return q.state(gate(t), t.assets.select(F.col("asset").alias("entity_id")))


@query("SELECT entity_id, seq, count(*) AS n FROM gate GROUP BY ALL", GATE)
def pipe_quality_gate(t: Tables) -> DataFrame:
    return gate(t).groupBy("entity_id", "seq").agg(F.count("*").alias("n"))


@query("SELECT d, entity_id, asof_close, days_since FROM (SELECT c.d, a.asset AS entity_id, last_value(p.close IGNORE NULLS) OVER w AS asof_close, CAST(c.d - last_value(p.d IGNORE NULLS) OVER w AS BIGINT) AS days_since FROM cal_day c CROSS JOIN (SELECT DISTINCT asset FROM px_daily) a LEFT JOIN px_daily p ON p.asset = a.asset AND p.d = c.d WINDOW w AS (PARTITION BY a.asset ORDER BY c.d ROWS UNBOUNDED PRECEDING)) WHERE asof_close IS NOT NULL")
def jn_market_view(t: Tables) -> DataFrame:
    grid = g.panel_daily(t.px_daily, t.px_daily.select("asset").distinct())
    w = Window.partitionBy("asset").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.select("d", F.col("asset").alias("entity_id"), F.last("close", ignorenulls=True).over(w).alias("asof_close"), F.datediff("d", F.last(F.when(F.col("close").isNotNull(), F.col("d")), ignorenulls=True).over(w)).cast("long").alias("days_since"))
    return out.where("asof_close is not null")


@query("SELECT d, asset, next_d FROM (SELECT c.d, lead(c.d) OVER (ORDER BY c.d) AS next_d FROM cal_day c) JOIN px_daily USING (d) WHERE next_d IS NOT NULL")
def jn_execution_lag(t: Tables) -> DataFrame:
    days = t.px_daily.select("d").distinct()
    nxt = days.withColumn("next_d", F.lead("d").over(Window.orderBy("d")))  # one row a date
    return t.px_daily.join(F.broadcast(nxt), "d").where("next_d is not null").select("d", "asset", "next_d")
