"""Domain tables of equity research over the given tables, in Spark and as common table expressions for the SQL side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.landing import written

BENCHMARK, DEFENSIVE = 0, 1  # nation keys
_KEPT: dict[tuple, DataFrame] = {}


class Tables:
    """The given tables of one folder, and the domain tables over them; every attribute is lazy but for the shared panels, which are written first."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def assets(self) -> DataFrame:
        return self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("asset"), F.col("r_name").alias("grp"), F.col("n_nationkey").alias("ord"))

    @property
    def sales(self) -> DataFrame:
        """One row a line: d, asset, qty, price, value, line, flag and status."""
        owner = self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        lines = self.read("lineitem").join(self.read("part"), F.col("l_partkey") == F.col("p_partkey")).join(owner, F.col("l_orderkey") == F.col("o_orderkey"))
        return lines.select(
            F.col("l_shipdate").cast("date").alias("d"), F.col("n_name").alias("asset"), F.col("l_quantity").alias("qty"), F.col("p_retailprice").alias("unit"),
            F.col("l_extendedprice").alias("value"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        )

    def kept(self, name: str, build) -> DataFrame:
        """A panel that many queries share, written once for a session and folder: what reads it doesn't plan the joins below it again."""
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _KEPT:
            _KEPT[key] = written(build(), name)
        return _KEPT[key]

    @property
    def px_daily(self) -> DataFrame:
        return self.kept("px_daily", self._px_daily)

    def _px_daily(self) -> DataFrame:
        q, u = F.col("qty"), F.col("unit")
        return self.sales.groupBy("d", "asset").agg(
            F.round((F.min(u) + F.max(u)) / 2, 9).alias("open"), F.max(u).alias("high"), F.min(u).alias("low"), F.round(F.sum(q * u) / F.sum(q), 9).alias("close"), F.sum(q).cast("long").alias("volume")
        )

    @property
    def px_noisy(self) -> DataFrame:
        return self.sales.groupBy("d", "asset").agg(F.round(F.sum("value") / F.sum("qty"), 8).alias("close"))

    @property
    def bad_bars(self) -> DataFrame:
        day = F.dayofmonth("d")
        return self.px_daily.select(
            "d", "asset", "open", F.when(day == 13, F.col("low") - 1).otherwise(F.col("high")).alias("high"), F.when(day == 13, F.col("high") + 1).otherwise(F.col("low")).alias("low"),
            F.when(day == 15, 0.0).otherwise(F.col("close")).alias("close"), F.when(day == 14, -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
        )

    @property
    def flows_daily(self) -> DataFrame:
        return self.kept("flows_daily", self._flows_daily)

    def _flows_daily(self) -> DataFrame:
        signed = F.when(F.col("status") == "O", F.col("qty")).otherwise(-F.col("qty"))
        part = lambda flag: F.sum(F.when(F.col("flag") == flag, signed).otherwise(0.0))
        return self.sales.groupBy("d", "asset").agg(part("A").alias("foreign_net"), part("N").alias("trust_net"), part("R").alias("dealer_net"), F.sum(signed).alias("total_net"))

    @property
    def security_master(self) -> DataFrame:
        key = F.col("ord")
        return self.assets.select(
            F.col("asset").alias("ticker"), F.col("grp").alias("industry"), (1e6 * (key + 1)).alias("issued_shares"), F.when(key % 2 == 0, "listed").otherwise("otc").alias("market"), F.lit("stock").alias("asset_type"), "ord"
        )

    @property
    def holdings(self) -> DataFrame:
        return self.assets.select(F.col("grp").alias("etf"), F.col("asset").alias("holding_ticker"), F.lit(0.2).alias("weight"), "ord")

    @property
    def raw_prices(self) -> DataFrame:
        q = F.col("qty")
        by_line = self.sales.groupBy("asset", "d", "line").agg(F.round(F.sum(q * F.col("unit")) / F.sum(q), 9).alias("close"), F.sum(q).cast("long").alias("volume"))
        return by_line.select(F.col("asset").alias("entity_id"), F.col("d").alias("trade_date"), "close", "volume", F.date_add("d", F.col("line")).alias("ingest_date"))

    @property
    def corp_actions(self) -> DataFrame:
        return self.corp_actions_all.where(F.col("action_id") % 10 == 0)

    @property
    def corp_actions_all(self) -> DataFrame:
        """Every urgent order as an action."""
        o = self.read("orders").where(F.col("o_orderpriority") == "1-URGENT")
        owner = o.join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        ex = F.col("o_orderdate").cast("date")
        return owner.select(F.col("n_name").alias("entity_id"), ex.alias("ex_date"), (0.9 + (F.col("o_orderkey") / 10 % 10) / 100).alias("factor"), F.col("o_orderkey").alias("action_id"), F.lit(0.95).alias("confidence"), F.date_add(ex, 30).alias("ingest_date"))

    @property
    def spans(self) -> DataFrame:
        dates = self.read("orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("valid_from"), F.max("o_orderdate").cast("date").alias("last"))
        c = self.read("customer").join(dates, F.col("c_custkey") == F.col("o_custkey"))
        state = F.when(F.col("c_mktsegment") == "BUILDING", "TRADABLE").when(F.col("c_mktsegment") == "MACHINERY", "SUSPENDED").otherwise("TRADABLE")
        return c.select(F.col("c_custkey").alias("entity_id"), "valid_from", F.when(F.col("c_custkey") % 5 != 0, F.col("last")).alias("valid_to"), state.alias("state"), F.date_add("valid_from", (F.col("c_custkey") % 30).cast("int")).alias("ingest_date"))

    @property
    def weights(self) -> DataFrame:
        c = self.read("customer").join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        held = c.groupBy(F.col("c_mktsegment").alias("portfolio"), F.col("n_name").alias("entity"), F.col("r_name").alias("sector")).agg(F.round(F.sum(F.greatest(F.col("c_acctbal"), F.lit(0.0))), 2).alias("held"))
        total = held.groupBy("portfolio").agg(F.round(F.sum("held"), 2).alias("total"))
        return held.join(total, "portfolio").select("portfolio", "entity", "sector", F.round(F.col("held") / F.col("total"), 8).alias("weight"))

    @property
    def scores(self) -> DataFrame:
        owner = self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        signed = F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(-F.col("l_quantity"))
        return self.read("lineitem").join(owner, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("c_mktsegment").alias("portfolio"), F.col("n_name").alias("entity"), F.col("r_name").alias("sector")).agg(F.sum(signed).alias("score"))

    @property
    def signals(self) -> DataFrame:
        family = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
        g = self.read("events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"), F.count("*").alias("n"), F.max("ts").alias("signal_time"))
        return g.select(F.col("user_id").alias("entity"), F.col("event_type").alias("name"), F.coalesce(family[F.col("event_type")], F.lit("other")).alias("family"), F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("v") / 100)), 6).alias("score"), F.least(F.lit(1.0), F.col("n") / 10.0).alias("confidence"), "signal_time")

    @property
    def opinions(self) -> DataFrame:
        i = F.col("event_id")
        return self.read("events").select(F.col("user_id").alias("entity"), F.to_date("ts").alias("d"), F.col("event_type").alias("agent"), F.when(i % 3 == 0, "LONG").when(i % 3 == 1, "SHORT").otherwise("FLAT").alias("direction"), ((i * 7) % 10 / 10.0).alias("confidence"))

    @property
    def alerts(self) -> DataFrame:
        kind = F.col("event_type")
        severity = F.when(kind == "error", "P0").when(kind.isin("purchase", "signup"), "P1").otherwise("P2")
        return self.read("events").select("event_id", F.col("user_id").alias("entity"), severity.alias("severity"), F.concat_ws(" ", kind, F.floor(F.col("value") / 10).cast("string")).alias("summary"), F.lit("review the position").alias("action"), F.col("ts").alias("created_at"))

    @property
    def order_stream(self) -> DataFrame:
        e = self.read("events")
        mean = e.groupBy("user_id").agg(F.avg("value").alias("ref_price"))
        return e.join(mean, "user_id").select("event_id", F.col("user_id").alias("entity"), F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.floor("value").cast("string"))).alias("idempotency_key"), "ts", F.col("value").alias("price"), "ref_price")


#: Families of the event types.
FAMILIES = {"click": "momentum", "view": "mean_reversion", "purchase": "event", "signup": "flow"}

#: The same tables for the SQL side.
CTE = """
WITH assets AS (SELECT n_name AS asset, r_name AS grp, n_nationkey AS ord FROM nation JOIN region ON n_regionkey = r_regionkey),
sales AS (
    SELECT CAST(l_shipdate AS DATE) AS d, n_name AS asset, l_quantity AS qty, p_retailprice AS unit, l_extendedprice AS value, l_linenumber AS line, l_returnflag AS flag, l_linestatus AS status
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
px_daily AS (SELECT d, asset, round((min(unit) + max(unit)) / 2, 9) AS open, max(unit) AS high, min(unit) AS low, round(sum(qty * unit) / sum(qty), 9) AS close, CAST(sum(qty) AS BIGINT) AS volume FROM sales GROUP BY d, asset),
px_noisy AS (SELECT d, asset, round(sum(value) / sum(qty), 8) AS close FROM sales GROUP BY d, asset),
bad_bars AS (SELECT d, asset, open, CASE WHEN day(d) = 13 THEN low - 1 ELSE high END AS high, CASE WHEN day(d) = 13 THEN high + 1 ELSE low END AS low, CASE WHEN day(d) = 15 THEN 0 ELSE close END AS close, CASE WHEN day(d) = 14 THEN -volume ELSE volume END AS volume FROM px_daily),
flows_daily AS (
    SELECT d, asset, sum(CASE WHEN flag = 'A' THEN s ELSE 0 END) AS foreign_net, sum(CASE WHEN flag = 'N' THEN s ELSE 0 END) AS trust_net, sum(CASE WHEN flag = 'R' THEN s ELSE 0 END) AS dealer_net, sum(s) AS total_net
    FROM (SELECT *, CASE WHEN status = 'O' THEN qty ELSE -qty END AS s FROM sales) GROUP BY d, asset
),
security_master AS (SELECT asset AS ticker, grp AS industry, 1e6 * (ord + 1) AS issued_shares, CASE WHEN ord % 2 = 0 THEN 'listed' ELSE 'otc' END AS market, 'stock' AS asset_type, ord FROM assets),
holdings AS (SELECT grp AS etf, asset AS holding_ticker, 0.2::DOUBLE AS weight, ord FROM assets),
raw_prices AS (SELECT asset AS entity_id, d AS trade_date, round(sum(qty * unit) / sum(qty), 9) AS close, CAST(sum(qty) AS BIGINT) AS volume, CAST(d + line AS DATE) AS ingest_date FROM sales GROUP BY asset, d, line),
corp_actions AS (
    SELECT n_name AS entity_id, CAST(o_orderdate AS DATE) AS ex_date, 0.9::DOUBLE + (o_orderkey::DOUBLE / 10 % 10) / 100 AS factor, o_orderkey AS action_id, 0.95::DOUBLE AS confidence, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS ingest_date
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 10 = 0
),
spans AS (
    SELECT c_custkey AS entity_id, valid_from, CASE WHEN c_custkey % 5 <> 0 THEN last END AS valid_to, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'SUSPENDED' ELSE 'TRADABLE' END AS state, CAST(valid_from + CAST(c_custkey % 30 AS INTEGER) AS DATE) AS ingest_date
    FROM customer JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS valid_from, CAST(max(o_orderdate) AS DATE) AS last FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey
),
weights AS (
    SELECT portfolio, entity, sector, round(held / round(sum(held) OVER (PARTITION BY portfolio), 2), 8) AS weight FROM (
        SELECT c_mktsegment AS portfolio, n_name AS entity, r_name AS sector, round(sum(greatest(c_acctbal, 0)), 2) AS held FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
),
scores AS (
    SELECT c_mktsegment AS portfolio, n_name AS entity, r_name AS sector, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END) AS score
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
),
signals AS (
    SELECT user_id AS entity, event_type AS name, CASE event_type WHEN 'click' THEN 'momentum' WHEN 'view' THEN 'mean_reversion' WHEN 'purchase' THEN 'event' WHEN 'signup' THEN 'flow' ELSE 'other' END AS family,
        round(greatest(-1, least(1, avg(value) / 100)), 6) AS score, least(1.0::DOUBLE, count(*) / 10.0::DOUBLE) AS confidence, max(ts) AS signal_time FROM events GROUP BY user_id, event_type
),
opinions AS (SELECT user_id AS entity, CAST(ts AS DATE) AS d, event_type AS agent, CASE event_id % 3 WHEN 0 THEN 'LONG' WHEN 1 THEN 'SHORT' ELSE 'FLAT' END AS direction, ((event_id * 7) % 10) / 10.0::DOUBLE AS confidence FROM events),
alerts AS (
    SELECT event_id, user_id AS entity, CASE WHEN event_type = 'error' THEN 'P0' WHEN event_type IN ('purchase', 'signup') THEN 'P1' ELSE 'P2' END AS severity, event_type || ' ' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS summary, 'review the position' AS action, ts AS created_at FROM events
),
order_stream AS (
    SELECT event_id, user_id AS entity, md5(user_id::VARCHAR || '|' || event_type || '|' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) AS idempotency_key, ts, value AS price, avg(value) OVER (PARTITION BY user_id) AS ref_price FROM events
),
cal_month AS (SELECT date_trunc('month', d) AS period, max(d) AS d, row_number() OVER (ORDER BY date_trunc('month', d)) AS pos FROM px_daily GROUP BY 1),
px_month AS (SELECT c.d, c.pos, p.asset, arg_max(p.close, p.d) AS close FROM px_daily p JOIN cal_month c ON date_trunc('month', p.d) = c.period GROUP BY ALL),
grid AS (SELECT c.d, c.pos, a.asset, a.grp, a.ord, p.close FROM cal_month c CROSS JOIN assets a LEFT JOIN px_month p ON p.d = c.d AND p.asset = a.asset),
cal_day AS (SELECT d, row_number() OVER (ORDER BY d) AS pos FROM (SELECT DISTINCT d FROM px_daily)),
grid_day AS (SELECT c.d, c.pos, a.asset, a.grp, a.ord, p.close, p.volume FROM cal_day c CROSS JOIN assets a LEFT JOIN px_daily p ON p.d = c.d AND p.asset = a.asset)
"""
