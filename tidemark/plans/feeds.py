"""Queries of sources and sinks: feeds are built from the given tables, landed, and read back as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import with_suffix
from ..operators import pit
from ..operators import rotation as ro
from ..sources import feeds, landing, snapshots
from .registry import query, rounded
from .rotation import HOW, SCORED, scores
from .views import Tables

ASOF = "2024-01-16 00:00:00"


def wide(t: Tables, prices: DataFrame, ticker: Column, label: str) -> str:
    """A written panel with a column for each ticker of a dimension."""
    names = [r[0] for r in t.assets.select(ticker.alias("ticker")).collect()]  # a column each: as many as assets
    path = landing.folder(t.spark, label)
    prices.join(t.assets, "asset").withColumn("ticker", ticker).groupBy("d").pivot("ticker", names).agg(F.first("close")).write.parquet(path)
    return path


@query("SELECT d, asset AS ticker, close FROM px_daily")
def src_prices_wide(t: Tables) -> DataFrame:
    return feeds.read_wide(t.spark, wide(t, t.px_daily, F.col("asset"), "wide"))


def exchange_ticker() -> Column:
    k = F.col("ord") % 3
    return F.when(k == 0, F.concat("asset", F.lit(".TW"))).when(k == 1, F.concat(F.lower("asset"), F.lit(".two"))).otherwise(F.col("asset"))


@query("SELECT 'TW:' || upper(asset) AS entity_id, d AS trade_date, round(close, 6) AS close, 0::BIGINT AS volume, true AS stamped FROM bad_bars JOIN assets USING (asset) WHERE ord % 3 < 2 AND close > 0")
def src_prices_legacy(t: Tables) -> DataFrame:
    rows = feeds.read_legacy(t.spark, wide(t, t.bad_bars.select("d", "asset", "close"), exchange_ticker(), "legacy"))
    return rounded(rows.select("entity_id", "trade_date", F.col("close").cast("double").alias("close"), "volume", F.col("ingest_time").isNotNull().alias("stamped")))


@query("SELECT 'TW:' || upper(ticker) AS entity_id, ticker AS local_symbol, ticker AS name, '' AS full_name, industry, market AS market_board, asset_type FROM security_master WHERE ord % 5 <> 0")
def src_master_csv(t: Tables) -> DataFrame:
    ticker = F.when(F.col("ord") % 5 == 0, F.col("ticker")).otherwise(with_suffix(F.col("ticker"), F.col("ord") % 2 == 0))
    raw = t.security_master.select(
        ticker.alias("Yahoo ticker"), F.col("ticker").alias("Code"), F.concat(F.lit("  "), "ticker", F.lit(" ")).alias("Name"), F.lit(None).cast("string").alias("Full name"),
        F.col("industry").alias("Industry"), F.col("market").alias("Market"), F.col("asset_type").alias("Asset type"),
    )
    path = landing.folder(t.spark, "master")
    raw.write.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path, header=True)
    return feeds.read_master(t.spark, path)


@query("""SELECT f.d, asset || CASE WHEN ord % 2 = 0 THEN '.TW' ELSE '.TWO' END AS ticker, asset AS name, foreign_net, trust_net, dealer_net, total_net FROM flows_daily f JOIN assets USING (asset) WHERE day(f.d) <> 31""")
def src_flow_payload(t: Tables) -> DataFrame:
    """Both exchanges' feeds: their columns stand elsewhere, short rows and days in another state give nothing."""
    text = lambda c: F.when(F.col(c) == 0, "--").otherwise(F.format_number(c, 0))

    def payload(rest: int, form: tuple, wrap) -> DataFrame:
        width, places = form
        cells = {0: F.concat("asset", F.lit(" ")), 1: F.col("asset"), **dict(zip(places, map(text, ("foreign_net", "trust_net", "dealer_net", "total_net")), strict=True))}
        row = F.array(*[cells.get(i, F.lit("")) for i in range(width)])
        rows = t.flows_daily.join(t.assets, "asset").where(F.col("ord") % 2 == rest).groupBy("d").agg(F.collect_list(row).alias("rows"))  # the assets of a day
        data = F.concat("rows", F.array(F.array(F.lit("short"), F.lit("row"))))
        return rows.select("d", F.to_json(wrap(F.dayofmonth("d") == 31, data)).alias("payload"))

    listed = payload(0, feeds.LISTED, lambda off, data: F.struct(F.when(off, "CLOSED").otherwise("OK").alias("stat"), data.alias("data")))
    empty = F.array().cast("array<array<string>>")
    otc = payload(1, feeds.OTC, lambda off, data: F.struct(F.when(off, "CLOSED").otherwise("ok").alias("stat"), F.array(F.struct(empty.alias("data")), F.struct(data.alias("data"))).alias("tables")))
    both = feeds.listed_flows(listed).unionByName(feeds.otc_flows(otc))
    return both.select("d", "ticker", "name", *[F.col(c).cast("double").alias(c) for c in ("foreign_net", "trust_net", "dealer_net", "total_net")])


DIVIDENDS = """ev AS (SELECT CAST(o_orderdate AS DATE) AS ex_date, n_name AS symbol, o_orderkey AS k, 1000 + o_orderkey % 1000 AS prior, round((1000 + o_orderkey % 1000) * (0.9::DOUBLE + (o_orderkey % 10) / 100.0::DOUBLE), 2) AS reference
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT')"""


def dividend_rows(t: Tables) -> DataFrame:
    """Every urgent order as an event of a landed payload, a payload a day; some lack a code or a price."""
    o = t.read("orders").where("o_orderpriority = '1-URGENT'").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    prior = 1000 + k % 1000
    reference = F.round(prior * (0.9 + (k % 10) / 100.0), 2)
    day = F.concat(F.lpad((F.year(d) - 1911).cast("string"), 3, "0"), F.date_format(d, "MMdd"))
    event = F.struct(
        day.alias("Date"), F.when(k % 11 == 0, " ").otherwise(F.col("n_name")).alias("Code"), k.cast("string").alias("Name"), F.when(k % 13 == 0, "--").otherwise(F.format_number(prior, 2)).alias("PreviousClosingPrice"),
        F.format_number(reference, 2).alias("ExRightsExDividendReferencePrice"), F.lit("").alias("CashDividend"), F.lit("N/A").alias("StockDividend"),
    )
    payloads = o.groupBy(F.to_date(d).alias("day")).agg(F.to_json(F.collect_list(event)).alias("payload"))  # the events of a day
    return feeds.dividends(payloads)


@query("SELECT ex_date, symbol, CAST(k AS VARCHAR) AS name, prior::DOUBLE AS prior_close, reference AS reference_price, 0.0::DOUBLE AS cash FROM ev WHERE k % 11 <> 0 AND k % 13 <> 0", DIVIDENDS)
def src_dividend_payload(t: Tables) -> DataFrame:
    return dividend_rows(t).select("ex_date", "symbol", "name", *[F.col(c).cast("double").alias(c) for c in ("prior_close", "reference_price", "cash")])


@query("SELECT CAST(k AS VARCHAR) AS name, round(reference / prior, 6) AS factor FROM ev WHERE k % 11 <> 0 AND k % 13 <> 0", DIVIDENDS)
def fn_dividend_factor(t: Tables) -> DataFrame:
    return rounded(dividend_rows(t).select("name", "factor"))


CLASSES = "CASE p_partkey % 7 WHEN 0 THEN '公司債' WHEN 1 THEN '原油期貨' WHEN 2 THEN '正2' WHEN 3 THEN '主動式' WHEN 4 THEN '美國' WHEN 5 THEN '反一債' ELSE '' END"
MASTER = f"""co AS (
    SELECT CAST(s_suppkey AS VARCHAR) || CASE WHEN s_suppkey % 2 = 0 THEN '.TW' ELSE '.TWO' END AS ticker, CAST(s_suppkey AS VARCHAR) AS code, s_name AS name, s_name AS full_name, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS industry_code,
        CASE WHEN s_suppkey % 4 <> 3 THEN s_acctbal END AS issued_shares, CASE WHEN s_suppkey % 2 = 0 THEN '上市' ELSE '上櫃' END AS market, CASE WHEN s_nationkey < 20 THEN n_name ELSE '其他／未分類' END AS industry, '股票' AS asset_type, '' AS fund_type
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
), fu AS (SELECT *, {CLASSES} AS fund FROM part), classed AS (
    SELECT *, CASE WHEN fund LIKE '%債%' THEN '債券 ETF' WHEN fund LIKE '%原油%' THEN '商品／期貨 ETF' WHEN fund LIKE '%正2%' THEN '槓桿／反向 ETF' WHEN fund LIKE '%主動%' THEN '主動式 ETF' WHEN fund LIKE '%美國%' THEN '海外股票 ETF' ELSE '台灣股票 ETF' END AS cls FROM fu
), et AS (
    SELECT '00' || p_partkey || '.TW' AS ticker, '00' || p_partkey AS code, p_name AS name, p_name AS full_name, 'ETF' AS industry_code, p_retailprice AS issued_shares, '上市' AS market, cls AS industry, 'ETF' AS asset_type, fund AS fund_type
    FROM classed WHERE p_partkey % 3 = 0 AND p_partkey % 2 = 0
    UNION ALL SELECT '00' || p_partkey || '.TWO', '00' || p_partkey, p_name || fund, p_name || fund, 'ETF', p_retailprice, '上櫃', cls, 'ETF', '' FROM classed WHERE p_partkey % 3 = 1 AND p_partkey % 2 = 0
)"""


def fund_text() -> Column:
    k = F.col("p_partkey") % 7
    return F.when(k == 0, "公司債").when(k == 1, "原油期貨").when(k == 2, "正2").when(k == 3, "主動式").when(k == 4, "美國").when(k == 5, "反一債").otherwise("")


def feed(rows: DataFrame, key: str, **fields: Column) -> DataFrame:
    """Pages of a hundred records each, as an exchange would serve them."""
    page = F.floor(F.col(key) / 100)
    return rows.groupBy(page.alias("seq")).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*[v.alias(k) for k, v in fields.items()])))).alias("payload"))


@query("SELECT * FROM co UNION ALL SELECT * FROM et", MASTER)
def src_master_payload(t: Tables) -> DataFrame:
    """Companies and funds of two exchanges; the industries' names come from a lookup that lacks some codes."""
    s, p, fund = t.read("supplier"), t.read("part"), fund_text()
    code, shares = F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 4 == 3, "n/a").otherwise(F.col("s_acctbal").cast("string"))
    listed = feed(s.where("s_suppkey % 2 = 0"), "s_suppkey", 公司代號=F.concat(code, F.lit(" ")), 公司簡稱=F.col("s_name"), 公司名稱=F.col("s_name"), 產業別=F.col("s_nationkey").cast("string"), 已發行普通股數或TDR原股發行股數=shares)
    otc = feed(s.where("s_suppkey % 2 = 1"), "s_suppkey", SecuritiesCompanyCode=code, CompanyAbbreviation=F.col("s_name"), CompanyName=F.col("s_name"), SecuritiesIndustryCode=F.col("s_nationkey").cast("string"), IssueShares=shares)
    industries = t.read("nation").where("n_nationkey < 20").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("code"), F.col("n_name").alias("industry"))
    key, units = F.col("p_partkey").cast("string"), F.col("p_retailprice").cast("string")
    first = feed(p.where("p_partkey % 3 = 0"), "p_partkey", **{"基金代號": F.concat(F.lit("00"), key), "基金簡稱": F.col("p_name"), "基金中文名稱": F.col("p_name"), "基金類型": fund, "發行單位數/轉換數": units})
    quoted = feed(p.where("p_partkey % 2 = 0"), "p_partkey", Code=F.concat(F.lit("00"), key, F.lit(" ")))
    second = feed(p.where("p_partkey % 3 = 1"), "p_partkey", SecuritiesCompanyCode=F.concat(F.when(F.col("p_partkey") % 2 == 0, "00").otherwise("02"), key), CompanyName=F.concat("p_name", fund), Capitals=units)
    both = feeds.companies(listed, otc, industries).unionByName(feeds.funds(first, quoted, second))
    return both.select("ticker", "code", "name", "full_name", "industry_code", "issued_shares", "market", "industry", "asset_type", "fund_type")


@query(f"SELECT p_partkey, CASE WHEN f LIKE '%債%' THEN '債券 ETF' WHEN f LIKE '%原油%' THEN '商品／期貨 ETF' WHEN f LIKE '%正2%' THEN '槓桿／反向 ETF' WHEN f LIKE '%主動%' THEN '主動式 ETF' WHEN f LIKE '%美國%' THEN '海外股票 ETF' ELSE '台灣股票 ETF' END AS cls FROM (SELECT p_partkey, {CLASSES} AS f FROM part)")
def lbl_etf_class(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", feeds.fund_class(F.col("p_name"), fund_text()).alias("cls"))


@query("""SELECT c_mktsegment AS etf, upper(n_name) AS holding_ticker, min(n_name) AS holding_name, max(c_acctbal) AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 GROUP BY ALL""")
def src_holdings(t: Tables) -> DataFrame:
    """Funds that hold a name more than once, weights that are no numbers, and rows without a ticker."""
    c = t.read("customer").join(t.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    ticker = F.when(F.col("c_custkey") % 11 != 0, F.lower("n_name"))
    weight = F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    return feeds.top_holdings(c.select(F.col("c_mktsegment").alias("etf"), ticker.alias("holding_ticker"), F.col("n_name").alias("holding_name"), weight.alias("weight")))


@query("""SELECT user_id AS ticker, event_type AS title, props AS summary, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'wire ' || CAST(event_id AS VARCHAR) END AS publisher, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published, 'u/' || CAST(event_id AS VARCHAR) AS url FROM events""")
def src_news_payload(t: Tables) -> DataFrame:
    """Headlines nested in `content` or not, with publishers and addresses as objects or strings, or without a publisher."""
    i = F.col("event_id")
    name, link = F.concat(F.lit("wire "), i.cast("string")), F.concat(F.lit("u/"), i.cast("string"))
    base = [F.col("event_type").alias("title"), F.col("props").alias("summary"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("pubDate")]
    plain = F.to_json(F.struct(*base, F.when(i % 5 != 0, name).alias("provider"), link.alias("canonicalUrl")))
    nested = F.to_json(F.struct(*base, F.when(i % 5 != 0, F.struct(name.alias("displayName"))).alias("provider"), F.struct(link.alias("url")).alias("canonicalUrl")))
    item = F.when(i % 2 == 0, plain).otherwise(F.concat(F.lit('{"id":"x","content":'), nested, F.lit("}")))
    payloads = t.read("events").groupBy("user_id", F.to_date("ts")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("payload"))  # a day's items of a ticker
    return feeds.headlines(payloads.select(F.col("user_id").alias("ticker"), "payload"))


def payloads(t: Tables) -> DataFrame:
    """Events as payloads of a source: a dataset for each kind, a part for each day."""
    e = t.read("events")
    return e.select(F.lit("events").alias("source"), F.col("event_type").alias("dataset"), F.date_format("ts", "yyyy-MM-dd").alias("part"), F.col("ts").cast("timestamp").alias("fetch_time"), F.when(F.col("event_id") % 19 == 0, "").otherwise(F.col("props")).alias("payload"), F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("request"))


def landing_of(t: Tables) -> str:
    """Two overlapping fetches landed one after the other."""
    path, rows = landing.folder(t.spark, "landing"), payloads(t)
    landing.land(rows.where(F.dayofmonth("fetch_time") <= 20), path)
    landing.land(rows.where(F.dayofmonth("fetch_time") >= 10), path)
    return path


LANDED = """landed AS (SELECT DISTINCT event_type AS dataset, strftime(ts, '%Y-%m-%d') AS part, epoch_us(ts) AS fetched_us, substr(sha256('events/' || event_type || chr(31) || props), 1, 16) AS evidence_id, sha256(props) AS sha256, CAST(strlen(props) AS BIGINT) AS byte_size FROM events WHERE event_id % 19 <> 0)"""


@query("SELECT * FROM landed", LANDED)
def sink_raw_landing(t: Tables) -> DataFrame:
    return landing.landed(t.spark, landing_of(t)).select("dataset", "part", F.unix_micros("fetch_time").alias("fetched_us"), "evidence_id", "sha256", "byte_size")


@query("SELECT part, fetched_us, evidence_id FROM landed WHERE dataset = 'purchase' AND fetched_us <= epoch_us(TIMESTAMP '2024-01-16 00:00:00') ORDER BY part, fetched_us", LANDED)
def src_raw_landing(t: Tables) -> DataFrame:
    """What one dataset had landed by a time, its folder alone read."""
    return landing.landed(t.spark, landing_of(t), "events", "purchase", asof=ASOF).select("part", F.unix_micros("fetch_time").alias("fetched_us"), "evidence_id")


@query("SELECT dataset, part, evidence_id, fetched_us FROM landed WHERE fetched_us <= epoch_us(TIMESTAMP '2024-01-16 00:00:00') QUALIFY row_number() OVER (PARTITION BY dataset, part ORDER BY fetched_us DESC, evidence_id DESC) = 1", LANDED)
def jn_landing_latest(t: Tables) -> DataFrame:
    return landing.latest(landing.landed(t.spark, landing_of(t), asof=ASOF)).select("dataset", "part", "evidence_id", F.unix_micros("fetch_time").alias("fetched_us"))


@query("SELECT entity_id, trade_date, close FROM raw_prices WHERE ingest_date <= DATE '1998-06-30' QUALIFY row_number() OVER (PARTITION BY entity_id, trade_date ORDER BY ingest_date DESC) = 1")
def sink_pit_append(t: Tables) -> DataFrame:
    """Prices, then their corrections, appended to one table; a reader as of a day sees the last known by then."""
    path, rows = landing.folder(t.spark, "facts"), t.raw_prices
    first = F.datediff("ingest_date", "trade_date") <= 3
    landing.append_facts(rows.where(first), path)
    landing.append_facts(rows.where(~first), path)
    return pit.as_of(t.spark.read.parquet(path), "1998-06-30", ["entity_id", "trade_date"]).select("entity_id", "trade_date", "close")


@query("SELECT d AS signal_date, 'Monthly' AS frequency, asset, rnk, round(score, 6) AS score, d = (SELECT max(d) FROM top) AS latest FROM top", SCORED)
def sink_snapshots(t: Tables) -> DataFrame:
    """Every month's ranking in dated CSV files, and which one is the latest, read back."""
    ranked = ro.selected(scores(t), HOW).select(F.col("d").alias("signal_date"), F.lit("Monthly").alias("frequency"), "asset", F.col("rnk").cast("long").alias("rnk"), "score")
    path, kinds = landing.folder(t.spark, "rankings"), "signal_date date, frequency string, asset string, rnk long, score double"
    snapshots.publish(ranked, path)
    now = snapshots.latest(t.spark, path, kinds).select("signal_date", "frequency", F.lit(True).alias("latest")).distinct()
    return rounded(snapshots.dated(t.spark, path, kinds).join(F.broadcast(now), ["signal_date", "frequency"], "left").withColumn("latest", F.coalesce("latest", F.lit(False))))  # one row


@query("""SELECT ticker, n, CASE WHEN n < 30 THEN DATE '1990-01-01' ELSE CAST(last - 10 AS DATE) END AS from_date FROM (
    SELECT n_name || '/' || c_mktsegment || '/' || o_orderpriority AS ticker, count(*) AS n, max(CAST(o_orderdate AS DATE)) AS last FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)""")
def sink_price_cache_plan(t: Tables) -> DataFrame:
    """Where the next fetch of each ticker begins: ten days before what is cached, or everything if that is short."""
    o = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cached = o.select(F.concat_ws("/", "n_name", "c_mktsegment", "o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("d"))
    return pit.fetch_plan(cached, "1990-01-01").select("ticker", "n", "from_date")


@query("SELECT d, asset AS ticker, CASE WHEN ord % 2 = 0 THEN close + 1 ELSE close END AS close FROM px_daily JOIN assets USING (asset)")
def set_dedupe_columns(t: Tables) -> DataFrame:
    """Two panels side by side: of columns of one ticker the last stays."""
    second = t.px_daily.join(t.assets.where("ord % 2 = 0").select("asset"), "asset").select("d", "asset", (F.col("close") + 1).alias("close"))
    both = t.px_daily.select("d", "asset", "close", F.lit(0).alias("column")).unionByName(second.withColumn("column", F.lit(1)))
    return pit.keep_last(both, ["d", "asset"], "column").select("d", F.col("asset").alias("ticker"), "close")
