"""Price panels, exchange feeds, masters, holdings and headlines to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import dividend_factor, entity_of_ticker, number, roc_date

#: Least width, and places (from 0) of foreign, trust, dealer and total, in a row of each exchange's feed.
LISTED = (19, (4, 10, 11, 18))
OTC = (24, (4, 13, 22, 23))
#: Markets, asset types, and the industry of a code that the table of industries lacks.
MARKETS = ("上市", "上櫃")
STOCK, FUND = "股票", "ETF"
NO_INDUSTRY = "其他／未分類"
#: Classes of funds, each with the words that show it, in order; without any, the last.
FUND_CLASSES = (
    ("債券 ETF", ("債",)),
    ("商品／期貨 ETF", ("原油", "黃金", "白銀", "期貨", "商品")),
    ("槓桿／反向 ETF", ("槓桿", "反向", "正2", "正二", "反1", "反一")),
    ("主動式 ETF", ("主動",)),
    ("海外股票 ETF", ("國外", "海外", "美國", "日本", "中國", "印度")),
)
OTHER_FUND = "台灣股票 ETF"


def read_wide(spark: SparkSession, path: str, date: str = "d") -> DataFrame:
    """A wide panel, a column for each ticker -> d, ticker, close, without missing prices."""
    wide = spark.read.parquet(path)
    tickers = [F.col(f"`{c}`") for c in wide.columns if c != date]
    return wide.withColumnRenamed(date, "d").unpivot("d", tickers, "ticker", "close").where("close is not null and not isnan(close)")


def read_legacy(spark: SparkSession, path: str, date: str = "d", entities: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """A wide panel of exchange tickers -> entity_id, trade_date, close (six decimals), volume 0 and ingest_time, that of the file.
    Other tickers, and prices that aren't above 0, are left out."""
    wide = spark.read.parquet(path)
    tickers = [F.col(f"`{c}`") for c in wide.columns if c != date]
    long = wide.select(F.col(date).alias("d"), F.col("_metadata.file_modification_time").alias("ingest_time"), *tickers).unpivot(["d", "ingest_time"], tickers, "ticker", "close")
    rows = long.select(entity_of_ticker(F.col("ticker")).alias("entity_id"), F.col("d").alias("trade_date"), F.col("close").cast("decimal(18,6)").alias("close"), F.lit(0).cast("long").alias("volume"), "ingest_time")
    rows = rows.where("entity_id is not null and close > 0")
    if entities is not None:
        rows = rows.where(F.col("entity_id").isin(entities))
    for bound, keep in ((start, F.col("trade_date") >= F.lit(start)), (end, F.col("trade_date") <= F.lit(end))):
        rows = rows.where(keep) if bound else rows
    return rows


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """The master's CSV, all strings -> entity_id and trimmed names; nulls are blank, tickers of no exchange are left out."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    text = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    new = {"local_symbol": "Code", "name": "Name", "full_name": "Full name", "industry": "Industry", "market_board": "Market", "asset_type": "Asset type"}
    return raw.select(entity_of_ticker(F.col("`Yahoo ticker`")).alias("entity_id"), *[text(c).alias(k) for k, c in new.items()]).where("entity_id is not null")


def _flow_rows(rows: DataFrame, suffix: str, form: tuple) -> DataFrame:
    width, places = form
    at = lambda i: F.get("row", F.lit(i))
    nets = [number(at(i)).alias(n) for n, i in zip(("foreign_net", "trust_net", "dealer_net", "total_net"), places, strict=True)]
    return rows.where(F.size("row") >= width).select("d", F.concat(F.trim(at(0)), F.lit(suffix)).alias("ticker"), F.trim(at(1)).alias("name"), *nets)


def listed_flows(payloads: DataFrame) -> DataFrame:
    """payloads(d, payload) of the first exchange -> d, ticker, name and the four nets; other states than OK, and short rows, give nothing."""
    doc = F.from_json("payload", "stat string, data array<array<string>>")
    return _flow_rows(payloads.select("d", doc.alias("p")).where("p.stat = 'OK'").select("d", F.explode("p.data").alias("row")), ".TW", LISTED)


def otc_flows(payloads: DataFrame) -> DataFrame:
    """The same of the second exchange, whose rows stand in the first table that has any."""
    doc = F.from_json("payload", "stat string, tables array<struct<data:array<array<string>>>>")
    first = F.get(F.filter("p.tables", lambda t: F.size(t["data"]) > 0), F.lit(0))
    return _flow_rows(payloads.select("d", doc.alias("p")).where("p.stat = 'ok'").select("d", F.explode(first["data"]).alias("row")), ".TWO", OTC)


def dividends(payloads: DataFrame) -> DataFrame:
    """payloads(payload), arrays of events -> ex_date, symbol, name, prior_close, reference_price, cash, stock and factor; events without
    a date, a code or positive prices are left out."""
    fields = "Date string, Code string, Name string, PreviousClosingPrice string, ExRightsExDividendReferencePrice string, CashDividend string, StockDividend string"
    e = payloads.select(F.explode(F.from_json("payload", f"array<struct<{fields.replace(' string', ':string')}>>")).alias("e")).where("e is not null").select("e.*")
    prior, reference = number(F.col("PreviousClosingPrice")), number(F.col("ExRightsExDividendReferencePrice"))
    kept = e.where((F.trim("Date") != "") & (F.trim("Code") != "") & (prior > 0) & (reference > 0))
    return kept.select(
        roc_date(F.col("Date")).alias("ex_date"), F.trim("Code").alias("symbol"), F.trim("Name").alias("name"), prior.alias("prior_close"), reference.alias("reference_price"),
        number(F.col("CashDividend")).alias("cash"), number(F.col("StockDividend")).alias("stock"), dividend_factor(reference.cast("double"), prior.cast("double")).alias("factor"),
    ).where("ex_date is not null")


def fund_class(name: Column, fund_type: Column) -> Column:
    """The class of a fund: the first of FUND_CLASSES whose words its name or type holds."""
    text, out = F.concat_ws(" ", name, fund_type), None
    for label, words in FUND_CLASSES:
        hit = F.rlike(text, F.lit("|".join(words)))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(OTHER_FUND)


def _zero_filled(text: Column, width: int) -> Column:
    """Zeros before a shorter text; a longer one stays."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def _first_of(rows: DataFrame) -> DataFrame:
    """The first row of each ticker by feed and place."""
    one = F.min_by(F.struct(*[c for c in rows.columns if c not in ("ticker", "seq")]), "seq")
    return rows.groupBy("ticker").agg(one.alias("r")).select("ticker", "r.*")


def companies(listed: DataFrame, otc: DataFrame, industries: DataFrame) -> DataFrame:
    """Two feeds of companies (payload: an array of records each; seq: their order) -> the master's rows; industries(code, industry) is a lookup."""
    first = "公司代號 string, 公司簡稱 string, 公司名稱 string, 產業別 string, 已發行普通股數或TDR原股發行股數 string"
    second = "SecuritiesCompanyCode string, CompanyAbbreviation string, CompanyName string, SecuritiesIndustryCode string, IssueShares string"

    def rows(feed: DataFrame, fields: str, market: str, suffix: str, order: int) -> DataFrame:
        names = [f.split()[0] for f in fields.split(", ")]
        kinds = ", ".join(f"`{n}`: string" for n in names)
        e = feed.select("seq", F.posexplode(F.from_json("payload", f"array<struct<{kinds}>>")).alias("i", "e"))
        get = lambda k: F.trim(F.col(f"e.`{names[k]}`"))
        return e.select(F.struct(F.lit(order).alias("o"), "seq", "i").alias("seq"), F.concat(get(0), F.lit(suffix)).alias("ticker"), get(0).alias("code"), get(1).alias("name"), get(2).alias("full_name"), _zero_filled(get(3), 2).alias("industry_code"), get(4).try_cast("double").alias("issued_shares"), F.lit(market).alias("market"))

    both = _first_of(rows(listed, first, MARKETS[0], ".TW", 0).unionByName(rows(otc, second, MARKETS[1], ".TWO", 1)))
    named = both.join(industries.select(F.col("code").alias("industry_code"), "industry"), "industry_code", "left")
    return named.withColumn("industry", F.coalesce("industry", F.lit(NO_INDUSTRY))).withColumn("asset_type", F.lit(STOCK)).withColumn("fund_type", F.lit(""))


def funds(listed: DataFrame, quoted: DataFrame, otc: DataFrame) -> DataFrame:
    """Funds of the first exchange that are quoted now, and those quotes of the second whose codes begin with 00; feeds as in companies()."""
    names = ("基金代號", "基金簡稱", "基金中文名稱", "基金類型", "發行單位數/轉換數")
    e = listed.select("seq", F.posexplode(F.from_json("payload", f"array<struct<{', '.join(f'`{n}`: string' for n in names)}>>")).alias("i", "e"))
    get = lambda k: F.trim(F.col(f"e.`{names[k]}`"))
    first = e.select(F.struct(F.lit(0).alias("o"), "seq", "i").alias("seq"), F.concat(get(0), F.lit(".TW")).alias("ticker"), get(0).alias("code"), get(1).alias("name"), get(2).alias("full_name"), get(3).alias("fund_type"), get(4).try_cast("double").alias("issued_shares"), F.lit(MARKETS[0]).alias("market"))
    codes = quoted.select(F.explode(F.from_json("payload", "array<struct<Code: string>>")).alias("e")).select(F.trim("e.Code").alias("code")).distinct()
    first = first.join(codes, "code", "left_semi")
    e = otc.select("seq", F.posexplode(F.from_json("payload", "array<struct<SecuritiesCompanyCode: string, CompanyName: string, Capitals: string>>")).alias("i", "e"))
    code, name = F.trim("e.SecuritiesCompanyCode"), F.trim("e.CompanyName")
    second = e.where(F.startswith(code, F.lit("00"))).select(F.struct(F.lit(1).alias("o"), "seq", "i").alias("seq"), F.concat(code, F.lit(".TWO")).alias("ticker"), code.alias("code"), name.alias("name"), name.alias("full_name"), F.lit("").alias("fund_type"), F.trim("e.Capitals").try_cast("double").alias("issued_shares"), F.lit(MARKETS[1]).alias("market"))
    both = _first_of(first.unionByName(second))
    return both.withColumn("industry_code", F.lit(FUND)).withColumn("industry", fund_class(F.col("name"), F.col("fund_type"))).withColumn("asset_type", F.lit(FUND))


def top_holdings(feed: DataFrame) -> DataFrame:
    """feed(etf, holding_ticker, holding_name, weight as text) -> upper-cased tickers and numeric weights; rows that lack either go, one stays of each."""
    rows = feed.select("etf", F.upper("holding_ticker").alias("holding_ticker"), "holding_name", F.col("weight").try_cast("double").alias("weight")).dropna(subset=["holding_ticker", "weight"])
    return rows.groupBy("etf", "holding_ticker").agg(F.min("holding_name").alias("holding_name"), F.max("weight").alias("weight"))


def headlines(payloads: DataFrame) -> DataFrame:
    """payloads(ticker, payload), arrays of items -> ticker, title, summary, publisher, published and url. An item's fields stand in its
    `content` or in itself; publisher and address are objects or plain strings; what is missing is blank."""
    items = payloads.select("ticker", F.explode(F.from_json("payload", "array<string>")).alias("item"))
    c = items.select("ticker", F.coalesce(F.get_json_object("item", "$.content"), "item").alias("c"))
    text = lambda path: F.coalesce(F.get_json_object("c", path), F.lit(""))
    either = lambda name, inner: F.when(F.startswith(text(f"$.{name}"), F.lit("{")), text(f"$.{name}.{inner}")).otherwise(text(f"$.{name}"))
    return c.select("ticker", text("$.title").alias("title"), text("$.summary").alias("summary"), either("provider", "displayName").alias("publisher"), text("$.pubDate").alias("published"), either("canonicalUrl", "url").alias("url"))
