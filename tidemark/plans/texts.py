"""Queries over documents, events, alerts and orders, and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import text as tx
from .registry import query, rounded
from .views import Tables

PATTERNS = (("licen[sc]e", "license"), ("@", "address"), (r"\bthe\b", "article"))


@query("""SELECT doc_id, regexp_matches(lower(text), 'licen[sc]e') AS license, regexp_matches(text, '@') AS address,
    round(greatest(0.1, 1 - 0.3 * (regexp_matches(lower(text), 'licen[sc]e')::INTEGER + regexp_matches(text, '@')::INTEGER)), 6)::DOUBLE AS trust FROM documents""")
def flt_injection(t: Tables) -> DataFrame:
    s = tx.injection_scan(t.read("documents"), tx.INJECTIONS + PATTERNS[:2])
    return rounded(s.select("doc_id", F.array_contains("reasons", "license").alias("license"), F.array_contains("reasons", "address").alias("address"), "trust"))


@query("SELECT doc_id, NOT regexp_matches(lower(text), 'licen[sc]e') AS passed FROM documents")
def flt_doc_gate(t: Tables) -> DataFrame:
    return tx.injection_scan(t.read("documents"), tx.INJECTIONS + PATTERNS[:1]).select("doc_id", (~F.col("suspicious")).alias("passed"))


@query("SELECT doc_id, md5('<<<DATA source=' || source || '>>>' || chr(10) || replace(replace(text, '<<<', ''), '>>>', '') || chr(10) || '<<<END>>>') AS wrapped_md5 FROM documents")
def prj_untrusted_wrap(t: Tables) -> DataFrame:
    clean = F.replace(F.replace(F.col("text"), F.lit("<<<"), F.lit("")), F.lit(">>>"), F.lit(""))
    return t.read("documents").select("doc_id", F.md5(F.concat(F.lit("<<<DATA source="), "source", F.lit(">>>\n"), clean, F.lit("\n<<<END>>>"))).alias("wrapped_md5"))


@query("SELECT event_id, entity::VARCHAR || ':' || severity || ':' || regexp_replace(lower(summary), '\\s', '', 'g') AS content_key FROM alerts")
def fn_content_key(t: Tables) -> DataFrame:
    return t.alerts.select("event_id", tx.content_key(F.col("entity"), F.col("severity"), F.col("summary")).alias("content_key"))


@query("SELECT event_id, substr(sha256('events' || chr(31) || event_type || chr(31) || props), 1, 16) AS evidence_id FROM events")
def fn_evidence_id(t: Tables) -> DataFrame:
    return t.read("events").select("event_id", F.substring(F.sha2(F.concat_ws(chr(31), F.lit("events"), "event_type", "props"), 256), 1, 16).alias("evidence_id"))


@query("SELECT DISTINCT 'TW:' || upper(trim(asset)) AS entity_id, asset FROM assets")
def fn_entity_id(t: Tables) -> DataFrame:
    return t.assets.select(F.concat(F.lit("TW:"), F.upper(F.trim("asset"))).alias("entity_id"), "asset").distinct()


@query("SELECT d, asset, CAST(d + CAST((5 - isodow(d) + 7) % 7 AS INTEGER) AS DATE) AS week_end, CAST(date_trunc('month', d) AS DATE) AS month FROM px_daily")
def fn_period_key(t: Tables) -> DataFrame:
    from ..operators.grid import period_key

    return t.px_daily.select("d", "asset", period_key("d", "Weekly").alias("week_end"), period_key("d", "Monthly").alias("month"))


@query("SELECT event_id, CAST(CASE WHEN CAST(ts + INTERVAL 8 HOUR AS TIME) > TIME '13:30:00' THEN CAST(ts + INTERVAL 8 HOUR AS DATE) + 1 ELSE CAST(ts + INTERVAL 8 HOUR AS DATE) END AS DATE) AS trading_day FROM events")
def fn_trading_day(t: Tables) -> DataFrame:
    local = F.col("ts") + F.expr("INTERVAL 8 HOURS")
    after = F.date_format(local, "HH:mm:ss.SSSSSS") > "13:30:00.000000"
    return t.read("events").select("event_id", F.when(after, F.date_add(local.cast("date"), 1)).otherwise(local.cast("date")).alias("trading_day"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) - 1911 AS VARCHAR) || '/' || strftime(o_orderdate, '%m/%d') AS roc, CAST(o_orderdate AS DATE) AS back FROM orders")
def fn_roc_date(t: Tables) -> DataFrame:
    roc = F.concat((F.year("o_orderdate") - 1911).cast("string"), F.lit("/"), F.date_format("o_orderdate", "MM/dd"))
    part = lambda i: F.split_part("roc", F.lit("/"), F.lit(i)).cast("int")
    return t.read("orders").select("o_orderkey", roc.alias("roc")).withColumn("back", F.make_date(part(1) + 1911, part(2), part(3)))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice END AS number FROM orders")
def fn_number(t: Tables) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 7 == 0, "--").otherwise(F.format_number("o_totalprice", 2))
    clean = F.regexp_replace("raw", ",", "")
    return t.read("orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", F.when(clean.isin("", "--", "---", "N/A"), 0.0).otherwise(F.try_to_number(clean, F.lit("999999999999.99")).cast("double")).alias("number"))


@query("SELECT event_id, row_number() OVER (PARTITION BY idempotency_key ORDER BY ts, event_id) > 1 AS duplicate FROM order_stream")
def set_idempotent(t: Tables) -> DataFrame:
    return tx.order_checks(t.order_stream).select("event_id", "duplicate")


@query("SELECT event_id, count(*) OVER (PARTITION BY entity ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) >= 3 AS halted FROM order_stream")
def win_order_rate(t: Tables) -> DataFrame:
    return tx.order_checks(t.order_stream, limit=3).select("event_id", "halted")


@query("SELECT event_id, abs(price / nullif(ref_price, 0) - 1) > 0.05 AS far FROM order_stream")
def fn_price_deviation(t: Tables) -> DataFrame:
    return tx.order_checks(t.order_stream).select("event_id", "far")


@query("""SELECT entity, count(*) AS n, max(gap) AS longest, count(*) FILTER (gap > 300000000) AS lapses, CASE WHEN (SELECT max(epoch_us(created_at)) FROM alerts) - max(us) > 300000000 THEN 'CLOSE_ONLY' ELSE 'NORMAL' END AS mode
    FROM (SELECT entity, epoch_us(created_at) AS us, CAST(epoch_us(lead(created_at) OVER (PARTITION BY entity ORDER BY created_at)) - epoch_us(created_at) AS BIGINT) AS gap FROM alerts) GROUP BY entity""")
def agg_heartbeat(t: Tables) -> DataFrame:
    """Each entity's lapses, and what it may do at the time of the last row of all."""
    us = F.unix_micros(F.col("created_at").cast("timestamp"))
    gaps = t.alerts.withColumn("at", us).withColumn("gap", F.lead(us).over(Window.partitionBy("entity").orderBy("created_at")) - us)
    now = F.broadcast(t.alerts.agg(F.max(us).alias("now")))  # one number
    by = gaps.groupBy("entity").agg(F.count("*").alias("n"), F.max("gap").alias("longest"), F.count_if(F.col("gap") > 300_000_000).alias("lapses"), F.max("at").alias("last"))
    return by.crossJoin(now).select("entity", "n", "longest", "lapses", F.when(F.col("now") - F.col("last") > 300_000_000, "CLOSE_ONLY").otherwise("NORMAL").alias("mode"))


@query("SELECT entity, CAST(created_at AS DATE) AS d, severity, count(*) AS n FROM alerts GROUP BY ALL")
def agg_paper_daily(t: Tables) -> DataFrame:
    return t.alerts.groupBy("entity", F.to_date("created_at").alias("d"), "severity").agg(F.count("*").alias("n"))


@query("SELECT week, sum(n) AS total, round(avg((severity = 'P2')::INTEGER), 6) AS noise FROM (SELECT CAST(date_trunc('week', created_at) AS DATE) AS week, severity, 1 AS n FROM alerts) GROUP BY week".replace("sum(n)", "CAST(sum(n) AS BIGINT)"))
def agg_paper_weekly(t: Tables) -> DataFrame:
    return rounded(t.alerts.groupBy(F.date_trunc("week", "created_at").cast("date").alias("week")).agg(F.count("*").alias("total"), F.avg((F.col("severity") == "P2").cast("int")).alias("noise")))


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS calls FROM events")
def agg_agent_calls(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return t.read("events").select("event_id", "user_id", F.count("*").over(w).alias("calls"))


@query("SELECT asset, d, open, high, low, close FROM px_daily WHERE asset <> 'NATION_4' OR day(d) <> 9")
def src_price_payload(t: Tables) -> DataFrame:
    """Arrays of a chart payload, with nulls, back to bars."""
    from ..sources.payloads import parse_chart

    gap = (F.col("asset") == "NATION_4") & (F.dayofmonth("d") == 9)
    bar = F.struct(F.unix_seconds(F.col("d").cast("timestamp")).alias("ts"), *[F.when(gap, None).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low", "close")], F.col("volume"))
    rows = t.px_daily.groupBy(F.col("asset").alias("ticker")).agg(F.sort_array(F.collect_list(bar)).alias("b"))
    quote = F.struct(*[F.col(f"b.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")])
    payload = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("b.ts").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))).alias("result")).alias("chart")), {"ignoreNullFields": "false"})
    return parse_chart(rows.select("ticker", payload.alias("payload"))).select(F.col("ticker").alias("asset"), "d", "open", "high", "low", "close")
