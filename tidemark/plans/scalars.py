"""Queries of scalar functions that the other modules don't have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import ledger
from ..operators.entities import normalized, ratios
from .registry import query, rounded
from .views import Tables


@query("""SELECT o_orderkey, list_sort(list_transform(list_filter(string_split_regex(trim(raw), '[\\s,;]+'), lambda x: regexp_full_match(x, '[A-Za-z0-9.^=-]+')), lambda x: upper(x)))::VARCHAR AS tickers
    FROM (SELECT o_orderkey, ' ' || o_orderpriority || ',, ' || lower(o_orderstatus) || ';b@d  ^x' || CAST(o_orderkey % 7 AS VARCHAR) AS raw FROM orders)""".replace("list_sort(", "array_to_string(list_sort(").replace(")::VARCHAR", "), ' ')"))
def fn_ticker_split(t: Tables) -> DataFrame:
    raw = F.concat(F.lit(" "), "o_orderpriority", F.lit(",, "), F.lower("o_orderstatus"), F.lit(";b@d  ^x"), (F.col("o_orderkey") % 7).cast("string"))
    return t.read("orders").select("o_orderkey", F.array_join(F.sort_array(fn.ticker_list(raw)), " ").alias("tickers"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 AND length(CAST(o_orderkey + 1000 AS VARCHAR)) <= 6 THEN CAST(o_orderkey + 1000 AS VARCHAR) END AS code FROM orders""")
def fn_ticker_pattern(t: Tables) -> DataFrame:
    n, k = (F.col("o_orderkey") + 1000).cast("string"), F.col("o_orderkey") % 4
    text = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(".tw"))).when(k == 2, F.concat(n, F.lit(".TWO"))).otherwise(F.concat(n, F.lit(".US")))
    return t.read("orders").select("o_orderkey", fn.ticker_code(text).alias("code"))


@query("SELECT ticker, trim(ticker) || CASE market WHEN 'listed' THEN '.TW' ELSE '.TWO' END AS symbol FROM security_master")
def fn_yahoo_suffix(t: Tables) -> DataFrame:
    return t.security_master.select("ticker", fn.with_suffix(F.col("ticker"), F.col("market") == "listed").alias("symbol"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS x FROM orders")
def fn_coerce(t: Tables) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.col("o_totalprice").cast("string"), F.lit(" TWD"))).otherwise(F.col("o_totalprice").cast("string"))
    return t.read("orders").select("o_orderkey", raw.try_cast("double").alias("x"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN NULL ELSE round(o_totalprice, 2) END::DOUBLE AS number FROM orders""")
def fn_number_rejects(t: Tables) -> DataFrame:
    """Signs for no number are 0; what can't be read is refused."""
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, " -- ").when(k == 1, "12x").otherwise(F.format_number("o_totalprice", 2))
    return t.read("orders").select("o_orderkey", fn.number(raw).cast("double").alias("number"))


@query("""SELECT o_orderkey, 48.5::DOUBLE AS round_trip_bps, round(10000 * (2 * o_totalprice * 0.001425 + o_totalprice * 0.003 + 2 * o_totalprice * 0.0005) / o_totalprice, 6) AS paid_bps FROM orders WHERE o_totalprice > 0""".replace("48.5", "68.5"))
def fn_round_trip(t: Tables) -> DataFrame:
    """Basis points of a round trip, and those of buying and selling each order's value in a market too deep to move."""
    n = F.col("o_totalprice")
    side = lambda sells: ledger.trade_cost(n, F.lit(sells), F.lit(1e30))
    rows = t.read("orders").where(n > 0)
    return rounded(rows.select("o_orderkey", F.lit(fn.round_trip_bps()).alias("round_trip_bps"), F.round(10_000 * (side(False) + side(True)) / n, 6).alias("paid_bps")))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(date_trunc('second', ts) - INTERVAL 8 HOUR) WHEN 1 THEN epoch_us(date_trunc('second', ts)) END AS utc_us, strftime(CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) + INTERVAL 8 HOUR END, '%Y-%m-%d %H:%M:%S') AS shown FROM events""")
def fn_utc(t: Tables) -> DataFrame:
    """Times with an offset become UTC and are shown in Taipei; those without one are refused."""
    k, text = F.col("event_id") % 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(k == 0, F.concat(text, F.lit("+08:00"))).when(k == 1, F.concat(text, F.lit("Z"))).otherwise(text)
    at = fn.utc(raw)
    return t.read("events").select("event_id", F.unix_micros(at).alias("utc_us"), F.date_format(F.from_utc_timestamp(at, "Asia/Taipei"), "yyyy-MM-dd HH:mm:ss").alias("shown"))


@query("SELECT event_id, CAST(CASE WHEN CAST(ts - INTERVAL 5 HOUR AS TIME) > TIME '16:00:00' THEN CAST(ts - INTERVAL 5 HOUR AS DATE) + 1 ELSE CAST(ts - INTERVAL 5 HOUR AS DATE) END AS DATE) AS trading_day FROM events")
def fn_trading_day_us(t: Tables) -> DataFrame:
    """The day of a market that closes at 16:00 in New York; the events are of a winter."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")
    after = F.date_format(local, "HH:mm:ss.SSSSSS") > "16:00:00.000000"
    return t.read("events").select("event_id", F.when(after, F.date_add(local.cast("date"), 1)).otherwise(local.cast("date")).alias("trading_day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS d FROM orders")
def fn_roc_date_shapes(t: Tables) -> DataFrame:
    """With slashes, as seven digits, and in a shape that is refused."""
    k, year = F.col("o_orderkey") % 3, F.lpad((F.year("o_orderdate") - 1911).cast("string"), 3, "0")
    text = F.when(k == 0, F.concat(year, F.date_format("o_orderdate", "/MM/dd"))).when(k == 1, F.concat(year, F.date_format("o_orderdate", "MMdd"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.read("orders").select("o_orderkey", fn.roc_date(text).alias("d"))


@query("SELECT conv_id, turn, substr(sha256(coalesce(role, '') || chr(31) || coalesce(text, '')), 1, 16) AS fingerprint FROM conversations")
def fn_prompt_hash(t: Tables) -> DataFrame:
    return t.read("conversations").select("conv_id", "turn", fn.digest(16, F.col("role"), F.col("text")).alias("fingerprint"))


@query("SELECT event_id, substr(sha256('TW:' || user_id || chr(31) || event_type || '@1' || chr(31) || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'), 1, 16) AS signal_id FROM events")
def fn_signal_id(t: Tables) -> DataFrame:
    """Entity, model version and time name a signal."""
    parts = F.concat(F.lit("TW:"), F.col("user_id").cast("string")), F.concat("event_type", F.lit("@1")), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return t.read("events").select("event_id", fn.digest(16, *parts).alias("signal_id"))


#: What an answer may hold here; the kinds are those of the events but one.
FORM = fn.Answer(
    "entity_symbol string, event_type string, confidence double, reasoning_digest string, findings array<string>",
    sets={"event_type": ("signup", "click", "view", "purchase")}, ranges={"confidence": (0.0, 1.0)}, lengths={"entity_symbol": (1, 20), "reasoning_digest": (0, 200)}, sizes={"findings": 8},
)


@query("""SELECT event_id, reason IS NULL AS valid, reason FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'json' WHEN event_id % 5 = 0 THEN 'missing' WHEN event_type = 'error' THEN 'enum' WHEN value > 100 THEN 'range' WHEN event_id % 13 = 0 THEN 'length' WHEN event_id % 17 = 0 THEN 'size' END AS reason FROM events)""")
def fn_agent_json(t: Tables) -> DataFrame:
    """Answers of models: cut off, fenced, without a field, out of a set, a range, a length or a size, and good ones."""
    i, eight = F.col("event_id"), F.array(*[F.lit(str(k)) for k in range(8)])
    data = F.to_json(F.struct(
        F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("entity_symbol"), "event_type", F.when(i % 5 != 0, F.col("value") / 100).alias("confidence"),
        F.when(i % 13 == 0, F.repeat(F.lit("x"), 201)).otherwise("fine").alias("reasoning_digest"), F.when(i % 17 == 0, F.slice(eight, 1, 7)).otherwise(eight).alias("findings"),
    ))
    text = F.when(i % 7 == 0, F.substring(data, 1, 25)).when(i % 3 == 0, F.concat(F.lit("```json\n"), data, F.lit("\n```"))).otherwise(data)
    return t.read("events").select("event_id", fn.answer(text, FORM).alias("a")).select("event_id", F.col("a.payload").isNotNull().alias("valid"), "a.reason")


@query("SELECT entity, coalesce(array_to_string(list_sort(list(name) FILTER (name IN ('view', 'error'))), ' '), '') AS missing FROM signals GROUP BY entity")
def fn_versions_check(t: Tables) -> DataFrame:
    """Features of an entity whose version isn't given."""
    values = F.map_from_entries(F.collect_list(F.struct("name", "score")))
    versions = F.map_from_entries(F.collect_list(F.when(~F.col("name").isin("view", "error"), F.struct("name", F.lit("1").alias("v")))))
    by = t.signals.groupBy("entity").agg(values.alias("values"), versions.alias("versions"))  # an entity's features
    return by.select("entity", F.array_join(F.sort_array(fn.unversioned(F.col("values"), F.col("versions"))), " ").alias("missing"))


@query("SELECT user_id, count(*) FILTER (event_id % 5 < 2) AS n_blocking, count(*) FILTER (event_id % 5 < 2) > 0 AS blocks FROM events GROUP BY user_id")
def fn_blocking_findings(t: Tables) -> DataFrame:
    severity = F.element_at(F.array(*map(F.lit, ("CRITICAL", "HIGH", "MEDIUM", "LOW", "NOT_APPLICABLE"))), (F.col("event_id") % 5 + 1).cast("int"))
    reports = t.read("events").groupBy("user_id").agg(F.collect_list(F.struct(severity.alias("severity"), F.col("props").alias("detail"))).alias("findings"))  # a report
    return reports.select("user_id", F.size(fn.blocking(F.col("findings"))).cast("long").alias("n_blocking"), (F.size(fn.blocking(F.col("findings"))) > 0).alias("blocks"))


@query("SELECT s_suppkey, upper(replace(replace(s_name, '#', '#'), ' ', '')) AS norm FROM supplier")
def fn_normalize_name(t: Tables) -> DataFrame:
    """Names in full-width letters, with endings and punctuation, come out plain."""
    ascii_, full = "".join(map(chr, range(0x21, 0x7F))), "".join(map(chr, range(0xFF01, 0xFF5F)))
    dressed = F.concat(F.lit("　"), F.translate("s_name", ascii_, full), F.lit("（股份有限公司） - 集團 "))
    return t.read("supplier").select("s_suppkey", normalized(dressed).alias("norm"))


@query("""SELECT p_partkey, round(CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 * (length(p_name) - 1) / (2 * length(p_name) - 1) WHEN 2 THEN 2.0 * length(p_name) / (2 * length(p_name) + 3) ELSE 0.0 END, 6)::DOUBLE AS ratio FROM part""")
def fn_similarity(t: Tables) -> DataFrame:
    """Each part's name against itself, itself without its last letter, itself after three signs of its own, and nothing."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    other = F.when(k == 0, name).when(k == 1, F.expr("left(p_name, length(p_name) - 1)")).when(k == 2, F.concat(F.lit("#?!"), name)).otherwise("")
    return rounded(t.read("part").select("p_partkey", ratios(name, other).alias("ratio")))
