"""Queries of names, universes, contracts, cards, hashes, reconciliation, health of signals, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import contracts as co
from ..operators import entities as en
from ..operators import features as fe
from ..operators import grid as g
from ..operators import rotation as ro
from ..operators import universe as un
from ..sources import landing, reviews
from .registry import query, rounded
from .research import EWMA, MRET, OWN, TREND, daily, daily_returns, month_returns
from .rotation import HOW, SCORED, scores
from .views import Tables


def part_aliases(t: Tables) -> DataFrame:
    return en.alias_table(t.read("part").select(F.concat(F.lit(" "), F.initcap("p_name"), F.lit(".")).alias("alias"), F.col("p_partkey").alias("entity_id"), F.col("p_partkey").alias("seq")))


@query("SELECT upper(replace(p_name, ' ', '')) AS key, max(p_partkey) AS entity_id FROM part GROUP BY 1")
def sink_alias_table(t: Tables) -> DataFrame:
    """Every part registers its name; the last registration of a name wins."""
    return part_aliases(t).select("key", "entity_id")


def supplier_queries(t: Tables) -> DataFrame:
    k, code = F.col("s_suppkey") % 5, (F.col("s_suppkey") + 1000).cast("string")
    text = F.when(k == 0, F.concat(code, F.lit(".TW"))).when(k == 1, F.concat(F.lit(" "), code, F.lit(" "))).when(k == 2, F.concat(F.lower("s_name"), F.lit("公司"))).when(k == 3, F.concat(F.lit("unknown "), code)).otherwise(F.lit("  "))
    return t.read("supplier").select("s_suppkey", text.alias("query"))


@query("""SELECT trim(CASE s_suppkey % 5 WHEN 0 THEN CAST(s_suppkey + 1000 AS VARCHAR) || '.TW' WHEN 1 THEN CAST(s_suppkey + 1000 AS VARCHAR) WHEN 2 THEN lower(s_name) || '公司' WHEN 3 THEN 'unknown ' || CAST(s_suppkey + 1000 AS VARCHAR) ELSE '' END) AS query,
    CASE WHEN s_suppkey % 5 < 3 THEN s_suppkey END AS entity_id, CASE WHEN s_suppkey % 5 < 2 THEN 'EXACT_CODE' WHEN s_suppkey % 5 = 2 THEN 'EXACT_ALIAS' ELSE 'UNRESOLVED' END AS method FROM supplier""")
def jn_alias_exact(t: Tables) -> DataFrame:
    """Codes with and without a market, names in another dress, and what is neither."""
    s = t.read("supplier")
    codes = s.select((F.col("s_suppkey") + 1000).cast("string").alias("code"), F.col("s_suppkey").alias("entity_id"))
    aliases = en.alias_table(s.select(F.col("s_name").alias("alias"), F.col("s_suppkey").alias("entity_id"), F.col("s_suppkey").alias("seq")))
    return en.exact(supplier_queries(t), codes, aliases).select("query", "entity_id", "method")


def part_queries(t: Tables) -> DataFrame:
    """Each part's name whole, without its last letter, with two letters swapped, and next to nothing of it."""
    k = F.col("p_partkey") % 4
    swapped = F.expr("concat(substring(p_name, 2, 1), substring(p_name, 1, 1), substring(p_name, 3))")
    return t.read("part").select(F.when(k == 0, F.upper("p_name")).when(k == 1, F.expr("left(p_name, length(p_name) - 1)")).when(k == 2, swapped).otherwise(F.expr("concat(left(p_name, 2), 'zzzz')")).alias("query"))


@query()
def jn_alias_fuzzy(t: Tables) -> DataFrame:
    """What each name is like among the aliases; tests hold it against all pairs."""
    names = part_queries(t).select(en.normalized(F.col("query")).alias("norm")).distinct()
    return rounded(en.fuzzy(names, part_aliases(t)).drop("candidates"))


@query()
def pipe_entity_resolution(t: Tables) -> DataFrame:
    """Codes, then aliases, then similar aliases; what is in doubt is put on the review queue, by two runs over the same queries, and once there:
    n_items counts the query's items. Tests hold it against a query at a time."""
    codes = t.read("part").select((F.col("p_partkey") + 100_000).cast("string").alias("code"), F.col("p_partkey").alias("entity_id"))
    own = t.read("part").where("p_partkey % 3 = 0").select((F.col("p_partkey") + 100_000).cast("string").alias("query"))
    queue, aliases = landing.folder(t.spark, "reviews"), landing.written(part_aliases(t), "aliases")
    found = landing.written(en.resolve(part_queries(t).unionByName(own).distinct(), codes, aliases), "resolved")
    for at in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        reviews.queue(found, queue, "part", at)
    items = reviews.waiting(t.spark, queue).groupBy("query").agg(F.count("*").alias("n_items"))
    return rounded(found.drop("candidates").join(items, "query", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0))))


def named_master(t: Tables) -> DataFrame:
    return t.security_master.withColumn("name", F.concat(F.lit("N "), "ticker"))


@query("SELECT ticker, 'N ' || ticker || ' (' || market || '／' || asset_type || ')' AS name, industry AS grp FROM security_master WHERE market = 'listed' AND asset_type = 'stock' AND industry IN (SELECT r_name FROM region WHERE r_regionkey IN (0, 2, 3))")
def flt_universe(t: Tables) -> DataFrame:
    wanted = [r[0] for r in t.read("region").where("r_regionkey in (0, 2, 3)").select("r_name").collect()]  # what a user would name
    return un.from_master(named_master(t), ["listed"], ["stock"], wanted)


@query("SELECT ticker, 'N ' || ticker || ' (' || market || ')' AS name, industry AS grp, row_number() OVER (PARTITION BY industry ORDER BY issued_shares DESC, ticker) AS place FROM security_master WHERE industry IN (SELECT r_name FROM region WHERE r_regionkey < 3) QUALIFY place <= 3")
def flt_industries(t: Tables) -> DataFrame:
    wanted = [r[0] for r in t.read("region").where("r_regionkey < 3").select("r_name").collect()]
    return un.from_industries(named_master(t), wanted, 3).withColumn("place", F.col("place").cast("long"))


@query("""SELECT CAST(p_partkey AS VARCHAR) || '.TW' AS ticker, p_name || ' (listed)' AS name, theme AS grp FROM (
    SELECT p_partkey, p_name, theme, row_number() OVER (PARTITION BY p_partkey ORDER BY grp_ord) AS r FROM part JOIN (SELECT * FROM (VALUES ('ECONOMY', 0), ('small', 1), ('red', 2)) v(theme, grp_ord)) c ON p_type = theme OR p_name LIKE theme || ' %') WHERE r = 1""")
def flt_themes(t: Tables) -> DataFrame:
    """Parts by kind and by words of their names; one that belongs to several themes stays in the first."""
    p = t.read("part")
    by = lambda theme, order, condition: p.where(condition).select(F.lit(theme).alias("theme"), F.lit(order).alias("grp_ord"), F.col("p_partkey").cast("string").alias("code"), F.col("p_partkey").alias("tick_ord"))
    catalogue = by("ECONOMY", 0, F.col("p_type") == "ECONOMY").unionByName(by("small", 1, F.col("p_name").startswith("small "))).unionByName(by("red", 2, F.col("p_name").startswith("red "))).unionByName(by("blue", 3, F.col("p_name").startswith("blue ")))
    code = F.col("p_partkey").cast("string")
    master = p.select(code.alias("code"), F.concat(code, F.lit(".TW")).alias("ticker"), F.col("p_name").alias("name"), F.lit("listed").alias("market"))
    return un.from_themes(catalogue, master, ["ECONOMY", "small", "red"])


@query("""SELECT asset || ' ' || CAST(d AS VARCHAR) AS key, unnest(list_filter([CASE WHEN high < low THEN 'high_below_low' END, CASE WHEN open < low OR open > high THEN 'open_outside' END, CASE WHEN close < low OR close > high THEN 'close_outside' END, CASE WHEN volume < 0 THEN 'negative_volume' END], lambda x: x IS NOT NULL)) AS rule FROM bad_bars
    UNION ALL SELECT CAST(event_id AS VARCHAR), 'taken_in_early' FROM events WHERE event_id % 10 = 0
    UNION ALL SELECT CAST(entity_id AS VARCHAR), 'ends_before_it_begins' FROM spans WHERE CASE WHEN entity_id % 9 = 0 THEN valid_from - 1 ELSE valid_to END < valid_from
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), unnest(CASE o_orderkey % 6 WHEN 0 THEN ['factor'] WHEN 1 THEN ['confidence_range'] WHEN 2 THEN ['official'] ELSE [] END) FROM orders""")
def flt_temporal(t: Tables) -> DataFrame:
    """Violations of bars, times, spans and corporate actions, a row each."""
    bars = co.violations(t.bad_bars, F.concat_ws(" ", "asset", F.col("d").cast("string")), co.bar_rules())
    early = F.when(F.col("event_id") % 10 == 0, F.expr("ts - INTERVAL 6 SECONDS")).otherwise(F.expr("ts - INTERVAL 5 SECONDS"))
    times = co.violations(t.read("events").withColumn("taken_in", early), F.col("event_id"), {"taken_in_early": co.taken_in_early(F.col("ts"), F.col("taken_in"))})
    spans = co.violations(t.spans.withColumn("valid_to", F.when(F.col("entity_id") % 9 == 0, F.date_sub("valid_from", 1)).otherwise(F.col("valid_to"))), F.col("entity_id"), co.span_rules())
    k = F.col("o_orderkey") % 6
    actions = t.read("orders").select("o_orderkey", F.when(k == 0, 0.0).otherwise(0.9).alias("factor"), F.when(k == 1, 1.5).when(k == 2, 1.0).otherwise(0.5).alias("confidence"), F.lit("INFERRED").alias("source"))
    return bars.unionByName(times).unionByName(spans).unionByName(co.violations(actions, F.col("o_orderkey"), co.action_rules()))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS key, 'rejected_without_limit' AS rule FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'
    UNION ALL SELECT CAST(event_id AS VARCHAR), CASE WHEN event_id % 4 = 0 THEN 'abstains_with_payload' ELSE 'answers_without_payload' END FROM events WHERE (event_id % 4 = 0) = (event_id % 3 <> 0)
    UNION ALL SELECT CAST(event_id AS VARCHAR), 'no_action' FROM alerts WHERE event_id % 9 = 0
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'parts_do_not_sum' FROM orders WHERE o_orderkey % 17 = 0
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'train_and_test' FROM orders WHERE o_orderkey % 50 = 0
    UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'disable_not_above_warn' FROM nation WHERE n_nationkey >= 10""")
def flt_contracts(t: Tables) -> DataFrame:
    """Violations of verdicts, answers, alerts, attributions, splits and thresholds, a row each."""
    o, e = t.read("orders"), t.read("events")
    verdicts = co.violations(o.withColumn("approved", F.col("o_orderstatus") != "F").withColumn("breached", F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("POSITION"))).otherwise(F.array().cast("array<string>"))), F.col("o_orderkey"), co.verdict_rules())
    answers = co.violations(e.withColumn("abstain", F.col("event_id") % 4 == 0).withColumn("payload", F.when(F.col("event_id") % 3 != 0, F.col("props"))), F.col("event_id"), co.answer_rules())
    alerts = co.violations(t.alerts.withColumn("action", F.when(F.col("event_id") % 9 == 0, "  ").otherwise(F.col("action"))), F.col("event_id"), co.alert_rules())
    k = F.col("o_orderkey")
    parts = co.violations(o.select(k, (k % 7 / 100.0).alias("beta"), (k % 5 / 100.0).alias("alpha"), (k % 7 / 100.0 + k % 5 / 100.0 + F.when(k % 17 == 0, 0.001).otherwise(0.0)).alias("total")), k, co.attribution_rules(["beta", "alpha"], "total"))
    splits = o.select(F.lit(1).alias("split"), k.alias("pos"), F.when(k % 4 == 0, "test").otherwise("train").alias("role")).unionByName(o.where(k % 50 == 0).select(F.lit(1).alias("split"), k.alias("pos"), F.when(k % 4 == 0, "train").otherwise("test").alias("role")))
    both = co.in_both(splits).select(F.col("pos").cast("string").alias("key"), F.lit("train_and_test").alias("rule"))
    limits = co.violations(t.read("nation").select("n_nationkey", (F.col("n_nationkey") / 40.0).alias("psi_warn"), F.lit(0.25).alias("psi_disable")), F.col("n_nationkey"), co.threshold_rules())
    return verdicts.unionByName(answers).unionByName(alerts).unionByName(parts).unionByName(both).unionByName(limits)


@query("""SELECT event_id, event_id % 3 = 0 AND event_id % 2 = 0 AS usable_for_mean_reversion, event_id % 4 <> 0 AS tradable, event_id % 5 <> 0 AS resolved, event_id % 5 = 0 AND event_id % 7 > 0 AS needs_review, value / 100 >= 0.7 AS high_confidence, event_type = 'error' AS needs_human FROM events""")
def flt_gates(t: Tables) -> DataFrame:
    i = F.col("event_id")
    rows = t.read("events").select(
        "event_id", F.when(i % 3 == 0, "STATIONARY").otherwise("INCONCLUSIVE").alias("verdict"), F.when(i % 2 == 0, 10.0).alias("half_life"), F.when(i % 4 == 0, "QUARANTINED").otherwise("WATCH").alias("health"),
        F.when(i % 5 != 0, i).alias("entity_id"), (i % 7).alias("n_candidates"), (F.col("value") / 100).alias("confidence"), F.when(F.col("event_type") == "error", "ESCALATED").otherwise("ACCEPTED").alias("decision"),
    )
    return co.gated(rows).select("event_id", *co.GATES)


FINDINGS = """fi AS (SELECT user_id AS entity, event_type AS name, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'NOT_APPLICABLE'][CAST(event_id % 5 + 1 AS INTEGER)] AS severity, props AS detail FROM events WHERE event_type <> 'view')"""


@query("""SELECT s.entity, s.name, CASE WHEN count(f.severity) = 0 THEN 'rejected' ELSE 'card' END AS status, coalesce(bool_or(f.severity IN ('CRITICAL', 'HIGH')), false) AS blocking,
    coalesce(string_agg(f.severity || ':' || f.detail, ' ' ORDER BY f.severity, f.detail) FILTER (f.severity <> 'NOT_APPLICABLE'), '') AS counter FROM signals s LEFT JOIN fi f ON f.entity = s.entity AND f.name = s.name GROUP BY s.entity, s.name""", FINDINGS)
def prj_signal_card(t: Tables) -> DataFrame:
    severity = F.element_at(F.array(*map(F.lit, ("CRITICAL", "HIGH", "MEDIUM", "LOW", "NOT_APPLICABLE"))), (F.col("event_id") % 5 + 1).cast("int"))
    findings = t.read("events").where("event_type != 'view'").select(F.col("user_id").alias("entity"), F.col("event_type").alias("name"), severity.alias("severity"), F.col("props").alias("detail"))
    cards = co.signal_cards(t.signals, findings, ["entity", "name"])
    return cards.select("entity", "name", "status", "blocking", F.array_join(F.transform("counter_arguments", lambda c: F.concat_ws(":", c["severity"], c["detail"])), " ").alias("counter"))


@query("""SELECT portfolio, substr(sha256('{' || string_agg('"' || entity || '": ' || printf('%.10f', weight), ', ' ORDER BY entity) || '}'), 1, 16) AS intent FROM weights GROUP BY portfolio""")
def prj_intent_hash(t: Tables) -> DataFrame:
    return co.intent_hash(t.weights, ["portfolio"])


@query("""SELECT event_id, key AS idempotency_key, substr(sha256(event_type || chr(31) || '1' || chr(31) || key), 1, 32) AS event_id_hash FROM (SELECT event_id, event_type, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS key FROM events)""")
def prj_payload_hash(t: Tables) -> DataFrame:
    return co.enveloped(t.read("events"), F.col("event_type"), ["user_id", "event_type", "event_id"]).select("event_id", "idempotency_key", "event_id_hash")


@query("""SELECT entity, ours, theirs FROM (SELECT coalesce(a.asset, b.asset) AS entity, coalesce(a.q, 0) AS ours, coalesce(b.q, 0) AS theirs FROM (SELECT asset, sum(total_net) AS q FROM flows_daily JOIN assets USING (asset) WHERE ord % 6 <> 5 GROUP BY asset) a
    FULL JOIN (SELECT asset, sum(total_net) + CASE WHEN ord % 7 = 0 THEN 1 WHEN ord % 7 = 1 THEN 0.00005 ELSE 0 END AS q FROM flows_daily JOIN assets USING (asset) WHERE ord % 5 <> 0 GROUP BY asset, ord) b ON a.asset = b.asset) WHERE abs(ours - theirs) > 0.0001""")
def jn_reconcile(t: Tables) -> DataFrame:
    """Our positions against the broker's: some missing on a side, some apart by a share, some by next to nothing."""
    held = t.flows_daily.groupBy("asset").agg(F.sum("total_net").alias("q")).join(t.assets, "asset")
    off = F.when(F.col("ord") % 7 == 0, 1.0).when(F.col("ord") % 7 == 1, 0.00005).otherwise(0.0)
    return co.reconciled(held.where("ord % 6 != 5").select(F.col("asset").alias("entity"), F.col("q").alias("qty")), held.where("ord % 5 != 0").select(F.col("asset").alias("entity"), (F.col("q") + off).alias("qty")))


PERIODS = """ic AS (SELECT event_type AS signal, CAST(ts AS DATE) AS period, CASE WHEN count(*) % 4 <> 0 THEN round(avg(value) / 100 - 0.25, 6) END AS ic FROM events GROUP BY ALL),
marked AS (SELECT *, coalesce(ic < 0, true) AS bad, sum((NOT coalesce(ic < 0, true))::INTEGER) OVER (PARTITION BY signal ORDER BY period ROWS UNBOUNDED PRECEDING) AS island FROM ic),
runs AS (SELECT *, CAST(sum(bad::INTEGER) OVER (PARTITION BY signal, island ORDER BY period ROWS UNBOUNDED PRECEDING) AS BIGINT) AS below, 0.1 - avg(ic) OVER (PARTITION BY signal ORDER BY period ROWS UNBOUNDED PRECEDING) AS gap FROM marked)"""


def signal_periods(t: Tables) -> DataFrame:
    ic = F.when(F.count("*") % 4 != 0, F.round(F.avg("value") / 100 - 0.25, 6))
    return t.read("events").groupBy(F.col("event_type").alias("signal"), F.to_date("ts").alias("period")).agg(ic.alias("ic"))


@query("SELECT signal, period, CASE WHEN below >= 5 THEN 'QUARANTINED' WHEN below > 0 THEN 'WATCH' ELSE 'HEALTHY' END AS health, below, round(gap, 6) AS gap, coalesce(abs(gap) > 0.05, false) AS breached FROM runs", PERIODS)
def win_signal_health(t: Tables) -> DataFrame:
    return rounded(co.signal_health(signal_periods(t), 0.1).drop("ic"))


@query("SELECT entity, score FROM (SELECT entity, sum(score) AS score FROM scores GROUP BY entity) JOIN assets ON asset = entity WHERE ord % 3 <> 0 ORDER BY score DESC, entity LIMIT 2")
def top_candidates(t: Tables) -> DataFrame:
    """The two best scores among what may be traded."""
    by = t.scores.groupBy("entity").agg(F.sum("score").alias("score"))
    return by.join(t.assets.where("ord % 3 != 0").select(F.col("asset").alias("entity")), "entity", "left_semi").orderBy(F.desc("score"), "entity").limit(2)


@query("SELECT entity, round(max(n) / sum(n), 6) AS consistency, max(n) / sum(n) >= 0.67 AS passes FROM (SELECT entity, coalesce(nullif(direction, 'FLAT'), '') AS a, count(*) AS n FROM opinions GROUP BY ALL) GROUP BY entity")
def udf_answer_key(t: Tables) -> DataFrame:
    """Agreement of an entity's opinions where only the side counts, and no side is an answer too."""
    return rounded(co.consistency(t.opinions, ["entity"], F.nullif(F.col("direction"), F.lit("FLAT"))))


@query("SELECT d, round(sum(abs(weight)), 6) AS gross, sum(abs(weight)) <= 1 + 1e-9 AS allowed FROM methods WHERE method = 'Equal weight' GROUP BY d", SCORED)
def udf_strategy(t: Tables) -> DataFrame:
    """A registered strategy and the check of its gross weights."""
    known = co.Strategies()
    known.register("momentum", lambda prices, calendar: ro.target_weights(scores(t), HOW))
    return rounded(known.gross(known.run("momentum", t.px_daily, g.calendar(t.px_daily))))


@query("SELECT symbol AS ticker, count(*) AS n FROM (SELECT DISTINCT user_id AS symbol, event_id FROM events) GROUP BY 1")
def udtf_payload(t: Tables) -> DataFrame:
    """One landed payload of many items to a row for each."""
    from .feeds import src_news_payload

    return src_news_payload(t).groupBy("ticker").agg(F.count("*").alias("n"))


LIQUID = """lq AS (SELECT asset, d, pos, CASE WHEN count(volume) OVER l = 60 AND avg(volume) OVER s / nullif(avg(volume) OVER l, 0) < 0.6 THEN 'STRESSED' ELSE 'NORMAL' END AS liquidity FROM own WINDOW s AS (PARTITION BY asset ORDER BY pos ROWS 4 PRECEDING), l AS (PARTITION BY asset ORDER BY pos ROWS 59 PRECEDING)),
cc AS (SELECT avg(c) AS correlation FROM (SELECT corr(a.x, b.x) AS c FROM mr a JOIN mr b ON a.pos = b.pos AND a.asset < b.asset GROUP BY a.asset, b.asset))"""
REGIME = EWMA + TREND.removeprefix(OWN) + ", " + MRET + ", " + LIQUID + """, reg AS (
    SELECT t.asset, t.d, t.trend, CASE WHEN ewma_vol >= 0.4 THEN 'EXTREME' WHEN ewma_vol >= 0.25 THEN 'HIGH' WHEN ewma_vol <= 0.12 THEN 'LOW' ELSE 'NORMAL' END AS volatility, liquidity, coalesce(correlation, 0) AS correlation
    FROM tr t JOIN lq USING (asset, pos) LEFT JOIN ewma USING (asset), cc QUALIFY row_number() OVER (PARTITION BY t.asset ORDER BY t.pos DESC) = 1)"""


def last_of(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("asset").agg(F.max_by(column, "pos").alias(column))


def regimes(t: Tables) -> DataFrame:
    bars = daily(t)
    mean = fe.pair_correlations(month_returns(t)).agg(F.coalesce(F.avg("corr"), F.lit(0.0)).alias("correlation"))  # one number
    vol = fe.ewma_volatility(daily_returns(t)).select("asset", "ewma_vol", fe.volatility_state(F.col("ewma_vol")).alias("volatility"))
    last = bars.groupBy("asset").agg(F.max("d").alias("d"), F.max_by("close", "pos").alias("close"))
    parts = last.join(last_of(fe.trend(bars, threshold=0.002), "trend"), "asset").join(last_of(fe.liquidity(bars), "liquidity"), "asset").join(vol, "asset", "left")
    return parts.withColumn("volatility", F.coalesce("volatility", F.lit("NORMAL"))).crossJoin(F.broadcast(mean))


@query("SELECT asset, trend || '/' || volatility || '/' || liquidity AS label, round(correlation, 6) AS correlation, volatility IN ('HIGH', 'EXTREME') OR liquidity = 'STRESSED' OR correlation > 0.7 AS risk_off FROM reg", REGIME)
def stat_regime(t: Tables) -> DataFrame:
    off = F.col("volatility").isin("HIGH", "EXTREME") | (F.col("liquidity") == "STRESSED") | (F.col("correlation") > 0.7)
    return rounded(regimes(t).select("asset", F.concat_ws("/", "trend", "volatility", "liquidity").alias("label"), "correlation", off.alias("risk_off")))
