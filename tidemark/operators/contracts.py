"""Record contracts as rows of violations, gates as boolean columns, cards, hashes of what was decided, and reconciliation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import digest

SKEW_SECONDS = 5


def violations(rows: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule, a condition that must not hold, that a row breaks; a null condition breaks nothing."""
    broken = F.array_compact(F.array(*[F.when(condition, name) for name, condition in rules.items()]))
    return rows.select(key.cast("string").alias("key"), F.explode(broken).alias("rule"))


def taken_in_early(event: Column, ingest: Column, skew_seconds: int = SKEW_SECONDS) -> Column:
    return F.unix_micros(ingest.cast("timestamp")) < F.unix_micros(event.cast("timestamp")) - skew_seconds * 1_000_000


def bar_rules() -> dict[str, Column]:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    return {"high_below_low": h < l, "open_outside": ~o.between(l, h), "close_outside": ~c.between(l, h), "negative_volume": F.col("volume") < 0}


def span_rules() -> dict[str, Column]:
    return {"ends_before_it_begins": F.col("valid_to") < F.col("valid_from")}


def action_rules() -> dict[str, Column]:
    """Factors are above 0; an official source is certain, and only it."""
    return {"factor": F.col("factor") <= 0, "confidence_range": ~F.col("confidence").between(0, 1), "official": (F.col("source") == "OFFICIAL") != (F.col("confidence") == 1.0)}


def verdict_rules() -> dict[str, Column]:
    return {"rejected_without_limit": ~F.col("approved") & (F.size("breached") == 0)}


def answer_rules() -> dict[str, Column]:
    return {"abstains_with_payload": F.col("abstain") & F.col("payload").isNotNull(), "answers_without_payload": ~F.col("abstain") & F.col("payload").isNull()}


def alert_rules() -> dict[str, Column]:
    return {"no_action": F.trim(F.coalesce("action", F.lit(""))) == ""}


def attribution_rules(parts: list[str], total: str, tolerance: float = 1e-9) -> dict[str, Column]:
    """Parts of a return sum to it."""
    whole = F.lit(0.0)
    for p in parts:
        whole = whole + F.col(p)
    return {"parts_do_not_sum": F.abs(whole - F.col(total)) > tolerance}


def threshold_rules() -> dict[str, Column]:
    return {"disable_not_above_warn": F.col("psi_disable") <= F.col("psi_warn")}


def in_both(splits: DataFrame) -> DataFrame:
    """splits(split, pos, role) -> the positions of a split that are both train and test."""
    roles = splits.groupBy("split", "pos").agg(F.bool_or(F.col("role") == "train").alias("train"), F.bool_or(F.col("role") == "test").alias("test"))
    return roles.where("train and test").select("split", "pos")


GATES: dict[str, Callable[[], Column]] = {
    "usable_for_mean_reversion": lambda: (F.col("verdict") == "STATIONARY") & F.col("half_life").isNotNull(),
    "tradable": lambda: F.col("health") != "QUARANTINED",
    "resolved": lambda: F.col("entity_id").isNotNull(),
    "needs_review": lambda: F.col("entity_id").isNull() & (F.col("n_candidates") > 0),
    "high_confidence": lambda: F.col("confidence") >= 0.7,
    "needs_human": lambda: F.col("decision") == "ESCALATED",
}


def gated(rows: DataFrame, gates: tuple[str, ...] = tuple(GATES)) -> DataFrame:
    """rows with a boolean column for each gate; a gate without what it asks for is shut."""
    return rows.select("*", *[F.coalesce(GATES[g](), F.lit(False)).alias(g) for g in gates])


def signal_cards(signals: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """signals and findings(*keys, severity, detail) -> a card for each signal: counter_arguments without those that don't apply,
    blocking if one is critical or high, and status: a signal without any finding is `rejected`."""
    found = findings.groupBy(*keys).agg(F.count("*").alias("n_findings"), F.sort_array(F.collect_list(F.struct("severity", "detail"))).alias("all"))  # a report's findings
    out = signals.join(found, keys, "left")
    counter = F.filter(F.coalesce("all", F.array().cast("array<struct<severity:string,detail:string>>")), lambda f: f["severity"] != "NOT_APPLICABLE")
    out = out.withColumn("counter_arguments", counter).withColumn("blocking", F.exists("counter_arguments", lambda f: f["severity"].isin("CRITICAL", "HIGH")))
    return out.withColumn("status", F.when(F.col("n_findings").isNull(), "rejected").otherwise("card")).drop("all", "n_findings")


def intent_hash(weights: DataFrame, keys: list[str]) -> DataFrame:
    """weights(*keys, entity, weight) -> intent, 16 hex digits over the canonical text of all weights, by entity and to ten decimals."""
    entry = F.concat(F.lit('"'), F.col("entity"), F.lit('": '), F.format_string("%.10f", F.col("weight")))
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entity", entry.alias("e")))), lambda x: x["e"]), ", "), F.lit("}"))
    return weights.groupBy(*keys).agg(F.substring(F.sha2(text, 256), 1, 16).alias("intent"))  # a portfolio's entities


def enveloped(rows: DataFrame, event_type: Column, payload: list[str], version: int = 1) -> DataFrame:
    """rows with idempotency_key, the hash of the payload's canonical JSON (columns by name), and event_id, that of type, version and key."""
    key = F.sha2(F.to_json(F.struct(*sorted(payload))), 256)
    return rows.withColumn("idempotency_key", key).withColumn("event_id_hash", digest(32, event_type, F.lit(str(version)), F.col("idempotency_key")))


def reconciled(internal: DataFrame, broker: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """internal and broker(entity, qty) -> entity, ours, theirs of the positions that differ; a missing one is 0."""
    a, b = internal.select("entity", F.col("qty").alias("ours")), broker.select("entity", F.col("qty").alias("theirs"))
    both = a.join(b, "entity", "full_outer").select("entity", F.coalesce("ours", F.lit(0.0)).alias("ours"), F.coalesce("theirs", F.lit(0.0)).alias("theirs"))
    return both.where(F.abs(F.col("ours") - F.col("theirs")) > tolerance)


def signal_health(periods: DataFrame, backtest_ic: float, floor: float = 0.0, quarantine: int = 5, tracking: float = 0.05) -> DataFrame:
    """periods(signal, period, ic) -> health, below (periods running without an ic of the floor or more), gap (backtest less the live
    mean so far, of finite ic) and breached."""
    ic = F.col("ic")
    bad = F.coalesce(F.isnan(ic) | (ic < floor), F.lit(True))
    order = Window.partitionBy("signal").orderBy("period")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = periods.withColumn("bad", bad).withColumn("island", F.sum((~bad).cast("int")).over(run))
    below = F.sum(F.col("bad").cast("long")).over(Window.partitionBy("signal", "island").orderBy("period").rowsBetween(Window.unboundedPreceding, 0))
    finite = F.when(~F.isnan(ic) & (F.abs(ic) != float("inf")), ic)
    out = marked.withColumn("below", below).withColumn("gap", backtest_ic - F.avg(finite).over(run))
    health = F.when(F.col("below") >= quarantine, "QUARANTINED").when(F.col("below") > 0, "WATCH").otherwise("HEALTHY")
    return out.select("signal", "period", "ic", health.alias("health"), "below", "gap", F.coalesce(F.abs("gap") > tracking, F.lit(False)).alias("breached"))


def consistency(answers: DataFrame, keys: list[str], answer: Column, gate: float = 0.67) -> DataFrame:
    """Share of the answer given most often among the repeats of a question; what counts as the same answer is an expression, and a null one is one too."""
    counts = answers.groupBy(*keys, F.coalesce(answer.cast("string"), F.lit("")).alias("given")).agg(F.count("*").alias("n"))
    share = F.max("n") / F.sum("n")
    return counts.groupBy(*keys).agg(share.alias("consistency"), (share >= gate).alias("passes"))


class Strategies:
    """Strategies by name: functions (prices, calendar) -> weights(d, asset, weight)."""

    def __init__(self) -> None:
        self.known: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}

    def register(self, name: str, weights: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        if name in self.known:
            raise ValueError(f"strategy {name} is registered already")
        self.known[name] = weights

    def run(self, name: str, prices: DataFrame, calendar: DataFrame) -> DataFrame:
        return self.known[name](prices, calendar)

    @staticmethod
    def gross(weights: DataFrame, most: float = 1.0) -> DataFrame:
        """d, gross (sum of absolute weights) and whether it is allowed."""
        return weights.groupBy("d").agg(F.sum(F.abs("weight")).alias("gross")).withColumn("allowed", F.col("gross") <= most + 1e-9)
