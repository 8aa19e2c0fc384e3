"""Data-quality gates: every check gives alert rows, and the first blocking alert decides an entity's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.landing import written

MOVE_LIMIT = {"TW": 0.105, "US": 0.5}
MISSING_LIMIT = 0.02
PSI_WARN, PSI_DISABLE = 0.25, 0.5
FLOOR = 1e-6


def alert(entity: Column | str, severity: str, state: str, code: str, *more: Column) -> list[Column]:
    return [F.col(entity).alias("entity_id") if isinstance(entity, str) else entity.alias("entity_id"), F.lit(severity).alias("severity"), F.lit(state).alias("state"), F.lit(code).alias("code"), *more]


def raw_sanity(rows: DataFrame) -> DataFrame:
    """One alert a problem: negative volume, close not above 0."""
    at = F.col("d")
    return rows.where("volume < 0").select(*alert("asset", "P0", "NO_TRADE", "negative_volume", at)).unionByName(rows.where("close <= 0").select(*alert("asset", "P0", "NO_TRADE", "bad_close", at)))


def consistency(bars: DataFrame) -> DataFrame:
    """One alert a bar, with all its problems."""
    h, l, o, c = (F.col(x) for x in ("high", "low", "open", "close"))  # noqa: E741
    problems = F.concat_ws(",", F.when(h < l, "high<low"), F.when((c < l) | (c > h), "close"), F.when((o < l) | (o > h), "open"))
    return bars.withColumn("problems", problems).where("problems != ''").select(*alert("asset", "P0", "NO_TRADE", "inconsistent", F.col("d"), F.col("problems")))


def freshness(entities: DataFrame, prices: DataFrame, asof: str, max_days: int = 1) -> DataFrame:
    day = F.lit(asof).cast("date")
    newest = prices.where(F.col("ingest_date") <= day).groupBy("entity_id").agg(F.max("ingest_date").alias("newest"))
    return entities.join(newest, "entity_id", "left").withColumn("age", F.datediff(day, "newest")).where(F.col("newest").isNull() | (F.col("age") > max_days)).select(*alert("entity_id", "P0", "NO_TRADE", "stale", F.col("age")))


def missing_sessions(prices: DataFrame, sessions: DataFrame) -> DataFrame:
    """(entity_id, d) expected and not there."""
    expected = prices.select("entity_id").distinct().crossJoin(F.broadcast(sessions.select("d")))
    return expected.join(prices.select("entity_id", F.col("trade_date").alias("d")).distinct(), ["entity_id", "d"], "left_anti")


def completeness(prices: DataFrame, sessions: DataFrame, limit: float = MISSING_LIMIT) -> DataFrame:
    n = F.broadcast(sessions.agg(F.count_distinct("d").alias("n")))
    gone = missing_sessions(prices, sessions).groupBy("entity_id").agg(F.count("*").alias("missing"), F.min("d").alias("first_missing")).crossJoin(n)
    return gone.withColumn("ratio", F.col("missing") / F.col("n")).where(F.col("ratio") > limit).select(*alert("entity_id", "P0", "NO_TRADE", "incomplete", F.col("missing"), F.col("first_missing"), F.col("ratio")))


def daily_moves(prices: DataFrame, limit: float) -> DataFrame:
    w = Window.partitionBy("asset").orderBy("d")
    moved = prices.withColumn("before", F.lag("close").over(w)).where("before > 0").withColumn("move", F.abs(F.col("close") / F.col("before") - 1))
    return moved.where(F.col("move") > limit).select(*alert("asset", "P0", "NO_TRADE", "move", F.col("d"), F.col("move")))


def zero_volume(bars: DataFrame) -> DataFrame:
    w = Window.partitionBy("asset").orderBy("d")
    return bars.withColumn("before", F.lag("close").over(w)).where("volume = 0 and close != before").select(*alert("asset", "P1", "TRADABLE", "zero_volume", F.col("d")))


def ranks(rows: DataFrame) -> DataFrame:
    """rows(feature, x), no nulls -> feature, x, i (place by x, from 0) and n (rows of the feature). Rows are dealt by range of feature
    and x and written, so a feature of any size is numbered by many tasks: each within its range, after the counts of those before."""
    ranged = written(rows.select("feature", "x").repartitionByRange("feature", "x").withColumn("part", F.spark_partition_id()), "ranks")
    counts = ranged.groupBy("feature", "part").agg(F.count("*").alias("c"))
    w = Window.partitionBy("feature")  # a row for each range
    before = F.coalesce(F.sum("c").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("feature", "part", before.alias("start"), F.sum("c").over(w).alias("n"))
    within = F.row_number().over(Window.partitionBy("feature", "part").orderBy("x")) - 1
    return ranged.withColumn("own", within).join(starts, ["feature", "part"]).select("feature", "x", (F.col("start") + F.col("own")).alias("i"), "n")


def psi(base: DataFrame, current: DataFrame, buckets: int = 10) -> DataFrame:
    """base and current(feature, x) -> feature, psi. Edges are the base's values at round(i n / buckets), halves to even; a value's bucket is the number of edges below it."""
    ranked = ranks(base.where("x is not null"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(buckets - 1)))
    wanted = ranked.groupBy("feature").agg(F.max("n").alias("n")).select("feature", "n", steps.alias("k")).withColumn("i", F.least(F.col("n") - 1, F.bround(F.col("k") * F.col("n") / buckets).cast("long")))
    edges = F.broadcast(wanted.join(ranked.select("feature", "i", "x"), ["feature", "i"]).groupBy("feature").agg(F.sort_array(F.collect_list("x")).alias("edges")))  # buckets - 1 numbers a feature
    both = base.where("x is not null").select("feature", "x", F.lit(0).alias("side")).unionByName(current.where("x is not null").select("feature", "x", F.lit(1).alias("side")))
    bucket = F.size(F.filter("edges", lambda e: e < F.col("x")))
    counts = both.join(edges, "feature").groupBy("feature", bucket.alias("bucket")).agg(F.count_if(F.col("side") == 0).alias("b"), F.count_if(F.col("side") == 1).alias("c"))
    totals = F.broadcast(counts.groupBy("feature").agg(F.sum("b").alias("nb"), F.sum("c").alias("nc")))
    share = counts.join(totals, "feature").select("feature", F.greatest(F.col("b") / F.col("nb"), F.lit(FLOOR)).alias("b"), F.greatest(F.try_divide("c", "nc"), F.lit(FLOOR)).alias("c"))
    return share.groupBy("feature").agg(F.sum((F.col("c") - F.col("b")) * F.log(F.col("c") / F.col("b"))).alias("psi"))


def drift(stability: DataFrame) -> DataFrame:
    x = F.col("psi")
    kept = stability.where(x > PSI_WARN)
    return kept.select("feature", "psi", F.when(x > PSI_DISABLE, "P0").otherwise("P1").alias("severity"), F.when(x > PSI_DISABLE, "NO_TRADE").otherwise("TRADABLE").alias("state"))


def state(alerts: DataFrame, entities: DataFrame) -> DataFrame:
    """entity_id, state: that of the first blocking alert by seq, else TRADABLE."""
    blocking = alerts.where("state != 'TRADABLE'").groupBy("entity_id").agg(F.min_by("state", "seq").alias("state"))
    return entities.join(blocking, "entity_id", "left").select("entity_id", F.coalesce("state", F.lit("TRADABLE")).alias("state"))
