"""Point-in-time reads: as-of rows, adjustment factors, universes, repair, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, asof: str | Column, keys: list[str], ingest: str = "ingest_date", *ties: str) -> DataFrame:
    """Per key the row ingested last up to asof; further columns break ties, the largest first."""
    seen = rows.where(F.col(ingest) <= (F.lit(asof).cast("date") if isinstance(asof, str) else asof))
    return seen.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ingest), *[F.desc(c) for c in ties]))).where("_rn = 1").drop("_rn")


def adjusted(prices: DataFrame, actions: DataFrame) -> DataFrame:
    """prices(entity_id, trade_date, close) with factor (the product of the factors of later actions), log_factor (its logarithm, for many actions), n_actions, confidence (their least) and adjusted.

    No range join: actions and prices of an entity stand in one order by falling date, and running aggregates over the actions pass before each price.
    """
    a = actions.select("entity_id", F.col("ex_date").alias("at"), F.lit(0).alias("kind"), "factor", "confidence", F.lit(None).cast("double").alias("close"))
    p = prices.select("entity_id", F.col("trade_date").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("factor"), F.lit(None).cast("double").alias("confidence"), "close")
    w = Window.partitionBy("entity_id").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(p).withColumns({"f": F.coalesce(F.product("factor").over(w), F.lit(1.0)), "n": F.count("factor").over(w), "l": F.coalesce(F.sum(F.log("factor")).over(w), F.lit(0.0)), "c": F.coalesce(F.min("confidence").over(w), F.lit(1.0))}).where("kind = 1")
    return out.select("entity_id", F.col("at").alias("trade_date"), "close", F.col("f").alias("factor"), F.col("l").alias("log_factor"), F.col("n").alias("n_actions"), F.col("c").alias("confidence"), (F.col("close") * F.col("f")).alias("adjusted"))


def universe(spans: DataFrame, days: DataFrame) -> DataFrame:
    """days(d, asof) -> (d, entity_id, state, tradable): spans that cover d and were known by asof, the last ingested per entity.

    Spans meet days by month first, so that the join has a key; a span is written out once for each month it covers.
    """
    end = F.coalesce("valid_to", F.lit("2100-01-01").cast("date"))
    months = days.select(F.trunc("d", "MM").alias("month"), "d", "asof")
    bounds = days.agg(F.trunc(F.min("d"), "MM").alias("lo"), F.trunc(F.max("d"), "MM").alias("hi"))
    by_month = spans.crossJoin(F.broadcast(bounds)).withColumn("from", F.greatest(F.trunc("valid_from", "MM"), F.col("lo"))).withColumn("to", F.least(end, F.col("hi"))).where("from <= to")
    by_month = by_month.withColumn("month", F.explode(F.sequence("from", F.trunc("to", "MM"), F.expr("interval 1 month")))).drop("lo", "hi", "from", "to")
    hit = by_month.join(F.broadcast(months), "month").where((F.col("valid_from") <= F.col("d")) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("d"))) & (F.col("ingest_date") <= F.col("asof")))
    last = hit.withColumn("_rn", F.row_number().over(Window.partitionBy("d", "entity_id").orderBy(F.desc("ingest_date"), F.desc("valid_from")))).where("_rn = 1")
    return last.select("d", "entity_id", "state", (F.col("state") == "TRADABLE").alias("tradable"))


def repaired(prices: DataFrame, threshold: float = 0.4) -> DataFrame:
    """prices(asset, d, close) with repaired: every price before a jump of more than `threshold` to the next is scaled by it; log_repaired
    is its logarithm, which holds where the product of many jumps leaves the range of doubles."""
    w = Window.partitionBy("asset").orderBy("d")
    p = prices.where("close is not null").withColumn("ratio", F.col("close") / F.lag("close").over(w))
    p = p.withColumn("event", F.when((F.col("ratio") > 0) & ((F.col("ratio") < 1 - threshold) | (F.col("ratio") > 1 + threshold)), F.col("ratio")))
    after = w.rowsBetween(1, Window.unboundedFollowing)
    scale = F.coalesce(F.sum(F.log("event")).over(after), F.lit(0.0))
    return p.select("asset", "d", "close", (F.col("close") * F.exp(scale)).alias("repaired"), (F.log("close") + scale).alias("log_repaired"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The union of both; per key and cell the last value that isn't null, new over old."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_seq"))).alias(value))


def fetch_plan(cached: DataFrame, start: str, overlap_days: int = 10, fewest: int = 30) -> DataFrame:
    """cached(ticker, d) -> ticker, n, from_date: `overlap_days` before the last cached date, or `start` with fewer than `fewest` rows."""
    seen = cached.groupBy("ticker").agg(F.count("*").alias("n"), F.max("d").alias("last"))
    return seen.withColumn("from_date", F.when(F.col("n") < fewest, F.lit(start).cast("date")).otherwise(F.date_sub("last", overlap_days)))


def append_missing(old: DataFrame, new: DataFrame, date: str, keys: list[str], order: str) -> DataFrame:
    """old and the rows of new on dates that old lacks, the last by `order` per key."""
    fresh = new.join(old.select(date).distinct(), date, "left_anti")
    return keep_last(old.unionByName(fresh), keys, order)


def keep_last(rows: DataFrame, keys: list[str], *order: str, first: bool = False) -> DataFrame:
    turn = (lambda c: F.asc(c)) if first else (lambda c: F.desc(c))
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*[turn(c) for c in order]))).where("_rn = 1").drop("_rn")


def membership(prices: DataFrame) -> DataFrame:
    """entity's first and last priced date; open (null) if the last is the dataset's."""
    end = F.broadcast(prices.agg(F.max("d").alias("end")))
    spans = prices.where("close is not null").groupBy("asset").agg(F.min("d").alias("valid_from"), F.max("d").alias("last"))
    return spans.crossJoin(end).select("asset", "valid_from", F.when(F.col("last") < F.col("end"), F.col("last")).alias("valid_to"))


def survivorship(grid: DataFrame, tail: int = 20) -> DataFrame:
    """One row: entities, those that end before the dataset, those whose last `tail` grid rows are constant, and biased if none ends."""
    n = F.broadcast(grid.agg(F.max("pos").alias("n")))
    last = F.col("pos") > F.col("n") - tail
    per = grid.crossJoin(n).where("close is not null").groupBy("asset", "n").agg(F.max("pos").alias("last"), F.count(F.when(last, 1)).alias("k"), F.min(F.when(last, F.col("close"))).alias("lo"), F.max(F.when(last, F.col("close"))).alias("hi"))
    out = per.agg(F.count("*").alias("entities"), F.count_if(F.col("last") < F.col("n")).alias("ended"), F.count_if((F.col("k") == tail) & (F.col("lo") == F.col("hi"))).alias("constant_tail"))
    return out.withColumn("biased", F.col("ended") == 0)
