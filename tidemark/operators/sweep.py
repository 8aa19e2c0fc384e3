"""Rotation runs for a table of configurations: the configuration is one more key of every window, so that one plan serves any number of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import PERIODS_PER_YEAR
from .rotation import CUSTOM, EQUAL, INVERSE_VOLATILITY, MOMENTUM

CONFIG = (
    "config_id string, frequency string, top_n int, weighting string, lookbacks map<int,double>, rank_weights array<double>, positive_only boolean, risk_adjusted boolean, "
    "volatility_window int, cost_bps double, defensive string"
)


def _deviation(values: Column) -> Column:
    """The sample deviation of an array without nulls; null for fewer than two."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


def _scored(grids: DataFrame, configs: DataFrame) -> DataFrame:
    """For each configuration the rows of its frequency's grid with ret, vol and score. A row carries its asset's last prices only as far as these
    reach; how far that is at most is read from the configurations, one number, when the plan is made."""
    per_year = F.create_map(*[F.lit(x) for pair in PERIODS_PER_YEAR.items() for x in pair])
    far = configs.groupBy("frequency").agg(F.max(F.greatest(F.array_max(F.map_keys("lookbacks")), "volatility_window")).alias("far"))
    longest = far.agg(F.max("far")).first()[0] or 1
    series = Window.partitionBy("frequency", "asset").orderBy("pos")
    # prices with the missing ones in their places: a struct isn't null, so that collect_list keeps it
    before = F.collect_list(F.struct("close")).over(series.rowsBetween(-longest, 0))
    rows = grids.withColumn("before", before).join(far, "frequency")
    rows = rows.withColumn("before", F.reverse(F.slice("before", -F.least(F.size("before"), F.col("far") + 1), F.least(F.size("before"), F.col("far") + 1)))["close"]).drop("far")
    runs = configs.join(grids.select("frequency", "asset").distinct(), "frequency")  # keyed by asset too, so that no task gets a whole frequency
    both = rows.join(runs, ["frequency", "asset"])
    price = lambda k: F.get("before", k)
    change = lambda i, k: price(i) / F.nullif(price(i + k), F.lit(0.0)) - 1
    total = F.aggregate(F.map_values("lookbacks"), F.lit(0.0), lambda a, w: a + w)
    score = F.aggregate(F.map_entries("lookbacks"), F.lit(0.0), lambda a, e: a + change(F.lit(0), e["key"]) * (e["value"] / total))
    returns = F.transform(F.sequence(F.lit(0), F.col("volatility_window") - 1), lambda i: change(i, F.lit(1)))
    vol = F.when(~F.exists(returns, lambda r: r.isNull()), _deviation(returns)) * F.sqrt(per_year[F.col("frequency")].cast("double"))
    both = both.select("config_id", "frequency", "d", "pos", "asset", "ord", "top_n", "weighting", "rank_weights", "positive_only", "risk_adjusted", "cost_bps", "defensive", change(F.lit(0), F.lit(1)).alias("ret"), vol.alias("vol"), score.alias("raw"))
    return both.withColumn("score", F.when(F.col("risk_adjusted"), F.try_divide("raw", F.nullif("vol", F.lit(0.0)))).otherwise(F.col("raw"))).drop("raw")


def weighted(grids: DataFrame, configs: DataFrame) -> DataFrame:
    """grids(frequency, d, pos, asset, ord, close), dense by frequency, and configs of CONFIG -> config_id, d, pos, asset, ret, cost_bps, score and weight.

    Of each date and configuration the top_n scores, ties in the order of `ord`, share the weight as `weighting` says; a date on which nothing is selected
    holds the defensive asset, which is never a candidate.
    """
    day = Window.partitionBy("config_id", "d")
    rows = _scored(grids, configs).withColumn("safe", F.coalesce(F.col("asset") == F.col("defensive"), F.lit(False)))
    fits = ~F.col("safe") & F.col("score").isNotNull() & (~F.col("positive_only") | (F.col("score") > 0))
    ranked = rows.withColumn("fits", fits).withColumn("rnk", F.row_number().over(day.orderBy(F.desc("fits"), F.desc_nulls_last("score"), "ord")))
    ranked = ranked.withColumn("held", F.col("fits") & (F.col("rnk") <= F.col("top_n")))
    own = lambda x: F.when(F.col("held"), x)
    strength, inverse = own(F.greatest("score", F.lit(0.0))), own(F.try_divide(F.lit(1.0), F.nullif("vol", F.lit(0.0))))
    given = own(F.coalesce(F.get("rank_weights", F.col("rnk") - 1), F.lit(0.0)))
    n, strengths, inverses, gifts = F.sum(own(F.lit(1.0))).over(day), F.sum(strength).over(day), F.sum(inverse).over(day), F.sum(given).over(day)
    equal = own(1.0 / n)
    by = F.when(F.col("weighting") == EQUAL, equal).when(F.col("weighting") == MOMENTUM, F.try_divide(strength, strengths))
    by = by.when(F.col("weighting") == INVERSE_VOLATILITY, own(F.when(inverses.isNull(), 1.0 / n).otherwise(F.coalesce(inverse / inverses, F.lit(0.0)))))
    by = by.when(F.col("weighting") == CUSTOM, F.when(gifts > 0, given / gifts).otherwise(equal))
    weight = F.coalesce(by, F.when(F.col("safe") & n.isNull(), 1.0), F.lit(0.0))
    return ranked.withColumn("weight", weight).select("config_id", "d", "pos", "asset", "ret", "cost_bps", F.when(~F.col("safe"), F.col("score")).alias("score"), "weight")


def sweep(grids: DataFrame, configs: DataFrame) -> DataFrame:
    """config_id, d, pos, gross, turnover, cost and net of each configuration's run: weights set on a date earn the next date's return, half the change in
    weights pays cost_bps, and the run starts one date after the first score. The number of shuffles doesn't depend on the number of configurations."""
    w = Window.partitionBy("config_id", "asset").orderBy("pos")
    held = weighted(grids, configs).withColumn("deployed", F.lag("weight", 1, 0.0).over(w))
    held = held.withColumn("moved", F.abs(F.col("deployed") - F.lag("deployed", 1).over(w)))
    gross, turnover = F.coalesce(F.sum(F.col("deployed") * F.col("ret")), F.lit(0.0)), F.coalesce(F.sum("moved") / 2, F.lit(0.0))
    days = held.groupBy("config_id", "d", "pos").agg(gross.alias("gross"), turnover.alias("turnover"), F.max("cost_bps").alias("bps"), F.count("score").alias("scores"))
    first = F.min(F.when(F.col("scores") > 0, F.col("pos"))).over(Window.partitionBy("config_id")) + 1  # a row a date
    cost = F.col("turnover") * (F.col("bps") / 10_000)
    return days.withColumn("start", first).where("start is null or pos >= start").select("config_id", "d", "pos", "gross", "turnover", cost.alias("cost"), (F.col("gross") - cost).alias("net"))


def latest_rankings(grids: DataFrame, configs: DataFrame) -> DataFrame:
    """Of each configuration all scores of its frequency's last date, from the top down, with target weights: config_id, frequency, d, asset, place, score, weight.

    A last date without scores gives no rows. Of the grids only the dates that these scores reach back to are scored.
    """
    far = configs.groupBy("frequency").agg(F.max(F.greatest(F.array_max(F.map_keys("lookbacks")), "volatility_window")).alias("far"))
    ends = grids.groupBy("frequency").agg(F.max("pos").alias("end")).join(far, "frequency")  # a row a frequency
    recent = grids.join(F.broadcast(ends), "frequency").where(F.col("pos") >= F.col("end") - F.col("far"))
    now = recent.where("pos = end").select("frequency", "pos").distinct()
    scored = weighted(recent.drop("end", "far"), configs).where("score is not null").join(configs.select("config_id", "frequency"), "config_id")
    place = F.row_number().over(Window.partitionBy("config_id").orderBy(F.desc("score"), "asset")).cast("long")
    return scored.join(F.broadcast(now), ["frequency", "pos"], "left_semi").select("config_id", "frequency", "d", "asset", place.alias("place"), "score", "weight")
