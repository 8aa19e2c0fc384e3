"""The daily reports: a watch list from bars to pretrade verdict, and a brief with a row for each session."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.landing import written
from . import contracts, features, risk
from .quality import MOVE_LIMIT


@dataclass(frozen=True)
class Watching:
    """least_rows: shorter series aren't looked at. Momentum runs over `lookback` rows and ends `skip` rows before the last."""

    least_rows: int = 60
    move_limit: float = MOVE_LIMIT["TW"]
    skip: int = 21
    lookback: int = 180
    candidates: int = 2
    trend: float = 0.02
    equity: float = 1e7
    limits: risk.Limits = field(default_factory=risk.Limits)


def checked(bars: DataFrame, how: Watching = Watching()) -> DataFrame:
    """bars(asset, pos, close, volume) -> asset, n, n_alerts, tradable, close and momentum, by one window and one aggregate.

    Alerts: a negative volume, a close not above 0, a move above the limit from one sound row to the next; any of them, or too few rows
    (one alert, and nothing else is said of the asset), makes it untradable and its momentum null.
    """
    w = Window.partitionBy("asset").orderBy("pos")
    sound = (F.col("close") > 0) & (F.col("volume") >= 0)
    before = F.last(F.when(sound, F.col("close")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    moved = sound & (F.abs(F.col("close") / before - 1) > how.move_limit)
    back = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("pos")))
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("close")))
    a = bars.withColumn("moved", F.coalesce(moved, F.lit(False))).withColumn("back", back).groupBy("asset").agg(
        F.count("*").alias("n"), (F.count_if(F.col("volume") < 0) + F.count_if(F.col("close") <= 0) + F.count_if("moved")).alias("faults"),
        F.max_by("close", "pos").alias("last"), F.min_by("close", "pos").alias("first"), at(how.skip + 1).alias("end"), at(how.skip + how.lookback + 1).alias("start"),
    )
    n, end = F.col("n"), F.col("end")
    enough, alerts = n >= how.least_rows, F.when(n < how.least_rows, F.lit(1).cast("long")).otherwise(F.col("faults"))
    momentum = F.when(n > how.skip + how.lookback, F.try_divide(end, "start") - 1).when(n > how.skip + 20, F.try_divide(end, "first") - 1)
    return a.select(
        "asset", "n", alerts.alias("n_alerts"), (alerts == 0).alias("tradable"), F.when(enough, F.col("last")).alias("close"),
        F.when(alerts == 0, momentum).alias("momentum"),
    )


def returns(bars: DataFrame) -> DataFrame:
    """bars with ret, null on the first row and after a close of 0."""
    w = Window.partitionBy("asset").orderBy("pos")
    return bars.withColumn("ret", F.try_divide("close", F.lag("close").over(w)) - 1)


def watchlist(bars: DataFrame, adv: DataFrame, how: Watching = Watching()) -> DataFrame:
    """bars(asset, pos, close, volume), adv(entity, adv_value) -> a row an asset: asset, n, n_alerts, tradable, close, ewma_vol, trend,
    volatility, momentum, candidate, weight and breached (codes of the limits that the equal-weighted candidates break, by name; '' if none).

    Candidates are the highest momenta among tradable assets, ties to the smaller name; weight and breached are null for all others.
    The checked rows are written once to the shared folder when this is called.
    """
    base = written(checked(bars, how), "watch")  # a row an asset, read by every limit
    vol = features.ewma_volatility(returns(bars))
    trend = features.trend(bars, threshold=how.trend).groupBy("asset").agg(F.max_by("trend", "pos").alias("trend"))
    best = base.where("momentum is not null").orderBy(F.desc("momentum"), "asset").limit(how.candidates).select("asset")  # a handful of names
    share = 1 / F.nullif(F.count("*").over(Window.partitionBy(F.lit(0))), F.lit(0))  # over the candidates only
    weights = best.select(F.lit("watchlist").alias("portfolio"), F.col("asset").alias("entity"), F.lit(None).cast("string").alias("sector"), share.alias("weight"))
    codes = risk.breaches(weights, adv, how.equity, [], how.limits).agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("breached"))
    verdict = weights.select(F.col("entity").alias("asset"), "weight").crossJoin(F.broadcast(codes))  # one row beside a handful
    out = base.join(vol, "asset", "left").join(trend, "asset", "left").join(verdict, "asset", "left")
    seen = F.col("n") >= how.least_rows
    state = F.coalesce(features.volatility_state(F.col("ewma_vol")), F.lit("NORMAL"))
    return out.select(
        "asset", "n", "n_alerts", "tradable", "close", F.when(seen, F.col("ewma_vol")).alias("ewma_vol"), F.when(seen, F.col("trend")).alias("trend"),
        F.when(seen, state).alias("volatility"), "momentum", F.col("weight").isNotNull().alias("candidate"), "weight", "breached",
    )


def tested(watch: DataFrame, bars: DataFrame, how: Watching = Watching(), alpha: float = 0.05) -> DataFrame:
    """A watch list with verdict and half_life of each asset's returns, both null for series that are too short to be looked at."""
    series = returns(bars).select("asset", "pos", F.col("ret").alias("close"))
    tests = features.stationarity(series, alpha)
    half = features.gated_half_life(series, tests, alpha)
    seen = F.col("n") >= how.least_rows
    found = tests.select("asset", "verdict").join(half, "asset", "left")
    out = watch.join(found, "asset", "left")
    return out.withColumn("verdict", F.when(seen, F.col("verdict"))).withColumn("half_life", F.when(seen, F.col("half_life")))


def attributed(sessions: DataFrame, span: int = 20, keys: tuple = ()) -> DataFrame:
    """sessions(*keys, pos, ret, bench, cost, ideal) with total, beta, market, cost_drag, timing and alpha of the `span` sessions before each;
    null where none of these has a return. One window a key, so a key's sessions are ordered in one task: a row a session."""
    w = Window.partitionBy(*(keys or (F.lit(0),))).orderBy("pos").rowsBetween(-span, -1)
    beta = F.coalesce(F.try_divide(F.covar_samp("ret", "bench").over(w), F.nullif(F.var_samp("bench").over(w), F.lit(0.0))), F.lit(0.0))
    out = sessions.withColumn("total", F.product(1 + F.col("ret")).over(w) - 1).withColumn("beta", beta)
    out = out.withColumn("market", F.col("beta") * (F.product(1 + F.col("bench")).over(w) - 1)).withColumn("cost_drag", F.sum("cost").over(w))
    out = out.withColumn("timing", F.sum(F.col("ret") - F.col("ideal")).over(w))
    out = out.withColumn("alpha", F.col("total") - F.col("market") - F.col("cost_drag") - F.col("timing"))
    return out.withColumn("beta", F.when(F.col("total").isNotNull(), F.col("beta"))).withColumn("market", F.when(F.col("total").isNotNull(), F.col("market")))


def regime_days(bars: DataFrame, trend: float = 0.02) -> DataFrame:
    """bars(asset, d, pos, close, volume) -> asset, d, label and risk_off by each day's close: trend / volatility / liquidity."""
    vol = features.ewma_by_day(returns(bars)).select("asset", "pos", F.coalesce(features.volatility_state(F.col("ewma_vol")), F.lit("NORMAL")).alias("volatility"))
    parts = features.trend(bars, threshold=trend).select("asset", "d", "pos", "trend")
    liquid = features.liquidity(bars).select("asset", "pos", "liquidity")
    out = parts.join(liquid, ["asset", "pos"]).join(vol, ["asset", "pos"])
    off = F.col("volatility").isin("HIGH", "EXTREME") | (F.col("liquidity") == "STRESSED")
    return out.select("asset", "d", F.concat_ws("/", "trend", "volatility", "liquidity").alias("label"), off.alias("risk_off"))


def card_counts(signals: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """signals(d, key), findings(key, severity, detail) -> d, cards, blocking (cards with a critical or high finding), rejected (without any)."""
    made = contracts.signal_cards(signals, findings, [key])
    card = F.col("status") == "card"
    return made.groupBy("d").agg(F.count_if(card).alias("cards"), F.count_if(card & F.col("blocking")).alias("blocking"), F.count_if(~card).alias("rejected"))


def exposures(weights: DataFrame, limits: risk.Limits = risk.Limits()) -> DataFrame:
    """weights(portfolio, entity, weight) -> portfolio, gross, net, top5 and usage, the largest share of its limit that one of them takes."""
    usage: Column = F.greatest(F.col("gross") / limits.gross, F.abs("net") / limits.net, F.col("top5") / limits.top5)
    return risk.exposure(weights).withColumn("usage", usage)


def brief(calendar: DataFrame, attribution: DataFrame, regimes: DataFrame, cards: DataFrame, exposure: DataFrame, events: DataFrame) -> DataFrame:
    """calendar(d, pos) with what is known before each session opens: attribution(pos, ...) up to the session before, the last of regimes(d, ...)
    and of exposure(d, ...) before it, its cards(d, ...) and what events(d, upcoming) announces. Counts are 0 where there is nothing."""
    w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # a row a session
    held = exposure.select("d", F.struct("gross", "net", "top5", "usage").alias("held"))
    late = regimes.select("d", F.struct("label", "risk_off").alias("regime")).join(held, "d", "full_outer")
    last = lambda c: F.last(c, ignorenulls=True).over(w).alias(c)
    known = calendar.join(late, "d", "left").select("d", "pos", last("regime"), last("held"))
    out = known.join(attribution, "pos", "left").join(cards, "d", "left").join(events, "d", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("cards", "blocking", "rejected", "upcoming")]
    return out.select(
        "d", "total", "beta", "market", "cost_drag", "timing", "alpha", "regime.label", "regime.risk_off",
        "held.gross", "held.net", "held.top5", "held.usage", *counts,
    )
