"""Signal fusion, portfolio construction, risk limits and monitoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gram import pair_sums


@dataclass(frozen=True)
class Limits:
    position: float = 0.05
    sector: float = 0.25
    gross: float = 1.0
    net: float = 0.6
    adv: float = 0.05
    top5: float = 0.4
    reduce_at: float = 0.08
    close_at: float = 0.15


@dataclass(frozen=True)
class Building:
    target_vol: float = 0.15
    max_leverage: float = 1.0
    turnover_penalty: float = 0.001
    min_weight: float = 0.005


def vol_target(forecast: Column, how: Building = Building()) -> Column:
    return F.when((forecast > 0) & (forecast < float("inf")), F.least(F.lit(how.target_vol) / forecast, F.lit(how.max_leverage))).otherwise(0.0)


def decay(age_days: Column, half_life: Column | float) -> Column:
    """Halving up to one half-life, then falling in a line to 0 at two; 0 for the future."""
    h = F.lit(half_life) if isinstance(half_life, float) else half_life
    return F.when(age_days < 0, 0.0).when(age_days <= h, F.pow(F.lit(0.5), age_days / h)).when(age_days >= 2 * h, 0.0).otherwise(0.5 * (1 - (age_days - h) / h))


def fuse(signals: DataFrame, min_weight: float = 0.05) -> DataFrame:
    """signals(entity, name, score, base, multiplier, confidence, decay) -> entity, combined, n_used, n_dropped."""
    e = Window.partitionBy("entity")
    w = signals.withColumn("effective", F.col("base") * F.col("multiplier") * F.col("confidence") * F.col("decay"))
    w = w.withColumn("kept", F.when(F.col("effective") < min_weight * F.greatest(F.sum("effective").over(e), F.lit(1e-12)), 0.0).otherwise(F.col("effective")))
    g = w.groupBy("entity").agg(F.sum("kept").alias("total"), F.sum(F.col("kept") * F.col("score")).alias("s"), F.count_if(F.col("kept") > 0).alias("n_used"), F.count_if(F.col("kept") == 0).alias("n_dropped"))
    return g.select("entity", F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide("s", "total"))), F.lit(0.0)).alias("combined"), "n_used", "n_dropped")


def shrinkage(panel: DataFrame) -> DataFrame:
    """Ledoit-Wolf over panel(asset, pos, x), complete: (a, b, cov, shrunk, delta). Sums only: sum_t |x_t x_t' - S|^2 = sum_t |x_t|^4 - T |S|^2,
    and S from the block matrices of gram.pair_sums(), half of it: the other half is written out last."""
    x = panel.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("asset")))
    T = F.broadcast(x.agg(F.count_distinct("pos").alias("T")))  # one number
    half = pair_sums(x).crossJoin(T).select("a", "b", (F.col("sum_ab") / F.col("T")).alias("cov"), "T")
    mean_var = F.broadcast(half.where("a = b").agg(F.avg("cov").alias("mu")))  # one number
    same = F.col("a") == F.col("b")
    c = half.crossJoin(mean_var).withColumn("target", F.when(same, F.col("mu")).otherwise(0.0))
    times = F.when(same, 1.0).otherwise(2.0)
    norms = c.agg(F.sum(times * (F.col("cov") - F.col("target")) ** 2).alias("delta2"), F.sum(times * F.col("cov") ** 2).alias("s2"), F.max("T").alias("T"))
    fourth = x.groupBy("pos").agg(F.sum(F.col("x") ** 2).alias("q")).agg(F.sum(F.col("q") ** 2).alias("q4"))
    delta = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((F.col("q4") - F.col("T") * F.col("s2")) / F.col("T") ** 2, "delta2"))), F.lit(0.0))
    d = F.broadcast(norms.crossJoin(F.broadcast(fourth)).select(delta.alias("delta")))  # one number
    one = c.crossJoin(d).withColumn("shrunk", F.col("delta") * F.col("target") + (1 - F.col("delta")) * F.col("cov"))
    ways = F.explode(F.when(same, F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).alias("w")
    return one.select("cov", "shrunk", "delta", ways).select("w.a", "w.b", "cov", "shrunk", "delta")


def decorrelated_weights(cov: DataFrame) -> DataFrame:
    """cov(a, b, shrunk) -> asset, weight: inverse variance over the sum of absolute correlations."""
    v = cov.where("a = b").select(F.col("a").alias("asset"), F.col("shrunk").alias("var"))
    c = cov.join(v.select(F.col("asset").alias("a"), F.col("var").alias("va")), "a").join(v.select(F.col("asset").alias("b"), F.col("var").alias("vb")), "b")
    rho = F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.abs(F.try_divide("shrunk", F.sqrt(F.col("va") * F.col("vb")))))
    raw = c.groupBy(F.col("a").alias("asset"), F.col("va").alias("var")).agg(F.sum(rho).alias("redundancy")).withColumn("raw", F.when(F.col("var") > 0, 1 / (F.col("var") * F.col("redundancy"))).otherwise(0.0))
    total = F.broadcast(raw.agg(F.sum("raw").alias("total"), F.count("*").alias("n")))
    return raw.crossJoin(total).select("asset", F.when(F.col("total") > 0, F.col("raw") / F.col("total")).otherwise(1.0 / F.col("n")).alias("weight"))


def build(scores: DataFrame, previous: DataFrame, forecast: float, limits: Limits = Limits(), how: Building = Building()) -> DataFrame:
    """scores(portfolio, entity, sector, score), previous(portfolio, entity, weight) -> (portfolio, entity, weight, constrained)."""
    p, s = Window.partitionBy("portfolio"), Window.partitionBy("portfolio", "sector")
    w = scores.withColumn("w0", F.coalesce(F.try_divide("score", F.sum(F.abs("score")).over(p)), F.lit(0.0)))
    w = w.withColumn("w1", F.greatest(F.lit(-limits.position), F.least(F.lit(limits.position), F.col("w0"))))
    w = w.withColumn("in_sector", F.sum(F.abs("w1")).over(s))
    w = w.withColumn("w2", F.when(F.col("in_sector") > limits.sector, F.col("w1") * (limits.sector / F.col("in_sector"))).otherwise(F.col("w1")))
    w = w.withColumn("constrained", (F.abs(F.col("w1") - F.col("w0")) > 1e-12 * F.greatest(F.abs("w1"), F.abs("w0"))) | (F.col("in_sector") > limits.sector))
    scalar = min(how.target_vol / forecast, how.max_leverage) if forecast > 0 else 0.0
    w = w.withColumn("w3", F.col("w2") * scalar).withColumn("gross", F.sum(F.abs("w3")).over(p))
    w = w.withColumn("w4", F.when(F.col("gross") > limits.gross, F.col("w3") * (limits.gross / F.col("gross"))).otherwise(F.col("w3")))
    blend = min(0.9, how.turnover_penalty * 100)
    prior = previous.select("portfolio", "entity", F.col("weight").alias("prior"))
    w = w.join(prior, ["portfolio", "entity"], "left").withColumn("w5", (1 - blend) * F.col("w4") + blend * F.coalesce("prior", F.lit(0.0)))
    return w.select("portfolio", "entity", F.when(F.abs("w5") < how.min_weight, 0.0).otherwise(F.col("w5")).alias("weight"), "constrained")


def turnover(current: DataFrame, previous: DataFrame) -> DataFrame:
    c, b = current.select("portfolio", "entity", F.col("weight").alias("now")), previous.select("portfolio", "entity", F.col("weight").alias("then"))
    return c.join(b, ["portfolio", "entity"], "full_outer").groupBy("portfolio").agg(F.sum(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("then", F.lit(0.0)))).alias("turnover"))


def exposure(weights: DataFrame) -> DataFrame:
    w = weights.withColumn("rnk", F.row_number().over(Window.partitionBy("portfolio").orderBy(F.desc(F.abs("weight")), "entity")))
    a = F.abs("weight")
    return w.groupBy("portfolio").agg(F.sum(a).alias("gross"), F.sum("weight").alias("net"), F.sum(F.when(F.col("rnk") <= 5, a)).alias("top5"))


def breaches(weights: DataFrame, adv: DataFrame, equity: float, restricted: list[str], limits: Limits = Limits()) -> DataFrame:
    """Every limit that weights(portfolio, entity, sector, weight) break: portfolio, code, subject, observed, limit. adv(entity, adv_value); limits break above, not at."""
    a = F.abs("weight")
    row = lambda df, code, subject, observed, limit: df.select("portfolio", F.lit(code).alias("code"), subject.alias("subject"), observed.alias("observed"), F.lit(limit).alias("limit")).where(F.col("observed") > limit)
    none = F.lit(None).cast("string")
    banned = weights.where(F.col("entity").isin(restricted) & (F.col("weight") != 0)).select("portfolio", F.lit("RESTRICTED").alias("code"), F.col("entity").alias("subject"), F.col("weight").alias("observed"), F.lit(0.0).alias("limit"))
    sums = exposure(weights)
    traded = weights.join(adv, "entity").where("adv_value > 0")
    parts = [
        row(weights, "POSITION", F.col("entity"), a, limits.position),
        row(weights.groupBy("portfolio", F.coalesce("sector", F.lit("未分類")).alias("sector")).agg(F.abs(F.sum("weight")).alias("w")), "SECTOR", F.col("sector"), F.col("w"), limits.sector),
        row(sums, "GROSS", none, F.col("gross"), limits.gross), row(sums, "NET", none, F.abs("net"), limits.net), row(sums, "TOP5", none, F.col("top5"), limits.top5),
        row(traded, "ADV", F.col("entity"), F.lit(equity) * a / F.col("adv_value"), limits.adv),
    ]
    out = banned
    for p in parts:
        out = out.unionByName(p)
    return out


def drawdown_tier(curves: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """curves(run, pos, equity) -> run, drawdown, mode, multiplier."""
    d = curves.groupBy("run").agg(((F.max("equity") - F.max_by("equity", "pos")) / F.max("equity")).alias("drawdown"))
    x = F.col("drawdown")
    return d.withColumn("mode", F.when(x >= limits.close_at, 2).when(x >= limits.reduce_at, 1).otherwise(0)).withColumn("multiplier", F.when(x >= limits.close_at, 0.0).when(x >= limits.reduce_at, 0.5).otherwise(1.0))


def arbitrate(opinions: DataFrame, keys: list[str], high: float = 0.7) -> DataFrame:
    """One resolution per key: flat opinions don't count; strong opposite ones go to people, weak ones are downgraded, agreement is accepted."""
    sided = F.col("direction") != "FLAT"
    strong = sided & (F.col("confidence") >= high)
    g = opinions.groupBy(*keys).agg(F.count_if(sided).alias("n"), F.count_distinct(F.when(sided, F.col("direction"))).alias("sides"), F.count_distinct(F.when(strong, F.col("direction"))).alias("strong"), F.min(F.when(sided, F.col("direction"))).alias("one"), F.min(F.when(sided, (F.col("confidence") >= high).cast("int"))).alias("all_strong"))
    agree = F.col("sides") == 1
    r = F.when(F.col("n") == 0, "NO_OPINION").when(~agree & (F.col("strong") > 1), "ESCALATED").when(~agree, "DOWNGRADED").otherwise("ACCEPTED")
    return g.select(*keys, r.alias("resolution"), F.when((F.col("n") > 0) & agree, F.col("one")).otherwise("FLAT").alias("direction"), F.when((F.col("n") > 0) & agree & (F.col("all_strong") == 1), "CONFIRM").otherwise("RESEARCH_ONLY").alias("level"))
