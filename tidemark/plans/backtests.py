"""Queries of validation, ledgers and attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import grid as g
from ..operators import ledger as le
from ..operators import rotation as ro
from ..operators import validation as va
from ..operators.features import correlation
from .registry import query, rounded
from .research import MRET, OWN, month_returns
from .rotation import SCORED, month_grid, with_defensive
from .views import Tables

N_MONTHS = 80


def positions(t: Tables) -> DataFrame:
    return g.calendar(t.px_daily, "Monthly").where(F.col("pos") <= N_MONTHS).select((F.col("pos") - 1).alias("pos"))


def trials(t: Tables) -> DataFrame:
    return month_returns(t).where(F.col("pos") <= N_MONTHS).select(F.col("asset").alias("trial"), (F.col("pos") - 1).alias("pos"), F.col("x").alias("ret"))


TRIALS = MRET + f", tr AS (SELECT asset AS trial, pos - 1 AS pos, x AS ret FROM mr WHERE pos <= {N_MONTHS})"
WALK = "wf AS (SELECT k AS split, pos, CASE WHEN pos < 13 * k THEN 'train' WHEN pos >= 13 * k + 2 AND pos < least(13 * k + 15, 80) THEN 'test' END AS role FROM (SELECT pos - 1 AS pos FROM cal_month WHERE pos <= 80), range(1, 6) r(k))"


@query("SELECT CAST(split AS INTEGER) AS split, pos, role FROM wf WHERE role IS NOT NULL", WALK)
def val_walk_forward(t: Tables) -> DataFrame:
    return va.walk_forward(positions(t), N_MONTHS, 5, 2)


@query("""SELECT split, pos, role FROM (SELECT split, pos, CASE WHEN (pos >= a * 20 AND pos < a * 20 + 20) OR (pos >= b * 20 AND pos < b * 20 + 20) THEN 'test' WHEN (pos >= a * 20 - 2 AND pos < a * 20 + 22) OR (pos >= b * 20 - 2 AND pos < b * 20 + 22) THEN NULL ELSE 'train' END AS role
    FROM (SELECT pos - 1 AS pos FROM cal_month WHERE pos <= 80), (VALUES (0, 0, 1), (1, 0, 2), (2, 0, 3), (3, 1, 2), (4, 1, 3), (5, 2, 3)) c(split, a, b)) WHERE role IS NOT NULL""")
def val_cpcv(t: Tables) -> DataFrame:
    return va.combinatorial(t.spark, positions(t), N_MONTHS, 4, 2, 2)


@query("SELECT CAST(split AS INTEGER) AS split, role, trial, count(*) AS n, round(avg(ret), 6) + 0.0::DOUBLE AS mean, round(CASE WHEN stddev_samp(ret) > greatest(max(abs(ret)) * 1e-12, 1e-15) THEN avg(ret) / stddev_samp(ret) * sqrt(12) END, 6) + 0.0::DOUBLE AS sharpe FROM wf JOIN tr USING (pos) WHERE role IS NOT NULL GROUP BY ALL", TRIALS + ", " + WALK)
def val_split_returns(t: Tables) -> DataFrame:
    s = va.walk_forward(positions(t), N_MONTHS, 5, 2).join(trials(t), "pos")
    m = s.groupBy("split", "role", "trial").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.max(F.abs("ret")).alias("scale"))
    return rounded(m.select("split", "role", "trial", "n", "mean", va.sharpe(F.col("mean"), F.col("sd"), F.col("scale"), F.col("n"), 12).alias("sharpe")))


@query("SELECT trial, count(*) AS n, round(CASE WHEN stddev_samp(ret) > greatest(max(abs(ret)) * 1e-12, 1e-15) THEN avg(ret) / stddev_samp(ret) * sqrt(252) END, 6) AS sharpe FROM tr GROUP BY trial", TRIALS)
def agg_sharpe(t: Tables) -> DataFrame:
    m = trials(t).groupBy("trial").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.max(F.abs("ret")).alias("scale"))
    return rounded(m.select("trial", "n", va.sharpe(F.col("mean"), F.col("sd"), F.col("scale"), F.col("n")).alias("sharpe")))


PBO = TRIALS + """, half AS (SELECT split, g.g, list_contains(grps, g.g) AS inside FROM (VALUES (0, [0, 1]), (1, [0, 2]), (2, [0, 3]), (3, [1, 2]), (4, [1, 3]), (5, [2, 3])) h(split, grps), range(0, 4) g(g)),
sh AS (SELECT split, inside, trial, CASE WHEN stddev_samp(ret) > greatest(max(abs(ret)) * 1e-12, 1e-15) THEN avg(ret) / stddev_samp(ret) END AS s FROM tr JOIN half h ON h.g = tr.pos // 20 GROUP BY ALL),
best AS (SELECT split, trial FROM sh WHERE inside AND s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY split ORDER BY s DESC, trial) = 1),
rk AS (SELECT o.split, avg((o.s < m.s)::INTEGER) AS rank FROM sh o JOIN best b ON b.split = o.split JOIN sh m ON m.split = b.split AND m.trial = b.trial AND NOT m.inside WHERE NOT o.inside AND o.s IS NOT NULL GROUP BY o.split)"""


@query("SELECT round(avg((rank < 0.5)::INTEGER), 6) AS pbo, count(*) AS n_splits FROM rk", PBO)
def val_pbo(t: Tables) -> DataFrame:
    return rounded(va.overfitting(t.spark, trials(t), N_MONTHS, 4))


@query()
def val_deflated_sharpe(t: Tables) -> DataFrame:
    m = every_trial(t).groupBy("trial").agg((F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0))).alias("observed"), F.count("ret").alias("n_obs"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"))
    a = F.broadcast(m.agg(F.count("*").alias("n_trials"), F.var_samp("observed").alias("var_trials")))
    return va.deflated_sharpe(m.crossJoin(a))


def n_months(t: Tables) -> int:
    """The calendar's number of months."""
    return g.calendar(t.px_daily, "Monthly").agg(F.max("pos")).first()[0] or 0


def every_position(t: Tables) -> DataFrame:
    return g.calendar(t.px_daily, "Monthly").select((F.col("pos") - 1).alias("pos"))


def every_trial(t: Tables) -> DataFrame:
    return month_returns(t).select(F.col("asset").alias("trial"), (F.col("pos") - 1).alias("pos"), F.col("x").alias("ret"))


TRIALS_ALL = MRET + ", tr AS (SELECT asset AS trial, pos - 1 AS pos, x AS ret FROM mr)"
MONTHS_ALL = "nm AS (SELECT max(pos) AS n, max(pos) // 6 AS fold, max(pos) // 4 AS size FROM cal_month)"
WALK_ALL = MONTHS_ALL + ", wf AS (SELECT k AS split, pos, CASE WHEN pos < fold * k THEN 'train' WHEN pos >= fold * k + 2 AND pos < least(fold * k + fold + 2, n) THEN 'test' END AS role FROM (SELECT pos - 1 AS pos FROM cal_month), nm, range(1, 6) r(k))"
GROUPS_ALL = MONTHS_ALL + ", gs AS (SELECT g, g * size AS lo, CASE WHEN g = 3 THEN n ELSE g * size + size END AS hi FROM nm, range(0, 4) r(g))"


@query("SELECT CAST(split AS INTEGER) AS split, pos, role FROM wf WHERE role IS NOT NULL", WALK_ALL)
def val_walk_forward_all(t: Tables) -> DataFrame:
    """val_walk_forward over every month."""
    return va.walk_forward(every_position(t), n_months(t), 5, 2)


@query("""SELECT split, pos, role FROM (SELECT split, pos, CASE WHEN (pos >= x.lo AND pos < x.hi) OR (pos >= y.lo AND pos < y.hi) THEN 'test' WHEN (pos >= x.lo - 2 AND pos < x.hi + 2) OR (pos >= y.lo - 2 AND pos < y.hi + 2) THEN NULL ELSE 'train' END AS role
    FROM (SELECT pos - 1 AS pos FROM cal_month), (VALUES (0, 0, 1), (1, 0, 2), (2, 0, 3), (3, 1, 2), (4, 1, 3), (5, 2, 3)) c(split, a, b) JOIN gs x ON x.g = a JOIN gs y ON y.g = b) WHERE role IS NOT NULL""", GROUPS_ALL)
def val_cpcv_all(t: Tables) -> DataFrame:
    """val_cpcv over every month."""
    return va.combinatorial(t.spark, every_position(t), n_months(t), 4, 2, 2)


@query("SELECT CAST(split AS INTEGER) AS split, role, trial, count(*) AS n, round(avg(ret), 6) + 0.0::DOUBLE AS mean, round(CASE WHEN stddev_samp(ret) > greatest(max(abs(ret)) * 1e-12, 1e-15) THEN avg(ret) / stddev_samp(ret) * sqrt(12) END, 6) + 0.0::DOUBLE AS sharpe FROM wf JOIN tr USING (pos) WHERE role IS NOT NULL GROUP BY ALL", TRIALS_ALL + ", " + WALK_ALL)
def val_split_returns_all(t: Tables) -> DataFrame:
    """val_split_returns over every month."""
    s = val_walk_forward_all(t).join(every_trial(t), "pos")
    m = s.groupBy("split", "role", "trial").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.max(F.abs("ret")).alias("scale"))
    return rounded(m.select("split", "role", "trial", "n", "mean", va.sharpe(F.col("mean"), F.col("sd"), F.col("scale"), F.col("n"), 12).alias("sharpe")))


@query("SELECT trial, count(*) AS n, round(CASE WHEN stddev_samp(ret) > greatest(max(abs(ret)) * 1e-12, 1e-15) THEN avg(ret) / stddev_samp(ret) * sqrt(252) END, 6) AS sharpe FROM tr GROUP BY trial", TRIALS_ALL)
def agg_sharpe_all(t: Tables) -> DataFrame:
    """agg_sharpe over every month."""
    m = every_trial(t).groupBy("trial").agg(F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.max(F.abs("ret")).alias("scale"))
    return rounded(m.select("trial", "n", va.sharpe(F.col("mean"), F.col("sd"), F.col("scale"), F.col("n")).alias("sharpe")))


PBO_ALL = TRIALS_ALL + ", " + MONTHS_ALL + """, half AS (SELECT split, g.g, list_contains(grps, g.g) AS inside FROM (VALUES (0, [0, 1]), (1, [0, 2]), (2, [0, 3]), (3, [1, 2]), (4, [1, 3]), (5, [2, 3])) h(split, grps), range(0, 4) g(g)),
sh AS (SELECT split, inside, trial, CASE WHEN stddev_samp(ret) > greatest(max(abs(ret)) * 1e-12, 1e-15) THEN avg(ret) / stddev_samp(ret) END AS s FROM tr CROSS JOIN nm JOIN half h ON h.g = tr.pos // nm.size GROUP BY ALL),
best AS (SELECT split, trial FROM sh WHERE inside AND s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY split ORDER BY s DESC, trial) = 1),
rk AS (SELECT o.split, avg((o.s < m.s)::INTEGER) AS rank FROM sh o JOIN best b ON b.split = o.split JOIN sh m ON m.split = b.split AND m.trial = b.trial AND NOT m.inside WHERE NOT o.inside AND o.s IS NOT NULL GROUP BY o.split)"""


@query("SELECT round(avg((rank < 0.5)::INTEGER), 6) AS pbo, count(*) AS n_splits FROM rk", PBO_ALL)
def val_pbo_all(t: Tables) -> DataFrame:
    """val_pbo with groups of the whole calendar; as in the method, months beyond four equal groups are dropped."""
    return rounded(va.overfitting(t.spark, every_trial(t), n_months(t), 4))


@query("""SELECT strategy, capital, round(base - 0.1 * sqrt(least(capital * 4 / 252 / adv, 0.05)) * 4, 6) AS net_return FROM (SELECT asset AS strategy, round(avg(close) / 10000, 6) AS base, round(avg(volume * close), 2) AS adv FROM px_daily GROUP BY asset), (VALUES (1e5::DOUBLE), (1e6), (1e7)) c(capital)""")
def val_capacity(t: Tables) -> DataFrame:
    s = t.px_daily.groupBy(F.col("asset").alias("strategy")).agg(F.round(F.avg("close") / 10000, 6).alias("base_return"), F.round(F.avg(F.col("volume") * F.col("close")), 2).alias("adv_value")).withColumn("turnover", F.lit(4.0))
    return rounded(va.capacity(s, [1e5, 1e6, 1e7]).select("strategy", "capital", "net_return"))


fn_capacity = val_capacity


@query("SELECT asset, d, round(n * 14.25e-4 + CASE WHEN day(d) % 2 = 0 THEN n * 0.003 ELSE 0 END + n * 5e-4 + n * 0.1 * sqrt(n / adv), 6) AS cost FROM (SELECT asset, d, close * 100 AS n, volume * close AS adv FROM px_daily)")
def fn_trade_cost(t: Tables) -> DataFrame:
    return rounded(t.px_daily.select("asset", "d", le.trade_cost(F.col("close") * 100, F.dayofmonth("d") % 2 == 0, F.col("volume") * F.col("close")).alias("cost")))


FILLS = SCORED + """, tg AS (SELECT method AS run, d, pos, asset AS entity, weight FROM held WHERE asset NOT IN (SELECT asset FROM assets WHERE ord = 0) AND method IN ('Equal weight', 'Momentum weight')),
dl AS (SELECT *, weight - coalesce(lag(weight) OVER (PARTITION BY run, entity ORDER BY pos), 0) AS delta FROM tg),
fl AS (SELECT run, f.d, entity, delta * 1e6 / close AS shares, close AS price, abs(delta * 1e6) * 14.25e-4 + CASE WHEN delta < 0 THEN abs(delta * 1e6) * 0.003 ELSE 0 END + abs(delta * 1e6) * 5e-4 + abs(delta * 1e6) * 0.1 * sqrt(abs(delta * 1e6) / (volume * close)) AS cost
    FROM dl f JOIN px_daily p ON p.d = f.d AND p.asset = f.entity WHERE abs(delta) > 1e-12)"""


def fill_rows(t: Tables) -> DataFrame:
    grid = month_grid(t).where("ord > 0")
    s, safe = ro.scored(grid, ro.Rotation()).where("ord > 1"), with_defensive(t).defensive
    out = None
    for m in (ro.EQUAL, ro.MOMENTUM):
        w = grid.join(ro.target_weights(s, ro.Rotation(weighting=m, defensive=safe)), ["d", "asset"], "left").select(F.lit(m).alias("run"), "d", "pos", F.col("asset").alias("entity"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
        out = w if out is None else out.unionByName(w)
    return le.fills(out, t.px_daily, 1e6)


@query("SELECT run, d, entity, round(shares, 5) AS shares, round(price, 5) AS price, round(cost, 4) AS cost FROM fl", FILLS)
def pipe_rebalance_fills(t: Tables) -> DataFrame:
    return fill_rows(t).select("run", "d", "entity", F.round("shares", 5).alias("shares"), F.round("price", 5).alias("price"), F.round("cost", 4).alias("cost"))


LEDGER = FILLS + """, lc AS (SELECT r.run, gr.d, gr.pos, gr.asset AS entity, gr.close, f.shares, f.price, f.cost FROM grid gr CROSS JOIN (SELECT DISTINCT run FROM fl) r LEFT JOIN fl f ON f.run = r.run AND f.d = gr.d AND f.entity = gr.asset),
lm AS (SELECT *, coalesce(sum(shares) OVER w, 0) AS hold, last_value(coalesce(close, price) IGNORE NULLS) OVER w AS mark FROM lc WINDOW w AS (PARTITION BY run, entity ORDER BY pos ROWS UNBOUNDED PRECEDING)),
ldg AS (SELECT run, d, pos, sum(coalesce(shares * price + cost, 0)) AS spent, sum(hold * coalesce(mark, 0)) AS value FROM lm GROUP BY ALL),
eqd AS (SELECT run, d, 1e6 - sum(spent) OVER (PARTITION BY run ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cash, value FROM ldg)"""


def ledger(t: Tables) -> DataFrame:
    return le.equity(fill_rows(t), month_grid(t), 1e6)


@query("SELECT run, d, round(cash, 2) AS cash, round(value, 2) AS value, round(cash + value, 2) AS equity FROM eqd", LEDGER)
def pipe_ledger_equity(t: Tables) -> DataFrame:
    return rounded(ledger(t), 2)


@query("SELECT run, round(arg_max(cash + value, d), 2) AS final_equity, (SELECT round(sum(cost), 2) FROM fl WHERE fl.run = eqd.run) AS total_cost, count(*) AS sessions FROM eqd GROUP BY run", LEDGER)
def agg_ledger_summary(t: Tables) -> DataFrame:
    e = ledger(t).groupBy("run").agg(F.round(F.max_by("equity", "d"), 2).alias("final_equity"), F.count("*").alias("sessions"))
    return e.join(fill_rows(t).groupBy("run").agg(F.round(F.sum("cost"), 2).alias("total_cost")), "run")


@query("SELECT pos AS n, round(avg(close / c2), 6) AS equity FROM (SELECT *, max(close) FILTER (pos = 2) OVER (PARTITION BY asset) AS c2 FROM own) WHERE pos >= 2 AND pos <= 100 GROUP BY pos", OWN)
def pipe_buy_hold(t: Tables) -> DataFrame:
    b = t.px_daily.withColumn("n", F.row_number().over(Window.partitionBy("asset").orderBy("d")).cast("long"))
    base = b.where("n = 2").select("asset", F.col("close").alias("c2"))
    return rounded(b.where("n >= 2 and n <= 100").join(base, "asset").groupBy("n").agg(F.avg(F.col("close") / F.col("c2")).alias("equity")))


@query("SELECT pos AS n, round(avg(close / c2), 6) AS equity FROM (SELECT *, max(close) FILTER (pos = 2) OVER (PARTITION BY asset) AS c2 FROM own) WHERE pos >= 2 GROUP BY pos", OWN)
def pipe_buy_hold_all(t: Tables) -> DataFrame:
    """pipe_buy_hold from the second session to the last."""
    b = t.px_daily.withColumn("n", F.row_number().over(Window.partitionBy("asset").orderBy("d")).cast("long"))
    base = b.where("n = 2").select("asset", F.col("close").alias("c2"))
    return rounded(b.where("n >= 2").join(base, "asset").groupBy("n").agg(F.avg(F.col("close") / F.col("c2")).alias("equity")))


ATTR = MRET + ", att AS (SELECT a.asset AS portfolio, a.x AS ret, b.x AS bench, -0.0001 AS cost, lag(a.x, 1, 0) OVER (PARTITION BY a.asset ORDER BY a.pos) AS ideal FROM mr a JOIN mr b ON b.pos = a.pos AND b.asset = (SELECT asset FROM assets WHERE ord = 0))"


@query("""SELECT portfolio, round(total, 6) AS total, round(beta, 6) AS beta, round(beta * mt, 6) AS market, round(cost, 6) AS cost, round(timing, 6) AS timing, round(total - beta * mt - cost - timing, 6) AS alpha FROM (
    SELECT portfolio, product(1 + ret) - 1 AS total, product(1 + bench) - 1 AS mt, coalesce(covar_samp(ret, bench) / nullif(var_samp(bench), 0), 0) AS beta, sum(cost)::DOUBLE AS cost, sum(ret - ideal) AS timing FROM att GROUP BY portfolio)""", ATTR)
def agg_attribution(t: Tables) -> DataFrame:
    r = month_returns(t).withColumn("ideal", F.lag("x", 1, 0.0).over(g.by_asset()))
    b = r.join(F.broadcast(t.assets.where("ord = 0").select("asset")), "asset").select("pos", F.col("x").alias("bench"))
    return rounded(le.attribution(r.join(F.broadcast(b), "pos").select(F.col("asset").alias("portfolio"), F.col("x").alias("ret"), "bench", F.lit(-0.0001).alias("cost"), "ideal")))


@query("""SELECT asset, count(*) FILTER (p <> 0) AS n, round(avg((sign(p) = sign(x))::INTEGER) FILTER (p <> 0), 6) AS hit_rate, round(avg(x) FILTER (p <> 0 AND sign(p) = sign(x)), 6) AS mean_right, round(avg(x) FILTER (p <> 0 AND sign(p) <> sign(x)), 6) AS mean_wrong FROM (SELECT *, lag(x) OVER (PARTITION BY asset ORDER BY pos) AS p FROM mr) GROUP BY asset""", MRET)
def agg_hit_rate(t: Tables) -> DataFrame:
    r = month_returns(t).withColumn("p", F.lag("x").over(g.by_asset())).where("p != 0").withColumn("hit", F.signum("p") == F.signum("x"))
    every = month_returns(t).select("asset").distinct()
    out = r.groupBy("asset").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("int")).alias("hit_rate"), F.avg(F.when(F.col("hit"), F.col("x"))).alias("mean_right"), F.avg(F.when(~F.col("hit"), F.col("x"))).alias("mean_wrong"))
    return rounded(every.join(out, "asset", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))))


@query("""SELECT pos, round(covar_pop(rp, rx) / nullif(stddev_pop(rp) * stddev_pop(rx), 0), 6) + 0.0::DOUBLE AS ic FROM (SELECT pos, rank() OVER (PARTITION BY pos ORDER BY p) + (count(*) OVER (PARTITION BY pos, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY pos ORDER BY x) + (count(*) OVER (PARTITION BY pos, x) - 1) / 2.0 AS rx
    FROM (SELECT *, lag(x) OVER (PARTITION BY asset ORDER BY pos) AS p FROM mr) WHERE p IS NOT NULL) GROUP BY pos HAVING count(*) >= 3""", MRET)
def agg_ic(t: Tables) -> DataFrame:
    r = month_returns(t).withColumn("p", F.lag("x").over(g.by_asset())).where("p is not null")
    rank = lambda c: F.rank().over(Window.partitionBy("pos").orderBy(c)) + (F.count("*").over(Window.partitionBy("pos", c)) - 1) / 2
    return rounded(r.select("pos", rank("p").alias("rp"), rank("x").alias("rx")).groupBy("pos").agg(F.count("*").alias("n"), correlation("rp", "rx").alias("ic")).where("n >= 3").select("pos", "ic"))



