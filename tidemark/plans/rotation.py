"""Queries of the rotation lab: resampling, scores, portfolios, relative rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import grid as g
from ..operators import groups as gr
from ..operators import rotation as ro
from ..operators import sweep as sw
from .registry import query, rounded
from .views import Tables

HOW = ro.Rotation()
METHODS = (ro.EQUAL, ro.MOMENTUM, ro.INVERSE_VOLATILITY, ro.CUSTOM)

SCORED = """
scored AS (
    SELECT *, close / lag(close, 1) OVER w - 1 AS ret,
        0.0::DOUBLE + (close / lag(close, 1) OVER w - 1) * (0.5::DOUBLE / 1.0) + (close / lag(close, 3) OVER w - 1) * (0.3::DOUBLE / 1.0) + (close / lag(close, 6) OVER w - 1) * (0.2::DOUBLE / 1.0) AS score
    FROM grid WINDOW w AS (PARTITION BY asset ORDER BY pos)
),
vols AS (
    SELECT *, CASE WHEN count(ret) OVER w = 6 THEN stddev_samp(ret) OVER w * sqrt(12) END AS vol FROM scored
    WINDOW w AS (PARTITION BY asset ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
),
defensive AS (SELECT asset FROM assets WHERE ord = 1),
candidates AS (SELECT * FROM vols WHERE ord > 1),
top AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, ord) AS rnk FROM candidates WHERE score > 0 QUALIFY rnk <= 5),
methods AS (
    SELECT d, pos, asset, 'Equal weight' AS method, 1.0::DOUBLE / count(*) OVER (PARTITION BY d) AS weight FROM top
    UNION ALL SELECT d, pos, asset, 'Momentum weight', score / sum(score) OVER (PARTITION BY d) FROM top
    UNION ALL SELECT d, pos, asset, 'Inverse volatility', coalesce((1 / nullif(vol, 0)) / sum(1 / nullif(vol, 0)) OVER (PARTITION BY d), CASE WHEN sum(1 / nullif(vol, 0)) OVER (PARTITION BY d) IS NULL THEN 1.0::DOUBLE / count(*) OVER (PARTITION BY d) ELSE 0 END) FROM top
    UNION ALL SELECT d, pos, asset, 'Custom rank weights', coalesce([0.4, 0.3, 0.2, 0.1][rnk]::DOUBLE, 0) / sum(coalesce([0.4, 0.3, 0.2, 0.1][rnk]::DOUBLE, 0)) OVER (PARTITION BY d) FROM top
),
bare AS (SELECT d, pos FROM cal_month WHERE d NOT IN (SELECT d FROM top)),
target AS (
    SELECT d, pos, asset, method, weight FROM methods
    UNION ALL SELECT b.d, b.pos, f.asset, m.method, 1.0 FROM bare b, defensive f, (SELECT DISTINCT method FROM methods) m
),
held AS (
    SELECT g.d, g.pos, g.asset, g.ret, m.method, coalesce(t.weight, 0) AS weight
    FROM vols g CROSS JOIN (SELECT DISTINCT method FROM methods) m LEFT JOIN target t ON t.d = g.d AND t.asset = g.asset AND t.method = m.method
),
deployed AS (SELECT *, lag(weight, 1, 0) OVER w AS dep FROM held WINDOW w AS (PARTITION BY method, asset ORDER BY pos)),
moves AS (SELECT *, abs(dep - lag(dep) OVER w) AS moved FROM deployed WINDOW w AS (PARTITION BY method, asset ORDER BY pos)),
run AS (
    SELECT method, d, pos, coalesce(sum(dep * ret), 0) AS gross, coalesce(sum(moved) / 2, 0) AS turnover FROM moves GROUP BY ALL
    HAVING pos >= (SELECT min(pos) + 1 FROM candidates WHERE score IS NOT NULL)
),
net AS (SELECT *, turnover * 0.001 AS cost, gross - turnover * 0.001 AS net FROM run)
"""


def month_grid(t: Tables) -> DataFrame:
    return t.kept("month_grid", lambda: ro.panel(t.px_daily, t.assets, "Monthly"))


def defensive(t: Tables) -> str:
    return t.assets.where("ord = 1").first()["asset"]  # one row of a dimension


def with_defensive(t: Tables, **more) -> ro.Rotation:
    return ro.Rotation(defensive=defensive(t), **more)


def candidates(t: Tables) -> list[str]:
    return [r["asset"] for r in t.assets.where("ord > 1").collect()]  # 23 rows of a dimension


def scores(t: Tables) -> DataFrame:
    return ro.scored(month_grid(t), HOW).where("ord > 1")


@query("SELECT d, pos, asset, close FROM px_month")
def agg_resample(t: Tables) -> DataFrame:
    return g.resample(t.px_daily, "Monthly")


@query("""SELECT max(c.d) AS d, p.asset, arg_max(p.close, p.d) AS close FROM px_daily p
    JOIN (SELECT d + CAST((5 - isodow(d) + 7) % 7 AS INTEGER) AS wk, max(d) AS d FROM px_daily GROUP BY 1) c ON c.wk = p.d + CAST((5 - isodow(p.d) + 7) % 7 AS INTEGER) GROUP BY c.wk, p.asset""")
def agg_resample_weekly(t: Tables) -> DataFrame:
    return g.resample(t.px_daily, "Weekly").select("d", "asset", "close")


@query("SELECT d, asset, round(close / lag(close, 3) OVER (PARTITION BY asset ORDER BY pos) - 1, 6) AS ret FROM grid")
def win_return_k(t: Tables) -> DataFrame:
    return rounded(month_grid(t).select("d", "asset", g.change(3).alias("ret")))


@query("SELECT d, asset, last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY pos ROWS UNBOUNDED PRECEDING) AS close FROM grid")
def win_ffill(t: Tables) -> DataFrame:
    return month_grid(t).select("d", "asset", g.forward_filled().alias("close"))


@query("SELECT d, asset, round(score, 6) AS score, round(CASE WHEN vol <> 0 THEN score / vol END, 6) AS risk_adjusted FROM candidates", SCORED)
def win_score(t: Tables) -> DataFrame:
    return rounded(scores(t).select("d", "asset", "score", F.try_divide("score", F.nullif("vol", F.lit(0.0))).alias("risk_adjusted")))


@query("SELECT d, asset, rnk FROM top", SCORED)
def top_assets(t: Tables) -> DataFrame:
    return ro.selected(scores(t), HOW).select("d", "asset", F.col("rnk").cast("long").alias("rnk"))


@query("SELECT d, asset, method, round(weight, 6) AS weight FROM target", SCORED)
def pipe_rotation_weights(t: Tables) -> DataFrame:
    s, safe = scores(t), defensive(t)
    parts = [ro.target_weights(s, ro.Rotation(weighting=m, defensive=safe)).withColumn("method", F.lit(m)) for m in METHODS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out.select("d", "asset", "method", "weight"))


def equal_run(t: Tables) -> DataFrame:
    return ro.backtest(month_grid(t).where("ord > 0"), with_defensive(t))


@query("SELECT d, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(cost, 6) AS cost, round(net, 6) AS net FROM net WHERE method = 'Equal weight'", SCORED)
def pipe_rotation_backtest(t: Tables) -> DataFrame:
    return rounded(equal_run(t).drop("pos"))


@query("SELECT method, d, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(net, 6) AS net FROM net", SCORED)
def pipe_rotation_sweep(t: Tables) -> DataFrame:
    """A run for each way of weighting."""
    out = sw.sweep(month_grid(t).where("ord > 0").withColumn("frequency", F.lit("Monthly")), configurations(t, frequencies=("Monthly",), tops=(5,), lookbacks=("1-3-6",)))
    return rounded(out.select(F.split("config_id", "/")[2].alias("method"), "d", "gross", "turnover", "net"))


#: Lookbacks by name: rows back and their weights.
LOOKBACKS = {"1-3-6": {1: 0.5, 3: 0.3, 6: 0.2}, "1": {1: 1.0}, "2-12": {2: 1.0, 12: 3.0}}


def configurations(t: Tables, frequencies: tuple = ("Weekly", "Monthly"), tops: tuple = (3, 5), weightings: tuple = METHODS, lookbacks: tuple = tuple(LOOKBACKS), risk_adjusted: tuple = (False,)) -> DataFrame:
    """Every combination, as a table."""
    safe = defensive(t)
    rows = [
        (f"{f}/{n}/{w}/{k}/{'risk' if r else 'plain'}", f, n, w, LOOKBACKS[k], [0.4, 0.3, 0.2, 0.1], True, r, 6, 10.0 if f == "Monthly" else 25.0, safe)
        for f in frequencies for n in tops for w in weightings for k in lookbacks for r in risk_adjusted
    ]
    return t.spark.createDataFrame(rows, sw.CONFIG)


def swept_grids(t: Tables) -> DataFrame:
    weeks = t.kept("week_grid", lambda: ro.panel(t.px_daily, t.assets, "Weekly"))
    both = weeks.withColumn("frequency", F.lit("Weekly")).unionByName(month_grid(t).withColumn("frequency", F.lit("Monthly")))
    return both.where("ord > 0")


SWEPT = """
per AS (SELECT 'Monthly' AS frequency, date_trunc('month', d) AS period, d FROM (SELECT DISTINCT d FROM px_daily) UNION ALL SELECT 'Weekly', d + CAST((5 - isodow(d) + 7) % 7 AS INTEGER), d FROM (SELECT DISTINCT d FROM px_daily)),
cal AS (SELECT frequency, period, max(d) AS d, row_number() OVER (PARTITION BY frequency ORDER BY period) AS pos FROM per GROUP BY frequency, period),
sampled AS (SELECT c.frequency, c.pos, p.asset, arg_max(p.close, p.d) AS close FROM px_daily AS p JOIN per ON per.d = p.d JOIN cal AS c ON c.frequency = per.frequency AND c.period = per.period GROUP BY ALL),
gs AS (SELECT c.frequency, c.d, c.pos, a.asset, a.ord, s.close FROM cal AS c CROSS JOIN assets AS a LEFT JOIN sampled AS s ON s.frequency = c.frequency AND s.pos = c.pos AND s.asset = a.asset WHERE a.ord > 0),
rets AS (SELECT *, close / lag(close) OVER (PARTITION BY frequency, asset ORDER BY pos) - 1 AS ret FROM gs),
vs AS (SELECT *, CASE WHEN count(ret) OVER w = 6 THEN stddev_samp(ret) OVER w * sqrt(CASE frequency WHEN 'Weekly' THEN 52 ELSE 12 END) END AS vol FROM rets WINDOW w AS (PARTITION BY frequency, asset ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
lk AS (SELECT * FROM (VALUES ('1-3-6', 1, 0.5::DOUBLE), ('1-3-6', 3, 0.3), ('1-3-6', 6, 0.2), ('1', 1, 1.0), ('2-12', 2, 0.25), ('2-12', 12, 0.75)) AS x(lookbacks, k, w)),
raws AS (
    SELECT g.frequency, g.pos, g.asset, lookbacks, CASE WHEN count(g.close / p.close) = any_value(n) THEN sum(w * (g.close / p.close - 1)) END AS raw
    FROM gs AS g CROSS JOIN (SELECT *, count(*) OVER (PARTITION BY lookbacks) AS n FROM lk) AS l LEFT JOIN gs AS p ON p.frequency = g.frequency AND p.asset = g.asset AND p.pos = g.pos - l.k GROUP BY ALL
),
cf AS (
    SELECT frequency || '/' || top_n || '/' || weighting || '/' || lookbacks || '/' || kind AS config_id, *, CASE frequency WHEN 'Weekly' THEN 0.0025::DOUBLE ELSE 0.001 END AS fee
    FROM (VALUES ('Weekly'), ('Monthly')) AS a(frequency), (VALUES (3), (5)) AS b(top_n), (VALUES ('Equal weight'), ('Momentum weight'), ('Inverse volatility'), ('Custom rank weights')) AS c(weighting),
        (SELECT DISTINCT lookbacks FROM lk), (VALUES ('plain'), ('risk')) AS e(kind)
),
sc AS (SELECT cf.*, v.d, v.pos, v.asset, v.ord, v.ret, v.vol, CASE kind WHEN 'risk' THEN raw / nullif(vol, 0) ELSE raw END AS score FROM cf JOIN vs AS v USING (frequency) JOIN raws AS r ON r.frequency = cf.frequency AND r.lookbacks = cf.lookbacks AND r.pos = v.pos AND r.asset = v.asset),
tp AS (SELECT *, row_number() OVER (PARTITION BY config_id, d ORDER BY score DESC, ord) AS rnk FROM sc WHERE ord > 1 AND score > 0 QUALIFY rnk <= top_n),
wt AS (
    SELECT config_id, d, asset, CASE weighting WHEN 'Equal weight' THEN 1.0::DOUBLE / count(*) OVER w WHEN 'Momentum weight' THEN score / sum(score) OVER w
        WHEN 'Inverse volatility' THEN coalesce((1 / nullif(vol, 0)) / sum(1 / nullif(vol, 0)) OVER w, CASE WHEN sum(1 / nullif(vol, 0)) OVER w IS NULL THEN 1.0::DOUBLE / count(*) OVER w ELSE 0 END)
        ELSE coalesce([0.4, 0.3, 0.2, 0.1][rnk]::DOUBLE, 0) / sum(coalesce([0.4, 0.3, 0.2, 0.1][rnk]::DOUBLE, 0)) OVER w END AS weight
    FROM tp WINDOW w AS (PARTITION BY config_id, d)
),
hd AS (SELECT s.config_id, s.fee, s.d, s.pos, s.asset, s.ret, CASE WHEN s.ord > 1 THEN s.score END AS score,
    coalesce(w.weight, CASE WHEN s.ord = 1 AND NOT EXISTS (SELECT 1 FROM wt WHERE wt.config_id = s.config_id AND wt.d = s.d) THEN 1.0 END, 0) AS weight FROM sc AS s LEFT JOIN wt AS w ON w.config_id = s.config_id AND w.d = s.d AND w.asset = s.asset),
dp AS (SELECT *, lag(weight, 1, 0) OVER (PARTITION BY config_id, asset ORDER BY pos) AS dep FROM hd),
mv AS (SELECT *, abs(dep - lag(dep) OVER (PARTITION BY config_id, asset ORDER BY pos)) AS moved FROM dp),
dy AS (SELECT config_id, d, pos, any_value(fee) AS fee, coalesce(sum(dep * ret), 0) AS gross, coalesce(sum(moved) / 2, 0) AS turnover, count(score) AS n FROM mv GROUP BY config_id, d, pos),
st AS (SELECT config_id, min(pos) + 1 AS start FROM dy WHERE n > 0 GROUP BY config_id)
"""


@query("SELECT config_id, d, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(turnover * fee, 6) AS cost, round(gross - turnover * fee, 6) AS net FROM dy JOIN st USING (config_id) WHERE pos >= start", SWEPT)
def pipe_rotation_sweep_table(t: Tables) -> DataFrame:
    """Ninety-six configurations: frequencies, numbers held, weightings, lookbacks, scores by themselves or by risk, and costs."""
    return rounded(sw.sweep(swept_grids(t), configurations(t, risk_adjusted=(False, True))).drop("pos"))


@query("SELECT d, asset, round(dep, 6) AS deployed, round(coalesce(moved, 0), 6) AS moved FROM moves WHERE method = 'Equal weight' AND asset <> (SELECT asset FROM assets WHERE ord = 0)", SCORED)
def win_signal_shift(t: Tables) -> DataFrame:
    target = ro.target_weights(scores(t), with_defensive(t))
    held = month_grid(t).where("ord > 0").join(target, ["d", "asset"], "left").withColumn("deployed", F.lag(F.coalesce("weight", F.lit(0.0)), 1, 0.0).over(g.by_asset()))
    return rounded(held.select("d", "asset", "deployed", F.coalesce(F.abs(F.col("deployed") - F.lag("deployed").over(g.by_asset())), F.lit(0.0)).alias("moved")))


@query("SELECT g.d, round(sum(dep * ret), 6) AS gross FROM moves g WHERE method = 'Equal weight' GROUP BY g.d HAVING gross IS NOT NULL", SCORED)
def jn_weights_returns(t: Tables) -> DataFrame:
    target = ro.target_weights(scores(t), with_defensive(t))
    w = g.by_asset()
    held = month_grid(t).where("ord > 0").withColumn("ret", g.change(1)).join(target, ["d", "asset"], "left").withColumn("deployed", F.lag(F.coalesce("weight", F.lit(0.0)), 1, 0.0).over(w))
    return rounded(held.groupBy("d").agg(F.sum(F.col("deployed") * F.col("ret")).alias("gross")).where("gross is not null"))


EQUITY = SCORED + """, eq AS (SELECT *, exp(sum(ln(1 + net)) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS equity FROM net WHERE method = 'Equal weight'),
dd AS (SELECT *, equity / max(equity) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM eq)"""


@query("SELECT d, round(equity, 6) AS equity FROM dd", EQUITY)
def win_equity(t: Tables) -> DataFrame:
    return rounded(ro.equity(equal_run(t)).select("d", "equity"))


@query("SELECT d, round(drawdown, 6) AS drawdown FROM dd", EQUITY)
def win_drawdown(t: Tables) -> DataFrame:
    return rounded(ro.equity(equal_run(t)).select("d", "drawdown"))


@query("""SELECT count(*) AS n, round(power(product(1 + net), 12.0 / count(*)) - 1, 6) AS cagr, round(stddev_samp(net) * sqrt(12), 6) AS volatility, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(12), 6) AS sharpe,
    round(min(drawdown), 6) AS max_drawdown, round(avg((net > 0)::INTEGER), 6) AS win_rate FROM dd""", EQUITY)
def agg_perf(t: Tables) -> DataFrame:
    return rounded(ro.performance(equal_run(t), 12))


@query("SELECT d, round(coalesce(close / lag(close) OVER (ORDER BY pos) - 1, 0), 6) AS ret FROM grid WHERE ord = 0")
def win_benchmark(t: Tables) -> DataFrame:
    return rounded(month_grid(t).where("ord = 0").select("d", F.coalesce(g.change(1), F.lit(0.0)).alias("ret")))


@query("""SELECT d, round(coalesce(f / lag(f) OVER (ORDER BY pos) - 1, 0), 6) AS ret FROM (
    SELECT c.d, c.pos, last_value(p.close IGNORE NULLS) OVER (ORDER BY c.pos ROWS UNBOUNDED PRECEDING) AS f FROM cal_month c LEFT JOIN (SELECT d, close FROM px_daily WHERE asset = (SELECT asset FROM assets WHERE ord = 0)) p ON p.d = c.d)""")
def win_price_benchmark(t: Tables) -> DataFrame:
    own = t.px_daily.join(F.broadcast(t.assets.where("ord = 0").select("asset")), "asset").select("d", "close")
    on_grid = g.calendar(t.px_daily, "Monthly").join(own, "d", "left")
    w = Window.orderBy("pos")  # one row a month
    filled = on_grid.withColumn("f", F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rounded(filled.select("d", F.coalesce(F.col("f") / F.lag("f").over(w) - 1, F.lit(0.0)).alias("ret")))


@query("""SELECT v.d, v.asset, v.grp, round(v.score, 6) AS score, round(coalesce(m.weight, 0), 6) AS weight FROM candidates v LEFT JOIN target m ON m.d = v.d AND m.asset = v.asset AND m.method = 'Equal weight'
    WHERE v.pos = (SELECT max(pos) FROM cal_month) AND v.score IS NOT NULL ORDER BY v.score DESC""", SCORED)
def srt_ranking(t: Tables) -> DataFrame:
    s = scores(t)
    last = F.broadcast(s.agg(F.max("pos").alias("pos")))
    now = s.join(last, "pos").where("score is not null")
    target = ro.target_weights(now, HOW)
    return rounded(now.join(target, ["d", "asset"], "left").orderBy(F.desc("score"), "ord").select("d", "asset", "grp", "score", F.coalesce("weight", F.lit(0.0)).alias("weight")))


@query("""SELECT grp, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score, count(*) FILTER (score > 0) AS n_positive, count(*) AS n FROM candidates WHERE pos = (SELECT max(pos) FROM cal_month) AND score IS NOT NULL GROUP BY grp""", SCORED)
def agg_group_score(t: Tables) -> DataFrame:
    s = scores(t)
    now = s.join(F.broadcast(s.agg(F.max("pos").alias("pos"))), "pos").where("score is not null")
    return rounded(now.groupBy("grp").agg(F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.count_if(F.col("score") > 0).alias("n_positive"), F.count("*").alias("n")))


RRG = """
rets AS (SELECT *, close / lag(close) OVER (PARTITION BY asset ORDER BY pos) - 1 AS ret FROM grid WHERE ord > 1),
gret AS (SELECT d, pos, grp, coalesce(avg(ret), 0) AS ret FROM rets GROUP BY ALL),
gidx AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY grp ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS idx FROM gret),
bench AS (SELECT pos, close AS b, first_value(close IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b0,
    close / lag(close, 3) OVER (ORDER BY pos) - 1 AS b_short, close / lag(close, 10) OVER (ORDER BY pos) - 1 AS b_long FROM grid WHERE ord = 0),
rs AS (SELECT i.*, idx / (b / b0) AS rs, b_short, b_long FROM gidx i LEFT JOIN bench USING (pos)),
ratios AS (SELECT *, CASE WHEN count(rs) OVER w = 10 THEN rs / avg(rs) OVER w * 100 END AS ratio FROM rs WINDOW w AS (PARTITION BY grp ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
rrg AS (SELECT *, (ratio / lag(ratio, 3) OVER w - 1) * 100 AS momentum, idx / lag(idx, 3) OVER w - 1 - b_short AS short_excess, idx / lag(idx, 10) OVER w - 1 - b_long AS long_excess FROM ratios WINDOW w AS (PARTITION BY grp ORDER BY pos)),
quads AS (SELECT *, CASE WHEN ratio IS NULL OR momentum IS NULL THEN 'Unavailable' WHEN ratio >= 100 AND momentum >= 0 THEN 'Leading' WHEN ratio >= 100 THEN 'Weakening' WHEN momentum >= 0 THEN 'Improving' ELSE 'Lagging' END AS quadrant FROM rrg),
members AS (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY excess DESC NULLS LAST, ord) AS rnk FROM (
        SELECT g.asset, g.grp, g.ord, g.pos, g.close / lag(g.close, 3) OVER (PARTITION BY g.asset ORDER BY g.pos) - 1 - b_short AS excess FROM grid g JOIN bench USING (pos) WHERE g.ord > 1)
    WHERE pos = (SELECT max(pos) FROM quads WHERE ratio IS NOT NULL)
),
latest AS (SELECT * FROM quads WHERE pos = (SELECT max(pos) FROM quads WHERE ratio IS NOT NULL) AND quadrant <> 'Unavailable')
"""


def groups_grid(t: Tables) -> DataFrame:
    return month_grid(t).where("ord > 1")


def strength(t: Tables) -> DataFrame:
    return gr.relative_strength(gr.group_index(groups_grid(t)), month_grid(t).where("ord = 0"), 10, 3)


@query("SELECT d, grp, round(idx, 6) AS idx FROM gidx", RRG)
def win_group_index(t: Tables) -> DataFrame:
    return rounded(gr.group_index(groups_grid(t)).select("d", "grp", "idx"))


@query("SELECT d, asset, grp, close FROM grid")
def jn_group_map(t: Tables) -> DataFrame:
    return month_grid(t).drop("grp").join(F.broadcast(t.assets.select("asset", "grp")), "asset").select("d", "asset", "grp", "close")


@query("SELECT d, grp, round(ratio, 6) AS ratio, round(momentum, 6) AS momentum FROM rrg", RRG)
def win_rrg(t: Tables) -> DataFrame:
    return rounded(strength(t).select("d", "grp", "ratio", "momentum"))


@query("SELECT d, grp, quadrant FROM quads", RRG)
def lbl_quadrant(t: Tables) -> DataFrame:
    return strength(t).select("d", "grp", gr.quadrant(F.col("ratio"), F.col("momentum")).alias("quadrant"))


@query("SELECT d, grp, round(ratio, 6) AS ratio, round(momentum, 6) AS momentum FROM rrg WHERE ratio IS NOT NULL AND momentum IS NOT NULL QUALIFY row_number() OVER (PARTITION BY grp ORDER BY pos DESC) <= 8", RRG)
def win_rrg_tail(t: Tables) -> DataFrame:
    kept = strength(t).where("ratio is not null and momentum is not null").withColumn("back", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("pos"))))
    return rounded(kept.where("back <= 8").select("d", "grp", "ratio", "momentum"))


def summary(t: Tables) -> DataFrame:
    return gr.rotation_summary(groups_grid(t), month_grid(t).where("ord = 0"), 3, 10, 3)


@query("""SELECT d, l.grp, quadrant, round(ratio, 6) AS ratio, round(momentum, 6) AS momentum, round(short_excess, 6) AS short_excess, round(long_excess, 6) AS long_excess, round(m.breadth, 6) AS breadth
    FROM latest l JOIN (SELECT grp, avg(coalesce((excess > 0)::INTEGER, 0)) AS breadth FROM members GROUP BY grp) m ON m.grp = l.grp""", RRG)
def pipe_rrg(t: Tables) -> DataFrame:
    return rounded(summary(t).drop("leaders", "reason"))


@query("SELECT grp, asset, rnk, round(excess, 6) AS excess FROM members WHERE rnk <= 3 AND excess IS NOT NULL", RRG)
def top_rotation_leaders(t: Tables) -> DataFrame:
    grid, bench = groups_grid(t), month_grid(t).where("ord = 0")
    b = bench.select("pos", (F.col("close") / F.lag("close", 3).over(Window.orderBy("pos")) - 1).alias("b"))
    last = F.broadcast(strength(t).where("ratio is not null").agg(F.max("pos").alias("pos")))
    m = grid.withColumn("r", g.change(3)).join(last, "pos").join(b, "pos").withColumn("excess", F.col("r") - F.col("b"))
    m = m.withColumn("rnk", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc_nulls_last("excess"), "ord")).cast("long"))
    return rounded(m.where("rnk <= 3 and excess is not null").select("grp", "asset", "rnk", "excess"))


@query("""SELECT grp, row_number() OVER (ORDER BY CASE quadrant WHEN 'Improving' THEN 0 WHEN 'Leading' THEN 1 WHEN 'Weakening' THEN 2 ELSE 3 END, momentum DESC, short_excess DESC) AS place FROM latest""", RRG)
def srt_rotation(t: Tables) -> DataFrame:
    w = Window.orderBy(gr.chosen(F.col("quadrant"), gr.PRIORITY), F.desc("momentum"), F.desc("short_excess"))  # one row a group
    return summary(t).select("grp", F.row_number().over(w).cast("long").alias("place"))


@query("""SELECT grp, quadrant FROM latest WHERE quadrant = CASE WHEN (SELECT count(*) FROM latest WHERE quadrant = 'Improving') > 0 THEN 'Improving' ELSE 'Leading' END ORDER BY momentum DESC LIMIT 3""", RRG)
def top_rotation_focus(t: Tables) -> DataFrame:
    s = summary(t)
    some = F.count_if(F.col("quadrant") == "Improving").over(Window.partitionBy()) > 0  # one row a group
    return s.withColumn("some", some).where(F.col("quadrant") == F.when(F.col("some"), "Improving").otherwise("Leading")).orderBy(F.desc("momentum")).limit(3).select("grp", "quadrant")


@query("""SELECT grp, quadrant, reason FROM (SELECT l.grp, quadrant, CASE quadrant WHEN 'Leading' THEN '相對強度高於基準且動能仍在增強' WHEN 'Improving' THEN '相對強度尚低於基準，但動能已翻正' WHEN 'Weakening' THEN '相對強度仍高於基準，但動能正在降溫' ELSE '相對強度低於基準且動能仍為負' END
    || '；短期超額 ' || printf('%+.1f%%', round(100 * short_excess, 1)) || '、中期超額 ' || printf('%+.1f%%', round(100 * long_excess, 1)) || '，' || printf('%.0f%%', round(100 * b.breadth, 0)) || ' 成分股跑贏基準。' AS reason
    FROM latest l JOIN (SELECT grp, avg(coalesce((excess > 0)::INTEGER, 0)) AS breadth FROM members GROUP BY grp) b ON b.grp = l.grp)""", RRG)
def lbl_rrg_reason(t: Tables) -> DataFrame:
    return summary(t).select("grp", "quadrant", "reason")
