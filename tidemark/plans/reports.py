"""Queries of the daily reports: the watch list and the brief."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grid as g
from ..operators import reports as re
from .registry import query, rounded
from .research import EWMA, OWN, TREND, daily, daily_returns
from .views import Tables

HOW = re.Watching(trend=0.002)

#: All bars, with what a gate must find: a negative volume here, a jump there.
WATCHED = """watch_bars AS (SELECT d, asset, CASE WHEN asset LIKE '%7' AND day(d) = 21 THEN close * 1.15 ELSE close END AS close, CASE WHEN asset
        LIKE '%4' AND day(d) = 14 THEN -volume ELSE volume END AS volume
    FROM px_daily), """ + (EWMA + TREND.removeprefix(OWN)).replace("FROM px_daily", "FROM watch_bars") + """,
wb AS (SELECT *, volume >= 0 AND close > 0 AS sound, row_number() OVER (PARTITION BY asset ORDER BY pos DESC) AS back FROM own),
wl AS (SELECT *, last_value(CASE WHEN sound THEN close END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1
        PRECEDING) AS b FROM wb),
wq AS (SELECT asset, count(*) AS n, count(*) FILTER (volume < 0) + count(*) FILTER (close <= 0) + count(*) FILTER (sound AND abs(close / b - 1) >
        0.105) AS faults, arg_max(close, pos) AS close,
    max(close) FILTER (back = 22) AS e, max(close) FILTER (back = 202) AS s, arg_min(close, pos) AS f FROM wl GROUP BY asset),
wn AS (SELECT *, CASE WHEN n < 60 THEN 1 ELSE faults END AS n_alerts FROM wq),
wm AS (SELECT *, CASE WHEN n_alerts = 0 AND n > 201 THEN e / s - 1 WHEN n_alerts = 0 AND n > 41 THEN e / f - 1 END AS momentum FROM wn),
wk AS (SELECT *, momentum IS NOT NULL AND row_number() OVER (ORDER BY momentum DESC NULLS LAST, asset) <= 2 AS candidate FROM wm),
ww AS (SELECT asset, 1.0::DOUBLE / count(*) OVER () AS weight FROM wk WHERE candidate),
wv AS (SELECT p.asset AS entity, avg(p.volume * p.close) AS adv_value FROM px_daily p GROUP BY p.asset),
wc AS (SELECT 'POSITION' AS code FROM ww WHERE weight > 0.05 UNION SELECT 'SECTOR' FROM ww HAVING sum(weight) > 0.25 UNION SELECT 'GROSS' FROM ww
        HAVING sum(weight) > 1
    UNION SELECT 'NET' FROM ww HAVING sum(weight) > 0.6 UNION SELECT 'TOP5' FROM ww HAVING sum(weight) > 0.4 UNION SELECT 'ADV' FROM ww JOIN wv ON
        entity = asset WHERE 1e7 * weight / adv_value > 0.05)"""


def watched(t: Tables) -> DataFrame:
    day = F.dayofmonth("d")
    jumps, bad = F.col("asset").endswith("7") & (day == 21), F.col("asset").endswith("4") & (day == 14)
    return daily(t).withColumn("close", F.when(jumps, F.col("close") * 1.15).otherwise(F.col("close"))).withColumn("volume", F.when(bad, -F.col("volume")).otherwise(F.col("volume")))


def watch(t: Tables) -> DataFrame:
    adv = t.px_daily.groupBy(F.col("asset").alias("entity")).agg(F.avg(F.col("volume") * F.col("close")).alias("adv_value"))
    return re.watchlist(watched(t), adv, HOW)


@query("""SELECT k.asset, k.n, n_alerts, n_alerts = 0 AS tradable, CASE WHEN n >= 60 THEN round(k.close, 6) END AS close, CASE WHEN n >= 60 THEN
        round(ewma_vol, 6) END AS ewma_vol, CASE WHEN n >= 60 THEN trend END AS trend,
    CASE WHEN n >= 60 THEN CASE WHEN ewma_vol >= 0.4 THEN 'EXTREME' WHEN ewma_vol >= 0.25 THEN 'HIGH' WHEN ewma_vol <= 0.12 THEN 'LOW' ELSE 'NORMAL'
        END END AS volatility, round(momentum, 6) AS momentum, candidate, weight,
    CASE WHEN candidate THEN coalesce((SELECT string_agg(code, ',' ORDER BY code) FROM wc), '') END AS breached
    FROM wk k LEFT JOIN ewma e ON e.asset = k.asset LEFT JOIN ww ON ww.asset = k.asset LEFT JOIN (SELECT asset, arg_max(trend, pos) AS trend FROM tr
        GROUP BY asset) r ON r.asset = k.asset""", WATCHED)
def pipe_watchlist(t: Tables) -> DataFrame:
    """From bars through the quality gate, volatility, trend and momentum to the two candidates and the limits that they would break."""
    return rounded(watch(t))


@query()
def pipe_watchlist_tested(t: Tables) -> DataFrame:
    """pipe_watchlist with the stationarity of each asset's returns and, where a unit root is rejected, their half-life."""
    return rounded(re.tested(watch(t), watched(t), HOW))


BRIEF = OWN + """, dr AS (SELECT d, avg(ret) AS ret, sum(ret * volume) / sum(volume) AS ideal, coalesce(max(ret) FILTER (asset = (SELECT asset FROM
        assets WHERE ord = 0)), 0) AS bench FROM own WHERE ret IS NOT NULL GROUP BY d),
dp AS (SELECT c.d, c.pos, ret, ideal, bench, CASE WHEN ret IS NOT NULL THEN -0.0001::DOUBLE END AS cost FROM cal_day c LEFT JOIN dr USING (d)),
da AS (SELECT d, pos, product(1 + ret) OVER w - 1 AS total, CASE WHEN count(ret) OVER w > 0 THEN coalesce(covar_samp(ret, bench) OVER w /
        nullif(var_samp(bench) OVER w, 0), 0) END AS beta, product(1 + bench) OVER w - 1 AS mt,
    sum(cost) OVER w AS cost_drag, sum(ret - ideal) OVER w AS timing, count(ret) OVER w AS k FROM dp WINDOW w AS (ORDER BY pos ROWS BETWEEN 20
        PRECEDING AND 1 PRECEDING)),
bb AS (SELECT o.* FROM own o JOIN assets a ON a.asset = o.asset WHERE a.ord = 0),
bw AS (SELECT x.pos, y.ret, pow(1 - 2.0::DOUBLE / 21, x.pos - y.pos) AS w FROM bb x JOIN bb y ON y.pos <= x.pos WHERE y.ret IS NOT NULL),
bm AS (SELECT pos, sum(w * ret) / sum(w) AS m FROM bw GROUP BY pos),
bv AS (SELECT pos, CASE WHEN count(*) >= 2 THEN sqrt(sum(w * (ret - m) * (ret - m)) / sum(w)) * sqrt(252) END AS v FROM bw JOIN bm USING (pos) GROUP
        BY pos),
bl AS (SELECT d, pos, CASE WHEN pos >= 60 AND avg(close) OVER s / avg(close) OVER l - 1 > 0.002 THEN 'UP' WHEN pos >= 60 AND avg(close) OVER s /
        avg(close) OVER l - 1 < -0.002 THEN 'DOWN' ELSE 'RANGING' END AS trend,
    CASE WHEN pos >= 60 AND avg(volume) OVER f / nullif(avg(volume) OVER l, 0) < 0.6 THEN 'STRESSED' ELSE 'NORMAL' END AS liquidity FROM bb
    WINDOW f AS (ORDER BY pos ROWS 4 PRECEDING), s AS (ORDER BY pos ROWS 19 PRECEDING), l AS (ORDER BY pos ROWS 59 PRECEDING)),
bs AS (SELECT d, trend, liquidity, CASE WHEN v >= 0.4 THEN 'EXTREME' WHEN v >= 0.25 THEN 'HIGH' WHEN v <= 0.12 THEN 'LOW' ELSE 'NORMAL' END AS
        volatility FROM bl LEFT JOIN bv USING (pos)),
be AS (SELECT f.d, total_net * close / 999983.0 AS w, row_number() OVER (PARTITION BY f.d ORDER BY abs(total_net * close) DESC, f.asset) AS r FROM
        flows_daily f JOIN px_daily p ON p.d = f.d AND p.asset = f.asset),
bx AS (SELECT d, sum(abs(w)) AS gross, sum(w) AS net, sum(abs(w)) FILTER (r <= 5) AS top5 FROM be GROUP BY d),
bf AS (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag = 'R' AND l_quantity > 40) AS high FROM lineitem WHERE l_returnflag <> 'N' GROUP BY
        l_orderkey),
bc AS (SELECT CAST(o_orderdate AS DATE) AS d, count(n) AS cards, count(*) FILTER (high) AS blocking, count(*) FILTER (n IS NULL) AS rejected FROM
        orders LEFT JOIN bf ON l_orderkey = o_orderkey GROUP BY 1),
bu AS (SELECT CAST(CAST(o_orderdate AS DATE) - k AS DATE) AS d, count(*) AS n FROM orders, (SELECT unnest(range(1, 4))::INTEGER AS k) WHERE
        o_orderpriority = '2-HIGH' GROUP BY 1)"""


def portfolio_days(t: Tables, calendar: DataFrame) -> DataFrame:
    """A row a session: the mean return of what traded, that of the benchmark, that by volume as the ideal, and costs."""
    first = F.max(F.when(F.col("ord") == 0, F.col("ret")))
    r = daily_returns(t).where("ret is not null").join(t.assets.select("asset", "ord"), "asset")
    days = r.groupBy("d").agg(F.avg("ret").alias("ret"), (F.sum(F.col("ret") * F.col("volume")) / F.sum("volume")).alias("ideal"), F.coalesce(first, F.lit(0.0)).alias("bench"))
    return calendar.join(days, "d", "left").withColumn("cost", F.when(F.col("ret").isNotNull(), -0.0001))


@query("""SELECT c.d, round(total, 6) + 0.0::DOUBLE AS total, round(beta, 6) + 0.0::DOUBLE AS beta, round(CASE WHEN k > 0 THEN beta * mt END, 6) +
        0.0::DOUBLE AS market, round(cost_drag, 6) + 0.0::DOUBLE AS cost_drag, round(timing, 6) + 0.0::DOUBLE AS timing, round(total - beta * mt -
        cost_drag - timing, 6) + 0.0::DOUBLE AS alpha,
    CASE WHEN s.d IS NOT NULL THEN trend || '/' || volatility || '/' || liquidity END AS label, CASE WHEN s.d IS NOT NULL THEN volatility IN ('HIGH',
        'EXTREME') OR liquidity = 'STRESSED' END AS risk_off,
    round(gross, 6) + 0.0::DOUBLE AS gross, round(net, 6) + 0.0::DOUBLE AS net, round(top5, 6) + 0.0::DOUBLE AS top5, round(greatest(gross / 1.0,
        abs(net) / 0.6, top5 / 0.4), 6) + 0.0::DOUBLE AS usage,
    coalesce(cards, 0) AS cards, coalesce(blocking, 0) AS blocking, coalesce(rejected, 0) AS rejected, coalesce(u.n, 0) AS upcoming
    FROM cal_day c JOIN da USING (pos) ASOF LEFT JOIN bs s ON c.d > s.d ASOF LEFT JOIN bx x ON c.d > x.d LEFT JOIN bc ON bc.d = c.d LEFT JOIN bu u ON
        u.d = c.d""", BRIEF)
def pipe_brief(t: Tables) -> DataFrame:
    """A row a session with what is known before it opens: the last 20 sessions' attribution, the benchmark's regime, the cards of its orders,
    the exposure of the session before, and what the next three days bring."""
    o, calendar = t.read("orders"), g.calendar(t.px_daily).select("d", "pos")
    attribution = re.attributed(portfolio_days(t, calendar)).drop("d")
    bench = daily(t).join(t.assets.where("ord = 0").select("asset"), "asset", "left_semi")
    lines = t.read("lineitem").where("l_returnflag != 'N'")
    severity = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40), "HIGH").otherwise("LOW")
    findings = lines.select(F.col("l_orderkey").alias("o_orderkey"), severity.alias("severity"), F.col("l_linenumber").cast("string").alias("detail"))
    cards = re.card_counts(o.select("o_orderkey", F.to_date("o_orderdate").alias("d")), findings, "o_orderkey")
    held = t.flows_daily.join(t.px_daily.select("d", "asset", "close"), ["d", "asset"])
    weights = held.select(F.col("d").alias("portfolio"), F.col("asset").alias("entity"), (F.col("total_net") * F.col("close") / 999_983.0).alias("weight"))
    ahead = F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.date_sub(F.to_date("o_orderdate"), k))).alias("d")
    events = o.where("o_orderpriority = '2-HIGH'").select(ahead).groupBy("d").agg(F.count("*").alias("upcoming"))
    exposure = re.exposures(weights).withColumnRenamed("portfolio", "d")
    return rounded(re.brief(calendar, attribution, re.regime_days(bench, 0.002), cards, exposure, events))
