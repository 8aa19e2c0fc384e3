"""Queries of snapshots: rankings and rotation by day, week and month, published twice as time goes by, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import groups as gr
from ..operators import rotation as ro
from ..operators import sweep as sw
from ..sources import landing, snapshots
from .registry import query, rounded
from .rotation import defensive
from .views import Tables

#: Rows back and their weights, and the long window and that of momentum, by frequency.
LOOKBACKS = {
    "Daily": {5: 0.10, 21: 0.20, 63: 0.30, 126: 0.40},
    "Weekly": {4: 0.10, 13: 0.20, 26: 0.30, 52: 0.40},
    "Monthly": {1: 0.10, 3: 0.20, 6: 0.30, 12: 0.40},
}
WINDOWS = {"Daily": (63, 21), "Weekly": (26, 4), "Monthly": (12, 3)}
TOP_N = 10
#: When the first of the two snapshots is taken.
FIRST = "1997-06-30"

#: Grids by frequency, as of the first snapshot and as of the last date.
TWICE = """
    cuts AS (SELECT DATE '1997-06-30' AS cut UNION ALL SELECT max(d) FROM px_daily),
    dates AS (SELECT DISTINCT cut, d FROM px_daily JOIN cuts ON d <= cut),
    per AS (
        SELECT cut, 'Daily' AS frequency, d AS period, d FROM dates UNION ALL SELECT cut, 'Monthly', date_trunc('month', d), d FROM dates
        UNION ALL SELECT cut, 'Weekly', d + CAST((5 - isodow(d) + 7) % 7 AS INTEGER), d FROM dates
    ),
    cal AS (SELECT cut, frequency, period, max(d) AS d, row_number() OVER (PARTITION BY cut, frequency ORDER BY period) AS pos FROM per GROUP BY cut, frequency, period),
    sampled AS (SELECT c.cut, c.frequency, c.pos, p.asset, arg_max(p.close, p.d) AS close FROM px_daily p JOIN per ON per.d = p.d JOIN cal c ON c.cut = per.cut AND c.frequency = per.frequency AND c.period = per.period GROUP BY ALL),
    gs AS (SELECT c.cut, c.frequency, c.d, c.pos, a.asset, a.grp, a.ord, s.close FROM cal c CROSS JOIN assets a LEFT JOIN sampled s ON s.cut = c.cut AND s.frequency = c.frequency AND s.pos = c.pos AND s.asset = a.asset),
    ends AS (SELECT cut, frequency, max(pos) AS pos FROM cal GROUP BY cut, frequency)"""

RANKED = TWICE + """,
    lk AS (SELECT * FROM (VALUES ('Daily', 5, 0.1::DOUBLE), ('Daily', 21, 0.2), ('Daily', 63, 0.3), ('Daily', 126, 0.4), ('Weekly', 4, 0.1), ('Weekly', 13, 0.2), ('Weekly', 26, 0.3), ('Weekly', 52, 0.4),
        ('Monthly', 1, 0.1), ('Monthly', 3, 0.2), ('Monthly', 6, 0.3), ('Monthly', 12, 0.4)) AS x(frequency, k, w)),
    sc AS (
        SELECT g.cut, g.frequency, g.d, g.asset, sum(w * (g.close / p.close - 1)) AS score
        FROM gs g JOIN ends USING (cut, frequency, pos) JOIN lk USING (frequency) JOIN gs p ON p.cut = g.cut AND p.frequency = g.frequency AND p.asset = g.asset AND p.pos = g.pos - lk.k
        WHERE g.ord > 1 GROUP BY g.cut, g.frequency, g.d, g.asset HAVING count(g.close / p.close) = 4
    ),
    pl AS (SELECT *, row_number() OVER (PARTITION BY cut, frequency ORDER BY score DESC, asset) AS place FROM sc),
    wt AS (SELECT *, CASE WHEN score > 0 AND place <= 10 THEN 1.0::DOUBLE / count(*) FILTER (score > 0 AND place <= 10) OVER (PARTITION BY cut, frequency) ELSE 0 END AS weight FROM pl)"""

ROTATED = TWICE + """,
    wn AS (SELECT * FROM (VALUES ('Daily', 63, 21), ('Weekly', 26, 4), ('Monthly', 12, 3)) AS x(frequency, long, short)),
    gw AS (SELECT gs.*, long, short FROM gs JOIN wn USING (frequency)),
    bn AS (SELECT cut, frequency, pos, close / first_value(close IGNORE NULLS) OVER (PARTITION BY cut, frequency ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS b,
        close / lag(close, short) OVER w - 1 AS b_short, close / lag(close, long) OVER w - 1 AS b_long FROM gw WHERE ord = 0 WINDOW w AS (PARTITION BY cut, frequency ORDER BY pos)),
    mb AS (SELECT *, close / lag(close) OVER w - 1 AS ret, close / lag(close, short) OVER w - 1 AS m_short FROM gw WHERE ord > 1 WINDOW w AS (PARTITION BY cut, frequency, asset ORDER BY pos)),
    gret AS (SELECT cut, frequency, long, short, d, pos, grp, coalesce(avg(ret), 0) AS ret FROM mb GROUP BY ALL),
    gidx AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY cut, frequency, grp ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS idx FROM gret),
    rs AS (SELECT *, idx / b AS rs FROM gidx JOIN bn USING (cut, frequency, pos)),
    lined AS (SELECT a.cut, a.frequency, a.grp, a.pos, CASE WHEN count(z.rs) = any_value(a.long) THEN any_value(a.rs) / avg(z.rs) * 100 END AS ratio
        FROM rs a JOIN rs z ON z.cut = a.cut AND z.frequency = a.frequency AND z.grp = a.grp AND z.pos BETWEEN a.pos - a.long + 1 AND a.pos GROUP BY a.cut, a.frequency, a.grp, a.pos),
    rr AS (SELECT rs.*, ratio, (ratio / lag(ratio, short) OVER w - 1) * 100 AS momentum, idx / lag(idx, short) OVER w - 1 - b_short AS short_excess, idx / lag(idx, long) OVER w - 1 - b_long AS long_excess
        FROM rs JOIN lined USING (cut, frequency, grp, pos) WINDOW w AS (PARTITION BY cut, frequency, grp ORDER BY pos)),
    la AS (SELECT cut, frequency, max(pos) AS pos FROM rr WHERE ratio IS NOT NULL GROUP BY cut, frequency),
    br AS (SELECT cut, frequency, grp, avg(coalesce((m_short - b_short > 0)::INTEGER, 0)) AS breadth FROM mb JOIN la USING (cut, frequency, pos) JOIN bn USING (cut, frequency, pos) GROUP BY cut, frequency, grp),
    qd AS (SELECT *, CASE WHEN ratio >= 100 AND momentum >= 0 THEN 'Leading' WHEN ratio >= 100 THEN 'Weakening' WHEN momentum >= 0 THEN 'Improving' ELSE 'Lagging' END AS quadrant
        FROM rr JOIN la USING (cut, frequency, pos) JOIN br USING (cut, frequency, grp) WHERE ratio IS NOT NULL AND momentum IS NOT NULL),
    pl AS (SELECT *, row_number() OVER (PARTITION BY cut, frequency ORDER BY CASE quadrant WHEN 'Improving' THEN 0 WHEN 'Leading' THEN 1 WHEN 'Weakening' THEN 2 ELSE 3 END, momentum DESC, short_excess DESC, grp) AS place FROM qd)"""


def grids(t: Tables, prices: DataFrame) -> DataFrame:
    """The dense grids of all frequencies, a key before their rows."""
    parts = [ro.panel(prices, t.assets, f).withColumn("frequency", F.lit(f)) for f in LOOKBACKS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def as_of_both(t: Tables, label: str, made) -> tuple[str, str]:
    """Publish what made(grids) gives as of FIRST, then as of today, in one set of snapshots; its folder and the columns."""
    path = landing.folder(t.spark, label)
    for prices in (t.px_daily.where(F.col("d") <= FIRST), t.px_daily):
        rows = made(landing.written(grids(t, prices), "grids")).withColumnRenamed("d", "signal_date")
        snapshots.publish(rows, path)
    return path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)


def flagged(t: Tables, path: str, kinds: str) -> DataFrame:
    """All snapshots, and whether each is the latest of its frequency."""
    last = snapshots.latest(t.spark, path, kinds).select("frequency", "signal_date", F.lit(True).alias("latest")).distinct()
    found = snapshots.dated(t.spark, path, kinds).join(F.broadcast(last), ["frequency", "signal_date"], "left")  # a row a frequency
    return rounded(found.withColumn("latest", F.coalesce("latest", F.lit(False))))


@query("SELECT d AS signal_date, frequency, asset, place, round(score, 6) AS score, round(weight, 6) AS weight, d = max(d) OVER (PARTITION BY frequency) AS latest FROM wt", RANKED)
def sink_snapshots_ranking(t: Tables) -> DataFrame:
    """Rankings by day, week and month with the weights of the ten best, as of two dates, from the files that hold them. A frequency
    whose last date has no score publishes nothing, and its latest ranking stays."""
    safe = defensive(t)
    rows = [(f, f, TOP_N, ro.EQUAL, k, [], True, False, 6, 0.0, safe) for f, k in LOOKBACKS.items()]
    how = t.spark.createDataFrame(rows, sw.CONFIG)
    path, kinds = as_of_both(t, "rankings", lambda g: sw.latest_rankings(g.where("ord > 0"), how).drop("config_id"))
    return flagged(t, path, kinds)


@query(
    """SELECT d AS signal_date, frequency, grp, place, quadrant, round(ratio, 6) AS ratio, round(momentum, 6) AS momentum, round(short_excess, 6) AS short_excess,
    round(long_excess, 6) AS long_excess, round(breadth, 6) AS breadth, d = max(d) OVER (PARTITION BY frequency) AS latest FROM pl""",
    ROTATED,
)
def sink_snapshots_rotation(t: Tables) -> DataFrame:
    """Rotation of groups by day, week and month, as of two dates, from the files that hold them, leaders and reasons beside."""
    path, kinds = as_of_both(t, "rotations", lambda g: gr.rotation_summaries(g.where("ord > 1"), g.where("ord = 0"), WINDOWS))
    return flagged(t, path, kinds).drop("leaders", "reason")
