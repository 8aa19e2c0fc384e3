"""Relative rotation of groups against a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order of quadrants in reports, and the words of their reasons.
PRIORITY = {"Improving": 0, "Leading": 1, "Weakening": 2, "Lagging": 3}
DIRECTION = {
    "Leading": "相對強度高於基準且動能仍在增強",
    "Improving": "相對強度尚低於基準，但動能已翻正",
    "Weakening": "相對強度仍高於基準，但動能正在降溫",
    "Lagging": "相對強度低於基準且動能仍為負",
}


def chosen(column: Column, words: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in words.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def quadrant(ratio: Column, momentum: Column) -> Column:
    strong, rising = ratio >= 100, momentum >= 0
    return F.when(ratio.isNull() | momentum.isNull(), "Unavailable").when(strong & rising, "Leading").when(strong, "Weakening").when(rising, "Improving").otherwise("Lagging")


def percent(x: Column, digits: int = 1, sign: bool = True) -> Column:
    """x in percent as C prints it: what rounds to nothing keeps its sign, as in -0.0%; null of null."""
    near = F.round(100 * x, digits)  # by decimals, which have no negative zero
    near = F.when((x < 0) & (near == 0), F.lit(-0.0)).otherwise(near)
    return F.when(x.isNotNull(), F.format_string(f"%{'+' if sign else ''}.{digits}f%%", near))


def reason() -> Column:
    """A summary's row in words."""
    return F.concat(chosen(F.col("quadrant"), DIRECTION), F.lit("；短期超額 "), percent(F.col("short_excess")), F.lit("、中期超額 "), percent(F.col("long_excess")), F.lit("，"), percent(F.col("breadth"), 0, False), F.lit(" 成分股跑贏基準。")).alias("reason")


def group_index(grid: DataFrame) -> DataFrame:
    """grid(d, pos, asset, grp, close) -> d, pos, grp, ret, idx: the running product of the members' mean returns, null as 0."""
    ret = F.col("close") / F.lag("close").over(Window.partitionBy("asset").orderBy("pos")) - 1
    by = grid.withColumn("ret", ret).groupBy("d", "pos", "grp").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("ret"))
    w = Window.partitionBy("grp").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return by.withColumn("idx", F.product(1 + F.col("ret")).over(w))


def relative_strength(index: DataFrame, benchmark: DataFrame, long_window: int, momentum_window: int) -> DataFrame:
    """index(d, pos, grp, idx) and benchmark(pos, close) -> with ratio (of its mean over long_window rows, in percent) and momentum."""
    w = Window.partitionBy("grp").orderBy("pos")
    base = benchmark.select("pos", F.col("close").alias("bench"))
    first = F.first("bench", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = index.join(base, "pos", "left").withColumn("rs", F.col("idx") / (F.col("bench") / first))
    over = w.rowsBetween(-(long_window - 1), 0)
    out = out.withColumn("ratio", F.when(F.count("rs").over(over) == long_window, F.col("rs") / F.avg("rs").over(over) * 100))
    return out.withColumn("momentum", (F.col("ratio") / F.lag("ratio", momentum_window).over(w) - 1) * 100)


def rotation_summary(grid: DataFrame, benchmark: DataFrame, short: int, long: int, momentum_window: int) -> DataFrame:
    """The latest quadrant of each group with excess returns, breadth, three leaders and a reason, in the order of reports."""
    index = group_index(grid)
    rs = relative_strength(index, benchmark, long, momentum_window)
    w, a = Window.partitionBy("grp").orderBy("pos"), Window.partitionBy("asset").orderBy("pos")
    rs = rs.withColumn("short_ret", F.col("idx") / F.lag("idx", short).over(w) - 1).withColumn("long_ret", F.col("idx") / F.lag("idx", long).over(w) - 1)
    last = rs.where("ratio is not null").agg(F.max("pos").alias("pos"))
    b = Window.orderBy("pos")  # one row a date
    bench = benchmark.select("pos", (F.col("close") / F.lag("close", short).over(b) - 1).alias("b_short"), (F.col("close") / F.lag("close", long).over(b) - 1).alias("b_long"))
    now = rs.join(F.broadcast(last), "pos").join(bench, "pos").where("ratio is not null and momentum is not null")
    members = grid.withColumn("m_short", F.col("close") / F.lag("close", short).over(a) - 1).join(F.broadcast(last), "pos").join(bench, "pos").withColumn("excess", F.col("m_short") - F.col("b_short"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc_nulls_last("excess"), "ord"))
    label = F.concat(F.col("asset"), F.lit(" ("), percent(F.col("excess")), F.lit(")"))
    top = members.withColumn("rnk", rank).groupBy("grp").agg(
        F.avg(F.coalesce((F.col("excess") > 0).cast("double"), F.lit(0.0))).alias("breadth"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("rnk") <= 3) & F.col("excess").isNotNull(), F.struct("rnk", label.alias("label"))))), lambda x: x["label"]), "；").alias("leaders"),
    )
    out = now.join(top, "grp").withColumn("quadrant", quadrant(F.col("ratio"), F.col("momentum"))).withColumn("short_excess", F.col("short_ret") - F.col("b_short")).withColumn("long_excess", F.col("long_ret") - F.col("b_long"))
    out = out.withColumn("reason", reason())
    return out.orderBy(chosen(F.col("quadrant"), PRIORITY), F.desc("momentum"), F.desc("short_excess")).select("d", "grp", "quadrant", "ratio", "momentum", "short_excess", "long_excess", "breadth", "leaders", "reason")


def rotation_summaries(grids: DataFrame, benchmarks: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """The latest summary of each frequency: grids(frequency, d, pos, asset, grp, ord, close), benchmarks(frequency, pos, close), and by frequency
    the long window and that of momentum and short returns -> frequency, d, grp, place (in the order of reports) and the columns of a summary.

    The frequency is a key of every window and join, so that shuffles don't grow in number with the frequencies; each column holds a
    choice by frequency among as many lags. A frequency without a benchmark, or whose history is too short, gives no rows.
    """

    def each(make) -> Column:
        """What make(long, short) gives for the row's frequency."""
        out = F.lit(None)
        for name, (long, short) in windows.items():
            out = F.when(F.col("frequency") == name, make(long, short)).otherwise(out)
        return out

    by_group, by_asset, by_date = (Window.partitionBy("frequency", *k).orderBy("pos") for k in (["grp"], ["asset"], []))  # the last: one row a date
    change = lambda x, k, w: F.col(x) / F.lag(x, k).over(w) - 1
    bench = benchmarks.select(
        "frequency", "pos", F.col("close").alias("bench"), F.first("close", ignorenulls=True).over(by_date.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("base"),
        each(lambda _, k: change("close", k, by_date)).alias("b_short"), each(lambda k, _: change("close", k, by_date)).alias("b_long"),
    )
    moved = grids.withColumn("ret", change("close", 1, by_asset)).withColumn("m_short", each(lambda _, k: change("close", k, by_asset)))
    index = moved.groupBy("frequency", "d", "pos", "grp").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("ret"))
    index = index.withColumn("idx", F.product(1 + F.col("ret")).over(by_group.rowsBetween(Window.unboundedPreceding, 0)))
    rs = index.join(bench, ["frequency", "pos"]).withColumn("rs", F.col("idx") / (F.col("bench") / F.col("base")))
    over = lambda k: by_group.rowsBetween(-(k - 1), 0)
    rs = rs.withColumn("ratio", each(lambda k, _: F.when(F.count("rs").over(over(k)) == k, F.col("rs") / F.avg("rs").over(over(k)) * 100)))
    rs = rs.withColumn("momentum", each(lambda _, k: change("ratio", k, by_group) * 100))
    rs = rs.withColumn("short_excess", each(lambda _, k: change("idx", k, by_group)) - F.col("b_short")).withColumn("long_excess", each(lambda k, _: change("idx", k, by_group)) - F.col("b_long"))
    last = rs.where("ratio is not null").groupBy("frequency").agg(F.max("pos").alias("pos"))  # a row a frequency
    now = rs.join(F.broadcast(last), ["frequency", "pos"]).where("ratio is not null and momentum is not null")
    members = moved.join(F.broadcast(last), ["frequency", "pos"]).join(bench.select("frequency", "pos", "b_short"), ["frequency", "pos"]).withColumn("excess", F.col("m_short") - F.col("b_short"))
    rank = F.row_number().over(Window.partitionBy("frequency", "grp").orderBy(F.desc_nulls_last("excess"), "ord"))
    leader = F.when((F.col("rnk") <= 3) & F.col("excess").isNotNull(), F.struct("rnk", F.concat(F.col("asset"), F.lit(" ("), percent(F.col("excess")), F.lit(")")).alias("label")))
    top = members.withColumn("rnk", rank).groupBy("frequency", "grp").agg(
        F.avg(F.coalesce((F.col("excess") > 0).cast("double"), F.lit(0.0))).alias("breadth"), F.array_join(F.array_sort(F.collect_list(leader))["label"], "；").alias("leaders")
    )
    out = now.join(top, ["frequency", "grp"]).withColumn("quadrant", quadrant(F.col("ratio"), F.col("momentum")))
    place = F.row_number().over(Window.partitionBy("frequency").orderBy(chosen(F.col("quadrant"), PRIORITY), F.desc("momentum"), F.desc("short_excess"), "grp"))  # a row a group
    return out.select("frequency", "d", "grp", place.cast("long").alias("place"), "quadrant", "ratio", "momentum", "short_excess", "long_excess", "breadth", "leaders", reason())
