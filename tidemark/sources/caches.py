"""Tables updated in place: prices by touched month and a pointer that moves at the end, flows by missing date."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import pit
from .landing import written

PRICES = "d date, asset string, close double"
POINTER = "part string, version string"
#: Options of the formats that parts are written in; a part as CSV is read as a whole, so that texts may hold line ends.
FORMATS = {"parquet": {}, "csv": {"header": "true", "escape": '"', "multiLine": "true"}}
#: Share of a price up to which two are the same, as rebasing twice rounds twice.
SAME = 1e-12


def _files(spark: SparkSession, path: str):
    """The path's file system and the path, as Hadoop has them: any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _files(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []


def _generation(spark: SparkSession, path: str) -> int:
    """The number of the last pointer table that was written to its end; 0 if there is none."""
    found = [int(n) for n in _names(spark, f"{path}/pointers") if n.isdigit()]
    fs, _ = _files(spark, path)
    return max((n for n in found if fs.exists(_files(spark, f"{path}/pointers/{n}/_SUCCESS")[1])), default=0)


def pointer(spark: SparkSession, path: str) -> dict[str, str]:
    """The version that holds each part (a month): as many entries as there are months."""
    n = _generation(spark, path)
    return {r["part"]: r["version"] for r in spark.read.schema(POINTER).parquet(f"{path}/pointers/{n}").collect()} if n else {}


def read(spark: SparkSession, path: str, schema: str = PRICES, kind: str = "parquet", parts: set[str] | None = None) -> DataFrame:
    """What the last finished update left: the parts that its pointer names, or those of them asked for, each in its version's folder."""
    where = [f"{path}/data/{version}/part={part}" for part, version in sorted(pointer(spark, path).items()) if parts is None or part in parts]
    return spark.read.schema(schema).format(kind).options(**FORMATS[kind]).load(where) if where else spark.createDataFrame([], schema)


def replace_parts(rows: DataFrame, path: str, part: Column, kind: str = "parquet") -> list[str]:
    """Write rows, which are whole parts, as a new version, then a pointer that names it for those parts; the parts' names.

    Readers see the old table until the pointer table has its success mark, and all of the new one from then on. An update that is interrupted
    leaves files that no pointer names. Two writers that began from one pointer write the same next one, and the later of them fails.
    """
    spark = rows.sparkSession
    old, n, version = pointer(spark, path), _generation(spark, path), uuid.uuid4().hex
    rows.withColumn("part", part).repartition("part").write.partitionBy("part").format(kind).options(**FORMATS[kind]).save(f"{path}/data/{version}")
    touched = sorted(name.removeprefix("part=") for name in _names(spark, f"{path}/data/{version}") if name.startswith("part="))
    if touched:
        new = sorted((old | dict.fromkeys(touched, version)).items())
        _publish(spark.createDataFrame(new, POINTER), f"{path}/pointers/{n + 1}", n + 1)
    return touched


def _publish(table: DataFrame, path: str, number: int) -> None:
    fs, where = _files(table.sparkSession, path)
    if fs.exists(where) and not fs.exists(_files(table.sparkSession, f"{path}/_SUCCESS")[1]):
        fs.delete(where, True)  # left by an update that was interrupted at this very step
    table.coalesce(1).write.mode("error").parquet(path)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove pointers but for the last `keep`, and versions that none of those names; the versions' names. Not while an update runs."""
    last = _generation(spark, path)
    named: set[str] = set()
    for n in sorted(int(x) for x in _names(spark, f"{path}/pointers") if x.isdigit()):
        fs, where = _files(spark, f"{path}/pointers/{n}")
        if last - keep < n <= last:
            named |= {r["version"] for r in spark.read.schema(POINTER).parquet(f"{path}/pointers/{n}").collect()}
        else:
            fs.delete(where, True)
    gone = [v for v in _names(spark, f"{path}/data") if v not in named]
    for v in gone:
        fs, where = _files(spark, f"{path}/data/{v}")
        fs.delete(where, True)
    return gone


def filled(prices: DataFrame) -> DataFrame:
    """prices(d, asset, close) with a row for each asset and each date of any asset from the asset's first price on; a missing price is the last before.

    Each price is written out up to the asset's next one, along the calendar, so that no asset meets dates before its first."""
    known = prices.where("close is not null")
    calendar = prices.select("d").distinct().withColumn("pos", F.row_number().over(Window.orderBy("d")))  # dates only
    last = calendar.agg(F.max("pos").alias("last_pos"))
    placed = known.join(calendar, "d").withColumn("next", F.lead("pos").over(Window.partitionBy("asset").orderBy("pos")))
    spans = placed.crossJoin(F.broadcast(last)).select("asset", "close", F.explode(F.sequence("pos", F.coalesce(F.col("next") - 1, "last_pos"))).alias("pos"))  # one number
    return spans.join(calendar, "pos").select("d", "asset", "close")


def update_prices(fresh: DataFrame, path: str, threshold: float = 0.4, repairable: str = "true") -> list[str]:
    """Bring fresh(d, asset, close) into the cache; the months that were written.

    Cell by cell the last price that isn't null counts, fresh over cached; then gaps are filled from before, and jumps of more than `threshold`
    rebase what is before them, of the assets for which `repairable` holds. Months in which nothing changes aren't written: an ordinary update
    writes the last months, one that finds a jump the asset's whole past. The same rows again write nothing. The cache is read whole, as a
    jump rebases all before it.
    """
    spark = fresh.sparkSession
    old = read(spark, path)
    merged = filled(pit.upsert(old, fresh.select("d", "asset", F.col("close").cast("double").alias("close")), ["d", "asset"], "close"))
    fixed = pit.repaired(merged, threshold).join(merged.select("asset").distinct().where(repairable).withColumn("fix", F.lit(True)), "asset", "left")
    month = F.date_format("d", "yyyy-MM")
    new = written(fixed.select("d", "asset", F.when(F.col("fix"), F.col("repaired")).otherwise(F.col("close")).alias("close")), "prices")
    before = old.select("d", "asset", F.col("close").alias("old_close"))
    same = F.coalesce(F.abs(F.col("close") - F.col("old_close")) <= SAME * F.abs(F.col("old_close")), F.lit(False))
    changed = new.join(before, ["d", "asset"], "left").where(~same).select(month.alias("month")).distinct()
    return replace_parts(new.withColumn("month", month).join(changed, "month", "left_semi").drop("month"), path, month)


def stored_dates(spark: SparkSession, path: str, date: str) -> DataFrame:
    """The dates that a table laid out by date has, from its folders' names."""
    found = [(n.removeprefix(f"{date}="),) for n in _names(spark, path) if n.startswith(f"{date}=")]
    return spark.createDataFrame(found, f"{date} string").select(F.col(date).cast("date").alias(date))


def update_flows(fresh: DataFrame, path: str, date: str = "d", keys: tuple = ("d", "asset"), order: str = "seq") -> int:
    """Add fresh's rows on dates that the table lacks, the last by `order` of each key; the number of dates written.

    The table is laid out by date. A date goes in as a whole, by dynamic partition overwrite, so that an update that was interrupted and runs again
    replaces what it left, and a rerun over stored dates writes no file.
    """
    spark = fresh.sparkSession
    new = pit.keep_last(fresh.join(stored_dates(spark, path, date), date, "left_anti"), list(keys), order)
    new = written(new, "flows")
    n = new.select(date).distinct().count()
    if n:
        new.repartition(date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)
    return n


def flows(spark: SparkSession, path: str, schema: str, date: str = "d") -> DataFrame:
    """The stored flows; schema names the columns, the date among them."""
    return spark.read.schema(schema).parquet(path)
