"""Structured Streaming forms: deduplication, time gates, tumbling and sliding counts, and the run that drains what is there."""

from __future__ import annotations

import contextlib
import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.landing import folder


def as_stream(rows: DataFrame, label: str, files: int = 4) -> DataFrame:
    """rows as a file stream, a file a batch. What a source has landed stands in for it where there is no live feed."""
    path = folder(rows.sparkSession, label)
    rows.repartition(files).write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def as_ordered_stream(rows: DataFrame, label: str, at: str, batches: int = 4, rows_a_file: int = 500_000) -> DataFrame:
    """rows as a file stream whose batches follow each other in time. A batch is as many files as its rows fill, the same number for all batches, so
    that no task writes a whole batch and every trigger takes exactly one."""
    spark, path = rows.sparkSession, folder(rows.sparkSession, label)
    us = F.unix_micros(F.col(at).cast("timestamp"))
    low, high, n = rows.agg(F.min(us), F.max(us), F.count("*")).first()
    files = 1 if low is None else max(1, math.ceil(n / batches / rows_a_file))
    if low is None:
        rows.write.parquet(path)
    else:
        part = F.call_function("div", (us - low) * batches, F.lit(high - low + 1))
        if files > 1:  # computed once, in parallel, and read again by batch
            given, kept = rows.schema, folder(spark, f"{label}-by-batch")
            rows.withColumn("batch_number", part).write.partitionBy("batch_number").parquet(kept)
            rows, part = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in given.fields)}, batch_number bigint").parquet(kept), F.col("batch_number")
        for k in range(batches):
            _add_batch(rows.where(part == k).drop("batch_number"), path, k, files)
        rows = rows.drop("batch_number")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def _add_batch(batch: DataFrame, path: str, number: int, files: int) -> None:
    """Append a batch of a feed as exactly `files` files, after those of the batches before it."""
    (batch.coalesce(1) if files == 1 else batch.repartition(files)).write.mode("append").parquet(path)
    missing = files * (number + 1) - len(batch.sparkSession.read.schema(batch.schema).parquet(path).inputFiles()) if files > 1 else 0
    for _ in range(missing):  # an empty task writes no file
        batch.limit(0).coalesce(1).write.mode("append").parquet(path)


def drained_updates(stream: DataFrame, label: str, keys: list[str], conf: dict[str, str] | None = None, by: str | None = None, rows_a_task: int = 250_000) -> DataFrame:
    """Run the stream in update mode: every batch appends the groups that it changed, with its number, and the last of each key counts.
    So no batch rewrites what came before, and a watermark can let old groups go. conf holds while it starts. If `by`, one of the keys, is given, the result is dealt by it over
    tasks of about rows_a_task rows, however many there are, and what groups by it later needs no further shuffle."""
    spark = stream.sparkSession
    out, progress = folder(spark, label), folder(spark, f"{label}-progress")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch_number={number}")  # the same again if the batch is repeated

    with _set(spark, conf or {}):
        query = stream.writeStream.outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch bigint").parquet(out)
    if by:
        rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / rows_a_task)), by)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("last", last).where("last = 1").select(*stream.columns)


def drained_apart(stream: DataFrame, label: str, good: Column) -> tuple[DataFrame, DataFrame]:
    """Run the stream and write the rows for which `good` holds to one table and all others to a second."""
    spark = stream.sparkSession
    kept, gone, progress = folder(spark, label), folder(spark, f"{label}-violations"), folder(spark, f"{label}-progress")
    fine = F.coalesce(good, F.lit(False))

    def keep(batch: DataFrame, number: int) -> None:
        batch.where(fine).write.mode("overwrite").parquet(f"{kept}/batch_number={number}")
        batch.where(~fine).write.mode("overwrite").parquet(f"{gone}/batch_number={number}")

    stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return tuple(spark.read.schema(stream.schema).parquet(p) for p in (kept, gone))


@contextlib.contextmanager
def _set(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """The settings while a query starts, which is when it reads them."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drained(stream: DataFrame, label: str, mode: str = "append", conf: dict[str, str] | None = None, progress_of: list | None = None) -> DataFrame:
    """Run the stream over all that is there, with its progress in the shared folder, and read what it wrote.

    Appended rows go to a file sink; in complete mode every batch replaces the table before it. conf holds while it starts; progress_of gets
    what the query says about each of its batches.
    """
    spark = stream.sparkSession
    out, progress = folder(spark, label), folder(spark, f"{label}-progress")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True)
    with _set(spark, conf or {}):
        if mode == "append":
            query = writer.format("parquet").option("path", out).start()
        else:
            keep: Callable = lambda batch, _: batch.write.mode("overwrite").parquet(out)
            query = writer.foreachBatch(keep).start()
        query.awaitTermination()
    if progress_of is not None:
        progress_of += list(query.recentProgress)
    return spark.read.schema(stream.schema).parquet(out)


def drained_in_time(stream: DataFrame, label: str, at: str, within_seconds: int, rows_a_file: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """Run the stream and part its rows: those not older than `within_seconds` before the latest row of the batches before, as a stream for what
    follows, and the late ones, as a table.

    The latest time so far is kept in a table of its own, a row a batch, written before the batch's rows, and read without the row of the batch itself,
    so that a batch that is repeated parts its rows as it did at first. A trigger of what follows takes exactly a batch, of however many files: within
    a batch the times of files overlap, so that a watermark moved by one of them would drop rows of the next.
    """
    spark = stream.sparkSession
    kept, gone, clock, progress = (folder(spark, f"{label}{x}") for x in ("", "-late", "-clock", "-progress"))
    us = F.unix_micros(F.col(at).cast("timestamp"))
    times = "latest bigint, batch_number bigint"

    def part(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max(us)).first()[0]
        spark.createDataFrame([(now,)], "latest long").write.mode("overwrite").parquet(f"{clock}/batch_number={number}")
        bound = spark.read.schema(times).parquet(clock).where(F.col("batch_number") < number).agg(F.max("latest")).first()[0]
        late = F.lit(False) if bound is None else us < bound - within_seconds * 1_000_000
        batch.where(~late).write.mode("overwrite").parquet(f"{kept}/batch_number={number}")
        batch.where(late).write.mode("overwrite").parquet(f"{gone}/batch_number={number}")

    stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True).foreachBatch(part).start().awaitTermination()
    fresh = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch_number bigint").parquet(kept)
    batches, files, again = spark.read.schema(times).parquet(clock).count(), 1, f"{kept}/batch_number=*"
    if len(fresh.inputFiles()) > batches:  # not a file a batch: dealt anew, the same number for all
        most = fresh.groupBy("batch_number").count().agg(F.max("count")).first()[0] or 0
        files, again = max(1, math.ceil(most / rows_a_file)), folder(spark, f"{label}-in-step")
        for k in range(batches):
            _add_batch(fresh.where(F.col("batch_number") == k).drop("batch_number"), again, k, files)
    return spark.readStream.schema(stream.schema).option("maxFilesPerTrigger", files).parquet(again), spark.read.schema(stream.schema).parquet(f"{gone}/batch_number=*")


def deduplicated(stream: DataFrame, key: str, at: str, within: str) -> DataFrame:
    """The first row of each key; a key is forgotten once the watermark has passed it by `within`."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def in_time(event: str, ingest: str, skew_seconds: int = 5) -> Column:
    """Whether a row wasn't taken in more than the skew before it happened."""
    return F.unix_micros(F.col(ingest).cast("timestamp")) >= F.unix_micros(F.col(event).cast("timestamp")) - skew_seconds * 1_000_000


def counted(stream: DataFrame, at: str, keys: list[str], length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Rows by key and tumbling, or sliding, window; a window's state goes once the watermark has passed it."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def hourly_rates(panes: DataFrame, key: str, pane_seconds: int = 300, panes_an_hour: int = 12) -> DataFrame:
    """panes(start, key, n) of a tumbling count -> start, key, n of the sliding windows that panes_an_hour of them make: a pane is in as many windows. If panes
    are dealt by key, no shuffle holds each of them twelve times."""
    starts = F.transform(F.sequence(F.lit(0), F.lit(panes_an_hour - 1)), lambda i: F.timestamp_micros(F.unix_micros("start") - i.cast("long") * (pane_seconds * 1_000_000)))
    return panes.select(F.explode(starts).alias("start"), key, "n").groupBy("start", key).agg(F.sum("n").alias("n"))


def last_of_day(stream: DataFrame, at: str, keys: list[str], value: str, ingest: str, late: str = "30 days") -> DataFrame:
    """By key and day the value taken in last: a late row within the watermark corrects its day, a later one is dropped."""
    w = F.window(at, "1 day")
    found = stream.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.max_by(value, ingest).alias(value), F.count("*").alias("n"))
    return found.select(F.to_date("w.start").alias("d"), *keys, value, "n")
