"""An event stream over files: publications of JSON envelopes, groups of readers with progress of their own, and replay from a chosen point."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import digest

ENVELOPE = (
    "message_id string, stream string, event_id string, event_type string, schema_version int, produced_at timestamp, "
    "correlation_id string, idempotency_key string, payload string"
)
FIELDS = [f.strip().split(" ")[0] for f in ENVELOPE.split(",")]
#: How JSON is written and read: times to the microsecond, nulls in their places.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
#: Names of streams are names of folders.
STREAM_NAME = r"^[A-Za-z0-9_.-]+$"
#: Length of a publication's name, with which its messages' ids begin.
PUBLICATION = 29


def wrapped(rows: DataFrame, stream: Column, event_type: Column, payload: list[str], produced_at: Column, correlation_id: Column, schema_version: int = 1) -> DataFrame:
    """rows as envelopes. The payload is JSON of the named columns, by name; its hash is the idempotency key, and type, version and hash name the
    event, so that a fact that is sent again keeps its name."""
    content = F.to_json(F.struct(*sorted(payload)), JSON)
    out = rows.select(
        stream.alias("stream"), event_type.alias("event_type"), F.lit(schema_version).alias("schema_version"), produced_at.cast("timestamp").alias("produced_at"),
        correlation_id.cast("string").alias("correlation_id"), F.sha2(content, 256).alias("idempotency_key"), content.alias("payload"),
    )
    return out.withColumn("event_id", digest(32, F.col("event_type"), F.col("schema_version").cast("string"), F.col("idempotency_key")))


def fault() -> Column:
    """The first field of an envelope that isn't as it must be, or null."""
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    out = F.when(~F.coalesce(F.col("stream").rlike(STREAM_NAME), F.lit(False)), "stream")
    for c in ("event_id", "event_type", "correlation_id", "idempotency_key", "payload"):
        out = out.when(empty(c), c)
    return out.when(F.coalesce(F.col("schema_version"), F.lit(0)) < 1, "schema_version").when(F.col("produced_at").isNull(), "produced_at")


def publish(envelopes: DataFrame, path: str) -> str:
    """Append envelopes as one publication, a folder for each stream in it, and give the publication's name; nothing is ever overwritten.

    Names follow the clock of whoever publishes, and any number may publish at once. A message's id is its publication's name and a number,
    fixed when it is written. An envelope with a fault fails the publication, and no message of it appears.
    """
    name = f"{time.time_ns() // 1000:020d}-{uuid.uuid4().hex[:8]}"
    sound = F.when(fault().isNotNull(), F.raise_error(F.concat(F.lit("an envelope without a right "), fault()))).otherwise(F.col("stream"))
    lines = envelopes.withColumn("stream", sound).withColumn("message_id", F.format_string("%s-%019d", F.lit(name), F.monotonically_increasing_id()))
    lines.select("stream", F.to_json(F.struct(*FIELDS), JSON).alias("value")).write.partitionBy("stream").text(f"{path}/publication={name}")
    return name


def parsed(lines: DataFrame) -> DataFrame:
    """(value) -> the envelope's fields, `raw` (the line) and `fault`; a line that isn't an envelope keeps its raw form and names what is wrong."""
    read = lines.select(F.from_json("value", ENVELOPE, JSON).alias("e"), F.col("value").alias("raw"))
    return read.select("e.*", "raw").withColumn("fault", fault())


def consume(spark: SparkSession, path: str, group: str, handle: Callable[[DataFrame, int], None], stream: str = "*", files: int = 1000) -> list:
    """Give `group` all that it hasn't acknowledged yet of a stream (or of all), in batches of at most `files` files; what the query said of each.

    handle(events, number) gets parsed events. When it returns, the batch is acknowledged; when it fails, the group stops there and the
    same batch comes again under the same number next time, so a handle that writes by number does its work once. Progress is a checkpoint by
    group and stream beside the publications: groups don't see each other's, and a new one begins at the first publication.
    """
    source = spark.readStream.schema("value string").option("maxFilesPerTrigger", files).text(f"{path}/publication=*/stream={stream}")
    progress = f"{path}/_groups/{group}/{'_all' if stream == '*' else stream}"
    writer = source.writeStream.option("checkpointLocation", progress).trigger(availableNow=True)
    query = writer.foreachBatch(lambda batch, number: handle(parsed(batch), number)).start()
    query.awaitTermination()
    return list(query.recentProgress)


def into(folder: str) -> Callable[[DataFrame, int], None]:
    """A handle that keeps the events of each batch in a folder of its number: the same again if the batch is."""
    return lambda events, number: events.write.mode("overwrite").parquet(f"{folder}/batch_number={number}")


def kept(spark: SparkSession, folder: str) -> DataFrame:
    """What `into` has kept."""
    return spark.read.schema(f"{ENVELOPE}, raw string, fault string, batch_number bigint").parquet(folder)


def replay(spark: SparkSession, path: str, stream: str = "*", since: str | None = None) -> DataFrame:
    """Parsed events, whatever any group has acknowledged: all, or those from a publication or a message on. Earlier publications aren't read."""
    lines = spark.read.schema("value string").option("basePath", path).text(f"{path}/publication=*/stream={stream}")
    if since is None:
        return parsed(lines)
    return parsed(lines.where(F.col("publication") >= since[:PUBLICATION])).where(F.col("message_id") >= since)


def pending(spark: SparkSession, path: str, delivered: DataFrame, stream: str = "*") -> DataFrame:
    """The events of a stream that aren't among `delivered`, by message id."""
    return replay(spark, path, stream).join(delivered.select("message_id"), "message_id", "left_anti")
