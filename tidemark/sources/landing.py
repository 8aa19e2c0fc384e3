"""Written tables in the shared folder, the append-only landing of raw payloads, and append-only facts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import digest

RECORD = ["source", "dataset", "part", "fetch_time", "evidence_id", "sha256", "byte_size", "request", "payload"]


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where that is unset, one of our own in local mode; elsewhere an error.

    It is removed when the driver's process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/{label}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by then; the folder is the cluster's to clear
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read back: many readers, one computation."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def records(payloads: DataFrame) -> DataFrame:
    """payloads(source, dataset, part, fetch_time, payload, request) -> landing records: evidence_id names a payload by source and content.
    Empty payloads are refused."""
    kept = payloads.where("payload is not null and payload != ''")
    name = F.concat_ws("/", "source", "dataset")
    return kept.withColumn("evidence_id", digest(16, name, F.col("payload"))).withColumn("sha256", F.sha2("payload", 256)).withColumn("byte_size", F.octet_length("payload").cast("long")).select(*RECORD)


def land(payloads: DataFrame, path: str) -> None:
    """Append records that aren't there yet: of one source, dataset, part and time, a content lands once. Nothing is ever overwritten."""
    spark = payloads.sparkSession
    new = records(payloads).dropDuplicates(["source", "dataset", "part", "fetch_time", "evidence_id"])
    try:
        there = landed(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = None
    if there is not None:
        new = new.join(there.select("source", "dataset", "part", "fetch_time", "evidence_id"), ["source", "dataset", "part", "fetch_time", "evidence_id"], "left_anti")
    new.select(*RECORD).write.mode("append").partitionBy("source", "dataset", "part").parquet(path)


def landed(spark: SparkSession, path: str, source: str | None = None, dataset: str | None = None, part: str | None = None, asof: str | None = None) -> DataFrame:
    """Landed records, ordered by part and time; source, dataset and part prune folders, asof leaves what was fetched by then."""
    kinds = "source string, dataset string, part string, fetch_time timestamp, evidence_id string, sha256 string, byte_size long, request map<string,string>, payload string"
    found = spark.read.schema(kinds).parquet(path)
    for name, value in (("source", source), ("dataset", dataset), ("part", part)):
        if value is not None:
            found = found.where(F.col(name) == value)
    return (found.where(F.col("fetch_time") <= F.lit(asof).cast("timestamp")) if asof else found).orderBy("part", "fetch_time")


def latest(found: DataFrame) -> DataFrame:
    """Of each source, dataset and part the record fetched last, the larger evidence_id on ties."""
    rest = [c for c in RECORD if c not in ("source", "dataset", "part", "fetch_time", "evidence_id", "request")]
    one = F.max_by(F.struct("fetch_time", "evidence_id", *rest), F.struct("fetch_time", "evidence_id"))
    return found.groupBy("source", "dataset", "part").agg(one.alias("r")).select("source", "dataset", "part", "r.*")


def append_facts(rows: DataFrame, path: str) -> None:
    """Facts are only ever added: a correction is a further row with a later ingest time, for readers as of a time to choose from."""
    rows.write.mode("append").parquet(path)
