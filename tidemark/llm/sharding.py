"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix64, staged, table, whole

#: Rows that one task numbers within a shard.
BUCKET_ROWS = 50_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key. No ring table; with one more shard, about 1 / (shards + 1) of the keys move, all into it."""
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    jump = np.zeros(len(key), np.int64)
    while len(live):
        shard[live] = jump[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead = (shard[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))
        jump[live] = np.minimum(ahead, float(shards)).astype(np.int64)
        live = live[jump[live] < shards]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a long key; a null key counts as the key 0 mixed once more."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def deal(keys: pd.Series, absent: pd.Series) -> pd.Series:
        mixed = mix64(keys.to_numpy(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        mixed = np.where(absent.to_numpy(bool), mix64(mixed), mixed)
        return pd.Series(jump_hash(mixed, shards))

    return deal(F.coalesce(key, F.lit(0).cast("long")), key.isNull())


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row of docs into one of `shards` shards, by its id alone, and number the rows of each shard from 0.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law ('key'), shard, slot (gapless, from 0, in an order
    that depends only on the rows) and grown_shard (the shard with one more shard; equal to shard, or the new one).

    Defined cases: a null text has no bytes and checksum 0; a null id is one key of its own, so that all its rows share a shard;
    repeated rows stay separate rows with slots of their own; equal ids share a shard; an empty table gives an empty result;
    other columns of docs are ignored, whatever their names. Texts are read once and never shuffled: only the narrow rows are.
    A shard is numbered in buckets of about BUCKET_ROWS rows, so that no task holds a whole shard.
    """
    key = F.col(id_col).cast("long")
    text = whole(text_col)
    rows = staged(
        docs.select(
            key.alias("doc_id"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            shard_of(key, shards).alias("shard"),
            shard_of(key, shards + 1).alias("grown_shard"),
        ),
        "shards",
    )
    buckets = max(8, -(-rows.count() // (BUCKET_ROWS * shards)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.join(starts, ["shard", "bucket"])
        .withColumn("slot", F.col("start") + F.row_number().over(within) - 1)
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id") -> None:
    """Write the whole rows of docs as Parquet, one folder for each shard; each shard's rows are written by many tasks."""
    docs.withColumn("shard", shard_of(F.col(id_col).cast("long"), shards)).write.partitionBy("shard").parquet(path)


def op7_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24, by its id, and its slot there."""
    return assign_shards(table(spark, sf_dir, "documents"), shards=24)
