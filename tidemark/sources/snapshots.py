"""Dated snapshots as CSV, a file or more for each date and frequency, and the latest of each frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import caches


def publish(rows: DataFrame, path: str) -> list[str]:
    """rows(signal_date, frequency, ...) into the snapshots, all frequencies by one write; the names of the parts written, as frequency@date.

    A part that is there already is replaced; a frequency without rows keeps what it has, its latest snapshot included. Dated snapshots and the latest ones move together, when the pointer table is there: a reader
    sees all of an update or nothing of it, and one that is interrupted changes nothing.
    """
    return caches.replace_parts(rows, path, F.concat_ws("@", "frequency", F.date_format("signal_date", "yyyy-MM-dd")), kind="csv")


def dated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All snapshots; schema names their columns as they were written."""
    return caches.read(spark, path, schema, kind="csv")


def latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Of each frequency the snapshot of the last date; other files aren't read."""
    last: dict[str, str] = {}
    for part in caches.pointer(spark, path):
        frequency = part.rpartition("@")[0]
        last[frequency] = max(part, last.get(frequency, part))
    return caches.read(spark, path, schema, kind="csv", parts=set(last.values()))
