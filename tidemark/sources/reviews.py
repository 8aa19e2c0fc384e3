"""The review queue: names in doubt, appended once each, and what people decided on them. Nothing is ever overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import digest

ITEM = "item_id string, query string, context string, score double, candidates array<struct<entity_id:string,key:string,score:double>>, queued_at timestamp"
DECISION = "item_id string, entity_id string, decided_at timestamp"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def items(spark: SparkSession, path: str) -> DataFrame:
    """Every item ever queued."""
    return _read(spark, f"{path}/items", ITEM)


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """The last decision on each item; one without an entity_id refuses all candidates."""
    found = _read(spark, f"{path}/decisions", DECISION)
    return found.groupBy("item_id").agg(F.max_by("entity_id", F.struct("decided_at", "entity_id")).alias("entity_id"), F.max("decided_at").alias("decided_at"))


def queue(resolved: DataFrame, path: str, context: str, at: str) -> None:
    """Append what resolve() left for review. An item is known by its query and context: one that is there, decided on or not, isn't queued again,
    so a run that is repeated, or that fails and runs anew, adds nothing twice."""
    spark = resolved.sparkSession
    listed = F.transform("candidates", lambda c: F.struct(c["entity_id"].cast("string").alias("entity_id"), c["key"].alias("key"), c["score"].alias("score")))
    query = F.coalesce(F.col("query"), F.lit(""))
    new = resolved.where("review").select(digest(16, query, F.lit(context)).alias("item_id"), query.alias("query"), F.lit(context).alias("context"), "score", listed.alias("candidates"), F.lit(at).cast("timestamp").alias("queued_at"))
    new = new.dropDuplicates(["item_id"]).join(items(spark, path).select("item_id"), "item_id", "left_anti")
    new.write.mode("append").parquet(f"{path}/items")


def decide(made: DataFrame, path: str) -> None:
    """Append decisions(item_id, entity_id, decided_at)."""
    made.selectExpr("cast(item_id as string) as item_id", "cast(entity_id as string) as entity_id", "cast(decided_at as timestamp) as decided_at").write.mode("append").parquet(f"{path}/decisions")


def waiting(spark: SparkSession, path: str) -> DataFrame:
    """Items without a decision."""
    return items(spark, path).join(decisions(spark, path).select("item_id"), "item_id", "left_anti")


def learnt(spark: SparkSession, path: str) -> DataFrame:
    """alias, entity_id and seq of the names that people gave an entity, for alias_table(): only decisions become aliases, never a guess."""
    given = decisions(spark, path).where("entity_id is not null")
    return items(spark, path).join(given, "item_id").select(F.col("query").alias("alias"), "entity_id", F.unix_micros("decided_at").alias("seq"))
