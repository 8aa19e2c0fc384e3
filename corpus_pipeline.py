"""A training corpus from `documents`: rejected, near-duplicate and repeated text goes, sources are mixed, and the rest is encoded."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import digests
from tidemark.llm.common import discard, numbered, recorded, staged, table
from tidemark.llm.jaccard import keep_one
from tidemark.llm.mixing import in_training_order
from tidemark.llm.quality import keep_good
from tidemark.llm.substrings import without_repeats

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


#: Tables that the last stage wrote on its way. Its result is written before the next stage begins, which removes them.
_written: list[str] = []


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes what the stage before has written on its way, but for what docs still reads."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _written, docs)
        with recorded() as paths:
            out = f(spark, docs, sf_dir)
        _written[:] = paths
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays, of the smallest id."""
    return keep_one(docs)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of a smaller id has too go; so do documents of which nothing is left."""
    return without_repeats(docs)


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them, in training order."""
    return in_training_order(docs)


def _place(docs: DataFrame) -> Column:
    """A row's place in training order: its file's number, the file's own part where a task cut it into several, and its place there. A table that
    isn't read from files has the order of its partitions."""
    try:
        docs.select("_metadata.file_name")
    except AnalysisException:
        return F.monotonically_increasing_id()
    number = lambda pattern: F.coalesce(F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("long"), F.lit(0))
    return number(r"part-(\d+)") * (1 << 43) + number(r"-c(\d+)\.") * (1 << 33) + F.col("_metadata.row_index")


@stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens, and digests of its ids and of the text that they decode to; place rises in training order.

    docs is read from the files that the stage before wrote in order. Results come back by a number for each row, so that rows of repeated ids stay
    apart however the files are cut.
    """
    rows = numbered(docs.select("doc_id", "text", _place(docs).alias("place")))
    texts = rows.select("number", F.col("row.text").alias("text"))
    encoded = digests(texts, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, "number").withColumnRenamed("doc_id", "number")
    return encoded.join(rows.select("number", "row.place", "row.doc_id"), "number").drop("number")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("mixing", mixing), ("encoding", encoding)]

#: SQL can't express the fit of the rules and the merges; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = staged(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
