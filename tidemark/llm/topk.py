"""Exact top-k inner products: vectors by falling length, rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, staged, table

#: Vectors that a block holds at most.
BLOCK = 4096
#: The longest vectors, at most, that give every query its first bound; they are broadcast.
HEAD = 4096
#: Share of the rotated dimensions that the first partial sum takes.
LEADING = 0.25
PACKED = "block bigint, n int, dim int, longest double, shortest double, ids binary, vectors binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v (array of floor(scale * x) as doubles) and length; without vectors that are null or hold a null, NaN or infinity."""
    v = F.col(vector_col)
    x = F.transform(v, lambda e: e.cast("double"))
    bad = v.isNull() | F.exists(v, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    quantised = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("double"))
    kept = vectors.where(~F.coalesce(bad, F.lit(True)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), quantised.alias("v"))
    return kept.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)))


def _matrix(rows: list[list[float]], dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _gram(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0).to_pylist(), dim)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(dim), dim)), pa.array(np.tile(np.arange(dim), dim)), pa.array(total.ravel())], ["i", "j", "x"])

    return run


def _pack(dim: int):
    """(block, id, v) in order of block -> one row for each block of BLOCK rows at most, integers as 64-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, rows = None, [], []

        def close() -> pa.RecordBatch:
            m = _matrix(rows, dim)
            lengths = np.sqrt((m * m).sum(1))
            one = [[block], [len(rows)], [dim], [float(lengths.max())], [float(lengths.min())], [np.array(ids, "<i8").tobytes()], [m.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(one, (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()), strict=True)], ["block", "n", "dim", "longest", "shortest", "ids", "vectors"])

        for batch in batches:
            for b, i, v in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if rows and (b != block or len(rows) >= BLOCK):
                    yield close()
                    ids, rows = [], []
                block = b
                ids.append(i)
                rows.append(v)
        if rows:
            yield close()

    return run


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k highest (score, id), ties to the smaller id, in order."""
    order = np.lexsort((ids, -scores))[:k]
    return [(int(scores[i]), int(ids[i])) for i in order]


def bounds(q: np.ndarray, ids: np.ndarray, head: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """Each query's k-th best score among the head, the longest vectors, without those of its own id; -inf with fewer."""
    head_ids, head_m = head
    found = np.full(len(q), -np.inf)
    for at in range(0, len(q), 256):
        scores = q[at : at + 256] @ head_m.T
        scores[ids[at : at + 256, None] == head_ids[None, :]] = -np.inf
        if scores.shape[1] >= k:
            found[at : at + 256] = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return found


def _ask(dim: int, head, k: int):
    """(number, id, v) -> blocks of queries: their numbers, ids and vectors, each query's bound, and the least length of a vector
    that can reach any of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = head.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                numbers, ids = (batch.column(i).slice(at, BLOCK).to_numpy(zero_copy_only=False).astype("<i8") for i in (0, 1))
                m = _matrix(batch.column(2).slice(at, BLOCK).to_pylist(), dim)
                own, lengths = bounds(m, ids, top, k), np.sqrt((m * m).sum(1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where((own > 0) & (lengths > 0), own / lengths * (1 - 1e-9) - 1e-6, -1.0)
                one = [[numbers.tobytes()], [ids.tobytes()], [m.tobytes()], [own.tobytes()], [float(reach.min())]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(one, (*[pa.binary()] * 4, pa.float64()), strict=True)], ["q_numbers", "q_ids", "q_vectors", "q_bounds", "least_length"])

    return run


def _search(rotation: np.ndarray, k: int, lead: int):
    """Pairs of a block of queries and a block of vectors -> each query's k best of the block, among those that can be of its k best at all.

    A vector passes if the product of lengths reaches the query's bound, then if the partial sum over the leading rotated dimensions plus
    the product of the residuals' lengths does; only then is the integer product made, which is exact below 2 ** 53. Vectors come by
    falling length, so the first test ends the block's scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers, q_ids, q_raw, q_bounds, ids_raw, m_raw, dim in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                numbers, queries, own = np.frombuffer(numbers, "<i8"), np.frombuffer(q_ids, "<i8"), np.frombuffer(q_bounds)
                ids = np.frombuffer(ids_raw, "<i8")
                q, m = np.frombuffer(q_raw).reshape(-1, dim), np.frombuffer(m_raw).reshape(-1, dim)
                lengths = np.sqrt((m * m).sum(1))
                order = np.argsort(-lengths, kind="stable")
                m, ids, lengths = m[order], ids[order], lengths[order]
                turned_q, turned = q @ rotation, m @ rotation
                rest_q = np.sqrt(np.maximum((turned_q[:, lead:] ** 2).sum(1), 0))
                rest = np.sqrt(np.maximum((turned[:, lead:] ** 2).sum(1), 0))
                q_lengths = np.sqrt((q * q).sum(1))
                out = []
                for i in range(len(queries)):
                    bound = own[i]
                    slack = 1e-9 * (1 + q_lengths[i] * (lengths[0] if len(lengths) else 0))  # of rounding, as bounds are floating point
                    n = int(np.searchsorted(-lengths, -(bound - slack) / q_lengths[i], "right")) if q_lengths[i] > 0 and bound > 0 else len(lengths)
                    near = np.flatnonzero(turned[:n, :lead] @ turned_q[i, :lead] + rest[:n] * rest_q[i] >= bound - slack)
                    near = near[ids[near] != queries[i]]
                    if len(near):
                        out += [(int(numbers[i]), int(queries[i]), s, v) for s, v in best(m[near] @ q[i], ids[near], k)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(4)], ["number", "query_id", "score", "vec_id"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Each query's k vectors of the highest integer inner product of floor(scale * x): query_id, rank (from 1), vec_id, score.

    Exact: ties go to the smaller id, and a query's own id is no candidate. With fewer candidates, all are returned. Both tables have id_col
    and vector_col; vectors that are null or hold nulls, NaN or infinities, and rows without an id, take no part. Shorter vectors
    count as if zeros followed. An empty vector scores 0. Equal vectors and repeated ids are rows of their own, on both sides. Scores must
    stay below 2 ** 53.

    Vectors are dealt by range of falling length into blocks of BLOCK at most, queries into blocks too. The HEAD longest vectors, which
    are broadcast, give every query its first bound; a block of queries then meets only the blocks of vectors whose longest can
    reach one of its bounds, and the others aren't sent to it. The rotation comes from the Gram matrix, whose size is that of the dimensions.
    """
    spark = vectors.sparkSession
    v = staged(usable(vectors, id_col, vector_col, scale), "vectors")
    q = staged(usable(queries, id_col, vector_col, scale), "queries")
    total, dim = v.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = max(dim or 0, q.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not total:
        return spark.createDataFrame([], schema)
    gram = v.select("v").mapInArrow(lean(_gram(dim)), "i bigint, j bigint, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # dim * dim numbers
    square = np.zeros((dim, dim))
    for r in gram:
        square[r["i"], r["j"]] = r["x"]
    rotation = np.linalg.svd(square)[0]  # columns: the vectors' right singular vectors, the strongest first
    top = v.orderBy(F.desc("length"), "id").limit(HEAD).collect()  # HEAD rows at most
    head = np.array([r["id"] for r in top], np.int64), _matrix([r["v"] for r in top], dim)
    blocks = -(-total // BLOCK)
    by_length = v.repartitionByRange(int(blocks), F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id")
    packed = by_length.select(F.spark_partition_id().cast("long").alias("block"), "id", "v").mapInArrow(lean(_pack(dim)), PACKED)
    packed = staged(packed.withColumn("block", F.monotonically_increasing_id()), "vector-blocks")
    numbered = q.select(F.monotonically_increasing_id().alias("number"), "id", "v")  # of a written table: the same whenever it is read
    schema_q = "q_numbers binary, q_ids binary, q_vectors binary, q_bounds binary, least_length double"
    asked = numbered.mapInArrow(lean(_ask(dim, spark.sparkContext.broadcast(head), k)), schema_q)
    asked = staged(asked.withColumn("q_block", F.monotonically_increasing_id()), "query-blocks")
    # which blocks meet is found from two numbers a block; vectors join only where they meet
    meet = asked.select("q_block", "least_length").join(packed.select(F.col("block").alias("v_block"), "longest"), F.col("longest") >= F.col("least_length")).select("q_block", "v_block")
    pairs = staged(meet, "meetings").join(asked, "q_block").join(packed.withColumnRenamed("block", "v_block"), "v_block")
    found = pairs.select("q_numbers", "q_ids", "q_vectors", "q_bounds", "ids", "vectors", "dim").mapInArrow(lean(_search(rotation, k, max(1, int(dim * LEADING)))), "number bigint, query_id bigint, score bigint, vec_id bigint")
    in_order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of the highest product with each vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))
