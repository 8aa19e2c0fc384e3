"""Embedding whitening by shifted CholeskyQR (Fukaya et al., 2020): Gram passes over all rows, small factors on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, staged, table

#: Entries become floor(SCALE * entry).
SCALE = 64
#: The components that are returned, at most.
MOST = 16
#: Size of an integer entry from which vectors are refused.
LARGEST = 1 << 40
#: Rows of which one task adds integers up before it sends the sums on.
SUMMED = 1 << 22
#: Passes at most; three are enough but for a nearly singular table.
PASSES = 12
#: After the shifted pass, the square of a direction's length from which it has variance.
NO_VARIANCE = 1e-11
EPS = float(np.finfo(np.float64).eps)
_SENT = ((np.int8, 1 << 7), (np.int16, 1 << 15), (np.int32, 1 << 31), (np.int64, 1 << 63))


def _packed(scale: int):
    """(id, vector) -> (id, x): floor(scale * entry) of each entry, in the least width that holds them all, so that equal vectors are equal bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            entries = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            bad = np.r_[0, np.cumsum(~np.isfinite(entries))]
            ends = np.cumsum(sizes)
            kept = np.flatnonzero((bad[ends] == bad[ends - sizes]) & (sizes > 0))
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * entries)
            made = []
            for a, b in zip((ends - sizes)[kept].tolist(), ends[kept].tolist(), strict=True):
                most = float(np.abs(x[a:b]).max())
                if not most < LARGEST:
                    raise ValueError(f"entries of {LARGEST} / {scale} or more aren't supported")
                kind = next(k for k, (_, bound) in enumerate(_SENT) if most < bound)
                made.append(bytes([kind]) + x[a:b].astype(_SENT[kind][0]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(made, pa.binary())], ["id", "x"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    """The integers of packed vectors, one row each."""
    rows = [np.frombuffer(v, _SENT[v[0]][0], offset=1) for v in column.to_pylist()]
    if len({len(r) for r in rows}) > 1:
        raise ValueError("vectors must have as many entries as each other")
    return np.stack(rows).astype(np.int64) if rows else np.empty((0, 0), np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x -> (i, total): exact sums of each dimension, and the number of rows as dimension -1."""
    n, total = 0, None

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([n, *total.tolist()], pa.int64())], ["i", "total"])

    for batch in batches:
        x = _matrix(batch.column(0))
        if not len(x):
            continue
        if total is not None and len(total) != x.shape[1]:
            raise ValueError("vectors must have as many entries as each other")
        total = x.sum(0) + (0 if total is None else total)
        n += len(x)
        if n >= SUMMED:
            yield sent()
            n, total = 0, None
    if n:
        yield sent()


class Centre:
    """The fit list's exact mean: x - S / n of a dimension is x - whole - part / n, with integers whole and 0 <= part < n."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.whole, self.part = n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.part / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - S)^2 of each row, exact whatever its size."""
        d = x - self.whole
        most = int(np.abs(d).max(initial=0))
        if max(most, self.n) * most * max(1, x.shape[1]) >= 1 << 62:
            d = d.astype(object)
        squares, mixed, rest = (d * d).sum(1).tolist(), (d * self.part).sum(1).tolist(), sum(p * p for p in self.part.tolist())
        return [self.n * self.n * s - 2 * self.n * m + rest for s, m in zip(squares, mixed, strict=True)]


def solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows times the inverse of the upper triangular r, by substitution."""
    q = rows.copy()
    for j in range(r.shape[0]):
        q[:, j] = (q[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _gram(make):
    """x -> (i, row): the rows of the Gram matrix of make(x), with the sums of its columns as the last one, added up over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                rows = make(x)
                both = np.vstack([rows.T @ rows, rows.sum(0)])
                total = both if total is None else total + both
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, row) -> one row for each i: their sum."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[i] = np.array(row) + total.get(i, 0.0)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["i", "row"])


def gram(fit: DataFrame, make) -> tuple[np.ndarray, np.ndarray]:
    """The Gram matrix of the rows make(x) over all of fit(x), and their sum. The driver gets one matrix, d x d, whatever the number of rows."""
    rows = "i int, row array<double>"
    found = fit.select("x").mapInArrow(lean(_gram(make)), rows).repartition("i").mapInArrow(lean(_added), rows).collect()
    both = np.array([r["row"] for r in sorted(found, key=lambda r: r["i"])])
    return both[:-1], both[-1]


def cholesky(g: np.ndarray, shift: float) -> np.ndarray:
    """The upper triangular r with r^T r = g + s I: s is 0 if that can be, else shift, doubled until it can."""
    s = 0.0
    while True:
        try:
            return np.linalg.cholesky(g + s * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            s = 2 * s or shift


def triangle(fit: DataFrame, centre: Centre) -> np.ndarray:
    """r with A = Q r, for the matrix A of the centred rows of fit and orthonormal columns in Q; as many rows as A has directions.

    The first Gram matrix is shifted by 11 (n d + d (d + 1)) u |A|^2, which makes its factor exist however ill-conditioned A is. Each further pass
    solves all rows against the factors so far and takes the Gram matrix of what comes out, until that is the identity. The first of them
    shows which directions have variance: a shifted pass lifts even a share of 10^-16 of the largest well above NO_VARIANCE, and leaves
    rounding errors, which are all that columns that depend on each other have besides, well below. Those directions are dropped there.
    """
    g, _ = gram(fit, centre.centred)
    d = len(g)
    top = float(np.linalg.eigvalsh(g)[-1])
    if not top > 0:
        return np.empty((0, d))
    shift = 11 * (centre.n * d + d * (d + 1)) * EPS / 2
    first = np.linalg.cholesky(g + shift * top * np.eye(d)).T
    steps = [lambda rows: solved(rows, first)]
    product = first
    for k in range(PASSES):

        def orthogonal(x: np.ndarray, steps: tuple = tuple(steps)) -> np.ndarray:
            rows = centre.centred(x)
            for step in steps:
                rows = step(rows)
            return rows

        g, _ = gram(fit, orthogonal)
        if k == 0:
            values, vectors = np.linalg.eigh(g)
            if values[0] <= NO_VARIANCE:
                kept = vectors[:, values > NO_VARIANCE]
                steps.append(lambda rows, kept=kept: rows @ kept)
                product, g = kept.T @ product, kept.T @ g @ kept
        r = cholesky(g, shift)
        steps.append(lambda rows, r=r: solved(rows, r))
        product = r @ product
        if np.abs(g - np.eye(len(g))).max() < 100 * d * EPS:
            break
    return product


def _whitened(centre: Centre, turn: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            white = centre.centred(x) @ turn
            exact = pa.array([Decimal(v) for v in centre.deviations(x)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), exact, pa.array(list(white), pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, most: int = MOST, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vectors -> vec_id, n (distinct vectors), deviation (decimal), component, whitened, explained and identity_error: a row for each
    vector and each of the `most` leading components.

    Entries c become integers x = floor(scale * c), in 64-bit floats; a constant added to all x changes none of the results. Mean and covariance are
    those of the distinct vectors, each once. whitened is x less the mean, on the component, over the root of its eigenvalue; explained is the
    eigenvalue's share of all; identity_error the largest entry by size of the covariance of whitened less the identity. deviation is the sum over
    dimensions of (n x - S)^2, exact. Of each component the largest entry by size is positive.

    Defined cases: vectors that are null, empty or hold a null, NaN or infinity are left out; equal vectors count once in the fit and each have
    their rows; ids may be null or repeated; directions without variance (to double precision) are no components, so one distinct vector, or an
    empty table, gives no rows; vectors of different lengths, and integers beyond 2^40, are errors; other columns are ignored.

    Distinct vectors are written once, in the least width; each pass reads them, and a task sends one d x d matrix, which tasks add by row. The
    driver holds d x d numbers. The passes are eager; the rows returned are computed when read.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).mapInArrow(lean(_packed(scale)), "id bigint, x binary")
    fit = staged(rows.select("x").distinct(), "vectors")
    sums = {r["i"]: int(r["total"]) for r in fit.mapInArrow(lean(_sums), "i int, total bigint").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    n = sums.pop(-1, 0)
    shape = "vec_id long, n long, deviation decimal(38,0), component int, whitened double, explained double, identity_error double"
    if not n:
        return vectors.sparkSession.createDataFrame([], shape)
    centre = Centre(n, [sums[i] for i in range(len(sums))])
    r = triangle(fit, centre)
    if not len(r):
        return vectors.sparkSession.createDataFrame([], shape)
    _, spread, components = np.linalg.svd(r, full_matrices=False)
    turn = components.T[:, :most]
    turn = turn * np.sign(turn[np.abs(turn).argmax(0), np.arange(turn.shape[1])])
    explained = (spread * spread / (spread @ spread))[:most].tolist()
    turn = turn * (np.sqrt(n) / spread[:most])
    squares, total = gram(fit, lambda x: centre.centred(x) @ turn)
    error = float(np.abs(squares / n - np.outer(total / n, total / n) - np.eye(len(squares))).max())
    white = rows.mapInArrow(lean(_whitened(centre, turn)), "id bigint, deviation decimal(38,0), whitened array<double>")
    out = white.select(F.col("id").alias("vec_id"), F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("whitened").alias("place", "whitened"))
    shares = F.array(*[F.lit(e) for e in explained])
    return out.select("vec_id", "n", "deviation", (F.col("place") + 1).alias("component"), "whitened", F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the 16 leading components of all, whitened."""
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")
