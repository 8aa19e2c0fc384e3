"""Sums of products of all pairs of series, as block matrices by range of dates and tile of assets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dates of one block and series of one side of a tile: a task holds two such matrices and their product.
DAYS, TILE = 512, 256
SUMS = "a string, b string, n bigint, sum_a double, sum_b double, sum_aa double, sum_bb double, sum_ab double"


def _matrix(names: list[str], series: dict[str, tuple[list, list]], places: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The values of the series by date, 0 where there is none, and where there is one."""
    x, there = np.zeros((len(places), len(names))), np.zeros((len(places), len(names)))
    for j, name in enumerate(names):
        at = [places[p] for p in series[name][0]]
        x[at, j] = series[name][1]
        there[at, j] = 1.0
    return x, there


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, x, y, side, asset, pos, values) in order of block and tile -> a row for each pair of the tile, a before b, with its sums over the block's dates."""
    now, sides = None, None

    def finish() -> Iterator[pa.RecordBatch]:
        left = sides[0]
        right = left if now[1] == now[2] else sides[1]
        if not left or not right:
            return
        rows, columns = sorted(left), sorted(right)
        places = {p: i for i, p in enumerate(sorted({p for s in (left, right) for pos, _ in s.values() for p in pos}))}
        x, x_there = _matrix(rows, left, places)
        y, y_there = _matrix(columns, right, places)
        sums = [x_there.T @ y_there, x.T @ y_there, x_there.T @ y, (x * x).T @ y_there, x_there.T @ (y * y), x.T @ y]
        i, j = np.triu_indices(len(rows)) if left is right else (k.ravel() for k in np.indices((len(rows), len(columns))))
        a, b = [rows[k] for k in i.tolist()], [columns[k] for k in j.tolist()]
        values = [s[i, j] for s in sums]
        if left is not right:  # tiles are dealt by hash, so that either may come first
            turn = np.array([p > q for p, q in zip(a, b, strict=True)])
            a, b = [q if t else p for p, q, t in zip(a, b, turn.tolist(), strict=True)], [p if t else q for p, q, t in zip(a, b, turn.tolist(), strict=True)]
            values = [values[0], *[np.where(turn, values[k], values[m]) for k, m in ((2, 1), (1, 2), (4, 3), (3, 4))], values[5]]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(values[0].astype(np.int64)), *[pa.array(v) for v in values[1:]]], [f.split()[0] for f in SUMS.split(", ")])

    for batch in batches:
        for block, x, y, side, asset, pos, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (block, x, y) != now:
                if now is not None:
                    yield from finish()
                now, sides = (block, x, y), ({}, {})
            sides[side][asset] = (pos, values)
    if now is not None:
        yield from finish()


def pair_sums(panel: DataFrame, days: int = DAYS, tile: int = TILE) -> DataFrame:
    """panel(asset, pos, x) -> SUMS for every pair a <= b of assets: over the dates that both have, how many, the sums of x, of its squares and of the products.

    A series is cut into pieces of `days` dates; the pieces of a block of dates meet in tiles of `tile` assets a side, half of all tiles, and each is
    one product of matrices. So a pair is a row for each block of dates, and none for each date. Rows without x are left out.
    """
    tiles = panel.agg(F.ceil(F.count_distinct("asset") / tile)).first()[0] or 1  # one number
    pieces = panel.where("x is not null").groupBy("asset", F.floor(F.col("pos") / days).alias("block")).agg(F.collect_list("pos").alias("pos"), F.collect_list(F.col("x").cast("double")).alias("values"))
    own = F.pmod(F.xxhash64("asset"), F.lit(tiles)).cast("int")
    met = pieces.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(int(tiles) - 1))))
    x, y, side = F.least("own", "other"), F.greatest("own", "other"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1)
    work = met.select("block", x.alias("x"), y.alias("y"), side.alias("side"), "asset", "pos", "values").repartition("block", "x", "y").sortWithinPartitions("block", "x", "y")
    found = work.mapInArrow(_products, SUMS)
    total = [F.sum(c).alias(c) for c in ("n", "sum_a", "sum_b", "sum_aa", "sum_bb", "sum_ab")]
    return found.groupBy("a", "b").agg(*total).where("n > 0")
