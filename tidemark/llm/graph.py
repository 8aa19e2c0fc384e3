"""Connected components of links, as joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, staged


class Forest:
    """Union-find over any hashable nodes; joins() keeps the links that united two trees."""

    def __init__(self) -> None:
        self.up: dict = {}
        self.kept: list[tuple] = []

    def root(self, node):
        up = self.up
        top = node
        while (above := up.get(top, top)) != top:
            top = above
        while node != top:
            up[node], node = top, up.get(node, node)
        return top

    def join(self, a, b) -> bool:
        x, y = self.root(a), self.root(b)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        self.kept.append((a, b))
        return True


class Labels:
    """Components of n numbered nodes, a label each; join() ties a node to others and keeps the links that united two components."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def join(self, i: int, others: np.ndarray) -> None:
        others = others[self.of[others] != self.of[i]]
        if len(others):
            labels, at = np.unique(self.of[others], return_index=True)
            self.kept += [(i, j) for j in others[at].tolist()]
            self.of[np.isin(self.of, labels)] = self.of[i]


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's links, a spanning forest; the forest of each batch is enough."""
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        pairs = forest.kept
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], batch.schema.types[i]) for i in (0, 1)], ["a", "b"])


#: A node is hot from HOT_SHARE of all links on, and from HOT_LEAST; so 2 / HOT_SHARE nodes can be hot at most.
HOT_SHARE, HOT_LEAST = 1 / 400, 100


def _hot(both: DataFrame, n: int) -> DataFrame:
    """(node, least) of the hot nodes and their least neighbours: 2 / HOT_SHARE rows at most, as each link has two ends."""
    found = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"), F.count("*").alias("n")).where(F.col("n") >= max(HOT_LEAST, n * HOT_SHARE))
    rows = found.select("node", "least").collect()
    return F.broadcast(both.sparkSession.createDataFrame(rows, found.select("node", "least").schema))


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, root): root is the smallest node that links reach. Nodes without links don't occur.

    Large-star and small-star rounds (Kiveris et al., 2014), each of them a minimum over a node's neighbours, until a round moves
    nothing: about log2 of the longest path. A round is two shuffles, and its links are written, so that lineage stays short and a
    lost executor costs one round at most. The links of hot nodes are spread over all tasks: their least neighbours, some hundreds of
    values whatever the input's size, are found first and broadcast. Null ends are dropped; repeated links and loops don't matter.
    """
    kind = links.schema["a"].dataType.simpleString()
    thin = links.where("a is not null and b is not null and a != b").mapInArrow(lean(_thin), f"a {kind}, b {kind}")
    current = staged(thin.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    n = current.count()
    moved = n > 0
    while moved:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        hot = _hot(both, n)
        known = both.join(hot, F.col("u") == F.col("node"), "left")
        own = Window.partitionBy("u", F.when(F.col("least").isNotNull(), F.col("v")))  # a hot node's links are on their own
        least = F.least("u", F.coalesce("least", F.min("v").over(own)))
        large = known.select("u", "v", least.alias("m")).where("v > u and v != m").select(F.col("v").alias("a"), F.col("m").alias("b"), (F.col("m") != F.col("u")).alias("moved"))
        known = large.join(hot, F.col("a") == F.col("node"), "left")
        own = Window.partitionBy("a", F.when(F.col("least").isNotNull(), F.col("b"))).orderBy("b")
        known = known.select("a", "b", "moved", "least", F.lag("b").over(own).alias("before"), F.coalesce("least", F.min("b").over(own)).alias("m")).where("not before <=> b")
        to_m = lambda x: F.struct(F.greatest(x, "m").alias("a"), F.least(x, "m").alias("b"), (F.col("moved") | (F.col("b") != F.col("m"))).alias("moved"))
        ends = F.when(F.col("least").isNotNull(), F.array(to_m("a"), to_m("b"))).otherwise(F.array(to_m(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")))))
        current = staged(known.select(F.explode(ends).alias("e")).select("e.*").where("a != b"), "links")
        moved = not current.where("moved").isEmpty()
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)
