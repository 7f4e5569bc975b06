"""Connected components of a graph given as edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outboxlake.llm.store import stored

_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class Forest:
    """Union-find over any hashable names; the smallest name leads."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        low, high = (x, y) if x < y else (y, x)
        self.parent[high] = low
        self.parent.setdefault(low, low)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A star forest with the same components as the edges of each batch."""
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        pairs = [(x, r) for x in forest.parent if (r := forest.find(x)) != x]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=_EDGES)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge (a, b); the component is its smallest node.

    Large-star and small-star rounds until nothing changes: a number of rounds that grows
    with the logarithm of the nodes. Minima combine before the shuffle; the join of a hot
    node's edges is left to adaptive execution, which splits it. Each round is written to
    the shared folder. Null ends and loops are ignored; no edges give no rows.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    edges = stored(edges.mapInArrow(_contract, "a long, b long").distinct(), "stars")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        # Large star: each larger neighbour moves to the smallest one.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: the node and its smaller neighbours move to the smallest one.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
