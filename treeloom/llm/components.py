"""Connected components of an undirected graph as Spark joins, by hooking and contracting.

Every round each vertex hooks to its smallest neighbour and the edges move to the vertices hooked to;
the number of edges left falls by a constant factor, so rounds grow with the logarithm of the longest
path. Edges are first contracted inside each partition by a union-find, which leaves at most one
edge per vertex and partition. All tables of a round are written to the shared folder, so its joins have plain
scans on both sides and hubs are split by AQE's skew join; minima are pre-aggregated in map tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


class Forest:
    """Union-find in which the smallest member is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x] = r
            x = p
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    ends = list(forest.up)
    yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array([forest.root(x) for x in ends], pa.int64())], names=["a", "b"])


def contracted(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").mapInArrow(_contract, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id, component (smallest id reachable) of every vertex of edges(a long, b long).

    Vertices without an edge to another one are left out. Raises RuntimeError if ``rounds`` don't suffice.
    """
    left = settle(contracted(edges.filter("a <> b")))
    found = None
    for _ in range(rounds):
        if not left.head(1):
            break
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to")))
        found = settle(hooks if found is None else _follow(found, hooks))
        moved = (
            left.join(hooks.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a")
            .join(hooks.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b")
            .select(F.col("ta").alias("a"), F.col("tb").alias("b"))
        )
        # A vertex hooked to may itself have hooked further down: that step stays an edge.
        further = hooks.join(hooks.select(F.col("to").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("a"), F.col("to").alias("b"))
        left = settle(contracted(moved.unionByName(further).filter("a <> b").distinct()))
    else:
        raise RuntimeError(f"components: edges are left after {rounds} rounds")
    if found is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    return found.select("id", F.col("to").alias("component"))


def _follow(found: DataFrame, hooks: DataFrame) -> DataFrame:
    """found(id, to) with each target replaced by what it hooked to; new vertices don't occur after the first round."""
    step = hooks.select(F.col("id").alias("to"), F.col("to").alias("next"))
    return found.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
