"""Connected components of an edge table by alternating star contraction.

Edges stay distributed: each partition first reduces its own edges to a forest
(union-find over the edges of that partition alone), then rounds of large-star
and small-star contract what is left. Every round is a written table, so a lost
executor repeats one round at most. The driver sees two numbers a round.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class Forest:
    """Union-find with path halving; the root of a tree is its smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        if x not in parent:
            parent[x] = x
            return x
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def stars(self) -> Iterator[tuple[int, int]]:
        """(member, root) of every member that is not a root."""
        for x in list(self.parent):
            if (root := self.find(x)) != x:
                yield x, root


def _local_forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(x, y)
    members, roots = [], []
    for x, root in forest.stars():
        members.append(x)
        roots.append(root)
        if len(members) == 100_000:
            yield pa.record_batch([pa.array(members, pa.int64()), pa.array(roots, pa.int64())], schema=EDGES)
            members, roots = [], []
    yield pa.record_batch([pa.array(members, pa.int64()), pa.array(roots, pa.int64())], schema=EDGES)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the smallest of them. Edges point downwards."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    handed = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node long, root long)`` for every node of ``edges (a long, b long)``.

    ``root`` is the smallest node that is reachable. Loops, repeated edges and
    edges with a null end are ignored; a node without another edge is absent.
    An empty edge table gives an empty result.
    """
    forest = edges.filter("a is not null and b is not null and a <> b").mapInArrow(_local_forests, "a long, b long")
    current = written(forest, name)
    seen = None
    while True:
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())
        if state == seen or state[0] == 0:
            break
        seen = state
        current = written(_small_star(_large_star(current)), name)
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
