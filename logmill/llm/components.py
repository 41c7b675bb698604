"""Connected components of an edge table, on DataFrames alone.

Alternating large-star and small-star rounds.  Each star takes a minimum by node (summed before the shuffle) and
joins it back, so that a node with very many neighbours is split by adaptive execution.  Before the first round
the edges of each task are contracted to a forest.  Every round's table is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

EDGE = "u long, v long"


class UnionFind:
    """Roots are the smallest members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while (up := parent[x]) != root:
            parent[x], x = root, up
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in self.parent if (r := self.find(x)) != x]


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(edges, np.int64).reshape(-1, 2)
    return common.batch_of(u=pa.array(a[:, 0], pa.int64()), v=pa.array(a[:, 1], pa.int64()))


def edge_table(edges: list[tuple[int, int]]) -> pa.Table:
    return pa.Table.from_batches([edge_batch(edges)])


def _contract(batches, most: int = 1_000_000):
    found = UnionFind()
    for b in batches:
        for u, v in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True):
            found.union(u, v)
        if len(found.parent) > most:
            yield edge_batch(found.edges())
            found = UnionFind()
    if found.parent:
        yield edge_batch(found.edges())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # repeated edges do no harm: the small star, which follows, makes them one
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _open(edges: DataFrame) -> bool:
    """Whether some node has two edges down, or one down and one up: not yet stars alone."""
    down = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    up = edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    nodes = down.union(up).groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.agg(F.max((F.col("down") + F.col("up") > 1) & (F.col("down") > 0))).first()[0] or False


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node long, root long`` for each node of ``edges`` (u long, v long): the smallest node that it reaches.

    Loops and repeated edges are allowed; nodes with loops alone are left out.  Empty edges give no rows.
    """
    spark = edges.sparkSession
    now, path = common.materialise(edges.where("u <> v").mapInArrow(_contract, EDGE).distinct(), name)
    while _open(now):
        large, at_large = common.materialise(_large_star(now), name)
        common.remove(spark, path)
        now, path = common.materialise(_small_star(large), name)
        common.remove(spark, at_large)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
