"""Connected components of a table of links, by union-find inside partitions
and alternating star steps between them.

Links never leave the executors.  Each round is written to the shared folder,
so a lost executor costs one round.  Labels are the smallest node reached.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearlink.llm.common import shared_table


class UnionFind:
    """Smallest member as root; path halving."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a < b:
            self.up[b] = a
        else:
            self.up[a] = b
        return True


def _contract(batches):
    """The links of one partition as one (node, root) row for each node."""
    uf = UnionFind()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            uf.union(x, y)
    pairs = [(x, r) for x in list(uf.up) if (r := uf.find(x)) != x]
    cols = np.array(pairs, np.int64).reshape(-1, 2)
    yield pa.record_batch([pa.array(cols[:, 0]), pa.array(cols[:, 1])], names=["a", "b"])


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _large_star(links: DataFrame) -> DataFrame:
    near = _both_ways(links)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` has two bigint columns a, b.  Returns (node, component) for
    every node of a link; component is the smallest node it is connected to.
    An empty table gives an empty table."""
    edges = shared_table(links.toDF("a", "b").where("a <> b").mapInArrow(_contract, "a long, b long").distinct(), "links")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        edges = shared_table(_small_star(_large_star(edges)), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b"), F.col("b")).distinct()
    )
