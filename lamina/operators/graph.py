"""Connected components of distributed links, by union-find in partitions and shortening of chains."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import cut

_SCHEMA = "u long, v long, own boolean"


def _trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over a partition's links: a link from every node to the least of its tree; ``own``: whether the node had a link to a smaller one."""
    parent: dict[int, int] = {}
    own: set[int] = set()

    def root(x: int) -> int:
        r = x
        while (p := parent.setdefault(r, r)) != r:
            r = p
        while parent[x] != r:
            parent[x], x = r, parent[x]
        return r

    for b in batches:
        for u, v in zip(b["u"].tolist(), b["v"].tolist(), strict=True):
            own.add(max(u, v))
            a, c = root(u), root(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    nodes = [x for x in parent if root(x) != x]
    yield pd.DataFrame({"u": pd.array(nodes, "int64"), "v": pd.array([parent[x] for x in nodes], "int64"), "own": pd.array([x in own for x in nodes], "boolean")})


def least_of_component(links: DataFrame) -> DataFrame:
    """``u`` and the least node it is connected with, ``v``, for each node of ``links(u, v)`` that isn't the least itself.

    In turn, all links of a node to smaller ones meet in one partition and are made one tree, and
    every link to a node that has a smaller one itself goes on to that: the number of rounds grows
    with the logarithm of a component's diameter. Links that share their end, as those of a large
    component do, meet in a join of two written tables only, which adaptive execution can split.
    """
    edges = links.select("u", "v").mapInPandas(_trees, _SCHEMA).select("u", "v")
    while True:
        edges = cut(edges.repartition("u").mapInPandas(_trees, _SCHEMA))
        ends = edges.select(F.col("u").alias("n"), F.col("v").alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(None), F.lit(1)))
        open_ = ends.groupBy("n").agg(F.min("up").alias("lo"), F.max("up").alias("hi"), F.max("down").alias("down")).where("lo < hi or (lo is not null and down = 1)")
        if open_.isEmpty():
            return cut(edges.select("u", "v").distinct())
        on = edges.where("own").select(F.col("u").alias("v"), F.col("v").alias("w"))
        edges = edges.join(on, "v", "left").select("u", F.coalesce("w", "v").alias("v"))
