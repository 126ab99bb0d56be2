"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep

#: Edges that one task contracts at once.
BLOCK = 200_000


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest of each block of edges, as (node, least node reached)."""

    def forest(block: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for a, b in zip(block["a"].tolist(), block["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if find(x) != x]
        return pd.DataFrame({"a": np.array(nodes, np.int64), "b": np.array([find(x) for x in nodes], np.int64)})

    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= BLOCK:
            yield forest(pd.concat(held))
            held, rows = [], 0
    if held:
        yield forest(pd.concat(held))


def _least(edges: DataFrame) -> DataFrame:
    """Edges (a > b) and, for each end, the least neighbour or itself."""
    return edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable.

    Edges are pairs of longs in any order, repeats and loops allowed; pairs with a
    null are ignored, and a node with loops only is left out.  Each round is a
    large star then a small star, both a grouped minimum (combined before the
    shuffle) and a join back; edges halve distances, so rounds grow with the
    logarithm of the longest chain.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now = keep(pairs.mapInPandas(_contract, "a long, b long").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a node hang on the least one it knows
        big = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
        # small star: neighbours below, and the node itself, hang on the least
        small = _least(big)
        near = big.join(small, "a")
        now = keep(
            near.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
            .union(small.select("a", F.col("least").alias("b")))
            .distinct(),
            "edges",
        )
        after = _mark(now)
        if after == mark:
            break
        mark = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
