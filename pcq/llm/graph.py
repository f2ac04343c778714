"""Connected components of an edge table: in one task while the edges are few, else by large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slim

#: Up to so many edges (two longs each) one task joins them; beyond, steps over the whole table do.
ONE_TASK = 1_000_000


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All edges -> node and the smallest node reachable."""
    edges = [b[["u", "v"]].to_numpy() for b in slim(batches) if len(b)]
    if not edges:
        return
    nodes, ends = np.unique(np.concatenate(edges), return_inverse=True)
    root = list(range(len(nodes)))
    for a, b in ends.reshape(-1, 2).tolist():
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        # Nodes are in order, so the smaller place is the smaller node.
        root[max(a, b)] = min(a, b)
    for k in range(len(root)):
        root[k] = root[root[k]]
    for at in range(0, len(root), 100_000):
        yield pd.DataFrame({"node": nodes[at : at + 100_000], "root": nodes[root[at : at + 100_000]]})


def components(edges: DataFrame, tmp: Scratch) -> DataFrame:
    """edges(u, v: long, not null) -> (node, root): root is the smallest node reachable; one row for each node of an edge.

    Beyond ONE_TASK edges, each step sends every neighbour of a node to the node's smallest neighbour: first the larger ones (large-star), then
    the others (small-star). The number of edges never grows, and rounds grow with the logarithm of the longest path. A
    hub's edges are joined with one row that holds its minimum, so a skewed join can split them; nothing is collected.
    """
    now = tmp.save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if now.count() <= ONE_TASK:
        return tmp.save(now.coalesce(1).mapInPandas(_joined, "node long, root long"), "roots")
    step = 0
    while True:
        before = now
        # Large-star. Both directions of each edge; the minimum takes the node itself in.
        both = before.select("u", "v").union(before.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("_m", "u").alias("_m"))
        large = both.join(least, both["u"] == least["_u"]).filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        large = tmp.save(large, f"large{step}")
        # Small-star. Each edge leads from the larger to the smaller end.
        least = large.groupBy("u").agg(F.min("v").alias("_m")).withColumnRenamed("u", "_u")
        moved = large.join(least, large["u"] == least["_u"]).filter("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        small = moved.union(least.select(F.col("_u").alias("u"), F.col("_m").alias("v"))).distinct()
        now = tmp.save(small, f"small{step}")
        step += 1
        # Done when every edge leads to a root: no smaller end is a larger end of another edge.
        tails = now.select(F.col("u").alias("_t")).distinct()
        if not now.join(tails, now["v"] == tails["_t"], "left_semi").head(1):
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
