"""Edits of a node table: points between two keys are deleted, or new points inserted, and only nodes that an edit touches are
counted again. The result is the table that octree.nodes gives for the edited points.

A node is a range of keys (see octree), so a range of deleted keys leaves three kinds of nodes: those within it, which go,
with the counts they have; those beside it, which stay; and those it cuts, two at most at each depth, which lose what goes
below them. Points are read of the two leaves at the ends only. Insertion reads the leaves that come to hold too many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import octree

COLUMNS = ("name", "depth", "num_points", "child_mask", "is_leaf", "key", "cell_x", "cell_y", "cell_z")


def _ends(depth: int) -> tuple[Column, Column]:
    """The first and last key of a node's range."""
    below = (F.lit(depth) - F.col("depth")) * 3
    first = F.call_function("shiftleft", F.col("key"), below)
    return first, first + F.call_function("shiftleft", F.lit(1).cast("long"), below) - 1


def _bit() -> Column:
    return F.call_function("shiftleft", F.lit(1), F.col("key").bitwiseAND(F.lit(7)).cast("int"))


def _up() -> Column:
    return F.shiftright("key", 3)


def delete(nodes: DataFrame, points: DataFrame, first: int, last: int, leaf_size: int, depth: int = octree.DEPTH) -> DataFrame:
    """The nodes without the points whose key is between first and last, both counted. points: the tree's points, with key; of
    these, those of the leaves at the two ends are read."""
    tmp = Scratch(nodes.sparkSession, "delete")
    a, b = _ends(depth)
    spread = nodes.withColumns({"_a": a, "_b": b})
    within, beside = (F.col("_a") >= first) & (F.col("_b") <= last), (F.col("_b") < first) | (F.col("_a") > last)
    cut = tmp.save(spread.filter(~within & ~beside), "cut")  # two for each depth at most
    rows = {(r["depth"], r["key"]): r for r in cut.collect()}
    # What goes below a cut node: of its children, those within go whole; a cut leaf tells by its points.
    whole = spread.filter(within).join(F.broadcast(cut.select((F.col("depth") + 1).alias("_d"), F.col("key").alias("_k"))), (F.col("depth") == F.col("_d")) & (_up() == F.col("_k")), "left_semi")
    gone = dict.fromkeys(rows, 0)

    def take(d: int, k: int, n: int) -> None:
        """n points go from a node and all above it."""
        while d >= 0:
            gone[d, k] += n
            d, k = d - 1, k >> 3

    lost: dict[tuple[int, int], int] = {}
    for r in whole.select("depth", "key", "num_points").collect():  # seven for each cut node at most
        take(r["depth"] - 1, r["key"] >> 3, r["num_points"])
        up = (r["depth"] - 1, r["key"] >> 3)
        lost[up] = lost.get(up, 0) | 1 << (r["key"] & 7)
    for (d, k), r in rows.items():
        if r["is_leaf"]:
            low, high = max(first, r["_a"]), min(last, r["_b"])
            take(d, k, points.filter(F.col("key").between(low, high)).count())
    # Cut nodes as they are now, from the bottom up, so that a node that has lost all its points is lost to its parent.
    now, closed = [], []
    for (d, k), r in sorted(rows.items(), reverse=True):
        n = r["num_points"] - gone[d, k]
        if n == 0:
            lost[d - 1, k >> 3] = lost.get((d - 1, k >> 3), 0) | 1 << (k & 7)
            continue
        leaf = r["is_leaf"] or n <= leaf_size
        mask = 0 if leaf else r["child_mask"] & ~lost.get((d, k), 0)
        if leaf and not r["is_leaf"]:
            closed.append((d, r["_a"], r["_b"]))
        now.append((r["name"], d, n, mask, leaf, k, r["cell_x"], r["cell_y"], r["cell_z"]))
    # Below a node that has become a leaf there are none.
    below = lambda d, low, high: (F.col("depth") > d) & (F.col("_a") >= low) & (F.col("_b") <= high)
    stay = F.lit(True)
    for c in closed:
        stay = stay & ~below(*c)
    kept = nodes.sparkSession.createDataFrame(now, nodes.select(*COLUMNS).schema).withColumns({"_a": a, "_b": b})
    return spread.filter(beside).unionByName(kept, allowMissingColumns=True).filter(stay).select(*COLUMNS)


def insert(nodes: DataFrame, points: DataFrame, added: DataFrame, leaf_size: int, depth: int = octree.DEPTH) -> DataFrame:
    """The nodes with the added points. points: the tree's points, added: the new ones, both with key. Of the old points, those
    of leaves that come to hold over leaf_size are read."""
    if nodes.isEmpty():
        return octree.nodes(added, leaf_size, depth).select(*COLUMNS)
    tmp = Scratch(nodes.sparkSession, "insert")
    at = [F.col("depth").alias("_d"), F.col("key").alias("_k")]
    same = (F.col("depth") == F.col("_d")) & (F.col("key") == F.col("_k"))

    def prefixes(counts: DataFrame, low: Column) -> DataFrame:
        """Points by node, of counts by key, for all depths from low on."""
        every = counts.withColumn("depth", F.explode(F.sequence(low, F.lit(depth))))
        return every.groupBy("depth", F.call_function("shiftright", F.col("_key"), (F.lit(depth) - F.col("depth")) * 3).alias("key")).agg(F.sum("_n").alias("_n"))

    new = tmp.save(prefixes(added.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("_n")), F.lit(0)), "new")
    # Existing nodes that get points, by what they get; no others are written anew.
    touched = tmp.save(nodes.join(new.select(*at, F.col("_n").alias("_more")), same).drop("_d", "_k"), "touched")
    full = touched.filter(F.col("is_leaf") & (F.col("num_points") + F.col("_more") > leaf_size) & (F.col("depth") < depth)).select(F.col("depth").alias("_d"), F.col("key").alias("_k"))
    full = tmp.save(full, "full")
    depths = [r["_d"] for r in full.select("_d").distinct().collect()]
    # The old points of leaves that are too full now, by key: asked at the depths that such leaves have.
    asked = points.select(F.col("key").alias("_key")).withColumn("_at", F.explode(F.array(*[F.lit(d) for d in sorted(depths)]) if depths else F.array().cast("array<int>")))
    count = full.count()
    asked = asked.withColumn("_up", F.call_function("shiftright", F.col("_key"), (F.lit(depth) - F.col("_at")) * 3))
    old = asked.join(F.broadcast(full) if count <= octree.BROADCAST_NODES else full, (F.col("_at") == F.col("_d")) & (F.col("_up") == F.col("_k"))).groupBy("_key", "_at").agg(F.count("*").alias("_n"))
    old = prefixes(old, F.col("_at") + 1)
    # All nodes that may come to be, with all their points; those that there are have theirs already.
    total = new.unionByName(old).groupBy("depth", "key").agg(F.sum("_n").alias("_n"))
    fresh = total.join(nodes.select(*at), same, "left_anti")
    grown = touched.select("depth", "key", (F.col("num_points") + F.col("_more")).alias("_n"))
    big = fresh.unionByName(grown).filter(F.col("_n") > leaf_size).select((F.col("depth") + 1).alias("_d"), F.col("key").alias("_k"))
    fresh = tmp.save(fresh.join(big, (F.col("depth") == F.col("_d")) & (_up() == F.col("_k")), "left_semi"), "fresh")
    bits = fresh.groupBy((F.col("depth") - 1).alias("_d"), _up().alias("_k")).agg(F.bit_or(_bit()).alias("_bits"))
    cells = [octree._gather(F.col("key"), s, depth).alias(f"cell_{c}") for c, s in (("x", 2), ("y", 1), ("z", 0))]
    made = fresh.select(octree.name_of(F.col("key"), F.col("depth")).alias("name"), "depth", F.col("_n").alias("num_points"), F.lit(0).alias("child_mask"), "key", *cells)
    grown = touched.withColumn("num_points", F.col("num_points") + F.col("_more")).select(*[c for c in COLUMNS if c != "is_leaf"])
    changed = made.unionByName(grown).join(bits, same, "left")
    mask = F.col("child_mask").bitwiseOR(F.coalesce("_bits", F.lit(0)))
    changed = changed.withColumn("child_mask", mask).withColumn("is_leaf", F.col("child_mask") == 0).select(*COLUMNS)
    return nodes.join(touched.select(*at), same, "left_anti").select(*COLUMNS).unionByName(changed)
