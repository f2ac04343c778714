"""Octrees as tables: a node is a range of keys, and the tree is made by counting keys from the top down.

A point's key interleaves the bits of its cells on the three axes (4 * x + 2 * y + z at each level), so the node that holds
it at some depth is a prefix of the key, and a node's name is 'r' and the prefix's octal digits. Counting starts at the
depth where nodes would be small if points were spread evenly; only points of cells that are still too large are counted
again, further down. A prefix is a node if it is the root or its parent holds more than leaf_size points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, running

DEPTH, LEAF_VIEW, LEAF_FILE = 12, 2000, 5000
#: Most levels that one count goes down at a time: a cell has at most 8 ** LEVELS cells below it there.
LEVELS = 6
#: Up to so many nodes (a few longs each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_NODES = 500_000


def with_cells(points: DataFrame, lo: tuple, hi: tuple, depth: int = DEPTH) -> DataFrame:
    """Adds _x, _y, _z, the cells by repeated halving: a value on a midpoint belongs to the upper half; an axis without extent
    has the last cell only. Division can round across a boundary; the boundary itself decides. Each step is a column of its
    own, so that the next one reads it instead of working it out again."""
    n = 1 << depth
    wide = [(k, c, (hi[k] - lo[k]) / n) for k, c in enumerate("xyz") if hi[k] > lo[k]]
    out = points.withColumns({f"_{c}": F.lit(n - 1) for k, c in enumerate("xyz") if not hi[k] > lo[k]})
    out = out.withColumns({f"_{c}0": F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.col(c) - lo[k]) / (hi[k] - lo[k]) * n).cast("int"))) for k, c, _ in wide})
    out = out.withColumns({f"_{c}1": F.col(f"_{c}0") - ((F.col(f"_{c}0") > 0) & (F.col(c) < F.lit(lo[k]) + F.col(f"_{c}0") * F.lit(step))).cast("int") for k, c, step in wide})
    out = out.withColumns({f"_{c}": F.col(f"_{c}1") + ((F.col(f"_{c}1") < n - 1) & (F.col(c) >= F.lit(lo[k]) + (F.col(f"_{c}1") + 1) * F.lit(step))).cast("int") for k, c, step in wide})
    return out.drop(*[f"_{c}{i}" for _, c, _ in wide for i in (0, 1)])


def _lookup(values: list[int], at: Column) -> Column:
    """values[at] of a constant array of 64 numbers."""
    return F.get(F.expr(f"array({', '.join(f'{v}L' for v in values)})"), at.bitwiseAND(F.lit(63)).cast("int"))


def _or(parts: list[Column]) -> Column:
    out = parts[0]
    for v in parts[1:]:
        out = out.bitwiseOR(v)
    return out


def _spread(cell: Column, place: int, depth: int) -> Column:
    """The bits of a cell, three apart, from `place` on: six at a time, by a table."""
    table = [sum((v >> b & 1) << 3 * b for b in range(6)) for v in range(64)]
    return _or([F.shiftleft(_lookup(table, F.shiftright(cell, 6 * k)), 18 * k + place) for k in range(-(-depth // 6))])


def _gather(key: Column, place: int, depth: int = 20) -> Column:
    """The cell whose bits stand three apart in the key: the reverse of _spread, two bits at a time."""
    table = [(v & 1) | (v >> 3 & 1) << 1 for v in range(64)]
    return _or([F.shiftleft(_lookup(table, F.shiftright(key, 6 * k + place)), 2 * k) for k in range(-(-depth // 2))]).cast("int")


def name_of(key: Column, depth: Column) -> Column:
    return F.when(depth == 0, F.lit("r")).otherwise(F.concat(F.lit("r"), F.lpad(F.conv(key.cast("string"), 10, 8), depth, F.lit("0"))))


def with_path(points: DataFrame, lo: tuple, hi: tuple, depth: int = DEPTH) -> DataFrame:
    """Adds key, and path: the name of the deepest node."""
    if not 0 < depth <= 20:
        raise ValueError("a key holds up to 20 levels")
    cells = with_cells(points, lo, hi, depth)
    key = _or([_spread(F.col(f"_{c}"), s, depth) for c, s in (("x", 2), ("y", 1), ("z", 0))])
    # Never null, or joins would test it for null far below, where it would be worked out once more.
    keyed = cells.withColumn("key", F.coalesce(key, F.lit(0).cast("long"))).drop("_x", "_y", "_z")
    return keyed.withColumn("path", name_of(F.col("key"), F.lit(depth)))


def _up(key: Column, levels: Column | int) -> Column:
    return F.shiftright(key, 3 * levels) if isinstance(levels, int) else F.call_function("shiftright", key, levels * 3)


def _hint(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_NODES else df


def nodes(pathed: DataFrame, leaf_size: int, depth: int = DEPTH) -> DataFrame:
    """name, depth, num_points (of the subtree), child_mask, is_leaf, key, and the node's cells at its own depth.

    Runs a job for each step down; the steps' counts and the node table are written, as they are used more than once."""
    tmp = Scratch(pathed.sparkSession, "octree")
    every, dense, dense_rows, top = None, None, 0, 0
    most = pathed.count()
    while most and (top == 0 or dense_rows):
        # As far down as the largest cell would need if its points were spread evenly.
        bottom = min(depth, top + min(LEVELS, max(1, math.ceil(math.log(max(1.0, most / leaf_size), 8)))))
        points = pathed.select(_up(F.col("key"), depth - bottom).alias("_k"))
        if top:
            points = points.join(_hint(dense, dense_rows), _up(F.col("_k"), bottom - top) == F.col("_dense"), "left_semi")
        counts = tmp.save(points.groupBy("_k").agg(F.count("*").alias("_n")), f"counts{bottom}")
        level = F.explode(F.sequence(F.lit(top + 1 if top else 0), F.lit(bottom))).alias("depth")
        step = counts.select("_k", "_n", level).groupBy("depth", _up(F.col("_k"), F.lit(bottom) - F.col("depth")).alias("key")).agg(F.sum("_n").alias("num_points"))
        every = step if every is None else every.unionByName(step)
        big = counts.filter(F.col("_n") > leaf_size)
        dense, top = big.select(F.col("_k").alias("_dense")), bottom
        found = big.agg(F.count("*").alias("n"), F.max("_n").alias("m")).first()
        dense_rows, most = found["n"], found["m"]
        if bottom == depth:
            break
    if every is None:
        every = pathed.sparkSession.createDataFrame([], "depth int, key long, num_points long")
    every = tmp.save(every, "every")
    inner = every.filter((F.col("num_points") > leaf_size) & (F.col("depth") < depth)).select(F.col("depth").alias("_d"), F.col("key").alias("_p"))
    kept = every.join(inner, (F.col("depth") == F.col("_d") + 1) & (_up(F.col("key"), 1) == F.col("_p")), "left_semi").union(every.filter("depth = 0"))
    digit = F.col("key").bitwiseAND(F.lit(7)).cast("int")
    masks = kept.filter("depth > 0").groupBy((F.col("depth") - 1).alias("_d"), _up(F.col("key"), 1).alias("_p")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), digit)).alias("child_mask"))
    out = kept.join(masks, (F.col("depth") == F.col("_d")) & (F.col("key") == F.col("_p")), "left")
    mask = F.coalesce("child_mask", F.lit(0))
    cells = [_gather(F.col("key"), s, depth).alias(f"cell_{c}") for c, s in (("x", 2), ("y", 1), ("z", 0))]
    return tmp.save(out.select(name_of(F.col("key"), F.col("depth")).alias("name"), "depth", "num_points", mask.alias("child_mask"), (mask == 0).alias("is_leaf"), "key", *cells), "nodes")


def cells_of_names(nodes: DataFrame) -> DataFrame:
    """Adds cell_x, cell_y, cell_z to nodes that only have a name."""
    key = F.conv(F.concat(F.lit("0"), F.substring("name", 2, 30)), 8, 10).cast("long")
    return nodes.withColumns({f"cell_{c}": _gather(key, s) for c, s in (("x", 2), ("y", 1), ("z", 0))})


def with_box(nodes: DataFrame, lo: tuple, hi: tuple) -> DataFrame:
    """Adds the node's box, bounding radius and spacing, from its cells (or else from its name)."""
    out = nodes if "cell_x" in nodes.columns else cells_of_names(nodes)
    for k, c in enumerate("xyz"):
        side = F.lit(float(hi[k] - lo[k])) / F.pow(F.lit(2.0), F.length("name") - 1)
        out = out.withColumn(f"min_{c}", F.lit(float(lo[k])) + F.col(f"cell_{c}") * side).withColumn(f"max_{c}", F.lit(float(lo[k])) + (F.col(f"cell_{c}") + 1) * side)
    half = sum((F.col(f"max_{c}") - F.col(f"min_{c}")) * (F.col(f"max_{c}") - F.col(f"min_{c}")) for c in "xyz")
    diagonal = sum((h - a) ** 2 for a, h in zip(lo, hi, strict=True)) ** 0.5
    return out.withColumn("radius", F.sqrt(half) / 2).withColumn("spacing", F.lit(diagonal) / F.pow(F.lit(2.0), F.length("name") - 1))


def _depth_at(firsts: np.ndarray, depths: np.ndarray, depth: int):
    """A function of keys: the depth of the leaf that holds each, null where none does. firsts: the first keys of leaves, sorted."""

    @F.pandas_udf("int")
    def find(key: pd.Series) -> pd.Series:
        own = key.to_numpy(np.int64, na_value=-1)
        at = np.searchsorted(firsts, own, "right") - 1
        found = np.where(at >= 0, depths[np.maximum(at, 0)], 0)
        held = (at >= 0) & (own >> 3 * (depth - found) == firsts[np.maximum(at, 0)] >> 3 * (depth - found))
        return pd.Series(found, dtype="Int32").where(held)

    return find


def leaf_of(pathed: DataFrame, nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Adds leaf: the leaf that holds each point; a point outside all leaves is left out. Leaves are ranges of keys that do not
    overlap, so the one that holds a key is the last that begins at it or before, and its depth tells its name.

    While leaves are few (checked), each task has their first keys, sorted, and points are not moved. Beyond, leaves and points
    are dealt into common ranges of keys and merged; points whose leaf begins in a range before theirs find it among the last
    leaves of the ranges, a row for each."""
    first = F.call_function("shiftleft", F.col("key"), (F.lit(depth) - F.col("depth")) * 3)
    leaves = nodes.filter("is_leaf").select(first.alias("key"), F.col("depth").alias("_depth"))
    n = leaves.count()
    if not n:
        return pathed.withColumn("leaf", F.lit(None).cast("string")).filter("false")
    if n <= BROADCAST_NODES:
        found = pathed.withColumn("_depth", _depth_of(leaves, depth)(F.col("key")))
    else:
        tmp = Scratch(pathed.sparkSession, "leaves")
        both = pathed.withColumn("_depth", F.lit(None).cast("int")).unionByName(leaves, allowMissingColumns=True).withColumn("_leaf", F.col("_depth").isNotNull())
        ranges = max(1, n // max(1, BROADCAST_NODES), int(pathed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        schema = both.schema
        merged = both.repartitionByRange(ranges, "key").sortWithinPartitions("key", F.desc("_leaf")).mapInArrow(_merged(depth, schema), schema)
        merged = tmp.save(merged, "merged")
        # What is left of the leaves is the last one of each range.
        last = _depth_of(merged.filter("_leaf").select("key", "_depth"), depth)
        found = merged.filter("not _leaf").withColumn("_depth", F.coalesce("_depth", last(F.col("key")))).drop("_leaf")
    found = found.filter("_depth is not null")
    name = name_of(F.call_function("shiftright", F.col("key"), (F.lit(depth) - F.col("_depth")) * 3), F.col("_depth"))
    # Never null, as with key.
    return found.withColumn("leaf", F.coalesce(name, F.lit(""))).drop("_depth")


def _depth_of(leaves: DataFrame, depth: int):
    rows = leaves.toPandas().sort_values("key")
    return _depth_at(rows["key"].to_numpy(np.int64), rows["_depth"].to_numpy(np.int64), depth)


def _merged(depth: int, schema):
    """Points with the depth of their leaf, from leaves and points in the order of keys, and the last leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, kept = -1, 0, None
        for own in batches:
            key, is_leaf = own.column("key").to_numpy(), own.column("_leaf").to_numpy(zero_copy_only=False).astype(bool)
            depths = own.column("_depth").fill_null(0).to_numpy()
            # The last leaf at each row: of those in this batch, else the one that is held.
            place = np.maximum.accumulate(np.where(is_leaf, np.arange(len(key)), -1))
            firsts = np.where(place >= 0, key[np.maximum(place, 0)], at)
            found = np.where(place >= 0, depths[np.maximum(place, 0)], held).astype(np.int64)
            inside = (firsts >= 0) & (key >> 3 * (depth - found) == firsts >> 3 * (depth - found))
            column = pa.array(np.where(inside, found, 0).astype(np.int32), mask=~inside)
            if len(key) and place[-1] >= 0:
                at, held = int(key[place[-1]]), int(depths[place[-1]])
                kept = own.slice(int(place[-1]), 1)
            out = own.set_column(own.schema.get_field_index("_depth"), "_depth", column)
            yield out.filter(pa.array(~is_leaf))
        if kept is not None:
            yield kept

    return run


def statistics(nodes: DataFrame) -> DataFrame:
    leaf = F.when(F.col("is_leaf"), 1)
    return nodes.agg(F.count("*").alias("total_nodes"), F.count(leaf).alias("leaf_nodes"), F.sum(F.when(F.col("is_leaf"), F.col("num_points"))).alias("total_points"), F.max("depth").alias("max_depth"), F.max(F.when(F.col("is_leaf"), F.col("num_points"))).alias("max_leaf_points"))


def byte_offsets(nodes: DataFrame, point_bytes: int = 19) -> DataFrame:
    """name, byte_offset, byte_size: leaves lie one after another in depth-first order; a parent spans its descendants."""
    leaves = nodes.filter("is_leaf").select("name", (F.col("num_points") * point_bytes).alias("byte_size"))
    leaves = running(leaves, ["name"], F.col("byte_size"), "byte_offset")
    spans = leaves.select("byte_offset", "byte_size", F.explode(F.expr("transform(sequence(1, length(name)), i -> substring(name, 1, i))")).alias("name"))
    return spans.groupBy("name").agg(F.min("byte_offset").alias("byte_offset"), F.sum("byte_size").alias("byte_size"))


def streaming_fill(pathed: DataFrame, cap: int, depth: int, held: DataFrame | None = None) -> DataFrame:
    """The points, all columns, with node: points come in the order of point_idx and stay in the first node on their path that
    holds fewer than cap; the deepest level keeps all. held: (node, n), what nodes hold before the first point comes.

    Level by level, the points of smallest point_idx for which a node has room stay: every task offers its own cap smallest of
    a node (so a node's points are never in one task), and the last one that stays is the threshold for those that go on.
    These are written for the next level, fewer each time."""
    from pyspark.sql import Window as W

    tmp = Scratch(pathed.sparkSession, "fill")
    left, kept = pathed, []
    for d in range(depth):
        at = left.withColumn("node", F.substring("path", 1, d + 1))
        # A filter on a rank is a partial one before the shuffle as well.
        ranked = at.select("point_idx", "node").withColumn("_r", F.row_number().over(W.partitionBy("node").orderBy("point_idx"))).filter(F.col("_r") <= cap)
        if held is not None:
            full = held.filter(F.length("node") == d + 1).select(F.col("node").alias("_held"), F.col("n").alias("_n"))
            ranked = ranked.join(full, F.col("node") == F.col("_held"), "left").filter(F.col("_r") + F.coalesce("_n", F.lit(0)) <= cap)
        # Of each node: how many stay, and the last of them.
        stay = tmp.save(ranked.groupBy("node").agg(F.count("*").alias("n"), F.max("point_idx").alias("_last")).withColumnRenamed("node", "_node"), f"stay{d}")
        met = at.join(_hint(stay, stay.count()), F.col("node") == F.col("_node"), "left")
        stays = F.coalesce(F.col("point_idx") <= F.col("_last"), F.lit(False))
        dealt = tmp.save(met.withColumn("_stays", stays).drop("_node", "n", "_last"), f"level{d}", by=["_stays"])
        kept.append(dealt.filter("_stays").drop("_stays"))
        left = dealt.filter("not _stays").drop("_stays", "node")
        if left.isEmpty():
            break
    else:
        kept.append(left.withColumn("node", F.substring("path", 1, depth + 1)))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out
