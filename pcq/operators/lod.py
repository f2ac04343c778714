"""Level of detail under a point budget.

A best-first heap pops nodes by falling weight, and weights never grow from parent to child, so one sort and a running
sum give the same nodes: filter the nodes whose ancestors all give way, order them by weight and name, and cut at the
first row that would overflow the budget (a break: later, smaller nodes don't fit in either).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.camera import Orbit, View, in_frustum, low_high
from ..scratch import running

# Pixels that a node must cover to be refined (isometric) and for a child to be pushed (perspective); the
# level up to which size does not matter; margins of the viewport in pixels; queue limits.
MIN_ISO, MIN_FPS, ALWAYS_LEVEL = 250.0, 300.0, 2
MARGIN_CLOUD, MARGIN_NODES = 40.0, 10.0
LOADS_LEAST, LOADS_MOST, LOADS = 4, 64, 16
TOP = 1.7976931348623157e308


def _box() -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    return tuple(F.col(f"min_{c}") for c in "xyz"), tuple(F.col(f"max_{c}") for c in "xyz")


def screen_box(view: View, lo: tuple[Column, ...], hi: tuple[Column, ...]) -> dict[str, Column]:
    """The screen box of the projected corners of a box."""
    fx, fy, _ = view.screen()
    (a, b), (c, d) = low_high(fx, lo, hi), low_high(fy, lo, hi)
    return {"sx_min": a, "sx_max": b, "sy_min": c, "sy_max": d}


def screen_boxes(nodes: DataFrame, view: View) -> DataFrame:
    """Adds sx_min, sx_max, sy_min, sy_max: the box of the projected corners."""
    return nodes.withColumns(screen_box(view, *_box()))


def on_screen(view: View, margin: float, box: dict[str, Column] | None = None) -> Column:
    box = box or {c: F.col(c) for c in ("sx_min", "sx_max", "sy_min", "sy_max")}
    return (box["sx_max"] >= -margin) & (box["sx_min"] <= view.width + margin) & (box["sy_max"] >= -margin) & (box["sy_min"] <= view.height + margin)


def _ancestors(holds) -> Column:
    """Whether holds(depth, lo, hi) is true for the box of every proper ancestor of a node. A box follows from the node's own
    (an ancestor is as many times larger as it is levels above, and begins at a multiple of that), so nothing is joined."""

    def at(j: Column) -> Column:
        times = F.pow(F.lit(2.0), F.col("depth") - j)
        up = F.col("depth") - j
        lo, hi = [], []
        for c in "xyz":
            side = F.col(f"max_{c}") - F.col(f"min_{c}")
            cell = F.col(f"cell_{c}")
            first = F.call_function("shiftleft", F.call_function("shiftright", cell, up), up)
            low = F.col(f"min_{c}") - (cell - first) * side
            lo.append(low)
            hi.append(low + side * times)
        return holds(j, tuple(lo), tuple(hi))

    return (F.col("depth") == 0) | F.forall(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("depth") - 1)), at)


def visible_leaves(nodes: DataFrame, view: View, margin: float = MARGIN_CLOUD) -> DataFrame:
    return screen_boxes(nodes.filter("is_leaf"), view).filter(on_screen(view, margin))


def stride_sample(points: DataFrame, leaves: DataFrame, budget: int) -> DataFrame:
    """points(point_idx, leaf) of the leaves, thinned: every stride-th in the order of leaf and point_idx, at most budget
    of them; stride is the rounded ratio of points to budget. leaves(name, num_points) give each leaf's first place; a
    point's own is that plus its rank within the leaf, so no window covers more than a leaf."""
    total = leaves.agg(F.sum("num_points")).first()[0] or 0
    stride = max(1, math.floor(total / budget + 0.5))
    starts = running(leaves.select(F.col("name").alias("_l"), "num_points"), ["_l"], F.col("num_points"), "_s").drop("num_points")
    place = F.col("_s") + F.row_number().over(W.partitionBy("leaf").orderBy("point_idx")) - 1
    out = points.join(starts, points["leaf"] == starts["_l"]).withColumn("place", place)
    return out.filter((F.col("place") % stride == 0) & (F.col("place") < budget * stride)).drop("_l", "_s")


def _cut(reached: DataFrame, counts: Column, takes: Column, budget: int) -> DataFrame:
    """Rows in order of weight and name, up to the first that would overflow; of these, the ones that take points.
    reached is a table of nodes, small beside the points."""
    order = W.orderBy(F.desc("weight"), "name")
    before = F.coalesce(F.sum(F.when(takes, counts).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    over = F.max(F.when(before + counts > budget, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0))
    out = reached.withColumn("_over", over).withColumn("_take", takes).withColumn("rank", F.row_number().over(order))
    return out.filter((F.col("_over") == 0) & F.col("_take")).drop("_over", "_take")


def select_iso(nodes: DataFrame, view: View, budget: int, count: str = "num_points", min_pixel: float = MIN_ISO) -> DataFrame:
    """Nodes (with boxes and cells) to draw in an isometric view: a node that is large on screen and has children gives way
    to them. A node is reached if all its ancestors are on screen and large, which its own row tells. What is reached is
    bounded by the screen: few nodes of min_pixel pixels fit on it at each level."""
    width = lambda box: F.greatest(box["sx_max"] - box["sx_min"], box["sy_max"] - box["sy_min"])

    def gives_way(depth: Column, lo: tuple, hi: tuple) -> Column:
        box = screen_box(view, lo, hi)
        return on_screen(view, MARGIN_NODES, box) & (width(box) >= min_pixel)

    rated = screen_boxes(nodes.filter(F.col(count) > 0), view).filter(on_screen(view, MARGIN_NODES))
    size = width({c: F.col(c) for c in ("sx_min", "sx_max", "sy_min", "sy_max")})
    rated = rated.withColumn("screen_size", size).withColumn("weight", F.when(F.col("depth") == 0, F.lit(TOP)).otherwise(size))
    refined = (F.col("screen_size") >= min_pixel) & (F.col("child_mask") != 0)
    return _cut(rated.filter(_ancestors(gives_way)), F.col(count), ~refined, budget)


def select_fps(nodes: DataFrame, cam: Orbit, budget: int, max_distance: float, count: str = "num_points", min_pixel: float = MIN_FPS) -> DataFrame:
    """Nodes to draw in a perspective view, parents and children alike, by frustum, distance and projected radius. As in
    select_iso, a node's row tells whether its ancestors are reached."""
    eye = cam.position()
    numerator = 0.5 * cam.height / math.tan(math.radians(cam.fov) / 2)

    def seen(lo: tuple, hi: tuple) -> tuple[Column, Column]:
        """Distance of the box's centre, and the radius about it."""
        mid = [(a + b) / 2 - F.lit(e) for a, b, e in zip(lo, hi, eye, strict=True)]
        half = [b - a for a, b in zip(lo, hi, strict=True)]
        return F.sqrt(mid[0] * mid[0] + mid[1] * mid[1] + mid[2] * mid[2]), F.sqrt(half[0] * half[0] + half[1] * half[1] + half[2] * half[2]) / 2

    def pushed(depth: Column, dist: Column, radius: Column) -> Column:
        near = (dist <= radius) | (radius * F.lit(numerator) / dist >= min_pixel) | (depth <= ALWAYS_LEVEL)
        return (depth == 0) | ((dist <= max_distance) & near)

    def goes_on(depth: Column, lo: tuple, hi: tuple) -> Column:
        dist, radius = seen(lo, hi)
        return pushed(depth, dist, radius) & in_frustum(cam, lo, hi) & (dist <= max_distance)

    lo, hi = _box()
    dist, radius = seen(lo, hi)
    rated = nodes.filter((F.col("depth") == 0) | (F.col(count) > 0)).withColumn("dist", dist)
    pixels = F.when(F.col("dist") <= F.col("radius"), F.lit(TOP)).otherwise(F.col("radius") * F.lit(numerator) / F.col("dist"))
    rated = rated.withColumn("weight", F.when(F.col("depth") == 0, F.lit(TOP)).otherwise(pixels))
    inside = rated.filter(pushed(F.col("depth"), F.col("dist"), radius) & in_frustum(cam, lo, hi) & _ancestors(goes_on))
    return _cut(inside, F.col(count), F.col("dist") <= max_distance, budget)


def load_queue(selected: DataFrame, loaded: DataFrame, in_flight: int = 0, most: int = LOADS) -> DataFrame:
    """Selected nodes that are not loaded, largest first, as many as may be asked for at once."""
    free = max(0, min(LOADS_MOST, max(LOADS_LEAST, most)) - in_flight)
    todo = selected.join(loaded.select(F.col("name").alias("_l")), F.col("name") == F.col("_l"), "left_anti")
    return todo.orderBy(F.desc("weight"), "name").limit(free)
