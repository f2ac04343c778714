"""Picking the point nearest to a cursor, and measuring between two picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import Scratch


#: Pairs of a cursor and a point that are compared, on average, at most; halvings of a cell until then, at most.
PAIRS, HALVINGS = 512, 30
#: More than rounding can add to a squared distance.
SLACK = 1 + 1e-9


def _far(cell: str, at: str, side: float, least: bool) -> Column:
    """The least or greatest distance, on one axis, of a place from a cell."""
    low, high = F.col(cell) * F.lit(side) - F.col(at), (F.col(cell) + 1) * F.lit(side) - F.col(at)
    return F.greatest(low, -high, F.lit(0.0)) if least else F.greatest(F.abs(low), F.abs(high))


def _square(cell: tuple[str, str], side: float, least: bool) -> Column:
    x, y = (_far(c, a, side, least) for c, a in zip(cell, ("cx", "cy"), strict=True))
    return x * x + y * y


def pick_nearest(projected: DataFrame, cursors: DataFrame, radius: float) -> DataFrame:
    """cursor_id, point_idx and d2 of the nearest point within (not at) the radius in pixels; ties go to the first point.

    Cursors in one place ask once, and points in one place answer once. A place looks into the cells around it, of the radius's
    size at first. One of the cells has a farthest corner that is nearer than the others': no cell that begins beyond it can
    hold the nearest point, and such cells are left out. While too many points would be compared still, the cells that are left
    are cut in four, of which those with points are looked at in the same way; only points of such cells are counted again. So
    what is compared grows with the places and not with how dense the points are. Points and cursors without coordinates take
    no part; cursors may be as many as points."""
    tmp = Scratch(projected.sparkSession, "pick")
    at = lambda c: F.col(c).cast("double") / radius
    points = projected.filter("sx is not null and sy is not null").groupBy("sx", "sy").agg(F.min("point_idx").alias("point_idx"))
    points = tmp.save(points.withColumns({"_qx": at("sx"), "_qy": at("sy")}), "points")
    asked = tmp.save(cursors.filter("cx is not null and cy is not null").select("cx", "cy").distinct(), "asked")
    places = asked.count()
    around = F.sequence(F.lit(-1), F.lit(1))
    cells = asked.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    cells = cells.select("cx", "cy", (F.floor(at("cx")) + F.col("_dx")).alias("_x"), (F.floor(at("cy")) + F.col("_dy")).alias("_y"))
    for halved in range(HALVINGS + 1):
        side, cell = radius / 2**halved, [F.floor(F.col(f"_q{c}") * 2**halved).alias(f"_p{c}") for c in "xy"]
        here = points.select("*", *cell)
        full = here.groupBy("_px", "_py").agg(F.count("*").alias("_n"))
        met = cells.join(full, (F.col("_x") == F.col("_px")) & (F.col("_y") == F.col("_py"))).drop("_px", "_py")
        met = met.withColumn("_near", _square(("_x", "_y"), side, True)).filter(F.col("_near") < radius * radius * SLACK)
        bound = F.min(_square(("_x", "_y"), side, False)).over(W.partitionBy("cx", "cy"))
        cells = tmp.save(met.withColumn("_bound", bound).filter(F.col("_near") <= F.col("_bound") * SLACK).select("cx", "cy", "_x", "_y", "_n"), f"cells{halved}")
        if (cells.agg(F.sum("_n")).first()[0] or 0) <= PAIRS * places or halved == HALVINGS:
            break
        wanted = cells.select(F.col("_x").alias("_px"), F.col("_y").alias("_py")).distinct()
        points = tmp.save(here.join(wanted, ["_px", "_py"], "left_semi").drop("_px", "_py"), f"points{halved}")
        two = F.sequence(F.lit(0), F.lit(1))
        cells = cells.withColumn("_dx", F.explode(two)).withColumn("_dy", F.explode(two)).select("cx", "cy", (F.col("_x") * 2 + F.col("_dx")).alias("_x"), (F.col("_y") * 2 + F.col("_dy")).alias("_y"))
    d2 = (F.col("sx") - F.col("cx")) * (F.col("sx") - F.col("cx")) + (F.col("sy") - F.col("cy")) * (F.col("sy") - F.col("cy"))
    near = cells.join(here, (F.col("_x") == F.col("_px")) & (F.col("_y") == F.col("_py"))).withColumn("d2", d2).filter(F.col("d2") < radius * radius)
    best = near.groupBy("cx", "cy").agg(F.min(F.struct("d2", "point_idx")).alias("_b"))
    return cursors.select("cursor_id", "cx", "cy").join(best, ["cx", "cy"]).select("cursor_id", F.col("_b.point_idx").alias("point_idx"), F.col("_b.d2").alias("d2"))


def measure(points: DataFrame, picks: DataFrame) -> DataFrame:
    """picks(measure_id, seq 0 or 1, point_idx) -> measure_id, distance, and its parts dx, dy, dz."""
    at = picks.join(points.select("point_idx", "x", "y", "z"), "point_idx")
    a = at.filter("seq = 0").select("measure_id", *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = at.filter("seq = 1").select("measure_id", *[F.col(c).alias(f"b{c}") for c in "xyz"])
    out = a.join(b, "measure_id").withColumns({f"d{c}": F.col(f"b{c}") - F.col(f"a{c}") for c in "xyz"})
    return out.select("measure_id", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")).alias("distance"), "dx", "dy", "dz")
