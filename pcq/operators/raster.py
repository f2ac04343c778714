"""Pixels as rows: depth test, shading from neighbours, sky, minimap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.style import mix


def zbuffer(projected: DataFrame, width: int, height: int) -> DataFrame:
    """px, py, depth, point_idx: of the points in a pixel the nearest, and of equals the last drawn (largest point_idx)."""
    px = projected.withColumns({"px": F.floor("sx").cast("int"), "py": F.floor("sy").cast("int")})
    inside = px.filter((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height))
    best = inside.groupBy("px", "py").agg(F.min(F.struct(F.col("depth").alias("d"), (-F.col("point_idx")).alias("i"))).alias("_b"))
    return best.select("px", "py", F.col("_b.d").alias("depth"), (-F.col("_b.i")).alias("point_idx"))


def shaded(pixels: DataFrame, light: tuple[float, float, float], ambient: float) -> DataFrame:
    """Adds light: ambient plus diffuse by a normal from the four neighbours' depths. A neighbour that no point covers has
    depth 1, the cleared value. Neighbours come from windows along a row and a column of pixels."""
    n = sum(v * v for v in light) ** 0.5
    lx, ly, lz = (v / n for v in light)
    row, column = W.partitionBy("py").orderBy("px"), W.partitionBy("px").orderBy("py")

    def beside(w, axis, step):
        f = F.lead if step > 0 else F.lag
        return F.when(f(axis, 1).over(w) == F.col(axis) + step, f("depth", 1).over(w)).otherwise(1.0)

    dx = (beside(row, "px", 1) - beside(row, "px", -1)) * 2.0
    dy = (beside(column, "py", 1) - beside(column, "py", -1)) * 2.0
    out = pixels.withColumns({"_dx": dx, "_dy": dy})
    length = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy") + 1)
    diffuse = F.greatest((-F.col("_dx") * lx - F.col("_dy") * ly + lz) / length, F.lit(0.0))
    return out.withColumn("light", ambient + diffuse * (1 - ambient)).drop("_dx", "_dy")


def sky(spark, width: int, height: int, top: tuple, bottom: tuple) -> DataFrame:
    """Every pixel with the sky's colour: a gradient from bottom to top."""
    v = (F.lit(height) - F.col("py") - 0.5) / height
    grid = spark.range(width * height).select((F.col("id") % width).cast("int").alias("px"), F.floor(F.col("id") / width).cast("int").alias("py"))
    return grid.withColumns({c: mix(b, t, v) for c, t, b in zip("rgb", top, bottom, strict=True)})


def sky_fill(pixels: DataFrame, background: DataFrame) -> DataFrame:
    """background's pixels, with point_idx where a point covers one."""
    return background.join(pixels.select("px", "py", "point_idx"), ["px", "py"], "left")


def minimap(points: DataFrame, n: int, width: int = 150, height: int = 150, pad: int = 8, most: int = 800) -> DataFrame:
    """Every max(1, floor(n / most))-th point, scaled alike on both axes into the map's frame, y upwards."""
    ends = points.agg(*[f(c).alias(f"_{k}{c}") for c in "xy" for k, f in (("a", F.min), ("b", F.max))])
    width_of = lambda c: F.when(F.col(f"_b{c}") > F.col(f"_a{c}"), F.col(f"_b{c}") - F.col(f"_a{c}")).otherwise(1.0)
    scale = F.least(F.lit(float(width - 2 * pad)) / width_of("x"), F.lit(float(height - 2 * pad)) / width_of("y"))
    kept = points.filter(F.col("point_idx") % max(1, n // most) == 0).crossJoin(F.broadcast(ends))
    return kept.select("point_idx", (pad + (F.col("x") - F.col("_ax")) * scale).alias("mx"), (height - pad - (F.col("y") - F.col("_ay")) * scale).alias("my"))
