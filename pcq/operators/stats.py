"""Extents, summaries and spacing of a cloud: plain aggregates, so partial and final steps are Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..bindings import numbered


def bounds(points: DataFrame) -> DataFrame:
    """One row: n, min and max of each axis, centre, and the intensity range (widened by 1 if flat)."""
    ends = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    out = points.agg(F.count("*").alias("n"), *ends, F.min("intensity").alias("i_min"), F.max("intensity").alias("_i"))
    out = out.withColumns({f"c{c}": (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in "xyz"})
    return out.withColumn("i_max", F.when(F.col("_i") == F.col("i_min"), F.col("_i") + 1).otherwise(F.col("_i"))).drop("_i")


def spacing(bounds: DataFrame) -> DataFrame:
    """The cube root of the volume for each point."""
    volume = F.greatest((F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")) * (F.col("max_z") - F.col("min_z")), F.lit(1e-6))
    return bounds.select("n", F.cbrt(volume / F.col("n")).alias("spacing"))


def short_count(n: Column) -> Column:
    """1.2M or 50k, as a budget label."""
    millions = F.concat(F.format_string("%.1f", n / 1e6), F.lit("M"))
    return F.when(n >= 1_000_000, millions).when(n >= 1000, F.concat(F.round(n / 1000.0).cast("long").cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def finite(points: DataFrame) -> DataFrame:
    """Rows whose coordinates are finite; null and NaN coordinates count as 0 before."""
    filled = points.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in "xyz"})
    return filled.filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & (F.abs("z") < float("inf")))


def normalised(points: DataFrame, column: str = "intensity") -> DataFrame:
    """column to 0..1 by its range; 0.5 where the range is flat."""
    ends = points.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    value = F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
    return points.crossJoin(F.broadcast(ends)).withColumn(column, value).drop("_lo", "_hi")


def chunked(points: DataFrame, n_chunks: int, n: int) -> DataFrame:
    """File-order slices of ceil(n / n_chunks) rows: chunk and its id grid_x, grid_y."""
    size = -(-n // n_chunks)
    side = round(n_chunks**0.5)
    chunk = F.floor(F.col("point_idx") / size).cast("int")
    return points.withColumns({"chunk": chunk, "grid_x": chunk % side, "grid_y": F.floor(chunk / side).cast("int")})


__all__ = ["bounds", "chunked", "finite", "normalised", "numbered", "short_count", "spacing"]
