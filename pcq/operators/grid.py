"""The pick grid: 128 x 128 cells over x and y, as a histogram or with offsets and ranks (compressed rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SIDE = 128


def with_cell(points: DataFrame, side: int = SIDE) -> DataFrame:
    """Adds gx, gy and cell = gy * side + gx. An axis without extent has one column of cells."""
    ends = points.agg(*[f(c).alias(f"_{n}{c}") for c in "xy" for n, f in (("a", F.min), ("b", F.max))])

    def index(c: str):
        span = F.when(F.col(f"_b{c}") > F.col(f"_a{c}"), F.col(f"_b{c}") - F.col(f"_a{c}")).otherwise(1.0)
        return F.least(F.lit(side - 1), F.floor((F.col(c) - F.col(f"_a{c}")) / span * side)).cast("int")

    out = points.crossJoin(F.broadcast(ends)).withColumns({"gx": index("x"), "gy": index("y")}).drop("_ax", "_bx", "_ay", "_by")
    return out.withColumn("cell", F.col("gy") * side + F.col("gx"))


def histogram(points: DataFrame, side: int = SIDE) -> DataFrame:
    return with_cell(points, side).groupBy("gx", "gy").agg(F.count("*").alias("n"))


def offsets(points: DataFrame, side: int = SIDE) -> DataFrame:
    """cell, n and start, the number of points in the cells before: at most side * side rows."""
    cells = with_cell(points, side).groupBy("cell").agg(F.count("*").alias("n"))
    return cells.withColumn("start", F.sum("n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))


def ranked(points: DataFrame, side: int = SIDE) -> DataFrame:
    """Adds each point's place in the compressed rows: the cell's start plus the rank by point_idx in the cell."""
    placed = with_cell(points, side)
    rank = F.row_number().over(W.partitionBy("cell").orderBy("point_idx")) - 1
    starts = offsets(points, side).select(F.col("cell").alias("_c"), "start")
    return placed.withColumn("rank", rank).join(F.broadcast(starts), placed["cell"] == starts["_c"]).withColumn("place", F.col("start") + F.col("rank")).drop("_c", "start")
