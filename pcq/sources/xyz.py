"""Text points (.xyz, .txt, .pts): x y z, x y z i or x y z r g b, by white space or commas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.style import DEFAULT_RGB, bytes_from_unit
from ..schema import POINTS, fields

#: The longest number at the start of a field, as a lenient parser takes it.
NUMBER = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def number(field: Column) -> Column:
    return F.regexp_extract(F.coalesce(field, F.lit("")), NUMBER, 1).try_cast("double")


def parse_lines(lines: DataFrame, double: bool = False) -> DataFrame:
    """lines(value, ...) -> x, y, z, r, g, b and intensity beside the other columns. Comment lines (# and // at their
    start), blank ones, and those with fewer than three numbers are dropped. The fourth field is the intensity, also
    where it is the red of a colour."""
    text = F.trim(F.regexp_replace("value", r"[\r\n]", ""))
    rows = lines.withColumn("_t", text).filter((F.col("_t") != "") & ~F.col("_t").startswith("#") & ~F.col("_t").startswith("//"))
    rows = rows.withColumn("_f", F.split("_t", r"[\s,]+"))
    at = lambda k: number(F.get("_f", F.lit(k)))
    rows = rows.withColumns({"x": at(0), "y": at(1), "z": at(2), "_a": at(3), "_b": at(4), "_c": at(5)}).filter("x is not null and y is not null and z is not null")
    color = bytes_from_unit(F.col("_a"), F.col("_b"), F.col("_c"))
    full = F.col("_c").isNotNull() & F.col("_b").isNotNull() & F.col("_a").isNotNull()
    gray = F.when(F.col("_a").isNotNull(), F.floor(F.least(F.greatest(F.col("_a"), F.lit(0.0)), F.lit(255.0))).cast("int"))
    rows = rows.withColumns({n: F.coalesce(F.when(full, c), gray, F.lit(v)).cast("short") for n, c, v in zip("rgb", color, DEFAULT_RGB, strict=True)})
    rows = rows.withColumn("intensity", F.col("_a").cast("float"))
    if not double:
        rows = rows.withColumns({c: F.col(c).cast("float") for c in "xyz"})
    return rows.drop("_t", "_f", "_a", "_b", "_c", "value")


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """Points of text files in the canonical schema. point_idx rises with the place in a file but has gaps."""
    lines = spark.read.text(path).withColumns({"src": F.col("_metadata.file_name"), "point_idx": F.monotonically_increasing_id()})
    points = parse_lines(lines)
    return points.select(*[(F.col(c) if c in points.columns else F.lit(None)).cast(t).alias(c) for c, t in fields(POINTS)])


def line_kinds(lines: DataFrame) -> DataFrame:
    """lines(src, place, value) -> src, kind: what the first line of points of each file has (xyz, xyzi or xyzrgb)."""
    text = F.trim(F.regexp_replace("value", r"[\r\n]", ""))
    points = lines.withColumn("_t", text).filter((F.col("_t") != "") & ~F.col("_t").startswith("#") & ~F.col("_t").startswith("//"))
    points = points.withColumn("_n", F.size(F.split("_t", r"[\s,]+"))).filter("_n >= 3")
    first = points.groupBy("src").agg(F.min_by("_n", "place").alias("_n"))
    return first.select("src", F.when(F.col("_n") >= 6, "xyzrgb").when(F.col("_n") >= 4, "xyzi").otherwise("xyz").alias("kind"))
