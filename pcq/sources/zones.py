"""Zone maps: what each range of a file's records spans, written once, so that a viewport reads only the ranges it meets.

An index is a Parquet table of ranges (INDEX). It is made by reading every range once, in tasks; the files stay as they are.
Asking is a filter on that table, which Spark pushes into it, followed by reading the ranges that are left: they are rows of
a table as well, dealt to tasks, so neither the list of ranges nor the points pass through the driver.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.camera import View, project_iso
from ..operators import lod
from ..schema import POINTS
from ..scratch import running
from .las import LasReader
from .ply import PlyReader
from .records import BATCH, RecordReader, batch, files, size_of
from .rxp import RxpReader

#: Records in a range; tasks that read at most, beyond which a task reads several ranges.
RANGE, MOST_TASKS = 100_000, 20_000
#: Records for one task, about: short ranges go to a task together, since starting it takes longer than reading them.
TASK = 500_000
READERS: tuple[type[RecordReader], ...] = (LasReader, PlyReader, RxpReader)
#: path, its bytes; the range: number of its first record in the file, records, number of its first record in all files;
#: and what its records span.
INDEX = "path string, bytes long, first long, count long, base long, min_x float, max_x float, min_y float, max_y float, min_z float, max_z float, min_intensity float, max_intensity float"
SPANNED = ("x", "y", "z", "intensity")


def _reader(path: str) -> RecordReader:
    kind = next((r for r in READERS if path.lower().endswith(r.suffixes)), None)
    if kind is None:
        raise ValueError(f"{path}: no ranges of records in files of this kind")
    return kind({"path": path})


def paths(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path) of a file or of a folder's files, each for a task of its own."""
    names = files(path, suffixes)
    return spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, min(len(names), MOST_TASKS)))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, records) of a file or of a folder's files, each read by a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            found = [(p, size_of(p), _reader(p).count(p)) for p in own.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)] if found else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64())], names=["path", "bytes", "records"])

    return paths(spark, path, tuple(s for r in READERS for s in r.suffixes)).mapInArrow(run, "path string, bytes long, records long")


def spans(points: DataFrame, by: Column) -> DataFrame:
    """The zones of a table of points: zone, n, and the least and greatest coordinates and intensity."""
    ends = [f(c).alias(f"{n}_{c}") for c in SPANNED for n, f in (("min", F.min), ("max", F.max))]
    return points.groupBy(by.alias("zone")).agg(F.count("*").alias("n"), *ends)


def build(spark: SparkSession, path: str, index: str, records: int = RANGE) -> DataFrame:
    """Write the index of a file or of a folder's files, and return it. Fails if there is one. Coordinates that are not numbers
    are in no span: a range of them alone is met by no viewport."""
    heads = running(headers(spark, path), ["path"], F.col("records"), "base").filter("records > 0")
    at = heads.select("path", "bytes", "records", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(records).cast("long"))).alias("first"))
    ranges = at.select("path", "bytes", "first", F.least(F.lit(records).cast("long"), F.col("records") - F.col("first")).alias("count"), (F.col("base") + F.col("first")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            rows = own.to_pylist()
            for row in rows:
                low, high = {}, {}
                for columns, _ in _decoded(row):
                    for c in SPANNED:
                        v = columns.get(c)
                        v = v[~np.isnan(v)] if v is not None else ()
                        if len(v):
                            low[c], high[c] = min(low.get(c, v.min()), v.min()), max(high.get(c, v.max()), v.max())
                row |= {f"{n}_{c}": float(d[c]) if c in d else None for c in SPANNED for n, d in (("min", low), ("max", high))}
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    found = _dealt(ranges).mapInArrow(run, INDEX)
    found.write.parquet(index)
    return spark.read.schema(INDEX).parquet(index)


_SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "float": pa.float32()}[t]) for n, t in (f.split() for f in INDEX.split(", "))])


def _dealt(ranges: DataFrame) -> DataFrame:
    """Ranges one to a task, or as many as make up TASK records, but no fewer tasks than run at once."""
    n, records = ranges.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    return ranges.repartition(max(1, min(n, max(ranges.sparkSession.sparkContext.defaultParallelism, -(-records // TASK)), MOST_TASKS)))


def _decoded(row: dict) -> Iterator[tuple[dict, int]]:
    """A range's columns, a batch at a time, and the place of its first record in the range."""
    if size_of(row["path"]) != row["bytes"]:
        raise ValueError(f"{row['path']} has changed since it was indexed")
    reader = _reader(row["path"])
    for at in range(0, row["count"], BATCH):
        columns = reader.decode(row["path"], row["first"] + at, min(BATCH, row["count"] - at))
        if len(columns["x"]):
            yield columns, at


def load(spark: SparkSession, index: str, where: Column | None = None) -> DataFrame:
    """Points of the ranges that pass `where`, a condition on the index's columns (in_box, in_view); all of them otherwise. Rows
    are those of a read of the files, with the same point_idx."""
    zones = spark.read.schema(INDEX).parquet(index)
    zones = zones if where is None else zones.filter(where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            for row in own.to_pylist():
                for columns, at in _decoded(row):
                    n = len(columns["x"])
                    yield batch(columns | {"point_idx": np.arange(row["base"] + at, row["base"] + at + n)}, n, os.path.basename(row["path"]))

    return _dealt(zones.select("path", "bytes", "first", "count", "base")).mapInArrow(run, POINTS)


def in_box(lo: tuple, hi: tuple) -> Column:
    """Whether a range meets a box."""
    near = F.lit(True)
    for c, a, b in zip("xyz", lo, hi, strict=True):
        near = near & (F.col(f"max_{c}") >= a) & (F.col(f"min_{c}") <= b)
    return near


def _ends(zones: DataFrame) -> DataFrame:
    return zones.withColumns({f"{n}_{c}": F.col(f"{n}_{c}").cast("double") for c in "xyz" for n in ("min", "max")})


def visible(zones: DataFrame, view: View, margin: float = 0.0) -> DataFrame:
    """Zones with the screen box that they project to, and visible: whether it meets the viewport."""
    boxed = lod.screen_boxes(_ends(zones), view)
    return boxed.withColumn("visible", F.coalesce(lod.on_screen(view, margin), F.lit(False)))


def in_view(view: View, margin: float = 1.0) -> Column:
    """Whether a range may have points on screen; the margin, in pixels, is more than rounding can take away."""
    lo, hi = (tuple(F.col(f"{n}_{c}").cast("double") for c in "xyz") for n in ("min", "max"))
    return lod.on_screen(view, margin, lod.screen_box(view, lo, hi))


def on_screen(points: DataFrame, view: View) -> DataFrame:
    """Points, with sx, sy and depth_key, that the viewport shows."""
    return project_iso(points, view).filter(F.col("sx").between(0, view.width) & F.col("sy").between(0, view.height))


def shown(spark: SparkSession, index: str, view: View) -> DataFrame:
    """What a viewport shows of the indexed files, read from the ranges that it meets."""
    return on_screen(load(spark, index, in_view(view)), view)
