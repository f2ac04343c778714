"""Readers and writers of point-cloud formats."""

from pyspark.sql import DataFrame, SparkSession

from ..schema import POINTS, fields
from . import e57_blocks, ply
from .e57 import E57Source
from .las import LasSource
from .ply import PlySource
from .octree_dataset import HierarchySource, OctreeSource
from .records import files
from .rxp import RxpSource
from .xyz import read_xyz

#: Readers by suffix, in the order in which they are tried.
FORMATS = ((".ply", "ply"), (".ply.gz", "ply"), (".las", "las"), (".laz", "las"), (".xyz", "xyz"), (".txt", "xyz"), (".pts", "xyz"), (".rxp", "rxp"), (".e57", "e57"))


def register(spark: SparkSession) -> None:
    """Make the readers and the sink known to a session. Readers prune by filters, which the session has to hand them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (LasSource, PlySource, RxpSource, E57Source, OctreeSource, HierarchySource):
        spark.dataSource.register(source)


def format_of(path: str) -> str | None:
    """The reader for a path's suffix, in any case; None if there is none."""
    low = path.lower()
    return "octree" if low.endswith("metadata.json") else next((f for suffix, f in FORMATS if low.endswith(suffix)), None)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Points of a file, by its suffix, of a folder whose files are of one format, or of an octree dataset's metadata.json."""
    low_format = format_of(path)
    if low_format is None:
        inside = {format_of(f) for f in files(path, tuple(suffix for suffix, _ in FORMATS))} - {None}
        if len(inside) != 1:
            raise ValueError(f"{path}: no reader for this suffix, and no folder of files of one format")
        low_format = inside.pop()
    if low_format == "xyz":
        return read_xyz(spark, path)
    if low_format == "e57":
        return e57_blocks.read_points(spark, path)
    if low_format == "ply":
        names = files(path, (".ply", ".ply.gz"))
        if names and all(n.lower().endswith(".ply") and ply.header(n)["ascii"] for n in names):
            return ply.read_ascii(spark, names)
    register(spark)
    read = spark.read.format(low_format).load(path)
    return read.select(*[c for c, _ in fields(POINTS)]) if low_format == "octree" else read
