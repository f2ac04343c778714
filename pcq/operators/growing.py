"""A tree that grows: each batch of points is placed against what the nodes hold already, and nothing that has been placed is
touched again.

A tree is a folder: placed/batch=k has the points of a batch with their node, nodes/version=k what each node holds after it.
A batch counts once its version is there, which is written last; one that failed half way is written again, and one that
counts already is skipped, so that a stream may be restarted at any point. Batches are numbered from 0 and come in order,
each with points of larger point_idx than those before it; then k batches make the tree that one batch of all would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import store
from . import octree

NODES = "node string, n long"


def _versions(root: str) -> list[int]:
    """The batches that count."""
    from pyarrow import fs

    own, at = store(root)
    found = own.get_file_info(fs.FileSelector(f"{at}/nodes", allow_not_found=True))
    done = [i.base_name for i in found if own.get_file_info(f"{i.path}/_SUCCESS").type == fs.FileType.File]
    return sorted(int(name.removeprefix("version=")) for name in done if name.startswith("version="))


def _held(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema(NODES).parquet(f"{root}/nodes/version={version}")


def grow(batch: DataFrame, root: str, number: int, cap: int, depth: int) -> bool:
    """Place a batch of points (point_idx, path, and what else they have); False if it counts already."""
    spark, done = batch.sparkSession, _versions(root)
    if number in done:
        return False
    if number and number - 1 not in done:
        raise ValueError(f"{root}: batch {number} before batch {number - 1}")
    held = _held(spark, root, number - 1) if number else None
    octree.streaming_fill(batch, cap, depth, held).write.mode("overwrite").parquet(f"{root}/placed/batch={number}")
    added = spark.read.parquet(f"{root}/placed/batch={number}").groupBy("node").agg(F.count("*").alias("n"))
    total = added if held is None else added.unionByName(held).groupBy("node").agg(F.sum("n").alias("n"))
    total.write.mode("overwrite").parquet(f"{root}/nodes/version={number}")
    return True


def grow_stream(points: DataFrame, root: str, lo: tuple, hi: tuple, cap: int, depth: int):
    """A writer of a stream of points (point_idx, x, y, z): start() it with a checkpoint location. Micro-batches are numbered by
    Spark, and one that is handed over again after a failure is placed once."""
    return points.writeStream.foreachBatch(lambda batch, number: grow(octree.with_path(batch, lo, hi, depth).drop("key"), root, number, cap, depth) and None)


def placed(spark: SparkSession, root: str) -> DataFrame:
    """All points that have been placed, with node; a batch that does not count yet is not among them."""
    done = _versions(root)
    if not done:
        raise ValueError(f"{root}: no batch has been placed")
    return spark.read.parquet(*[f"{root}/placed/batch={k}" for k in done])


def nodes(spark: SparkSession, root: str) -> DataFrame:
    """(node, n, child_mask): what nodes hold themselves, and which children they have."""
    held = _held(spark, root, _versions(root)[-1])
    digit = F.substring("node", -1, 1).cast("int")
    masks = held.filter(F.length("node") > 1).groupBy(F.expr("substring(node, 1, length(node) - 1)").alias("_up")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), digit)).alias("child_mask"))
    return held.join(masks, F.col("node") == F.col("_up"), "left").select("node", "n", F.coalesce("child_mask", F.lit(0)).alias("child_mask"))
