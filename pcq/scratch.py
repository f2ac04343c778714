"""Tables written for one run of one operator, and ordered numbering that needs one."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows in one range of a global order, about; up to so many ranges (a short row each) are broadcast.
RANGE, BROADCAST_RANGES = 1_000_000, 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set, else one of our own in local mode,
    where driver and executors are one machine. A cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = getattr(spark, "_pcq_shared", None) or "file://" + tempfile.mkdtemp(prefix="pcq-")
        spark._pcq_shared = found
    return found.rstrip("/")


_MADE: list[Scratch] = []


def clean() -> None:
    """Delete what all operators of this process have written. Results that have not been read yet are lost with it."""
    while _MADE:
        _MADE.pop().drop()


class Scratch:
    """Tables written for one run of one operator. They cut lineage and outlive lost executors. Those that a lazy result still
    reads stay until clean(); operators drop the others."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/pcq-{name}-{uuid.uuid4().hex}"
        _MADE.append(self)

    def save(self, df: DataFrame, table: str, by: list[str] | None = None) -> DataFrame:
        schema = df.schema
        path = f"{self.root}/{table}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def keep(self, *tables: str) -> None:
        """Delete all tables but these, which are what the result still reads."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in files.listStatus(root) if files.exists(root) else ():
            if status.getPath().getName() not in tables:
                files.delete(status.getPath(), True)

    def drop(self, table: str = "") -> None:
        """Delete a table that nothing reads any more (or all); shuffle files of jobs that are out of reach go as well."""
        jvm = self.spark.sparkContext._jvm
        gc.collect()
        jvm.System.gc()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def running(df: DataFrame, order: list[str], value: Column, name: str, rows: int | None = None) -> DataFrame:
    """df with `name`: the sum of value over the rows before, in the order of `order`. Rows are dealt into ranges of even
    size, found by sampling, and written; a range's own sums are shifted by the totals of the ranges before it. No task sees
    more than a range, and the only window over all ranges is over one short row for each."""
    spark = df.sparkSession
    rows = df.count() if rows is None else rows
    ranges = max(1, -(-rows // RANGE))
    if ranges == 1:
        return df.withColumn(name, F.coalesce(F.sum(value).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    ranged = df.withColumn("_value", value).repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    ranged = Scratch(spark, "running").save(ranged, "ranged")
    totals = ranged.groupBy("_range").agg(F.sum("_value").alias("_total"))
    before = totals.select(F.col("_range").alias("_r"), (F.sum("_total").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("_total")).alias("_before"))
    before = F.broadcast(before) if ranges <= BROADCAST_RANGES else before
    own = F.coalesce(F.sum("_value").over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_own", own).join(before, ranged["_range"] == before["_r"]).withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_value", "_range", "_own", "_r", "_before")
