"""Helpers shared by the training-data operators: scratch tables in the shared folder, and fixed text rules."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..scratch import BROADCAST_RANGES, RANGE, shared_dir
from ..scratch import Scratch as Tables

__all__ = ["NON_SPACE", "Scratch", "crc_mod", "give_back", "partitions", "ranked", "shared_dir", "slim", "small_batches", "table", "words"]

#: A word is a run of anything but these (the white space of ASCII).
NON_SPACE = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: Arrow batches of 16 MB keep Python workers small. A setting that the user made stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, "16m")


def give_back() -> None:
    """Hand free memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def slim(batches: Iterator) -> Iterator:
    """The batches; behind the last one, free memory goes back to the system, since idle workers live on."""
    yield from batches
    give_back()


class Scratch(Tables):
    """Tables written for one run of one operator, over texts."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        super().__init__(spark, name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")), F.lit(n))


def words(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(NON_SPACE)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, tmp: Tables, name: str, group: list[str], order: list[str]) -> DataFrame:
    """df with `rank`, a row's place from 0 on in its group in the order given, and `members`, the group's rows; nulls group
    and sort together, first. df should be a written table, since it is read twice.

    Rows are dealt into ranges of (group, order) and written as sorted runs, in which a row's place is known; a group's runs
    are as many as it needs, so that no task sees more than a run. Rows that tie throughout `order` share a run: let order end
    with a column that parts them. What is summed over runs is one short row for each run and group."""
    ranges = max(partitions(df.sparkSession), -(-df.count() // RANGE))
    runs = df.repartitionByRange(ranges, *group, *order).sortWithinPartitions(*group, *order)
    # The number of the partition and the place in it, in one number.
    runs = tmp.save(runs.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_run", F.shiftright("_at", 33))
    firsts = runs.groupBy(*group, "_run").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_run").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    firsts = tmp.save(firsts.withColumns({"_before": before, "members": F.sum("_n").over(W.partitionBy(*group))}).drop("_n"), f"{name}_firsts")
    firsts = firsts.select("_first", "_before", "members", F.col("_run").alias("_r"), *[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)])
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_RANGES else firsts
    on = F.col("_run") == F.col("_r")
    for k, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    return runs.join(firsts, on).withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_run", "_r", "_first", "_before", *[f"_g{k}" for k in range(len(group))])
