"""The driver's tables as point tables: x, y, z as float, widened to double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import running

def single(c: str) -> Column:
    return F.col(c).cast("float").cast("double")


def numbered(df: DataFrame, keys: list[str], name: str = "point_idx") -> DataFrame:
    """Number rows from 0 in the order of keys. No task sees more than a range of the order (see running)."""
    return running(df, keys, F.lit(1), name)


LI_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice"]


def points_li(spark: SparkSession, sf_dir: str, index: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if index:
        df = numbered(df.select(*LI_KEYS, "l_quantity", "l_discount", "l_returnflag"), LI_KEYS)
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    own = ["point_idx"] if index else []
    return df.select(*own, single("l_quantity").alias("x"), single("l_extendedprice").alias("y"), single("l_partkey").alias("z"), single("l_discount").alias("intensity"), code.alias("classification"))


def points_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first = df.agg(F.min(micros).alias("_t0"))
    kinds = ["view", "click", "purchase", "signup", "error"]
    code = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("event_type")) - 1
    return df.crossJoin(F.broadcast(first)).select(
        F.col("event_id").alias("point_idx"), ((micros - F.col("_t0")) / 1e6).cast("float").cast("double").alias("x"), single("user_id").alias("y"),
        single("value").alias("z"), single("value").alias("intensity"), code.cast("int").alias("classification"),
    )


def points_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda k: F.get("embedding", F.lit(k)).cast("float").cast("double")
    return e.select(F.col("vec_id").alias("point_idx"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), at(3).alias("intensity"), F.col("label").alias("classification"))


def rescaled(points: DataFrame, size: float = 1000.0) -> DataFrame:
    """Each axis to [0, size]; an axis without extent becomes 0."""
    ends = points.agg(*[f(c).alias(f"_{n}{c}") for c in "xyz" for n, f in (("a", F.min), ("b", F.max))])
    span = lambda c: F.when(F.col(f"_b{c}") > F.col(f"_a{c}"), F.col(f"_b{c}") - F.col(f"_a{c}")).otherwise(1.0)
    new = {c: (F.col(c) - F.col(f"_a{c}")) / span(c) * size for c in "xyz"}
    return points.crossJoin(F.broadcast(ends)).select(*[new[c].alias(c) if c in new else F.col(c) for c in points.columns])
