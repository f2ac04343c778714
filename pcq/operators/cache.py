"""Cache and allocation logs: recency, eviction, runs of regions, first-fit allocation, chunks and where they are found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The part of the byte limit from which eviction starts, chunks that stay, bytes a point takes on a GPU.
FULL, CHUNKS_KEPT, POINT_BYTES = 0.9, 10, 24


def lru_keep(touches: DataFrame, max_points: int, max_bytes: int) -> DataFrame:
    """touches(seq, node, num_points, gpu_bytes) -> the nodes that stay when the least recent go until both sums fit.
    A node's last touch tells its size. Nodes are few beside their touches."""
    last = touches.groupBy("node").agg(F.max(F.struct("seq", "num_points", "gpu_bytes")).alias("_t")).select("node", "_t.*")
    recent = W.orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, 0)
    summed = last.withColumns({"points_upto": F.sum("num_points").over(recent), "bytes_upto": F.sum("gpu_bytes").over(recent)})
    return summed.filter((F.col("points_upto") <= max_points) & (F.col("bytes_upto") <= FULL * max_bytes))


def merge_regions(regions: DataFrame, key: str) -> DataFrame:
    """regions(key, offset, count) -> merged regions: those that touch or overlap are one."""
    end = F.col("offset") + F.col("count")
    before = W.partitionBy(key).orderBy("offset", "count").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(key).orderBy("offset", "count").rowsBetween(W.unboundedPreceding, 0)
    starts = regions.withColumn("_new", F.when(F.max(end).over(before) >= F.col("offset"), 0).otherwise(1))
    islands = starts.withColumn("_island", F.sum("_new").over(upto))
    return islands.groupBy(key, "_island").agg(F.min("offset").alias("offset"), (F.max(end) - F.min("offset")).alias("count")).drop("_island")


def draw_runs(slots: DataFrame, key: str) -> DataFrame:
    """slots(key, offset, count) -> runs of slots that follow on one another exactly: first, count, slots."""
    order = W.partitionBy(key).orderBy("offset")
    starts = slots.withColumn("_new", F.when(F.lag(F.col("offset") + F.col("count")).over(order) == F.col("offset"), 0).otherwise(1))
    runs = starts.withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(key, "_run").agg(F.min("offset").alias("first"), F.sum("count").alias("count"), F.count("*").alias("slots")).drop("_run")


def chunks_evicted(chunks: DataFrame, key: str, keep: int = CHUNKS_KEPT) -> DataFrame:
    """chunks(key, id, last_access): those beyond the most recent `keep` of each key."""
    order = W.partitionBy(key).orderBy(F.desc("last_access"), F.desc("id"))
    return chunks.withColumn("age_rank", F.row_number().over(order)).filter(F.col("age_rank") > keep)


def dedupe_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key, the one that comes last."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")


# Points that half a gigabyte holds, most points, megabytes by the largest texture side, part of it to draw.
CAPACITY_BASE, CAPACITY_MOST, VRAM_BASE = 200_000, 50_000_000, 512
VRAM_BY_TEXTURE = ((16384, 8192), (8192, 4096), (4096, 2048))
AUTO_SHARE = 0.6


def batch_capacity(max_texture: Column, max_buffer: Column) -> Column:
    """Points that a graphics card can hold, guessed from its largest texture side, or else from its largest buffer (bytes)."""
    vram = F.greatest(F.lit(VRAM_BASE), F.when(F.coalesce(max_buffer, F.lit(0)) > 0, F.floor(max_buffer / (1 << 20))).otherwise(VRAM_BASE))
    for side, mb in reversed(VRAM_BY_TEXTURE):
        vram = F.when(max_texture >= side, F.lit(mb)).otherwise(vram)
    return F.least(F.lit(CAPACITY_MOST), F.floor(vram / VRAM_BASE * CAPACITY_BASE)).cast("long")


def auto_budget(capacity: Column) -> Column:
    return F.floor(capacity * AUTO_SHARE).cast("long")


def first_fit(log: DataFrame, key: str, capacity: int) -> DataFrame:
    """log(key, seq, kind 'alloc' or 'free', id, count) -> key, seq, id, offset: where each allocation lies, in the order of
    seq: at the start of the first free region that is large enough, else behind all others, else nowhere (-1). What is freed
    joins its free neighbours. A key's log is folded as it streams by; a task holds its live and free regions only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, live, free, end = None, {}, [], 0
        for batch in batches:
            out = []
            for own, seq, kind, name, count in batch.itertuples(index=False):
                if own != now:
                    now, live, free, end = own, {}, [], 0
                if kind == "free":
                    if name in live:
                        free.append(live.pop(name))
                        free.sort()
                        joined = [free[0]]
                        for at, n in free[1:]:
                            last, size = joined[-1]
                            if last + size >= at:
                                joined[-1] = (last, max(size, at + n - last))
                            else:
                                joined.append((at, n))
                        free = joined
                    continue
                place = next((k for k, (_, n) in enumerate(free) if n >= count), None)
                if place is not None:
                    offset, n = free.pop(place)
                    if n > count:
                        free.insert(place, (offset + count, n - count))
                elif end + count <= capacity:
                    offset, end = end, end + count
                else:
                    offset = -1
                if offset >= 0:
                    live[name] = (offset, count)
                out.append((own, seq, name, offset))
            yield pd.DataFrame(out, columns=["key", "seq", "id", "offset"])

    rows = log.select(F.col(key).cast("long").alias("key"), F.col("seq").cast("long").alias("seq"), "kind", F.col("id").cast("long").alias("id"), F.col("count").cast("long").alias("count"))
    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(run, "key long, seq long, id long, offset long").withColumnRenamed("key", key)


def found_in(asked: DataFrame, held: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """asked(key, ...) with tier: memory, store or file, the first that has the chunk."""
    one = lambda df, name: df.select(F.col(key).alias(f"_{name}")).distinct()
    a, b = one(held, "held"), one(stored, "stored")
    out = asked.join(a, F.col(key) == F.col("_held"), "left").join(b, F.col(key) == F.col("_stored"), "left")
    return out.withColumn("tier", F.when(F.col("_held").isNotNull(), "memory").when(F.col("_stored").isNotNull(), "store").otherwise("file")).drop("_held", "_stored")


def store_chunks(points: DataFrame, path: str, chunk: str = "chunk") -> None:
    """Write points so that a chunk can be read, replaced or dropped alone: a folder for each chunk."""
    points.repartition(chunk).write.partitionBy(chunk).mode("overwrite").parquet(path)


#: Bytes that a fingerprint reads, and the powers of 31 that they are weighed with, the last byte by 1.
HEAD = 1024
_POWERS = np.array([pow(31, HEAD - 1 - k, 1 << 32) for k in range(HEAD)], np.uint32)


def fingerprint(head: Column, size: Column) -> Column:
    """A file's short name from its first 1,024 bytes and its size: a polynomial in 31 over 32 bits with sign, and the size,
    both to the base of 36."""

    @F.pandas_udf("long")
    def hashed(heads: pd.Series) -> pd.Series:
        h = np.zeros(len(heads), np.uint32)
        for k, raw in enumerate(heads):
            if raw:
                # 32-bit products and sums wrap around as the polynomial does.
                h[k] = (np.frombuffer(raw, np.uint8).astype(np.uint32) * _POWERS[HEAD - len(raw) :]).sum(dtype=np.uint32)
        out = pd.Series(h.view(np.int32).astype(np.int64), dtype="Int64").abs()
        return out.mask(heads.isna())

    signed = hashed(F.substring(head, 1, HEAD))
    base = lambda v: F.lower(F.conv(v.cast("string"), 10, 36))
    return F.concat(base(signed), F.lit("_"), base(size.cast("long")))
