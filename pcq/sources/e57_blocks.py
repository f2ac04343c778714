"""E57 files of any size: tasks find the packets in blocks of bytes, and a stitch confirms them.

Packets are a chain: each tells its own size, so the place of one is only known from all before it. A task that gets a block
in the middle guesses: it looks for a place whose header fits what follows it, and which leads to more such places, and walks
the chain from there to the end of its block. Where one block's chain ends, the next one's must begin. The stitch follows
that, with one short row for each block; a block whose guess is wrong is walked once more from the place that is right, so
guesses cost time but never points. Only then are packets read, by tasks again.
"""

from __future__ import annotations

import bz2
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import POINTS
from . import e57
from .records import batch, files, store

#: Bytes of a block; bytes looked at in one go for a place to begin; packets that must follow such a place.
BLOCK, WINDOW, FOLLOW = 64 << 20, 1 << 20, 4
_HEADER = 8


def _fits(head: bytes, size: int, width: int) -> bool:
    """Whether a packet of data may begin with these bytes: its records fill it, or it is compressed."""
    full = _HEADER + -(-int.from_bytes(head[4:8], "big") * width // 8)
    return head[0] >> 4 == 0 and (head[8:11] == e57.BZIP2 or full <= size < full + 8)


class Chain:
    """The packets of an open file, by their headers."""

    def __init__(self, file, begin: int, end: int, width: int):
        self.file, self.begin, self.end, self.width = file, begin, end, width

    def packet(self, at: int) -> tuple[bytes, int]:
        """The first bytes of the packet at a place, and how many it has; 0 where the chain ends."""
        head = self.file.read_at(_HEADER + 3, at) if at + 4 <= self.end else b""
        size = int.from_bytes(head[1:4], "big") * 4
        return head, size if at + size <= self.end else 0

    def walk(self, at: int, until: int) -> Iterator[tuple[int, int, int]]:
        """(place, bytes, records) of the packets that begin before `until`; no records in one that is not of data."""
        while at < until:
            head, size = self.packet(at)
            if not size:
                break
            yield at, size, int.from_bytes(head[4:8], "big") if head[0] >> 4 == 0 else 0
            at += size

    def _leads_on(self, at: int) -> bool:
        for _ in range(FOLLOW):
            head, size = self.packet(at)
            if not size or not _fits(head, size, self.width):
                return False
            at += size
            if at >= self.end:
                break
        return True

    def guess(self, at: int, until: int) -> int:
        """The first place of a block where a packet seems to begin, or `until`. Places are whole words from the beginning."""
        at += (self.begin - at) % 4
        while at < until:
            raw = self.file.read_at(min(WINDOW, until - at) + _HEADER + 3, at)
            words = np.frombuffer(raw[: len(raw) // 4 * 4], ">u4")
            size, count = (words[:-1] & 0xFFFFFF).astype(np.int64) * 4, words[1:].astype(np.int64)
            full = _HEADER + -(-count * self.width // 8)
            packed = np.zeros(len(size), bool)
            packed[:-1] = words[2:] >> 8 == int.from_bytes(e57.BZIP2, "big")
            near = np.flatnonzero((words[:-1] >> 28 == 0) & (size > 0) & (packed | (full <= size) & (size < full + 8)))
            for k in near.tolist():
                if at + 4 * k < until and self._leads_on(at + 4 * k):
                    return at + 4 * k
            at += WINDOW
        return until


def _opened(path: str):
    own, at = store(path)
    return own.open_input_file(at)


_BLOCKS = "path string, begin long, end long, low long, high long, first long, exit long, records long"
_NAMES = [f.split()[0] for f in _BLOCKS.split(", ")]


def _chain(path: str, file) -> Chain:
    begin, end, fields = e57.layout(path)
    return Chain(file, begin, end, sum(f.bits for f in fields))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the place that their first packet has, or seems to have, the one behind their last, and their records. A
    chain that ends in a block has no place behind it: exit is null."""
    for own in batches:
        out = []
        for row in own.to_pylist():
            with _opened(row["path"]) as f:
                chain = _chain(row["path"], f)
                first = row["first"] if row["first"] is not None else row["begin"] if row["low"] == row["begin"] else chain.guess(row["low"], row["high"])
                at, records = first, 0
                for place, size, n in chain.walk(first, row["high"]):
                    at, records = place + size, records + n
                out.append(tuple((row | {"first": first, "exit": at if at >= row["high"] else None, "records": records})[c] for c in _NAMES))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "path" else pa.int64()) for n, c in zip(_NAMES, zip(*out, strict=True) if out else [()] * len(_NAMES), strict=True)], names=_NAMES)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where a file's packets begin and end."""
    for own in batches:
        paths = own.column("path").to_pylist()
        found = [e57.layout(p)[:2] for p in paths]
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *[pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]], names=["path", "begin", "end"])


def _stitched(spark: SparkSession, rows: list[dict]) -> list[tuple]:
    """(path, first, high, base) of the blocks that have packets; rows are all blocks, by path and place."""
    out, base, path, at = [], 0, None, None
    for row in rows:
        if row["path"] != path:
            path, at = row["path"], row["begin"]
        if at is None or at >= row["high"]:
            continue  # the chain has ended, or a packet spans the whole block
        if row["first"] != at:
            again = spark.createDataFrame([tuple((row | {"first": at})[c] for c in _NAMES)], _BLOCKS)
            row = again.mapInArrow(_walked, _BLOCKS).first().asDict()
        if row["records"]:
            out.append((path, at, row["high"], base))
        at, base = row["exit"], base + row["records"]
    return out


def blocks(spark: SparkSession, path: str, size: int = BLOCK) -> list[tuple]:
    """(path, place of the first packet, end of the block, number of its first record) of a file or of a folder's files: what
    the driver holds, a row for each block."""
    names = files(path, (".e57",))
    ends = spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, len(names))).mapInArrow(_ends, "path string, begin long, end long")
    low = F.explode(F.sequence(F.col("begin"), F.greatest(F.col("begin"), F.col("end") - 1), F.lit(size).cast("long")))
    cut = ends.withColumn("low", low).select("path", "begin", "end", "low", F.least(F.col("low") + size, "end").alias("high"), *[F.lit(None).cast("long").alias(c) for c in _NAMES[5:]])
    cut = cut.repartition(max(1, cut.count()))
    return _stitched(spark, [r.asDict() for r in cut.mapInArrow(_walked, _BLOCKS).orderBy("path", "low").collect()])


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The points of blocks, a packet at a time."""
    for own in batches:
        for row in own.to_pylist():
            base, fields = row["base"], e57.layout(row["path"])[2]
            with _opened(row["path"]) as f:
                for at, length, count in _chain(row["path"], f).walk(row["first"], row["high"]):
                    if count:
                        payload = f.read_at(length - _HEADER, at + _HEADER)
                        payload = bz2.BZ2Decompressor().decompress(payload) if payload.startswith(e57.BZIP2) else payload
                        columns = e57.points_of(e57.unpack(payload, count, fields))
                        n = len(columns["x"])
                        yield batch(columns | {"point_idx": np.arange(base, base + n)}, n, row["path"].rsplit("/", 1)[-1])
                    base += count


def read_points(spark: SparkSession, path: str, size: int = BLOCK) -> DataFrame:
    """Points of a file or of a folder's files. point_idx numbers the records, those that are dropped as well (see e57)."""
    found = blocks(spark, path, size)
    rows = spark.createDataFrame(found, "path string, first long, high long, base long")
    return rows.repartition(max(1, len(found))).mapInArrow(_points, POINTS)
