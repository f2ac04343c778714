"""PLY, ascii and binary little-endian, plain or gzipped. Lists and big-endian files are refused."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schema import POINTS, fields
from ..scratch import BROADCAST_RANGES, Scratch, running
from .records import RecordReader, RecordSource, batch, clamp_byte, read_bytes, size_of

# Scalar types, and other names of a property.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}
ALIASES = {"red": "r", "green": "g", "blue": "b", "scalar_intensity": "intensity", "i": "intensity", "reflectance": "intensity"}


@lru_cache(64)
def header(path: str) -> dict:
    raw = read_bytes(path, 0, 1 << 16)
    end = raw.find(b"end_header")
    if not raw.startswith(b"ply") or end < 0:
        raise ValueError(f"{path} is not a PLY file")
    body = raw.index(b"\n", end) + 1
    kind, count, own, inside = "", None, [], False
    for line in raw[:end].decode("ascii", "replace").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            kind = w[1]
        elif w[:1] == ["element"]:
            inside = w[1] == "vertex"
            count = int(w[2]) if inside else count
        elif w[:1] == ["property"] and inside:
            if w[1] == "list":
                raise ValueError(f"{path}: list properties of vertices are not supported")
            name = w[2].lower()
            own.append((ALIASES.get(name, name), TYPES.get(w[1], "<f4")))
    if count is None:
        raise ValueError(f"{path} has no vertices")
    if kind not in ("ascii", "binary_little_endian"):
        raise ValueError(f"{path}: format {kind} is not supported")
    return {"ascii": kind == "ascii", "count": count, "fields": own, "body": body}


def decoded(values: dict, types: dict) -> dict:
    """Canonical columns of a file's own."""
    out = {c: values[c].astype(np.float32) for c in "xyz"}
    if "intensity" in values:
        out["intensity"] = values["intensity"].astype(np.float32)
    if all(c in values for c in "rgb"):
        out |= {c: clamp_byte(values[c] * (255.0 if types[c] in ("<f4", "<f8") else 1.0)) for c in "rgb"}
    return out


@lru_cache(1)
def _table(path: str) -> np.ndarray:
    """All rows of an ascii file, which one task reads once; lines with too few numbers are dropped."""
    h = header(path)
    rows = (line.split() for line in read_bytes(path, h["body"]).decode("ascii", "replace").splitlines())
    rows = [w[: len(h["fields"])] for w in rows if len(w) >= len(h["fields"])][: h["count"]]
    return np.array(rows, np.float64).reshape(-1, len(h["fields"]))


class PlyReader(RecordReader):
    """Binary files by ranges of records. Gzipped ones are read by one task each, as a stream, and so are ascii files here; the
    latter are split by read_ascii, which load() takes."""

    suffixes = (".ply", ".ply.gz")

    def count(self, path):
        h = header(path)
        if h["ascii"] or path.lower().endswith(".gz"):
            # How many there are is only known by reading all: the header's number plans, and a task finds what is there.
            return h["count"]
        return min(h["count"], (size_of(path) - h["body"]) // np.dtype(h["fields"]).itemsize)

    def whole(self, path):
        return header(path)["ascii"] or path.lower().endswith(".gz")

    def decode(self, path, first, n):
        h = header(path)
        if h["ascii"]:
            t = _table(path)[first : first + n]
            return decoded({name: t[:, k] for k, (name, _) in enumerate(h["fields"])}, dict(h["fields"]))
        kind = np.dtype(h["fields"])
        raw = read_bytes(path, h["body"] + first * kind.itemsize, n * kind.itemsize)
        t = np.frombuffer(raw[: len(raw) // kind.itemsize * kind.itemsize], kind)
        return decoded({name: t[name] for name, _ in h["fields"]}, dict(h["fields"]))


class _Lines:
    """Rows of numbers of ascii files, from lines that come with their file and the place of their split in it. The header is
    in the first split; lines with too few numbers are none."""

    def __init__(self):
        self.key, self.n, self.inside = None, 0, False

    def rows(self, batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, list[list[str]]]]:
        """(file, split, rows of the split before, rows), for lines that stand together."""
        lines = zip(*(batch.column(c).to_pylist() for c in ("file", "split", "value")), strict=True)
        for key, own in groupby(lines, lambda r: r[:2]):
            if key != self.key:
                self.key, self.n, self.inside = key, 0, key[1] > 0
            fields = len(header(unquote(key[0]))["fields"])
            found = []
            for *_, line in own:
                if self.inside:
                    words = line.split()
                    if len(words) >= fields:
                        found.append(words[:fields])
                else:
                    self.inside = line.startswith("end_header")
            if found:
                yield *key, self.n, found
                self.n += len(found)


def read_ascii(spark: SparkSession, names: list[str]) -> DataFrame:
    """Points of ascii files, each of which any number of tasks may read. A first pass counts the rows of each split; sums over
    them, one short row for a split, number the rows of a second one, and end them where the header says."""
    lines = spark.read.text(names).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, total = _Lines(), {}
        for batch_ in batches:
            for file, split, before, rows in state.rows(batch_):
                total[file, split] = before + len(rows)
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([total[k] for k in keys], pa.int64()), pa.array([header(unquote(k[0]))["count"] for k in keys], pa.int64())], names=["file", "split", "n", "most"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Lines()
        for batch_ in batches:
            for file, split, before, rows in state.rows(batch_):
                h, t = header(unquote(file)), np.array(rows, np.float64)
                columns = decoded({name: t[:, k] for k, (name, _) in enumerate(h["fields"])}, dict(h["fields"]))
                columns["point_idx"] = np.arange(before, before + len(rows))
                yield batch(columns, len(rows), unquote(file.rsplit("/", 1)[-1]), {"_file": pa.array([file] * len(rows), pa.string()), "_split": pa.array(np.full(len(rows), split))})

    counts = Scratch(spark, "ply").save(lines.mapInArrow(count, "file string, split long, n long, most long"), "counts")
    before = F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    bases = running(counts.select("file", "most").distinct(), ["file"], F.col("most"), "_base").select(F.col("file").alias("_of"), "_base")
    places = counts.withColumn("_before", before).join(bases, F.col("file") == F.col("_of")).select(F.col("file").alias("_f"), F.col("split").alias("_s"), "_before", "_base", "most")
    places = F.broadcast(places) if counts.count() <= BROADCAST_RANGES else places
    rows = lines.mapInArrow(parse, f"{POINTS}, _file string, _split long").join(places, (F.col("_file") == F.col("_f")) & (F.col("_split") == F.col("_s")))
    nth = F.col("point_idx") + F.col("_before")
    return rows.filter(nth < F.col("most")).withColumn("point_idx", nth + F.col("_base")).select(*[c for c, _ in fields(POINTS)])


class PlySource(RecordSource):
    reader_class = PlyReader

    @classmethod
    def name(cls):
        return "ply"
