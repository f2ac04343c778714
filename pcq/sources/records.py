"""What the binary sources share: files, partitions of records, and the canonical schema.

A reader plans ranges of records on the driver from a file's header and decodes each range with numpy in a task. Paths may
be files or folders, local or of any store that pyarrow reaches, that every task can open.
"""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import datasource as D
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import POINTS

#: Records in one partition and in one Arrow batch.
PART, BATCH = 2_000_000, 100_000
_ARROW = {
    "point_idx": pa.int64(), "x": pa.float32(), "y": pa.float32(), "z": pa.float32(), "r": pa.int16(), "g": pa.int16(), "b": pa.int16(), "intensity": pa.float32(),
    "classification": pa.int16(), "return_number": pa.int16(), "num_returns": pa.int16(), "source_id": pa.int32(), "gps_time": pa.float64(), "nir": pa.int32(), "src": pa.string(),
}


def batch(columns: dict, n: int, src: str, more: dict | None = None) -> pa.RecordBatch:
    """Canonical columns; what a format lacks is null. more: further columns' arrays."""
    arrays = [pa.array(columns[c]).cast(t) if c in columns else pa.array([src] * n, t) if c == "src" else pa.nulls(n, t) for c, t in _ARROW.items()]
    return pa.RecordBatch.from_arrays([*arrays, *(more or {}).values()], names=[*_ARROW, *(more or {})])


class Pushed:
    """What filters that Spark pushes down say of single columns. They only spare reading: Spark still applies them all, so
    whatever is not understood here is left out."""

    def __init__(self, filters: list[D.Filter] = ()):
        self.low: dict[str, object] = {}
        self.high: dict[str, object] = {}
        self.among: dict[str, set] = {}
        self.starts: dict[str, list[str]] = {}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if name is None or value is None or value != value:
                continue
            if isinstance(f, D.In):
                own = set(value)
                self.among[name] = self.among.get(name, own) & own
            elif isinstance(f, D.StringStartsWith):
                self.starts.setdefault(name, []).append(value)
            else:
                if isinstance(f, (D.EqualTo, D.EqualNullSafe, D.GreaterThan, D.GreaterThanOrEqual)):
                    self.low[name] = max(self.low.get(name, value), value)
                if isinstance(f, (D.EqualTo, D.EqualNullSafe, D.LessThan, D.LessThanOrEqual)):
                    self.high[name] = min(self.high.get(name, value), value)

    def meets(self, name: str, low, high) -> bool:
        """Whether a value between low and high, both counted, can pass."""
        near = name not in self.low or high >= self.low[name]
        near = near and (name not in self.high or low <= self.high[name])
        near = near and (name not in self.among or any(v is not None and low <= v <= high for v in self.among[name]))
        # Of texts from low to high, some start with s if and only if s stands between them or starts one of them.
        return near and all(low[: len(s)] <= s <= high[: len(s)] for s in self.starts.get(name, ()))


def widened(low: float, high: float) -> tuple[float, float]:
    """The range of what is between low and high once it is narrowed to a float."""
    slack = 2.0**-22 * max(abs(low), abs(high))
    return low - slack, high + slack


def store(path: str):
    """The file system of a path or URI, and the path on it: whatever pyarrow reaches (local, HDFS, object stores)."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def files(path: str, suffixes: tuple[str, ...]) -> list[str]:
    from pyarrow import fs

    own, at = store(path)
    if own.get_file_info(at).type == fs.FileType.Directory:
        names = [i.base_name for i in own.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File]
        return [f"{path.rstrip('/')}/{n}" for n in sorted(names) if n.lower().endswith(suffixes) and not n.startswith(("_", "."))]
    return [path]


def size_of(path: str) -> int:
    own, at = store(path)
    return own.get_file_info(at).size


def write_bytes(path: str, data: bytes) -> None:
    own, at = store(path)
    own.create_dir(at.rsplit("/", 1)[0], recursive=True)
    # The bytes are as they shall stand: no codec by the name's suffix.
    with own.open_output_stream(at, compression=None) as f:
        f.write(data)


@lru_cache(1)
def _unzipping(path: str) -> gzip.GzipFile:
    """A gzipped file is not splittable: a task unpacks it from the start on, as far as it reads, and holds none of it."""
    own, at = store(path)
    return gzip.GzipFile(fileobj=own.open_input_file(at))


def read_bytes(path: str, start: int = 0, size: int | None = None) -> bytes:
    if path.lower().endswith(".gz"):
        f = _unzipping(path)
        f.seek(start)
        return f.read() if size is None else f.read(size)
    own, at = store(path)
    with own.open_input_file(at) as f:
        end = f.size()
        return f.read_at(max(0, min(end - start, end if size is None else size)), start)


def clamp_byte(v: np.ndarray) -> np.ndarray:
    return np.clip(np.nan_to_num(np.floor(v), nan=128.0), 0, 255).astype(np.int16)


@dataclass
class Range(InputPartition):
    path: str
    first: int
    count: int
    base: int


class RecordReader(DataSourceReader):
    """Subclasses say how many records a file has and how a range of them decodes to canonical columns."""

    suffixes: tuple[str, ...] = ()

    def __init__(self, options):
        self.path = options["path"]
        self.part = int(options.get("part_records", PART))
        self.pushed = Pushed()

    def pushFilters(self, filters):
        self.pushed = Pushed(filters)
        return filters

    def wanted(self, path: str) -> bool:
        """Whether a file may hold rows that pass the filters."""
        return self.pushed.meets("src", os.path.basename(path), os.path.basename(path))

    def count(self, path: str) -> int:
        raise NotImplementedError

    def span(self, path: str) -> int:
        """How many records of a file a task reads."""
        return self.part

    def whole(self, path: str) -> bool:
        """Whether one task has to read the file."""
        return False

    def decode(self, path: str, first: int, n: int) -> dict:
        raise NotImplementedError

    def partitions(self):
        out, base = [], 0
        for path in files(self.path, self.suffixes):
            n = self.count(path)
            part = max(1, n) if self.whole(path) else self.span(path)
            if self.wanted(path):
                out += [Range(path, at, min(part, n - at), base + at) for at in range(0, n, part) if self.pushed.meets("point_idx", base + at, base + at + min(part, n - at) - 1)]
            base += n
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for at in range(0, partition.count, BATCH):
            n = min(BATCH, partition.count - at)
            columns = self.decode(partition.path, partition.first + at, n)
            n = len(columns["x"])
            if not n:
                return
            columns["point_idx"] = np.arange(partition.base + at, partition.base + at + n)
            yield batch(columns, n, os.path.basename(partition.path))


class RecordSource(DataSource):
    reader_class: type[RecordReader]

    def schema(self):
        return POINTS

    def reader(self, schema):
        return self.reader_class(self.options)
