"""Octree datasets: metadata.json, files of nodes and files of points, pruned by filters, written by a sink that commits.

A node's block is planar: positions (three floats), colours (four bytes), intensities (u16), classes (u8). Only leaves have
a block; inner nodes are written with byte_size 0 and read as such. A dataset is one hierarchy.bin and one octree.bin, or
parts that metadata.json lists, each a range of node names; a task reads or writes a part.
"""

from __future__ import annotations

import json
import math
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..schema import POINTS
from ..scratch import Scratch, running
from .records import BATCH, Pushed, RecordSource, batch, read_bytes, store, widened, write_bytes

# Attributes in the order of a block, with their bytes; bytes of a point.
ATTRIBUTES = (("POSITION_CARTESIAN", 12), ("RGBA", 4), ("INTENSITY", 2), ("CLASSIFICATION", 1))
POINT_BYTES = 19
#: Bytes of blocks in a part, about, and parts at most: metadata.json lists them all.
PART_BYTES, MOST_PARTS = 16 << 20, 50_000
#: Levels of the keys that points are read with.
KEY_LEVELS = 20
NODE_SCHEMA = "name string, depth int, num_points long, child_mask int, is_leaf boolean, byte_offset long, byte_size long"


def _root(path: str) -> str:
    return path.rstrip("/").removesuffix("/metadata.json")


def metadata(path: str) -> dict:
    return json.loads(read_bytes(f"{_root(path)}/metadata.json"))


def files_of(path: str) -> list[dict]:
    """The dataset's parts: files of nodes and of blocks, the place of a part's blocks among all, and the names it holds. A
    dataset without a list of parts is one part of files with fixed names."""
    return metadata(path).get("parts") or [{"hierarchy": "hierarchy.bin", "octree": "octree.bin", "offset": 0, "base": 0, "first": "", "last": "s"}]


def entries(raw: bytes) -> list[tuple]:
    """Rows of NODE_SCHEMA. An entry has a name if its first bit is set; else it has 22 bytes and is the root if it comes
    first, and nothing otherwise. Of entries with the same name the last one counts; a cut one ends the list."""
    at, found = 0, {}
    while at + 22 <= len(raw):
        name = "" if at else "r"
        if raw[at] & 0x80:
            n = raw[at] & 0x3F
            name = raw[at + 1 : at + 1 + n].decode("ascii", "replace")
            at += 1 + n
            if at + 22 > len(raw):
                break
            mask, _, points, offset, size = struct.unpack_from("<BBIqq", raw, at)
        else:
            _, mask, points, offset, size = struct.unpack_from("<BBIqq", raw, at)
        if name:
            found[name] = (name, len(name) - 1, points, mask, mask == 0, offset, size)
        at += 22
    return list(found.values())


def part_nodes(path: str, part: dict) -> list[tuple]:
    """The nodes of a part, with offsets that count from the first block of the dataset."""
    return [(*row[:5], row[5] + part["offset"], row[6]) for row in entries(read_bytes(f"{_root(path)}/{part['hierarchy']}"))]


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The node table; each part is read by a task of its own."""
    spark.dataSource.register(HierarchySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("octree_hierarchy").load(path)


def first_key(name: str) -> int:
    """The first key of a node's range, at KEY_LEVELS levels."""
    return int("0" + name[1:], 8) << 3 * (KEY_LEVELS - len(name) + 1)


def _span(name: str, k: int, low: float, high: float) -> tuple[float, float]:
    """What a node spans on an axis. Points beyond the box are in the outermost nodes, which therefore have no end there."""
    cells = 1 << len(name) - 1
    at = sum((int(digit) >> 2 - k & 1) << len(name) - 2 - i for i, digit in enumerate(name[1:]))
    side = (high - low) / cells
    a, b = widened(low + at * side, low + (at + 1) * side)
    slack = 2.0**-22 * max(abs(low), abs(high))
    return (a - slack if at else -math.inf), (b + slack if at < cells - 1 else math.inf)


class Wanted:
    """Which nodes may hold rows that pass the filters: on src (the node's name), depth, key, x, y and z."""

    def __init__(self, pushed: Pushed, meta: dict, names: set[str] | None = None):
        self.pushed, self.names = pushed, names
        box = meta.get("boundingBox", {})
        self.box = [(box[f"l{c}"], box[f"u{c}"]) if f"l{c}" in box and f"u{c}" in box else None for c in "xyz"]

    def names_between(self, first: str, last: str) -> bool:
        return self.pushed.meets("src", first, last) and (self.names is None or any(first <= n <= last for n in self.names))

    def __call__(self, name: str) -> bool:
        if self.names is not None and name not in self.names or not self.pushed.meets("src", name, name):
            return False
        if set(name[1:]) - set("01234567") or len(name) - 1 > KEY_LEVELS:
            return True
        key, depth = first_key(name), len(name) - 1
        return self.pushed.meets("depth", depth, depth) and self.pushed.meets("key", key, key) and all(ends is None or self.pushed.meets(c, *_span(name, k, *ends)) for k, (c, ends) in enumerate(zip("xyz", self.box, strict=True)))


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its files, bytes of blocks, points, nodes, leaves, and the first and last node."""

    hierarchy: str
    octree: str
    size: int
    points: int
    nodes: int
    leaves: int
    first: str
    last: str


@dataclass
class Part(InputPartition):
    part: dict
    blocks: list | None  # (name, offset, size, points, index of its first point), or None: those of the part's own list


class OctreeReader(DataSourceReader):
    """Points of leaves, pruned by pushed filters and by the option nodes: names to read, by commas.

    What is planned is a list of parts: a part outside the names asked for is left out, and the others' nodes are read, and
    pruned, by the task that reads the part. A dataset in one file has one list of nodes, which is cut on the driver."""

    def __init__(self, options):
        self.path = _root(options["path"])
        self.nodes = set(options["nodes"].split(",")) if options.get("nodes") else None
        self.most = int(options.get("part_bytes", 64 << 20))
        self.meta = metadata(self.path)
        self.wanted = Wanted(Pushed(), self.meta, self.nodes)

    def pushFilters(self, filters):
        self.wanted = Wanted(Pushed(filters), self.meta, self.nodes)
        return filters

    def partitions(self):
        parts = files_of(self.path)
        if self.meta.get("parts"):
            return [Part(p, None) for p in parts if self.wanted.names_between(p["first"], p["last"])] or [Part(parts[0], [])]
        out, held, size = [], [], 0
        for block in self.blocks(Part(parts[0], None)):
            held.append(block)
            size += block[2]
            if size >= self.most:
                out.append(Part(parts[0], held))
                held, size = [], 0
        return [*out, Part(parts[0], held)]

    def blocks(self, partition: Part) -> list[tuple]:
        """The blocks to read, with places in the part's own file."""
        if partition.blocks is not None:
            return partition.blocks
        out, base = [], partition.part["base"]
        for name, _, points, _, _, offset, length in sorted(entries(read_bytes(f"{self.path}/{partition.part['hierarchy']}"))):
            if length > 0 and points > 0:
                if self.wanted(name):
                    out.append((name, offset, length, points, base))
                base += points
        return out

    def read(self, partition: Part) -> Iterator:
        blocks = self.blocks(partition)
        own, at = store(f"{self.path}/{partition.part['octree']}")
        if blocks:
            with own.open_input_file(at) as f:
                for name, offset, size, n, base in blocks:
                    raw = f.read_at(size, offset)
                    columns = decode_block(raw, n, self.meta) | {"point_idx": np.arange(base, base + n)}
                    for i in range(0, n, BATCH):
                        m = min(BATCH, n - i)
                        node = {"depth": pa.array(np.full(m, len(name) - 1, np.int32)), "key": pa.array(np.full(m, first_key(name), np.int64))}
                        yield batch({c: v[i : i + m] for c, v in columns.items()}, m, name, node)


def decode_block(raw: bytes, n: int, meta: dict) -> dict:
    """Planar attributes of n points to canonical columns; attributes that are not known are skipped."""
    out, at = {}, 0
    for a in meta["attributes"]:
        name, size = a["name"], a["size"]
        part = raw[at : at + n * size]
        at += n * size
        if len(part) < n * size:
            raise ValueError("a node's block is shorter than its points")
        if name == "POSITION_CARTESIAN":
            if a.get("type") == "int32":
                v = np.frombuffer(part, "<i4").reshape(n, 3) * np.array(meta.get("scale", 1)) + np.array(meta.get("offset", 0))
            else:
                v = np.frombuffer(part, "<f4").reshape(n, 3)
            out |= {c: v[:, k].astype(np.float32) for k, c in enumerate("xyz")}
        elif name in ("RGBA", "RGB"):
            out |= {c: np.frombuffer(part, np.uint8).reshape(n, size)[:, k].astype(np.int16) for k, c in enumerate("rgb")}
        elif name == "INTENSITY":
            out["intensity"] = (np.frombuffer(part, "<u2") / 65535).astype(np.float32)
        elif name == "CLASSIFICATION":
            out["classification"] = np.frombuffer(part, np.uint8).astype(np.int16)
        elif name == "RETURN_NUMBER":
            out["return_number"] = (np.frombuffer(part, np.uint8) >> 4).astype(np.int16)
        elif name == "NUMBER_OF_RETURNS":
            out["num_returns"] = (np.frombuffer(part, np.uint8) & 15).astype(np.int16)
        elif name == "SOURCE_ID":
            out["source_id"] = np.frombuffer(part, "<u2").astype(np.int32)
        elif name == "GPS_TIME":
            out["gps_time"] = np.frombuffer(part, "<f8")
    return out


class OctreeSource(RecordSource):
    """Reads points with depth and key (first_key) of their node; writes rows as write_dataset lays them out."""

    @classmethod
    def name(cls):
        return "octree"

    def schema(self):
        return f"{POINTS}, depth int, key long"

    def reader(self, schema):
        return OctreeReader(self.options)

    def writer(self, schema, overwrite):
        return OctreeWriter(self.options, overwrite)


class HierarchyReader(DataSourceReader):
    def __init__(self, options):
        self.path = _root(options["path"])
        self.pushed = Pushed()

    def pushFilters(self, filters):
        self.pushed = Pushed(filters)
        return filters

    def partitions(self):
        parts = files_of(self.path)
        return [Part(p, None) for p in parts if self.pushed.meets("name", p["first"], p["last"])] or [Part(parts[0], [])]

    def read(self, partition):
        if partition.blocks is None:
            yield from part_nodes(self.path, partition.part)


class HierarchySource(DataSource):
    @classmethod
    def name(cls):
        return "octree_hierarchy"

    def schema(self):
        return NODE_SCHEMA

    def reader(self, schema):
        return HierarchyReader(self.options)


class OctreeWriter(DataSourceArrowWriter):
    """Sink of rows in the order of node names, each node's row before its points (see write_dataset).

    A task writes its share into two files of its own, whose names no other attempt has, and tells their sizes. Only the commit
    makes a dataset of them: it puts metadata.json, which lists the files, in its place at one stroke, and then deletes what
    the list does not name. Until then a reader sees nothing, or what was there before. A job that fails leaves no files."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = _root(options["path"]), overwrite, uuid.uuid4().hex
        self.head = json.loads(options["metadata"])
        if not overwrite and _there(f"{self.path}/metadata.json"):
            raise ValueError(f"{self.path} holds a dataset already")

    def write(self, iterator) -> Written:
        task = TaskContext.get()
        tag = f"{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}"
        own, root = store(self.path)
        own.create_dir(root, recursive=True)
        made = Written(f"hierarchy-{tag}.bin", f"octree-{tag}.bin", 0, 0, 0, 0, "", "")
        nodes = bytearray()
        with own.open_output_stream(f"{root}/{made.octree}", compression=None) as out:
            for row, points in _by_node(iterator):
                size = POINT_BYTES * len(points["x"])
                if size != POINT_BYTES * (row["num_points"] if row["is_leaf"] else 0):
                    raise ValueError(f"node {row['name']} has {len(points['x'])} points, not {row['num_points']}")
                name = row["name"].encode()
                nodes += bytes([0x80 | len(name)]) + name + struct.pack("<BBIqq", row["child_mask"], 0, row["num_points"], made.size, size)
                if size:
                    for column in _block(points):
                        out.write(column)
                made.first, made.last = made.first or row["name"], row["name"]
                made.size, made.points, made.nodes, made.leaves = made.size + size, made.points + len(points["x"]), made.nodes + 1, made.leaves + row["is_leaf"]
        write_bytes(f"{self.path}/{made.hierarchy}", bytes(nodes))
        return made

    def commit(self, messages) -> None:
        parts, offset, base = [], 0, 0
        for m in sorted((m for m in messages if m is not None and m.nodes), key=lambda m: m.first):
            parts.append({"hierarchy": m.hierarchy, "octree": m.octree, "offset": offset, "size": m.size, "base": base, "points": m.points, "nodes": m.nodes, "leaves": m.leaves, "first": m.first, "last": m.last})
            offset, base = offset + m.size, base + m.points
        if any(a["last"] >= b["first"] for a, b in zip(parts, parts[1:], strict=False)):
            raise ValueError("tasks' nodes do not follow one another")
        meta = self.head | {"hierarchy": {"firstChunkSize": sum(p["nodes"] for p in parts)}, "parts": parts}
        own, root = store(self.path)
        own.create_dir(root, recursive=True)
        write_bytes(f"{self.path}/metadata-{self.job}.json", json.dumps(meta).encode())
        own.move(f"{root}/metadata-{self.job}.json", f"{root}/metadata.json")
        self._clear({p[k] for p in parts for k in ("hierarchy", "octree")}, "")

    def abort(self, messages) -> None:
        self._clear(set(), self.job)

    def _clear(self, keep: set[str], job: str) -> None:
        """Delete the files of nodes and blocks that are not kept, of a job or of all."""
        from pyarrow import fs

        own, root = store(self.path)
        for info in own.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            name = info.base_name
            if info.type == fs.FileType.File and re.fullmatch(r"(hierarchy|octree|metadata)(-.*)?\.(bin|json)", name) and job in name and name not in keep and name != "metadata.json":
                own.delete_file(f"{root}/{name}")


def _there(path: str) -> bool:
    from pyarrow import fs

    own, at = store(path)
    return own.get_file_info(at).type == fs.FileType.File


_POINT = ("x", "y", "z", "r", "g", "b", "intensity", "classification")


def _by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict]]:
    """Each node's row and its points' columns. A leaf is held, at the size that its columns have in a block."""
    row, held = None, []

    def points() -> dict:
        return {c: np.concatenate([h[c] for h in held]) if held else np.empty(0) for c in _POINT}

    for own in batches:
        starts = np.flatnonzero(~own.column("is_point").to_numpy(zero_copy_only=False).astype(bool))
        columns = {c: own.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in _POINT}
        for a, b in zip([-1, *starts.tolist()], [*starts.tolist(), own.num_rows], strict=True):
            if a >= 0:
                if row is not None:
                    yield row, points()
                row, held = {c: own.column(c)[a].as_py() for c in ("name", "num_points", "child_mask", "is_leaf")}, []
            if b > a + 1:
                held.append({c: v[a + 1 : b] for c, v in columns.items()})
    if row is not None:
        yield row, points()


def _block(p: dict) -> list[bytes]:
    """The planar block of one leaf's points, a column at a time."""
    rgba = np.full((len(p["x"]), 4), 255, np.uint8)
    for k, c in enumerate("rgb"):
        rgba[:, k] = np.clip(p[c], 0, 255)
    intensity = np.round(np.clip(p["intensity"].astype(np.float64), 0, 1) * 65535).astype("<u2")
    return [np.stack([p[c] for c in "xyz"], 1).astype("<f4").tobytes(), rgba.tobytes(), intensity.tobytes(), p["classification"].astype(np.uint8).tobytes()]


def _part_of(begins: np.ndarray):
    """A function of keys: in which part each lies. begins: the first keys of all parts but the first, sorted."""

    @F.pandas_udf("int")
    def find(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(begins, key.to_numpy(np.int64), "right").astype(np.int32))

    return find


def write_dataset(points: DataFrame, path: str, lo: tuple, hi: tuple, leaf_size: int = 5000, depth: int = 12) -> dict:
    """Index points and write a dataset into a folder of any store, in place of what is there; returns its statistics.

    Nodes and points are rows of one table, dealt into ranges of node names, so that a part holds all points of its leaves and
    no bytes meet on the driver. Points are written once with their keys, which is what all counts read; where the parts begin
    follows from the leaves' counts, so no pass over the points samples them. Offsets within a part follow from its own rows, those
    of parts from their sizes. Points are in the order of point_idx within a leaf. intensity is stored as u16 of 0..1, missing columns by their defaults, null ones as
    well; coordinates are finite. A leaf at the deepest level may have any number of points; its task holds them."""
    from ..operators import octree

    spark, root = points.sparkSession, _root(path)
    has, tmp = set(points.columns), Scratch(spark, "dataset")
    column = lambda c, default: F.coalesce(F.col(c).cast("double"), F.lit(default)) if c in has else F.lit(default)
    keyed = octree.with_path(points, lo, hi, depth).select(
        "key", "point_idx", *[F.col(c).cast("float") for c in "xyz"], *[column(c, 180.0).cast("short").alias(c) for c in "rgb"],
        column("intensity", 0.0).alias("intensity"), column("classification", 0.0).cast("short").alias("classification"),
    )
    keyed = tmp.save(keyed, "keyed")
    nodes = octree.nodes(keyed, leaf_size, depth)
    total = nodes.filter("is_leaf").agg(F.sum("num_points")).first()[0] or 0
    size = max(PART_BYTES, total * POINT_BYTES // MOST_PARTS) // POINT_BYTES
    # A part begins with the leaf whose first point is the first beyond a multiple of size, and with the nodes above that leaf.
    first = F.call_function("shiftleft", F.col("key"), (F.lit(depth) - F.col("depth")) * 3)
    before = running(nodes.filter("is_leaf").select(first.alias("_first"), "num_points"), ["_first"], F.col("num_points"), "_before")
    begins = [r["at"] for r in before.groupBy(F.floor(F.col("_before") / size)).agg(F.min("_first").alias("at")).orderBy("at").collect()]
    part = _part_of(np.array(begins[1:], np.int64))
    leaves = octree.leaf_of(keyed, nodes, depth).withColumnRenamed("leaf", "name").withColumns({"is_point": F.lit(True), "_part": part(F.col("key"))}).drop("key")
    # A node goes with its first leaf, which need not begin where the node's own range does.
    spans = F.explode(F.expr("transform(sequence(1, length(name)), i -> substring(name, 1, i))")).alias("_name")
    above = nodes.filter("is_leaf").select(spans, first.alias("_first")).groupBy("_name").agg(F.min("_first").alias("_first"))
    rows = nodes.join(above, nodes["name"] == above["_name"]).select("name", F.lit(False).alias("is_point"), "num_points", "child_mask", "is_leaf", part(F.col("_first")).alias("_part"))
    rows = rows.unionByName(leaves, allowMissingColumns=True)
    box = {f"{k}{c}": float(v) for k, ends in (("l", lo), ("u", hi)) for c, v in zip("xyz", ends, strict=True)}
    head = {"version": "2.0", "boundingBox": box, "spacing": math.dist(lo, hi), "scale": 1, "offset": [0, 0, 0], "attributes": [{"name": n, "size": s} for n, s in ATTRIBUTES]}
    spark.dataSource.register(OctreeSource)
    rows = rows.repartitionById(max(1, len(begins)), F.col("_part")).drop("_part")
    rows.sortWithinPartitions("name", "is_point", "point_idx").write.format("octree").mode("overwrite").option("metadata", json.dumps(head)).save(root)
    tmp.drop()
    made = metadata(root)["parts"]
    return {"total_points": total, "total_nodes": sum(p["nodes"] for p in made), "leaf_nodes": sum(p["leaves"] for p in made), "bytes": sum(p["size"] for p in made)}


def join_files(spark: SparkSession, path: str, out: str) -> None:
    """A copy of a dataset with its nodes in one hierarchy.bin and its blocks in one octree.bin, as viewers ask for them. One
    task copies all bytes piece by piece, since a file has one writer."""
    root, to = _root(path), _root(out)
    meta = metadata(root)
    parts = files_of(root)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        own, at = store(to)
        own.create_dir(at, recursive=True)
        with own.open_output_stream(f"{at}/octree.bin", compression=None) as blocks, own.open_output_stream(f"{at}/hierarchy.bin", compression=None) as nodes:
            for part in parts:
                source, name = store(f"{root}/{part['octree']}")
                with source.open_input_stream(name, compression=None) as f:
                    while piece := f.read(8 << 20):
                        blocks.write(piece)
                for name, _, points, mask, _, offset, size in part_nodes(root, part):
                    nodes.write(bytes([0x80 | len(name)]) + name.encode() + struct.pack("<BBIqq", mask, 0, points, offset, size))
        yield pa.RecordBatch.from_pydict({"parts": pa.array([len(parts)], pa.int64())})

    spark.range(1).coalesce(1).mapInArrow(copy, "parts long").collect()
    write_bytes(f"{to}/metadata.json", json.dumps({k: v for k, v in meta.items() if k != "parts"}).encode())
