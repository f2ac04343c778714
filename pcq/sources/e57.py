"""E57 in the dialect of binary node trees: a header, a tree of typed nodes that describes the points, and packets of
bit-packed records, plain or compressed by bzip2. Packets are grouped into partitions; numpy unpacks each one at once."""

from __future__ import annotations

import bz2
import math
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql.datasource import DataSourceReader, InputPartition

from .records import RecordSource, batch, files, read_bytes, size_of

# The signature, where the tree's place and length stand, node types, colour of points that have none.
SIGNATURE, TREE_AT = b"ASTM-E57", 18
BLOB, STRUCTURE, VECTOR, INTEGER, FLOAT, SCALED, STRING, COMPRESSED = range(1, 9)
DEFAULT_RGB = (180, 180, 200)
BZIP2 = b"BZh"
#: Bytes of packets in one partition, about.
PART_BYTES = 64 << 20


def _text(raw: bytes, at: int) -> tuple[str, int]:
    n, at = raw[at], at + 1
    if n == 0xFF:
        n, at = struct.unpack_from("<H", raw, at)[0], at + 2
    return raw[at : at + n].decode("latin-1"), at + n


def parse_node(raw: bytes, at: int = 0) -> tuple[dict, int]:
    """The node at a place, with its children, and the place behind it."""
    kind = raw[at]
    name, at = _text(raw, at + 1)
    node: dict = {"kind": kind, "name": name}
    if kind == BLOB:
        n = struct.unpack_from("<Q", raw, at)[0]
        node["data"], at = raw[at + 8 : at + 8 + n], at + 8 + n
    elif kind in (STRUCTURE, VECTOR):
        n, at = struct.unpack_from("<I", raw, at)[0], at + 4
        node["children"] = []
        for _ in range(n):
            child, at = parse_node(raw, at)
            node["children"].append(child)
    elif kind == INTEGER:
        node["value"], at = struct.unpack_from("<q", raw, at)[0], at + 8
    elif kind == FLOAT:
        node["value"], at = struct.unpack_from("<d", raw, at)[0], at + 8
    elif kind == SCALED:
        (node["raw"], node["scale"], node["offset"]), at = struct.unpack_from("<qdd", raw, at), at + 24
    elif kind == STRING:
        node["value"], at = _text(raw, at)
    elif kind == COMPRESSED:
        (node["offset"], node["length"]), at = struct.unpack_from("<QQ", raw, at), at + 16
        node["prototype"], at = parse_node(raw, at)
    else:
        raise ValueError(f"unknown node type {kind}")
    return node, at


def child(node: dict, name: str) -> dict | None:
    return next((c for c in node.get("children", ()) if c["name"] == name), None)


@dataclass(frozen=True)
class Field:
    name: str
    kind: int
    bits: int
    least: int = 0
    scale: float = 1.0
    offset: float = 0.0


def field_of(node: dict, least: float | None = None, most: float | None = None, single: bool = False) -> Field:
    """A field of the prototype: 64 bits for a number (32 if single), else as many as its range takes, 32 without one."""
    if node["kind"] == FLOAT:
        return Field(node["name"], FLOAT, 32 if single else 64)
    scale, offset = (node["scale"], node["offset"]) if node["kind"] == SCALED else (1.0, 0.0)
    if least is None or most is None:
        return Field(node["name"], node["kind"], 32, 0, scale, offset)
    low, high = math.ceil((least - offset) / scale), math.floor((most - offset) / scale)
    return Field(node["name"], node["kind"], math.ceil(math.log2(high - low + 1)) if high > low else 0, low, scale, offset)


def unpack(payload: bytes, count: int, fields: list[Field]) -> dict[str, np.ndarray]:
    """Columns of count records, whose fields stand one behind another, highest bit first; bits that are missing are 0."""
    width = sum(f.bits for f in fields)
    raw = np.frombuffer(payload[: -(-count * width // 8)].ljust(-(-count * width // 8), b"\0"), np.uint8)
    bits = np.unpackbits(raw, count=count * width).reshape(count, width)
    out, at = {}, 0
    for f in fields:
        own = np.zeros((count, 64), np.uint8)
        own[:, 64 - f.bits :] = bits[:, at : at + f.bits]
        value = np.packbits(own, axis=1).view(">u8").ravel().astype(np.uint64)
        at += f.bits
        if f.kind == FLOAT:
            out[f.name] = value.view(np.float64) if f.bits == 64 else value.astype(np.uint32).view(np.float32).astype(np.float64)
        else:
            # Fields without a range are signed.
            whole = value.astype(np.uint32).view(np.int32).astype(np.int64) if f.bits == 32 else value.astype(np.int64)
            out[f.name] = (whole + f.least) * f.scale + f.offset
    return out


@lru_cache(64)
def layout(path: str) -> tuple[int, int, list[Field]]:
    """Where the packets begin and end, and the fields of a record, of the first scan."""
    head = read_bytes(path, 0, 64)
    if head[:8] != SIGNATURE:
        raise ValueError(f"{path} is not an E57 file")
    at, size = struct.unpack_from("<QQ", head, TREE_AT)
    root, _ = parse_node(read_bytes(path, at, size))
    scans = child(root, "data3D")
    points = child(scans["children"][0], "points") if scans and scans.get("children") else None
    if not points or points["kind"] != COMPRESSED:
        raise ValueError(f"{path} holds no points")
    return points["offset"], min(points["offset"] + points["length"], size_of(path)), [field_of(f) for f in points["prototype"].get("children", ()) if f["kind"] in (INTEGER, FLOAT, SCALED)]


def packets(path: str) -> list[tuple[int, int, int]]:
    """(place, bytes, records) of each packet of data; the list ends where a packet does not fit."""
    at, end, _ = layout(path)
    out = []
    while at + 4 <= end:
        head = read_bytes(path, at, 8)
        size = int.from_bytes(head[1:4], "big") * 4
        if not size or at + size > end:
            break
        if head[0] >> 4 == 0:
            out.append((at, size, int.from_bytes(head[4:8], "big")))
        at += size
    return out


def points_of(columns: dict[str, np.ndarray]) -> dict:
    """Canonical columns: missing coordinates are 0, points with an infinite one are dropped; colours of 0 to 1 are scaled."""
    n = len(next(iter(columns.values()), ()))
    xyz = [np.nan_to_num(columns[c], nan=0.0, posinf=np.inf, neginf=-np.inf) if (c := f"cartesian{a}") in columns else np.zeros(n) for a in "XYZ"]
    keep = np.isfinite(xyz).all(0)
    out = {c: v[keep].astype(np.float32) for c, v in zip("xyz", xyz, strict=True)}
    if all(c in columns for c in ("colorRed", "colorGreen", "colorBlue")):
        rgb = np.array([columns[c] for c in ("colorRed", "colorGreen", "colorBlue")])
        rgb = np.where((rgb <= 1).all(0), rgb * 255, rgb)
        out |= {c: np.clip(v, 0, 255).astype(np.int16)[keep] for c, v in zip("rgb", rgb, strict=True)}
    else:
        out |= {c: np.full(int(keep.sum()), v, np.int16) for c, v in zip("rgb", DEFAULT_RGB, strict=True)}
    if "intensity" in columns:
        out["intensity"] = columns["intensity"][keep].astype(np.float32)
    return out


@dataclass
class Packets(InputPartition):
    path: str
    packets: list
    base: int


class E57Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("part_bytes", PART_BYTES))

    def partitions(self):
        out, base = [], 0
        for path in files(self.path, (".e57",)):
            held, size, first = [], 0, base
            for p in packets(path):
                held.append(p)
                size, base = size + p[1], base + p[2]
                if size >= self.most:
                    out.append(Packets(path, held, first))
                    held, size, first = [], 0, base
            if held:
                out.append(Packets(path, held, first))
        return out or [Packets("", [], 0)]

    def read(self, partition: Packets):
        base = partition.base
        for at, size, count in partition.packets:
            payload = read_bytes(partition.path, at + 8, size - 8)
            payload = bz2.BZ2Decompressor().decompress(payload) if payload.startswith(BZIP2) else payload
            columns = points_of(unpack(payload, count, layout(partition.path)[2]))
            n = len(columns["x"])
            # Numbers are those of the records, so dropped ones leave no gap within a packet but between packets.
            yield batch(columns | {"point_idx": np.arange(base, base + n)}, n, partition.path.rsplit("/", 1)[-1])
            base += count


class E57Source(RecordSource):
    @classmethod
    def name(cls):
        return "e57"

    def reader(self, schema):
        return E57Reader(self.options)
