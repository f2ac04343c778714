"""Writers of point files: each partition of a table becomes files of a folder, in the layouts that the readers take."""

from __future__ import annotations

import bz2
import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import POINTS, fields
from . import e57, las, laz, rxp
from .records import write_bytes

#: Records in a packet of E57; records in a file, which a task holds.
PACKET, FILE = 10_000, 1_000_000


def _records(columns: dict, layout: list[tuple[str, str]], extra: dict | None = None) -> bytes:
    out = np.zeros(len(columns["x"]), np.dtype(layout))
    for name, _ in layout:
        source = (extra or {}).get(name, columns.get(name))
        if source is not None:
            out[name] = source
    return out.tobytes()


def _beyond(v: np.ndarray, most: int = 65535) -> bool:
    """Whether some values are no numbers from 0 to `most`."""
    return not ((v >= 0) & (v < most + 1)).all()


def _descriptor(kind: int, name: str) -> bytes:
    """What LAS calls a description of extra bytes: 192 bytes with a type and a name."""
    return struct.pack("<2xBB32s156x", kind, 0, name.encode())


def las_bytes(c: dict, scale: float = 0.01, wide: bool = True) -> bytes:
    """LAS 1.2, point format 3. Its intensities and sources have 16 bits. Where a file has others, these two stand once more in
    extra bytes (las.WIDE), which a record of the file describes, and the plain fields hold the nearest value. Without `wide`
    the plain fields are all there is."""
    n = len(c["x"])
    raw = {k: np.round(c[k].astype(np.float64) / scale) for k in "xyz"}
    if any((np.abs(v) >= 2**31).any() for v in raw.values()):
        raise ValueError(f"coordinates beyond 32 bits at a scale of {scale}")
    raw = {k: v.astype(np.int64) for k, v in raw.items()}
    more = las.WIDE if wide and any(_beyond(c[k]) for k in las.WIDE if k in c) else {}
    plain = {k: np.clip(np.nan_to_num(c[k]), 0, 65535) for k in las.WIDE if k in c}
    flags = (c["return_number"].astype(np.int64) & 7) | (c["num_returns"].astype(np.int64) & 7) << 3
    layout = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("angle", "i1"), ("user", "u1"), ("source_id", "<u2"), ("gps_time", "<f8"), ("r", "<u2"), ("g", "<u2"), ("b", "<u2")]
    layout += [(name, kind) for name, _, kind in more.values()]
    body = _records(c, layout, raw | plain | {"flags": flags} | {k: c[k].astype(np.int64) * 256 for k in "rgb"} | {name: c[k] for k, (name, _, _) in more.items() if k in c})
    how = b"".join(_descriptor(code, name) for name, code, _ in more.values())
    record = struct.pack("<H16sHH32s", 0, las.SPEC, las.EXTRA, len(how), b"") + how if more else b""
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = bytes((1, 2))
    struct.pack_into("<HII", head, 94, 227, 227 + len(record), len(more) > 0)
    struct.pack_into("<BHI", head, 104, 3, np.dtype(layout).itemsize, n)
    ends = [f(raw[k]) * scale if n else 0.0 for k in "xyz" for f in (np.max, np.min)]
    struct.pack_into("<12d", head, 131, scale, scale, scale, 0.0, 0.0, 0.0, *ends)
    return bytes(head) + record + body


def _ply_header(kind: str, n: int) -> bytes:
    lines = ["ply", f"format {kind} 1.0", f"element vertex {n}", *[f"property float {k}" for k in "xyz"], *[f"property uchar {k}" for k in ("red", "green", "blue")], "property float intensity", "end_header", ""]
    return "\n".join(lines).encode()


def ply_bytes(c: dict, ascii: bool = False) -> bytes:
    columns = ["x", "y", "z", "r", "g", "b", "intensity"]
    if ascii:
        rows = zip(*[c[k].astype(np.float32 if k in "xyz" or k == "intensity" else np.int64).tolist() for k in columns], strict=True)
        return _ply_header("ascii", len(c["x"])) + "".join(" ".join(map(repr, r)) + "\n" for r in rows).encode()
    return _ply_header("binary_little_endian", len(c["x"])) + _records(c, [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("intensity", "<f4")])


def rxp_bytes(c: dict) -> bytes:
    """Intensities have 16 bits; where a file has others, all are floats, and the end of the header says so."""
    wide = _beyond(c["intensity"])
    head = bytes(rxp.HEADER - len(rxp.WIDE)) + (rxp.WIDE if wide else bytes(len(rxp.WIDE)))
    return head + _records(c, [("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("intensity", "<f4" if wide else "<u2")])


def _name(text: str) -> bytes:
    raw = text.encode("latin-1")
    return (bytes([len(raw)]) if len(raw) < 255 else b"\xff" + struct.pack("<H", len(raw))) + raw


def e57_bytes(c: dict, compressed: bool = False) -> bytes:
    fields = [("cartesianX", "x", e57.FLOAT), ("cartesianY", "y", e57.FLOAT), ("cartesianZ", "z", e57.FLOAT), ("intensity", "intensity", e57.FLOAT), ("colorRed", "r", e57.INTEGER), ("colorGreen", "g", e57.INTEGER), ("colorBlue", "b", e57.INTEGER)]
    packets = []
    for at in range(0, len(c["x"]), PACKET):
        part = {k: c[k][at : at + PACKET] for _, k, _ in fields}
        body = _records(part, [(k, ">f8" if kind == e57.FLOAT else ">i4") for _, k, kind in fields])
        body = bz2.compress(body) if compressed else body
        body += bytes(-len(body) % 4)
        packets.append(b"\0" + ((len(body) + 8) // 4).to_bytes(3, "big") + len(part["x"]).to_bytes(4, "big") + body)
    data = b"".join(packets)
    leaf = lambda kind, name: bytes([kind]) + _name(name) + bytes(8)
    inner = lambda kind, name, own: bytes([kind]) + _name(name) + struct.pack("<I", len(own)) + b"".join(own)
    prototype = inner(e57.STRUCTURE, "prototype", [leaf(kind, name) for name, _, kind in fields])
    points = bytes([e57.COMPRESSED]) + _name("points") + struct.pack("<QQ", 64, len(data)) + prototype
    tree = inner(e57.STRUCTURE, "e57Root", [inner(e57.VECTOR, "data3D", [inner(e57.STRUCTURE, "scan", [points])])])
    head = bytearray(64)
    head[:8] = e57.SIGNATURE
    struct.pack_into("<QQ", head, e57.TREE_AT, 64 + len(data), len(tree))
    return bytes(head) + data + tree


#: Suffix and encoder by format.
ENCODERS = {
    "las": (".las", las_bytes), "las plain": (".las", lambda c: las_bytes(c, wide=False)), "laz": (".laz", lambda c: laz.compress(las_bytes(c))), "ply": (".ply", ply_bytes), "ply ascii": (".ply", lambda c: ply_bytes(c, ascii=True)), "ply.gz": (".ply.gz", lambda c: gzip.compress(ply_bytes(c), mtime=0)),
    "rxp": (".rxp", rxp_bytes), "e57": (".e57", e57_bytes), "e57 bzip2": (".e57", lambda c: e57_bytes(c, compressed=True)),
}


def write_points(points: DataFrame, path: str, form: str) -> int:
    """Write each partition of points into files of the folder `path`, of FILE points at most, and tell how many points there
    are. Columns that are missing or null are 0. A task that runs again writes the same files again. Text goes by write_xyz."""
    suffix, encode = ENCODERS[form]
    columns = [c for c, _ in fields(POINTS) if c != "src"]
    ready = points.select(*[F.coalesce(F.col(c).cast("double") if c in points.columns else F.lit(None).cast("double"), F.lit(0.0)).alias(c) for c in columns])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, done = [], 0, 0

        def put() -> pd.DataFrame:
            own = pd.concat(held, ignore_index=True)
            write_bytes(f"{path}/part-{TaskContext.get().partitionId():05d}-{done:05d}{suffix}", encode({c: own[c].to_numpy() for c in own.columns}))
            return pd.DataFrame({"n": [len(own)]})

        for own in batches:
            for at in range(0, len(own), FILE):
                part = own.iloc[at : at + FILE]
                if held and size + len(part) > FILE:
                    yield put()
                    held, size, done = [], 0, done + 1
                held.append(part)
                size += len(part)
        if held:
            yield put()

    return ready.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_xyz(points: DataFrame, path: str, comment: str = "") -> None:
    """x y z intensity, a line for each point, by Spark's own text writer; a comment line before each file's points is
    what `comment` adds to a line's start on points without intensity."""
    number = lambda c: F.col(c).cast("float").cast("string")
    line = F.concat_ws(" ", *[number(c) for c in ("x", "y", "z", "intensity")])
    points.select(F.when(F.col("intensity").isNull(), F.concat(F.lit(comment), line)).otherwise(line).alias("value")).write.text(path)
