"""LAS 1.2 to 1.4, point formats 0 to 10; compressed (LAZ), formats 0 to 5."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

from . import laz
from .records import RecordReader, RecordSource, read_bytes, size_of, widened

# Bytes of a record, and where colour, GPS time and infrared stand, by point format.
SIZES = (20, 28, 26, 34, 57, 63, 30, 36, 42, 59, 67)
RGB = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
GPS = {1: 20, 3: 20, 4: 20, 5: 20, 6: 22, 7: 22, 8: 22, 9: 22, 10: 22}
NIR = {8: 36, 10: 36}
#: Columns that have 16 bits in a record, and in what extra bytes of this library's own they stand where those are too few: name,
#: type in a description, type in a record.
WIDE = {"intensity": ("pcq intensity", 9, "<f4"), "source_id": ("pcq source_id", 6, "<i4")}
#: User and number of the record that describes extra bytes; bytes of its types from 1 on.
SPEC, EXTRA, EXTRA_BYTES = b"LASF_Spec", 4, (1, 1, 2, 2, 4, 4, 8, 8, 4, 8)
#: Records of a compressed file in one partition.
PACKED = 500_000


@lru_cache(64)
def extra(path: str) -> dict[str, tuple[int, str]]:
    """Where WIDE's columns stand in a record of the file, and their types there."""
    h, out = header(path), {}
    raw, at = read_bytes(path, h["start"], h["offset"] - h["start"]) if h["length"] > SIZES[h["format"]] else b"", 0
    for _ in range(h["records"] if raw else 0):
        user, number, size = struct.unpack_from("<2x16sHH", raw, at)
        if user.rstrip(b"\0") == SPEC and number == EXTRA:
            place = SIZES[h["format"]]
            for k in range(at + 54, at + 54 + size, 192):
                code, count, name = struct.unpack_from("<2xBB32s", raw, k)
                out |= {c: (place, kind) for c, (own, t, kind) in WIDE.items() if name.rstrip(b"\0") == own.encode() and code == t}
                # Types beyond 10 are two or three of the same (of old); bytes without a type are counted.
                place += EXTRA_BYTES[(code - 1) % 10] * ((code - 1) // 10 + 1) if code else count
        at += 54 + size
    return out


@lru_cache(64)
def header(path: str) -> dict:
    raw = read_bytes(path, 0, 375)
    if raw[:4] != b"LASF":
        raise ValueError(f"{path} is not a LAS file")
    size, offset = struct.unpack_from("<HI", raw, 94)
    code, length, count = struct.unpack_from("<BHI", raw, 104)
    packed = bool(code & 0x80) or path.lower().endswith(".laz")
    if raw[25] >= 4 and size >= 375:
        count = struct.unpack_from("<Q", raw, 247)[0] or count
    numbers = struct.unpack_from("<12d", raw, 131)
    # Records that a truncated file lacks are not there; a compressed file that is cut lacks its table, and fails.
    there = count if packed else (size_of(path) - offset) // length
    return {"packed": packed, "start": size, "records": struct.unpack_from("<I", raw, 100)[0], "version": (raw[24], raw[25]), "offset": offset, "format": code & 0x3F, "length": length, "count": min(count, there), "scale": numbers[:3], "shift": numbers[3:6], "max": numbers[6::2], "min": numbers[7::2]}


class LasReader(RecordReader):
    suffixes = (".las", ".laz")

    def count(self, path):
        return header(path)["count"]

    def span(self, path):
        """Whole chunks of a compressed file, whose points take longer to decode."""
        h = header(path)
        if not h["packed"]:
            return self.part
        chunk, _ = laz.described(path, h["start"], h["records"], h["offset"])
        if chunk in (0, laz.OWN_SIZES):
            return min(self.part, PACKED) if chunk else max(1, h["count"])
        return -(-min(self.part, PACKED) // chunk) * chunk

    def wanted(self, path):
        """By the extent in the header, where it has one; coordinates are narrowed to floats, so it counts a little wider."""
        h = header(path)
        near = super().wanted(path)
        for c, low, high in zip("xyz", h["min"], h["max"], strict=True):
            near = near and (not low < high or self.pushed.meets(c, *widened(low, high)))
        return near

    def decode(self, path, first, n):
        h = header(path)
        own = laz.read(path, h, first, n) if h["packed"] else read_bytes(path, h["offset"] + first * h["length"], n * h["length"])
        raw = np.frombuffer(own, np.uint8).reshape(-1, h["length"])
        at = lambda offset, kind: np.ascontiguousarray(raw[:, offset : offset + np.dtype(kind).itemsize]).view(kind).ravel()
        f, new = h["format"], h["format"] >= 6
        out = {c: (at(4 * k, "<i4") * h["scale"][k] + h["shift"][k]).astype(np.float32) for k, c in enumerate("xyz")}
        flags = raw[:, 14]
        out |= {"intensity": at(12, "<u2").astype(np.float32), "classification": raw[:, 16 if new else 15].astype(np.int16), "source_id": at(20 if new else 18, "<u2").astype(np.int32)}
        out |= {"return_number": (flags & (15 if new else 7)).astype(np.int16), "num_returns": (flags >> 4 if new else flags >> 3 & 7).astype(np.int16)}
        out |= {c: at(place, kind).astype(np.float32 if c == "intensity" else np.int32) for c, (place, kind) in extra(path).items()}
        if f in GPS:
            out["gps_time"] = at(GPS[f], "<f8")
        if f in RGB:
            out |= {c: np.minimum(255, at(RGB[f] + 2 * k, "<u2") // 256).astype(np.int16) for k, c in enumerate("rgb")}
        if f in NIR:
            out["nir"] = at(NIR[f], "<u2").astype(np.int32)
        return out


class LasSource(RecordSource):
    reader_class = LasReader

    @classmethod
    def name(cls):
        return "las"
