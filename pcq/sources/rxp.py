"""RXP by its record layout: after a header of 1024 bytes (none in a smaller file) records of three doubles and an
intensity; with 29 bytes a record also colour. The stride is the one that divides the data and gives finite points."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .records import RecordReader, RecordSource, read_bytes, size_of

# The header, and strides in the order in which they are tried.
HEADER, STRIDES = 1024, (26, 29, 28, 32, 36, 40)
#: The end of the header of a file whose intensities are floats (28 bytes a record): what this library writes if 16 bits are too few.
WIDE = b"intensity=float4"


@lru_cache(64)
def wide(path: str) -> bool:
    return size_of(path) >= HEADER and read_bytes(path, HEADER - len(WIDE), len(WIDE)) == WIDE


@lru_cache(64)
def layout(path: str) -> tuple[int, int, int]:
    """Start, stride and count."""
    size = size_of(path)
    start = HEADER if size >= HEADER else 0
    if wide(path):
        return start, 28, (size - start) // 28
    best = None
    for stride in STRIDES:
        n = (size - start) // stride
        if not n:
            continue
        sample = np.frombuffer(read_bytes(path, start, min(n, 64) * stride), np.uint8).reshape(-1, stride)
        xyz = np.ascontiguousarray(sample[:, :24]).view("<f8")
        sane = np.isfinite(xyz).all() and (np.abs(xyz) < 1e9).all() and not ((np.abs(xyz) > 0) & (np.abs(xyz) < 1e-30)).any()
        rank = (bool(sane), (size - start) % stride == 0)
        if best is None or rank > best[0]:
            best = (rank, (start, stride, n))
    if best is None or not best[0][0]:
        raise ValueError(f"{path}: no record layout fits")
    return best[1]


class RxpReader(RecordReader):
    suffixes = (".rxp",)

    def count(self, path):
        return layout(path)[2]

    def decode(self, path, first, n):
        start, stride, _ = layout(path)
        raw = np.frombuffer(read_bytes(path, start + first * stride, n * stride), np.uint8).reshape(-1, stride)
        xyz = np.ascontiguousarray(raw[:, :24]).view("<f8")
        out = {c: xyz[:, k].astype(np.float32) for k, c in enumerate("xyz")}
        end, kind = (28, "<f4") if wide(path) else (26, "<u2")
        out["intensity"] = np.ascontiguousarray(raw[:, 24:end]).view(kind).ravel().astype(np.float32)
        if stride == 29:
            out |= {c: raw[:, 26 + k].astype(np.int16) for k, c in enumerate("rgb")}
        return out


class RxpSource(RecordSource):
    reader_class = RxpReader

    @classmethod
    def name(cls):
        return "rxp"
