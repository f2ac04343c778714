"""LAZ: LAS whose records are compressed in chunks, each by a range coder with adaptive models that start anew.

Chunks know nothing of each other, and a table at the file's end tells their bytes, so that tasks decode ranges of a file apart.
Within a chunk each symbol depends on all before it; that walk is plain Python over integers, and a task holds the compressed
bytes of one chunk and the models, never its points. Reading and writing are one walk: a Decoder ignores the values that it is
offered, an Encoder writes them, and both return what the file holds.

Point formats 0 to 5, with extra bytes, chunked (of even or of own sizes) or not. Formats 6 to 10 are compressed in layers and
are refused.
"""

from __future__ import annotations

import struct
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

from .records import read_bytes, size_of

# Fixed values of the format: the coder's interval, item kinds, contexts of returns by number of returns and return number,
# codes of time steps, the record that describes the compression, and the chunk size that says that chunks have their own.
LEAST, MOST = 1 << 24, (1 << 32) - 1
BYTES, POINT, TIME, COLOUR, WAVE = 0, 6, 7, 8, 9
RETURNS = (
    (15, 14, 13, 12, 11, 10, 9, 8),
    (14, 0, 1, 3, 6, 10, 10, 9),
    (13, 1, 2, 4, 7, 11, 11, 10),
    (12, 3, 4, 5, 8, 12, 12, 11),
    (11, 6, 7, 8, 9, 13, 13, 12),
    (10, 10, 11, 12, 13, 14, 14, 13),
    (9, 10, 11, 12, 13, 14, 15, 14),
    (8, 9, 10, 11, 12, 13, 14, 15),
)
MULTI, MULTI_LEAST, SAME, FULL = 500, -10, 511, 512
USER, RECORD = b"laszip encoded", 22204
OWN_SIZES = MOST
#: Points in a chunk that is written here.
CHUNK = 50_000


class Model:
    """Frequencies of n symbols, scaled to 2^15 from time to time."""

    __slots__ = ("counts", "cycle", "last", "left", "low", "total")

    def __init__(self, n: int):
        self.counts, self.last, self.total, self.cycle = [1] * n, n - 1, 0, n
        self.update()
        self.left = self.cycle = n + 6 >> 1

    def update(self) -> None:
        self.total += self.cycle
        if self.total > 1 << 15:
            self.counts = [c + 1 >> 1 for c in self.counts]
            self.total = sum(self.counts)
        scale = (1 << 31) // self.total
        self.low = [scale * s >> 16 for s in accumulate(self.counts[:-1], initial=0)]
        self.left = self.cycle = min(5 * self.cycle >> 2, self.last + 7 << 3)

    def saw(self, symbol: int) -> None:
        self.counts[symbol] += 1
        self.left -= 1
        if not self.left:
            self.update()


class Bit:
    """Frequency of a zero, scaled to 2^13."""

    __slots__ = ("cycle", "left", "low", "total", "zeros")

    def __init__(self):
        self.zeros, self.total, self.low, self.cycle, self.left = 1, 2, 1 << 12, 4, 4

    def saw(self, bit: int) -> None:
        self.zeros += not bit
        self.left -= 1
        if self.left:
            return
        self.total += self.cycle
        if self.total > 1 << 13:
            self.total, self.zeros = self.total + 1 >> 1, self.zeros + 1 >> 1
            self.total += self.zeros == self.total
        self.low = self.zeros * ((1 << 31) // self.total) >> 18
        self.left = self.cycle = min(5 * self.cycle >> 2, 64)


class Decoder:
    writes = False

    def __init__(self, data: bytes, at: int = 0):
        # A chunk that ends too early runs out of these zeros and raises.
        self.data, self.at, self.length = data + bytes(8), at + 4, MOST
        self.value = int.from_bytes(self.data[at : at + 4], "big")

    def _cut(self, low: int, length: int) -> None:
        self.value -= low
        while length < LEAST:
            self.value = self.value << 8 | self.data[self.at]
            self.at += 1
            length <<= 8
        self.length = length

    def symbol(self, model: Model, _: int = 0) -> int:
        # What _cut and Model.saw do, in place: most of a file's time is spent here.
        value, length, low = self.value, self.length, model.low
        unit = length >> 15
        found = bisect_right(low, value // unit) - 1
        start = low[found] * unit
        value -= start
        length = (length if found == model.last else low[found + 1] * unit) - start
        while length < LEAST:
            value = value << 8 | self.data[self.at]
            self.at += 1
            length <<= 8
        self.value, self.length = value, length
        model.counts[found] += 1
        model.left -= 1
        if not model.left:
            model.update()
        return found

    def bit(self, model: Bit, _: int = 0) -> int:
        start = model.low * (self.length >> 13)
        found = int(self.value >= start)
        self._cut(start * found, self.length - start if found else start)
        model.saw(found)
        return found

    def even(self, bits: int, _: int = 0) -> int:
        unit = self.length >> bits
        found = self.value // unit
        self._cut(found * unit, unit)
        return found


class Encoder:
    writes = True

    def __init__(self):
        self.out, self.base, self.length = bytearray(), 0, MOST

    def _cut(self, low: int, length: int) -> None:
        self.base += low
        if self.base > MOST:
            self.base &= MOST
            at = len(self.out) - 1
            while self.out[at] == 255:
                self.out[at] = 0
                at -= 1
            self.out[at] += 1
        while length < LEAST:
            self.out.append(self.base >> 24)
            self.base = self.base << 8 & MOST
            length <<= 8
        self.length = length

    def symbol(self, model: Model, symbol: int) -> int:
        unit = self.length >> 15
        start = model.low[symbol] * unit
        self._cut(start, (self.length if symbol == model.last else model.low[symbol + 1] * unit) - start)
        model.counts[symbol] += 1
        model.left -= 1
        if not model.left:
            model.update()
        return symbol

    def bit(self, model: Bit, bit: int) -> int:
        start = model.low * (self.length >> 13)
        self._cut(start * bit, self.length - start if bit else start)
        model.saw(bit)
        return bit

    def even(self, bits: int, value: int) -> int:
        unit = self.length >> bits
        self._cut(value * unit, unit)
        return value

    def done(self) -> bytes:
        """What was written, with the zeros that a decoder reads ahead."""
        wide = self.length > 2 * LEAST
        self._cut(LEAST if wide else LEAST >> 1, LEAST >> 1 if wide else LEAST >> 9)
        return bytes(self.out) + bytes(3 if wide else 2)


def _bits(c, bits: int, value: int) -> int:
    """Even bits, the lower 16 first where there are more than 19."""
    if bits <= 19:
        return c.even(bits, value)
    low = c.even(16, value & 0xFFFF)
    return low | c.even(bits - 16, value >> 16) << 16


def _word(c, value: int = 0) -> int:
    return c.even(16, value & 0xFFFF) | c.even(16, value >> 16) << 16


def _signed(v: int, bits: int = 32) -> int:
    half = 1 << bits - 1
    return (v + half & (1 << bits) - 1) - half


class Integers:
    """Integers of 16 (unsigned) or 32 (signed) bits by their difference from a guess: its number of bits, by context, then the
    difference among those of so many bits, of which the upper eight are modelled."""

    def __init__(self, bits: int, contexts: int = 1):
        self.bits, self.k, self.single = bits, 0, Bit()
        self.sizes = [Model(bits + 1) for _ in range(contexts)]
        self.tops: list[Model | None] = [None] * (bits + 1)

    def code(self, c, guess: int, context: int = 0, value: int = 0) -> int:
        d = k = place = 0
        if c.writes:
            d = _signed(value - guess, self.bits)
            k = (d - 1 if d > 0 else -d).bit_length()
        self.k = k = c.symbol(self.sizes[context], k)
        if k == 0:
            d = c.bit(self.single, d)
        elif k < 32:
            top = self.tops[k]
            if top is None:
                top = self.tops[k] = Model(1 << min(k, 8))
            if c.writes:
                place = d - 1 if d > 0 else d + (1 << k) - 1
            if k <= 8:
                place = c.symbol(top, place)
            else:
                rest = k - 8
                place = c.symbol(top, place >> rest) << rest | _bits(c, rest, place & (1 << rest) - 1)
            d = place + 1 if place >> k - 1 else place + 1 - (1 << k)
        else:
            d = -(1 << 31)
        return _signed(guess + d) if self.bits == 32 else guess + d & 0xFFFF


def _models() -> defaultdict:
    return defaultdict(lambda: Model(256))


class _Median:
    """The middle of five values, of which a new one puts out the greatest or the least, in turn as they come."""

    __slots__ = ("greatest", "own")

    def __init__(self):
        self.own, self.greatest = [0] * 5, True

    def add(self, v: int) -> None:
        own, middle = self.own, self.own[2]
        if self.greatest:
            own.pop()
            self.greatest = v < middle
        else:
            own.pop(0)
            self.greatest = v <= middle
        insort(own, v)


class PointItem:
    """Coordinates, intensity, return flags, class, angle, user byte and source."""

    layout = "<iiiHBBBBH"

    def __init__(self, raw: bytes):
        self.last = struct.unpack(self.layout, raw)
        self.changes, self.flags, self.classes, self.users = Model(64), _models(), _models(), _models()
        self.angles = Model(256), Model(256)
        self.intensity, self.source = Integers(16, 4), Integers(16)
        self.dx, self.dy, self.z = Integers(32, 2), Integers(32, 22), Integers(32, 20)
        self.x_steps, self.y_steps = [_Median() for _ in range(16)], [_Median() for _ in range(16)]
        self.intensities, self.heights = [0] * 16, [0] * 8
        self.last = (*self.last[:3], 0, *self.last[4:])

    def code(self, c, raw: bytes) -> bytes:
        x, y, z, intensity, flags, kind, angle, user, source = last = self.last
        new, changed = last, 0
        if c.writes:
            new = struct.unpack(self.layout, raw)
            known = (*last[:3], self.intensities[RETURNS[new[4] >> 3 & 7][new[4] & 7]], *last[4:])
            differs = [a != b for a, b in zip(new, known, strict=True)]
            changed = sum(differs[k] << bit for k, bit in ((4, 5), (3, 4), (5, 3), (6, 2), (7, 1), (8, 0)))
        changed = c.symbol(self.changes, changed)
        if changed & 32:
            flags = c.symbol(self.flags[flags], new[4])
        count, number = flags >> 3 & 7, flags & 7
        own, level, single = RETURNS[count][number], abs(count - number), int(count == 1)
        if changed:
            if changed & 16:
                self.intensities[own] = self.intensity.code(c, self.intensities[own], min(own, 3), new[3])
            intensity = self.intensities[own]
            if changed & 8:
                kind = c.symbol(self.classes[kind], new[5])
            if changed & 4:
                angle = angle + c.symbol(self.angles[flags >> 6 & 1], new[6] - angle & 255) & 255
            if changed & 2:
                user = c.symbol(self.users[user], new[7])
            if changed & 1:
                source = self.source.code(c, source, 0, new[8])
        steps = self.x_steps[own]
        step = self.dx.code(c, steps.own[2], single, new[0] - x)
        steps.add(step)
        x = _signed(x + step)
        steps = self.y_steps[own]
        step = self.dy.code(c, steps.own[2], single + (self.dx.k & ~1 if self.dx.k < 20 else 20), new[1] - y)
        steps.add(step)
        y = _signed(y + step)
        k = self.dx.k + self.dy.k >> 1
        z = self.heights[level] = self.z.code(c, self.heights[level], single + (k & ~1 if k < 18 else 18), new[2])
        self.last = x, y, z, intensity, flags, kind, angle, user, source
        return struct.pack(self.layout, *self.last)


class TimeItem:
    """GPS times as 64-bit integers, in up to four sequences, each by multiples of its step."""

    def __init__(self, raw: bytes):
        self.at, self.newest = 0, 0
        self.last, self.step, self.odd = [int.from_bytes(raw, "little"), 0, 0, 0], [0] * 4, [0] * 4
        self.multi, self.first, self.integers = Model(516), Model(6), Integers(32, 9)

    def _choice(self, value: int) -> int:
        """How a writer puts a time: the code of a multiple, SAME, FULL, or FULL plus the number of sequences to go on."""
        near = [_signed(value - self.last[self.at + i & 3], 64) for i in range(4)]
        short = [-(1 << 31) <= d < 1 << 31 for d in near]
        if near[0] == 0:
            return SAME
        if not short[0]:
            return FULL + next((i for i in (1, 2, 3) if short[i]), 0)
        if not self.step[self.at]:
            return 1
        ratio = round(near[0] / self.step[self.at])
        return min(ratio, MULTI) if ratio >= 0 else MULTI - max(ratio, MULTI_LEAST)

    def code(self, c, raw: bytes) -> bytes:
        value = int.from_bytes(raw, "little") if c.writes else 0
        while True:
            at, code = self.at, self._choice(value) if c.writes else SAME
            if self.step[at]:
                code = c.symbol(self.multi, code)
            else:
                # The same choices in fewer codes: nothing, a step, in full, another sequence.
                short = c.symbol(self.first, 0 if code == SAME else 1 if code == 1 else code - FULL + 2)
                code = SAME if short == 0 else 1 if short == 1 else short - 2 + FULL
            if code <= FULL:
                break
            self.at = at + code - FULL & 3
        if code == FULL:
            high = self.integers.code(c, _signed(self.last[at] >> 32), 8, _signed(value >> 32))
            self.at = self.newest = at = self.newest + 1 & 3
            self.last[at] = (high & MOST) << 32 | _word(c, value & MOST)
            self.step[at] = self.odd[at] = 0
        elif code != SAME:
            d = value - self.last[at]
            if not self.step[at]:
                d = self.step[at] = self.integers.code(c, 0, 0, d)
                self.odd[at] = 0
            elif code == 1:
                d = self.integers.code(c, self.step[at], 1, d)
                self.odd[at] = 0
            else:
                ratio = code if code <= MULTI else MULTI - code
                context = 7 if ratio == 0 else 2 if 0 < ratio < 10 else 3 if 0 < ratio < MULTI else 4 if ratio == MULTI else 5 if ratio > MULTI_LEAST else 6
                d = self.integers.code(c, ratio * self.step[at], context, d)
                if context in (4, 6, 7):
                    self.odd[at] += 1
                    if self.odd[at] > 3:
                        self.step[at], self.odd[at] = d, 0
            self.last[at] = self.last[at] + d & (1 << 64) - 1
        return self.last[self.at].to_bytes(8, "little")


def _half(v: int) -> int:
    return -(-v >> 1) if v < 0 else v >> 1


class ColourItem:
    """Red by its bytes' differences; green and blue by what red, and green, changed by, where a point is not grey."""

    layout = "<6B"

    def __init__(self, raw: bytes):
        self.last = struct.unpack(self.layout, raw)
        self.used, self.models = Model(128), [Model(256) for _ in range(6)]

    def code(self, c, raw: bytes) -> bytes:
        last, new, used = self.last, self.last, 0
        if c.writes:
            new = struct.unpack(self.layout, raw)
            used = sum((new[k] != last[k]) << k for k in range(6)) | (new[:2] != new[2:4] or new[:2] != new[4:]) << 6
        used = c.symbol(self.used, used)
        out = list(last)

        def byte(k: int, change: int) -> None:
            if used >> k & 1:
                guess = min(255, max(0, last[k] + change))
                out[k] = guess + c.symbol(self.models[k], new[k] - guess & 255) & 255

        byte(0, 0)
        byte(1, 0)
        if used & 64:
            for k in (0, 1):
                red = out[k] - last[k]
                byte(k + 2, red)
                byte(k + 4, _half(red + out[k + 2] - last[k + 2]))
        else:
            out[2:] = out[:2] * 2
        self.last = tuple(out)
        return bytes(out)


class WaveItem:
    """The waveform packet: descriptor, place in the file, bytes, place of the return, direction."""

    layout = "<BQI4i"

    def __init__(self, raw: bytes):
        self.last = struct.unpack(self.layout, raw)
        self.index, self.kinds, self.kind, self.step = Model(256), [Model(4) for _ in range(4)], 0, 0
        self.steps, self.size, self.back, self.xyz = Integers(32), Integers(32), Integers(32), Integers(32, 3)

    def code(self, c, raw: bytes) -> bytes:
        last = self.last
        new = struct.unpack(self.layout, raw) if c.writes else last
        d = new[1] - last[1]
        kind = 0 if d == 0 else 1 if d == last[2] else 2 if -(1 << 31) <= d < 1 << 31 else 3
        index = c.symbol(self.index, new[0])
        self.kind = kind = c.symbol(self.kinds[self.kind], kind)
        if kind == 2:
            self.step = self.steps.code(c, self.step, 0, d)
        place = _word(c, new[1] & MOST) | _word(c, new[1] >> 32) << 32 if kind == 3 else last[1] + (0, last[2], self.step)[kind] & (1 << 64) - 1
        size = self.size.code(c, _signed(last[2]), 0, _signed(new[2])) & MOST
        back = self.back.code(c, last[3], 0, new[3])
        self.last = index, place, size, back, *(self.xyz.code(c, last[4 + k], k, new[4 + k]) for k in range(3))
        return struct.pack(self.layout, *self.last)


class BytesItem:
    """Extra bytes, each by its difference from the last point's."""

    def __init__(self, raw: bytes):
        self.last, self.models = raw, [Model(256) for _ in raw]

    def code(self, c, raw: bytes) -> bytes:
        new = raw if c.writes else self.last
        self.last = bytes(a + c.symbol(m, b - a & 255) & 255 for a, b, m in zip(self.last, new, self.models, strict=True))
        return self.last


ITEMS = {POINT: (PointItem, 2), TIME: (TimeItem, 2), COLOUR: (ColourItem, 2), WAVE: (WaveItem, 1), BYTES: (BytesItem, 2)}
SIZES = {POINT: 20, TIME: 8, COLOUR: 6, WAVE: 29}
#: What the point formats consist of.
FORMATS = ((POINT,), (POINT, TIME), (POINT, COLOUR), (POINT, TIME, COLOUR), (POINT, TIME, WAVE), (POINT, TIME, COLOUR, WAVE))


def _started(kinds: tuple, first: bytes) -> list:
    """(item, its start, its end) of a record, begun with the chunk's first."""
    out, at = [], 0
    for kind, size in kinds:
        out.append((ITEMS[kind][0](first[at : at + size]), at, at + size))
        at += size
    return out


class Chunk:
    """The records of a chunk, read in order."""

    def __init__(self, data: bytes, kinds: tuple, count: int):
        length = sum(size for _, size in kinds)
        self.first, self.count, self.at = data[:length], count, 0
        if len(self.first) < length:
            raise ValueError("a compressed chunk is cut")
        self.coder, self.items = Decoder(data, length), _started(kinds, self.first)

    def take(self, n: int) -> Iterator[bytes]:
        for _ in range(n):
            try:
                yield self.first if self.at == 0 else b"".join([item.code(self.coder, b"") for item, _, _ in self.items])
            except IndexError:
                raise ValueError("a compressed chunk is cut") from None
            self.at += 1


@lru_cache(64)
def described(path: str, start: int, records: int, first: int) -> tuple[int, tuple]:
    """Points in a chunk (0: one chunk for all), and the kinds and sizes of items, from the records between header and points."""
    raw, at = read_bytes(path, start, first - start), 0
    for _ in range(records):
        size = struct.unpack_from("<H", raw, at + 20)[0]
        if raw[at + 2 : at + 18].rstrip(b"\0") == USER and struct.unpack_from("<H", raw, at + 18)[0] == RECORD:
            how, coder = struct.unpack_from("<HH", raw, at + 54)
            chunk, items = struct.unpack_from("<I", raw, at + 66)[0], struct.unpack_from("<H", raw, at + 86)[0]
            own = [struct.unpack_from("<HHH", raw, at + 88 + 6 * k) for k in range(items)]
            if how == 3 or coder or any(kind not in ITEMS or version != ITEMS[kind][1] for kind, _, version in own):
                raise ValueError(f"{path} is compressed in a way that is not read here (point formats 6 to 10, or an early version): {how}, {own}")
            return chunk if how == 2 else 0, tuple((kind, n) for kind, n, _ in own)
        at += 54 + size
    raise ValueError(f"{path} is marked or named as compressed (LAZ), but no record says how")


def _codes(c, own_sizes: bool, counts: list[int], sizes: list[int], n: int) -> tuple[list[int], list[int]]:
    """The chunk table's points and bytes; what a reader offers are zeros."""
    integers, points, size, some, out = Integers(32, 2), 0, 0, [], []
    for k in range(n):
        if own_sizes:
            points = integers.code(c, points, 0, counts[k] if c.writes else 0)
            some.append(points)
        size = integers.code(c, size, 1, sizes[k] if c.writes else 0)
        out.append(size)
    return some, out


@lru_cache(64)
def table(path: str, first: int, chunk: int, count: int) -> list[tuple[int, int, int, int]]:
    """(first point, points, place, bytes) of each chunk."""
    end = size_of(path)
    if not chunk:
        return [(0, count, first, end - first)] if count else []
    at = struct.unpack("<q", read_bytes(path, first, 8))[0]
    # A writer that could not go back left the table's place at the end.
    at, stop = (at, end) if at >= 0 else (struct.unpack("<q", read_bytes(path, end - 8, 8))[0], end - 8)
    if not first < at <= end - 8:
        raise ValueError(f"{path}: the table of compressed chunks is missing; the file is cut")
    raw = read_bytes(path, at, stop - at)
    n = struct.unpack_from("<I", raw, 4)[0]
    counts, sizes = _codes(Decoder(raw, 8), chunk == OWN_SIZES, [], [], n) if n else ([], [])
    counts = counts or [min(chunk, count - chunk * k) for k in range(n)]
    starts = accumulate(counts[:-1], initial=0)
    places = accumulate(sizes[:-1], initial=first + 8)
    return list(zip(starts, counts, places, sizes, strict=False))


@lru_cache(2)
def _open(path: str, place: int, size: int, kinds: tuple, count: int) -> Chunk:
    return Chunk(read_bytes(path, place, size), kinds, count)


def read(path: str, h: dict, first: int, n: int) -> bytes:
    """Records first to first + n, as LAS has them. Going on where a read ended decodes nothing twice."""
    chunk, kinds = described(path, h["start"], h["records"], h["offset"])
    out, chunks = [], table(path, h["offset"], chunk, h["count"])
    for start, count, place, size in chunks[max(0, bisect_right([c[0] for c in chunks], first) - 1) :]:
        if start >= first + n:
            break
        skip, stop = max(0, first - start), min(count, first + n - start)
        if _open(path, place, size, kinds, count).at > skip:
            _open.cache_clear()
        own = _open(path, place, size, kinds, count)
        for _ in own.take(skip - own.at):
            pass
        out += own.take(stop - own.at)
    return b"".join(out)


def compress(las: bytes, chunk: int | list[int] = CHUNK) -> bytes:
    """A LAS file, compressed in chunks of so many points, or of the points listed. Records before its points stay."""
    (offset, records), (code, length, count) = struct.unpack_from("<II", las, 96), struct.unpack_from("<BHI", las, 104)
    if code >= len(FORMATS):
        raise ValueError("only point formats 0 to 5 are compressed here")
    kinds = tuple((kind, SIZES[kind]) for kind in FORMATS[code])
    more = length - sum(size for _, size in kinds)
    kinds += ((BYTES, more),) if more else ()
    counts = chunk if isinstance(chunk, list) else [min(chunk, count - at) for at in range(0, count, chunk)]
    body, sizes, at = bytearray(), [], offset
    for n in counts:
        first, c = las[at : at + length], Encoder()
        items = _started(kinds, first)
        for k in range(at + length, at + n * length, length):
            for item, a, b in items:
                item.code(c, las[k + a : k + b])
        own = first + c.done()
        sizes.append(len(own))
        body += own
        at += n * length
    c = Encoder()
    _codes(c, isinstance(chunk, list), counts, sizes, len(counts))
    how = struct.pack("<HHBBHIIqqH", 2, 0, 2, 2, 0, 0, OWN_SIZES if isinstance(chunk, list) else chunk, -1, -1, len(kinds))
    how += b"".join(struct.pack("<HHH", kind, size, ITEMS[kind][1]) for kind, size in kinds)
    record = struct.pack("<H16sHH32s", 0, USER, RECORD, len(how), b"") + how
    head = bytearray(las[:offset])
    struct.pack_into("<II", head, 96, offset + len(record), records + 1)
    head[104] = code | 0x80
    points = offset + len(record)
    return bytes(head) + record + struct.pack("<q", points + 8 + len(body)) + bytes(body) + struct.pack("<II", 0, len(counts)) + c.done()
