"""An adaptive context-mixing range coder for token ids, run over the many independent blocks of a shard at once.

Each block starts from the same model and is coded on its own; numpy carries one block in each lane, so a step codes one
id of every block. Two tables per block, empty at its start, predict the next id from the last one and the last two, each
with a confidence. The mixture gives order 2, order 1 and order 0 their shares of the range, adapted to who was right
before under the same two confidences. Where order 0 has to speak, it is one of TABLES distributions of whole ids which the
shard's header holds (found by clustering the shard's stretches, so about one for each language); every block moves on
to the one that fits its latest ids best.

State fits exactly into doubles: a window of 48 bits, words of 16 bits, so one division a decision is a vector operation.
A carry out of the window stays in the word that it belongs to until the words of a block are written.

Header: zlib of u32 ids, u32 tables, the ids (u16) by falling frequency, the tables' shares (u32). Block: u32 number of
ids, u32 CRC-32 of the ids as u16, then the code words as u16. All little endian.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Most ids in a block, and most blocks in a shard (about 15 KB of model each).
BLOCK, LANES = 8192, 512
TABLES, SEGMENT, ROUNDS = 4, 512, 6
_S1, _S2 = 10, 12  # bits of the two prediction tables
_ONE, _RATE = 1 << 15, 5  # what the shares of the mixture add up to, and how fast they move
#: Steps after which a block chooses its order-0 table anew, by scores that lose a quarter each time.
_CHOICE = 16
#: Where the mixture moves when order 2, order 1 or order 0 was right; each keeps a share.
_GOAL2, _GOAL1 = np.array([_ONE - 128, 64, 64]), np.array([64, _ONE - 128, 64])
_TOP, _BOT, _WORD = 2.0**48, 2.0**32, 65536.0


class Tables:
    """Order 0: ids by falling frequency (their places are what is coded), and TABLES distributions of them."""

    def __init__(self, ids: np.ndarray, shares: np.ndarray):
        self.ids, self.shares = ids, shares
        n = len(ids)
        self.total = 1 << (16 if n <= 1 << 13 else 18)
        self.cum = (np.cumsum(shares, axis=1) - shares).astype(np.float64).ravel()
        self.freq = shares.astype(np.float64).ravel()
        self.slot = np.concatenate([np.repeat(np.arange(n, dtype=np.int64), s) for s in shares]) if n else np.zeros(0, np.int64)
        self.value = np.round(16 * np.log2(np.maximum(shares, 1))).astype(np.int64).T.copy()

    @classmethod
    def of(cls, ids: np.ndarray) -> Tables:
        """Cluster stretches of a shard's ids by likelihood, and count each cluster."""
        count = np.bincount(ids, minlength=1)
        known = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
        place = np.zeros(len(count), np.int32)
        place[known] = np.arange(len(known))
        x, n = place[ids], len(known)
        total = 1 << (16 if n <= 1 << 13 else 18)
        segment = np.repeat(np.arange(-(-len(x) // SEGMENT), dtype=np.int32), SEGMENT)[: len(x)]
        wide = min(n, 512)
        top = x < wide
        seen = np.bincount(segment[top] * wide + x[top], minlength=(int(segment[-1]) + 1) * wide).reshape(-1, wide).astype(np.float32)
        size = np.maximum(1.0, seen.sum(1, keepdims=True))
        fit = lambda rows: np.log((seen[rows].sum(0) + 0.5) / (seen[rows].sum() + 0.5 * wide))
        logs = [fit(slice(None))]
        for _ in range(1, TABLES):
            # The stretch that is told worst so far starts the next cluster.
            logs.append(fit([int(((seen @ np.array(logs).T) / size).max(1).argmin())]))
        for _ in range(ROUNDS):
            own = (seen @ np.array(logs).T).argmax(1)
            logs = [fit(own == k) for k in range(TABLES)]
        own = (seen @ np.array(logs).T).argmax(1)
        del top, seen
        counts = np.array([np.bincount(x[own[segment] == k], minlength=n) for k in range(TABLES)])
        shares = 1 + counts * (total - n) // np.maximum(1, counts.sum(1, keepdims=True))
        shares[:, 0] += total - shares.sum(1)
        return cls(known.astype(np.uint16), shares)

    def pack(self) -> bytes:
        return zlib.compress(struct.pack("<II", len(self.ids), len(self.shares)) + self.ids.astype("<u2").tobytes() + self.shares.astype("<u4").tobytes(), 6)

    @classmethod
    def unpack(cls, raw: bytes) -> Tables:
        raw = zlib.decompress(raw)
        n, tables = struct.unpack_from("<II", raw)
        return cls(np.frombuffer(raw, "<u2", n, 8), np.frombuffer(raw, "<u4", n * tables, 8 + 2 * n).astype(np.int64).reshape(tables, n))


class _Model:
    """What all blocks of a shard know; entries of the prediction tables are place * 4 + confidence."""

    def __init__(self, lanes: int, tables: Tables):
        self.base1, self.base2, self.base = np.arange(lanes) << _S1, np.arange(lanes) << _S2, np.arange(lanes) << 5
        kind = np.uint16 if len(tables.ids) <= 1 << 14 else np.uint32
        self.t1, self.t2 = np.zeros(lanes << _S1, kind), np.zeros(lanes << _S2, kind)
        m = np.arange(32)
        first = np.stack([1 + 8 * (m >> 3), 1 + 4 * (m >> 1 & 3), np.full(32, 12)])
        self.w2, self.w1 = (np.tile(w, lanes) for w in (first[:2] * (_ONE - 128) // first.sum(0) + 64))
        self.last, self.prev = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.score = np.zeros((lanes, len(tables.shares)), np.int64)
        self.table = np.zeros(lanes, np.int64)

    def predict(self, n: int) -> None:
        last = self.last[:n] * 40503
        self.at1 = ((last >> 4) & ((1 << _S1) - 1)) + self.base1[:n]
        self.at2 = (((last + self.prev[:n] * 30011) >> 3) & ((1 << _S2) - 1)) + self.base2[:n]
        e1, e2 = self.t1[self.at1].astype(np.int64), self.t2[self.at2].astype(np.int64)
        self.e1, self.e2, self.p1, self.p2, self.c1, self.c2 = e1, e2, e1 >> 2, e2 >> 2, e1 & 3, e2 & 3
        self.m = self.c2 * 8 + self.c1 * 2 + (self.p1 == self.p2) + self.base[:n]
        self.f2, self.f1 = self.w2[self.m], self.w1[self.m]

    def learn(self, n: int, x: np.ndarray, who: np.ndarray) -> None:
        self.w2[self.m] = self.f2 + ((_GOAL2[who] - self.f2) >> _RATE)
        self.w1[self.m] = self.f1 + ((_GOAL1[who] - self.f1) >> _RATE)
        new = x * 4 + 1
        # Right: surer. Wrong: an entry of some confidence loses it, any other is replaced.
        self.t1[self.at1] = np.where(self.p1 == x, self.e1 + (self.c1 < 3), np.where(self.c1 > 1, self.p1 * 4 + 1, new))
        self.t2[self.at2] = np.where(self.p2 == x, self.e2 + (self.c2 < 3), np.where(self.c2 > 1, self.p2 * 4 + 1, new))
        self.prev[:n] = self.last[:n]
        self.last[:n] = x

    def choose(self, tables: Tables, recent: np.ndarray) -> None:
        """recent[step, lane]: the ids since the last choice."""
        n = recent.shape[1]
        own = self.score[:n]
        own -= own >> 2
        own += tables.value[recent].sum(0)
        self.table[:n] = own.argmax(1) * len(tables.ids)


class _Encoder:
    def __init__(self, lengths: np.ndarray):
        self.low, self.range = np.zeros(len(lengths)), np.full(len(lengths), _TOP)
        self.width = int(lengths.max(initial=0)) // 2 + 1024
        self.words, self.at = np.zeros((len(lengths), self.width), np.uint32), np.zeros(len(lengths), np.int64)

    def room(self, steps: int) -> None:
        """Make room for so many ids more: at most three words each, and what finish() adds."""
        need = int(self.at.max(initial=0)) + 3 * steps + 4
        if need > self.width:
            wider = np.zeros((len(self.words), max(need, self.width * 3 // 2)), np.uint32)
            wider[:, : self.width] = self.words
            self.words, self.width = wider, wider.shape[1]

    def _emit(self, own: np.ndarray) -> None:
        word = np.floor(self.low[own] / _BOT)
        self.words.reshape(-1)[own * self.width + self.at[own]] = word
        self.at[own] += 1
        self.low[own] = (self.low[own] - word * _BOT) * _WORD

    def code(self, n: int, cum, freq, total: int) -> None:
        r = np.floor(self.range[:n] * (1.0 / total))
        self.low[:n] += r * cum
        self.range[:n] = r * freq

    def settle(self, n: int) -> None:
        own = np.flatnonzero(self.range[:n] < _BOT)
        while len(own):
            self._emit(own)
            self.range[own] *= _WORD
            own = own[self.range[own] < _BOT]

    def finish(self) -> list[bytes]:
        own = np.arange(len(self.low))
        for _ in range(3):
            self._emit(own)
        carry = np.zeros(len(own), np.uint32)
        for k in range(int(self.at.max(initial=0)) - 1, -1, -1):
            word = self.words[:, k] + carry
            carry = word >> np.uint32(16)
            self.words[:, k] = word
        low = self.words.astype("<u2")
        return [low[i, : self.at[i]].tobytes() for i in own]


class _Decoder:
    def __init__(self, words: np.ndarray, at: np.ndarray):
        self.words, self.at, self.range = words, at + 3, np.full(len(at), _TOP)
        self.code_ = words[at] * _BOT + words[at + 1] * _WORD + words[at + 2]

    def peek(self, n: int, total: int) -> np.ndarray:
        self.r = np.floor(self.range[:n] * (1.0 / total))
        return np.minimum(np.floor(self.code_[:n] / self.r), total - 1)

    def code(self, n: int, cum, freq) -> None:
        # A sound block's value always lies below the range; a damaged one is kept there.
        self.range[:n] = self.r * freq
        self.code_[:n] = np.minimum(self.code_[:n] - self.r * cum, self.range[:n] - 1)

    def settle(self, n: int) -> None:
        own = np.flatnonzero(self.range[:n] < _BOT)
        while len(own):
            self.code_[own] = self.code_[own] * _WORD + self.words[self.at[own]]
            self.at[own] += 1
            self.range[own] *= _WORD
            own = own[self.range[own] < _BOT]


def _live(lengths: np.ndarray) -> np.ndarray:
    """How many lanes (sorted by falling length) still have an id, by step."""
    steps = int(lengths.max(initial=0))
    return len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps), side="right")


def encode(ids: np.ndarray) -> tuple[bytes, list[bytes]]:
    """A shard's ids (u16, at most BLOCK * LANES) as a header and blocks of BLOCK ids."""
    if not len(ids):
        return b"", []
    tables = Tables.of(ids)
    starts = np.arange(0, len(ids), BLOCK)
    lengths = np.minimum(BLOCK, len(ids) - starts)
    place = np.zeros(1 << 16, np.int32)
    place[tables.ids] = np.arange(len(tables.ids))
    x = np.zeros(len(starts) * BLOCK, np.int32)
    x[: len(ids)] = place[ids]
    # Only the last block is shorter than others, so lanes are sorted by length as they stand.
    x = np.ascontiguousarray(x.reshape(len(starts), BLOCK)[:, : int(lengths.max())].T)
    model, coder, total = _Model(len(starts), tables), _Encoder(lengths), float(tables.total)
    for step, n in enumerate(_live(lengths).tolist()):
        now = x[step, :n].astype(np.int64)
        if step % _CHOICE == 0:
            coder.room(_CHOICE)
            if step:
                model.choose(tables, x[step - _CHOICE : step, :n])
        model.predict(n)
        second, first = model.p2 == now, model.p1 == now
        who = np.where(second, 0, 2 - first)
        f2, f1 = model.f2, model.f1
        coder.code(n, np.where(second, 0, np.where(first, f2, f2 + f1)), np.where(second, f2, np.where(first, f1, _ONE - f2 - f1)), _ONE)
        rest, at = who == 2, model.table[:n] + now
        coder.code(n, tables.cum[at] * rest, np.where(rest, tables.freq[at], total), tables.total)
        coder.settle(n)
        model.learn(n, now, who)
    out = []
    for at, n, body in zip(starts.tolist(), lengths.tolist(), coder.finish(), strict=True):
        out.append(struct.pack("<II", n, zlib.crc32(np.ascontiguousarray(ids[at : at + n], "<u2").tobytes())) + body)
    return tables.pack(), out


def decode(header: bytes, blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each of a shard's blocks; a block whose ids don't match their checksum raises ValueError."""
    if not blocks:
        return []
    tables = Tables.unpack(header)
    heads = [struct.unpack_from("<II", b) for b in blocks]
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][0])
    lengths = np.array([heads[i][0] for i in order])
    # Padding: a damaged block may read on (at most three words an id), and is then refused by its checksum.
    bodies = [blocks[i][8 : len(blocks[i]) // 2 * 2] for i in order]
    starts = np.cumsum([0, *(len(b) // 2 for b in bodies[:-1])])
    words = np.frombuffer(b"".join(bodies) + b"\0" * (16 + 6 * int(lengths.max())), "<u2").astype(np.float64)
    model, coder, n_ids = _Model(len(order), tables), _Decoder(words, starts), len(tables.ids)
    x = np.zeros((int(lengths.max()), len(order)), np.int32)
    slots, total = tables.slot, float(tables.total)
    for step, n in enumerate(_live(lengths).tolist()):
        if step and step % _CHOICE == 0:
            model.choose(tables, x[step - _CHOICE : step, :n])
        model.predict(n)
        f2, f1 = model.f2, model.f1
        both = f2 + f1
        v = coder.peek(n, _ONE)
        second, rest = v < f2, v >= both
        who = np.where(second, 0, 1 + rest)
        coder.code(n, np.where(second, 0, np.where(rest, both, f2)), np.where(second, f2, np.where(rest, _ONE - both, f1)))
        table = model.table[:n]
        slot = coder.peek(n, tables.total).astype(np.int64)
        zero = slots[slot + table // n_ids * tables.total]
        at = table + zero
        coder.code(n, tables.cum[at] * rest, np.where(rest, tables.freq[at], total))
        now = np.where(second, model.p2, np.where(rest, zero, model.p1))
        x[step, :n] = now
        coder.settle(n)
        model.learn(n, now, who)
    out: list[np.ndarray] = [np.empty(0, np.uint16)] * len(blocks)
    ids = tables.ids[x]
    for k, i in enumerate(order):
        out[i] = np.ascontiguousarray(ids[: lengths[k], k], "<u2")
        if zlib.crc32(out[i].tobytes()) != heads[i][1]:
            raise ValueError("a block does not match its checksum")
    return out
