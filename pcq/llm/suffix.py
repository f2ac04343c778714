"""Repeated byte strings by suffix arrays, sorted by external induction (see induced).

Which strings of `length` bytes also start earlier? Every such string is known by an anchor: the least hash among its
32-byte pieces, so equal strings have equal anchors. A run of strings that share one anchor in a text is a piece.

Texts are kept as chunks of several megabytes, and chunks talk to shards in packed messages, each step recomputing the
pieces of a chunk, which is cheap, instead of storing them:

1. chunks send their anchors to shards by hash, which answer which anchors occur more than once;
2. pieces of such anchors are told by a digest and a place: later copies of a piece are covered whole, and a first copy
   matters only if its anchor has other pieces too;
3. these few pieces go as text to shards by anchor, which sort their suffixes with common prefixes; strings that share
   `length` bytes stand next to each other, and all but the first of them are covered;
4. chunks put the answers together.

An anchor of very many different pieces (the edges of a line that many texts share) is too much for one shard. Its strings
become rows, grouped one by one by a digest, so that no task holds them all.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions, shared_dir, slim
from .induced import suffixes

LENGTH, ANCHOR = 100, 32
#: Bytes of text in a chunk, about (a longer text is a chunk of its own), and positions handled at a time.
CHUNK, SEGMENT = 4 << 20, 1 << 17
#: Bytes of text for each shard of anchors, and bytes of pieces in a shard that is sorted, about.
ANCHOR_BYTES, SHARD_BYTES = 64 << 20, 6_000_000
#: An anchor is crowded if its different pieces have more bytes than this.
CROWDED_BYTES = 500_000
_A, _B = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = np.uint64((1 << 21) - 1)
_LAST = (1 << 63) - 1


def pack(**arrays) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def unpack(raw: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(raw))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))), dtype=np.uint64)


#: Powers of a number and of its inverse modulo 2^64, so that sums over prefixes give the hash of any piece.
_POWER, _INVERSE = _powers(_A, SEGMENT + 4096), _powers(pow(_A, -1, 1 << 64), SEGMENT + 4096)


def _pieces(b: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, start, size and digest (u64) of each piece of the texts that b holds one behind another, up to `ends`."""
    width = length - ANCHOR + 1
    found = []
    # Starts of strings that lie within one text.
    for at in range(0, max(0, len(b) - length + 1), SEGMENT):
        part = b[at : at + SEGMENT + length - 1]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWER[: len(part)], dtype=np.uint64)))
        h = (sums[ANCHOR:] - sums[:-ANCHOR]) * _INVERSE[: len(part) - ANCHOR + 1]
        h = (h ^ (h >> np.uint64(29))) * _B
        h ^= h >> np.uint64(32)
        # The place in the low bits makes the leftmost of equals the least.
        v = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        low, have = v, 1
        while have * 2 <= width:
            low = np.minimum(low[: len(low) - have], low[have:])
            have *= 2
        n = len(v) - width + 1
        low = np.minimum(low[:n], low[width - have : width - have + n])
        place = (low & _PLACE).astype(np.int64)
        # A string is valid if no text ends within it, so runs end where texts do.
        close = ends[np.searchsorted(ends, at, side="right") : np.searchsorted(ends, at + n + length, side="left")] - at
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, np.clip(close - length + 1, 0, n), 1)
        np.add.at(mark, np.clip(close, 0, n), -1)
        valid = np.cumsum(mark[:n]) == 0
        new = place[1:] != place[:-1]
        new |= valid[1:] != valid[:-1]
        new[close[(close > 0) & (close < n)] - 1] = True
        cut = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(new) + 1))
        run = np.diff(np.append(cut, n))
        cut, run = cut[valid[cut]], run[valid[cut]]
        size = run + length - 1
        digest = (sums[cut + size] - sums[cut]) * _INVERSE[cut]
        found.append((h[place[cut]], at + cut, size, (digest ^ (digest >> np.uint64(31))) * _B))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    task, k, size = TaskContext.get().partitionId(), 0, 0
    ids: list = []
    texts: list[bytes] = []

    def row() -> pd.DataFrame:
        null = np.array([x is None for x in ids])
        body = pack(ids=np.array([0 if x is None else x for x in ids], np.int64), null=null, ends=np.cumsum([len(t) for t in texts], dtype=np.int64), body=b"".join(texts))
        return pd.DataFrame({"chunk": [task << 32 | k], "bytes": [size], "body": [body]})

    for batch in slim(batches):
        for name, text in zip(batch["doc_id"], batch["_text"], strict=True):
            ids.append(None if pd.isna(name) else int(name))
            texts.append((text or "").encode("utf-8", "surrogatepass"))
            size += len(texts[-1])
            if size >= CHUNK:
                yield row()
                ids, texts, size, k = [], [], 0, k + 1
    if ids:
        yield row()


class _Chunk:
    """A chunk's texts and pieces, in the order in which steps number them: by anchor, then by place."""

    def __init__(self, raw: bytes, length: int):
        c = unpack(raw)
        self.ids, self.null, self.ends, self.body = c["ids"], c["null"], c["ends"], c["body"]
        self.bytes = np.frombuffer(self.body, np.uint8)
        key, start, size, digest = _pieces(self.bytes, self.ends, length)
        order = np.argsort(key, kind="stable")
        self.key, self.start, self.size, self.digest = key[order], start[order], size[order], digest[order]
        self.text = np.searchsorted(self.ends, self.start, side="right")
        # Texts without an id come last.
        self.order = np.where(self.null, _LAST, self.ids)[self.text]

    def repeated(self, answers: list[bytes]) -> np.ndarray:
        """Places of the pieces whose anchor occurs more than once anywhere."""
        known = np.flatnonzero(np.concatenate(([True], self.key[1:] != self.key[:-1]))) if len(self.key) else np.empty(0, np.int64)
        bits = np.concatenate([unpack(a)["often"] for a in answers]) if answers else np.empty(0, bool)
        return np.flatnonzero(np.repeat(bits, np.diff(np.append(known, len(self.key)))))


def _anchors(batches: Iterator[pd.DataFrame], shards: int, length: int) -> Iterator[pd.DataFrame]:
    """A chunk's different anchors, in order, to shards by their upper bits."""
    for batch in slim(batches):
        for chunk, raw in zip(batch["chunk"], batch["body"], strict=True):
            key, count = np.unique(_Chunk(raw, length).key, return_counts=True)
            cut = np.searchsorted(_shard(key, shards), np.arange(shards + 1))
            rows = [(s, chunk, pack(d=np.diff(key[cut[s] : cut[s + 1]], prepend=np.uint64(0)), more=count[cut[s] : cut[s + 1]] > 1)) for s in np.flatnonzero(np.diff(cut))]
            yield pd.DataFrame(rows, columns=["shard", "chunk", "body"])


def _often(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard of anchors: for each chunk, in its order, which anchors occur more than once."""
    parts = [unpack(b) for b in rows["body"]]
    each = [np.cumsum(p["d"], dtype=np.uint64) for p in parts]
    known, where, count = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    often = count > 1
    often[where[np.concatenate([p["more"] for p in parts])]] = True
    cut = np.cumsum([len(e) for e in each])[:-1]
    return pd.DataFrame({"kind": "often", "chunk": rows["chunk"].to_numpy(), "shard": rows["shard"].to_numpy(), "body": [pack(often=often[w]) for w in np.split(where, cut)]})


def _answers(rows: pd.DataFrame, kind: str) -> list[bytes]:
    return rows[rows["kind"] == kind].sort_values("shard")["body"].tolist()


def _copies(chunk: pd.DataFrame, answers: pd.DataFrame, shards: int, length: int) -> pd.DataFrame:
    """The digests and places of a chunk's pieces of repeated anchors, to shards by anchor."""
    c = _Chunk(chunk["body"].iat[0], length)
    own = c.repeated(_answers(answers, "often"))
    cut = np.searchsorted(_shard(c.key[own], shards), np.arange(shards + 1))
    name = int(chunk["chunk"].iat[0])
    rows = []
    for s in np.flatnonzero(np.diff(cut)):
        p = own[cut[s] : cut[s + 1]]
        rows.append((int(s), name, pack(d=np.diff(c.key[p], prepend=np.uint64(0)), digest=c.digest[p], order=c.order[p], start=c.start[p].astype(np.uint32 if len(c.body) < 1 << 32 else np.uint64), size=c.size[p].astype(np.uint8 if length < 128 else np.uint32))))
    return pd.DataFrame(rows, columns=["shard", "chunk", "body"])


#: What becomes of a piece: nothing; covered whole; sorted in a shard; its strings grouped as rows.
ALONE, COVERED, SORTED, ROWS = range(4)


def _fates(rows: pd.DataFrame, crowded: int) -> pd.DataFrame:
    """One shard: what becomes of each chunk's pieces, in the chunk's order."""
    parts = [unpack(b) for b in rows["body"]]
    n = [len(p["d"]) for p in parts]
    key = np.concatenate([np.cumsum(p["d"], dtype=np.uint64) for p in parts])
    digest, order, start, size = (np.concatenate([p[k] for p in parts]) for k in ("digest", "order", "start", "size"))
    chunk = np.repeat(rows["chunk"].to_numpy(), n)
    by = np.lexsort((start, chunk, order, size, digest, key))
    same_key = np.concatenate(([False], key[by][1:] == key[by][:-1]))
    copy = same_key & np.concatenate(([False], (digest[by][1:] == digest[by][:-1]) & (size[by][1:] == size[by][:-1])))
    group = np.cumsum(~same_key) - 1
    different = np.bincount(group, weights=~copy)
    weight = np.bincount(group, weights=np.where(copy, 0, size[by]))
    fate = np.where(different[group] < 2, ALONE, np.where(weight[group] > crowded, ROWS, SORTED))
    out = np.empty(len(by), np.uint8)
    out[by] = np.where(copy, COVERED, fate)
    return pd.DataFrame({"kind": "fate", "chunk": rows["chunk"].to_numpy(), "shard": rows["shard"].to_numpy(), "body": [pack(fate=f, rows=int((f == ROWS).sum()), bytes=int(z[f == SORTED].sum())) for f, z in zip(np.split(out, np.cumsum(n)[:-1]), np.split(size.astype(np.int64), np.cumsum(n)[:-1]), strict=True)]})


def _fate_of(c: _Chunk, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pieces of repeated anchors, and their fates."""
    own = c.repeated(_answers(answers, "often"))
    fates = [unpack(a)["fate"] for a in _answers(answers, "fate")]
    return own, np.concatenate([*fates, np.empty(0, np.uint8)])


def _texts(chunk: pd.DataFrame, answers: pd.DataFrame, shards: int, length: int) -> pd.DataFrame:
    """The pieces of a chunk that have to be sorted, to shards by anchor; those of crowded anchors as rows of shard -1."""
    c = _Chunk(chunk["body"].iat[0], length)
    own, fate = _fate_of(c, answers)
    name, rows = int(chunk["chunk"].iat[0]), []
    for kind in (SORTED, ROWS):
        p = own[fate == kind]
        shard = _shard((c.key[p] ^ (c.key[p] >> np.uint64(7))) * _B, shards) if kind == SORTED else np.full(len(p), -1)
        by = np.argsort(shard, kind="stable")
        for s in np.unique(shard).tolist():
            q = p[by[np.searchsorted(shard[by], s) : np.searchsorted(shard[by], s, side="right")]]
            pieces = [c.body[a : a + n] for a, n in zip(c.start[q].tolist(), c.size[q].tolist(), strict=True)]
            rows.append((int(s), name, pack(order=c.order[q], start=c.start[q], size=c.size[q], body=b"".join(pieces))))
    return pd.DataFrame(rows, columns=["shard", "chunk", "body"])


def _runs(covered: np.ndarray) -> np.ndarray:
    """Bounds of the runs of a mask, as pairs."""
    return np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))


def _repeats(rows: pd.DataFrame, length: int, scratch: str) -> pd.DataFrame:
    """One shard of pieces: the strings in them that start earlier elsewhere, as bounds of runs of starts, by chunk."""
    parts = [unpack(b) for b in rows["body"]]
    order, start, size = (np.concatenate([p[k] for p in parts]) for k in ("order", "start", "size"))
    chunk = np.repeat(rows["chunk"].to_numpy(), [len(p["size"]) for p in parts])
    joined = np.frombuffer(b"".join(p["body"] for p in parts), np.uint8)
    own = np.repeat(np.arange(len(size)), size)
    offset = np.arange(len(joined)) - (np.cumsum(size) - size)[own]
    # Pieces stand one behind another with an end mark, so that no string reaches from one into the next.
    where = np.arange(len(joined)) + own
    text = np.ones(len(joined) + len(size) + 1, np.int32)
    text[where] = joined.astype(np.int32) + 2
    text[-1] = 0
    back = np.full(len(text), -1)
    back[where] = np.arange(len(joined))
    covered = np.zeros(len(joined), bool)
    held: list[np.ndarray] = []

    def settle(run: np.ndarray) -> None:
        """Of the places whose strings are equal, all but the first are covered. Runs are told apart by their number."""
        places, number = run
        if not len(places):
            return
        by = np.lexsort((start[own[places]] + offset[places], chunk[own[places]], order[own[places]], number))
        first = np.concatenate(([True], number[by][1:] != number[by][:-1]))
        covered[places[by[~first]]] = True

    number = 0
    for at, lcp in suffixes(text, length, scratch):
        place = back[at]
        # A string that does not fit in its piece ends the run of what stands before it.
        fits = place >= 0
        fits[fits] = offset[place[fits]] + length <= size[own[place[fits]]]
        group = np.cumsum(lcp < length) + number
        number = int(group[-1])
        if held:
            place, group, fits = (np.concatenate((a, b)) for a, b in zip(held, (place, group, fits), strict=True))
        # The last run may go on in what comes next.
        open_ = group == number
        if not open_.all():
            done = ~open_ & fits
            settle((place[done], group[done]))
        held = [place[open_], group[open_], fits[open_]]
    if held:
        settle((held[0][held[2]], held[1][held[2]]))
    mask = np.zeros(len(text), bool)
    mask[where] = covered
    bounds = _runs(mask)
    first = back[bounds[::2]]
    piece = own[first]
    starts = start[piece] + offset[first]
    ends = starts + bounds[1::2] - bounds[::2]
    out = [(int(c), pack(a=starts[chunk[piece] == c], b=ends[chunk[piece] == c])) for c in np.unique(chunk[piece])]
    return pd.DataFrame({"kind": "span", "chunk": np.array([c for c, _ in out], np.int64), "shard": int(rows["shard"].iat[0]), "body": [b for _, b in out]})


def _crowded_spans(pieces: DataFrame, tmp: Scratch, length: int) -> DataFrame:
    """The same for pieces of crowded anchors: every string of `length` bytes is a row, and equal strings (by a digest of 128
    bits) are grouped. No task holds more than its batch."""

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slim(batches):
            for chunk, raw in zip(batch["chunk"], batch["body"], strict=True):
                p = unpack(raw)
                ends = np.cumsum(p["size"])
                for k in range(0, len(ends), 200):
                    digests, places, orders = [], [], []
                    for a, n, place, order in zip((ends - p["size"])[k : k + 200].tolist(), p["size"][k : k + 200].tolist(), p["start"][k : k + 200].tolist(), p["order"][k : k + 200].tolist(), strict=True):
                        strings = n - length + 1
                        digests += [hashlib.blake2b(p["body"][a + j : a + j + length], digest_size=16).digest() for j in range(strings)]
                        places.append(np.arange(place, place + strings))
                        orders.append(np.full(strings, order))
                    h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    yield pd.DataFrame({"h1": h[:, 0], "h2": h[:, 1], "order": np.concatenate(orders), "chunk": chunk, "at": np.concatenate(places)})

    rows = tmp.save(pieces.mapInPandas(strings, "h1 long, h2 long, order long, chunk long, at long"), "strings")
    place = F.struct("order", "chunk", "at")
    firsts = rows.groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.min(place).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    again = rows.join(firsts, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).filter(place != F.col("_first")).select("chunk", "at")
    again = again.repartition(partitions(rows.sparkSession), "chunk").sortWithinPartitions("chunk", "at")

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, own in batch.groupby("chunk"):
                at = np.unique(own["at"].to_numpy())
                new = np.concatenate(([True], np.diff(at) > 1))
                yield pd.DataFrame({"kind": ["span"], "chunk": [chunk], "shard": [-1], "body": [pack(a=at[new], b=at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] + 1)]})

    return again.mapInPandas(joined, "kind string, chunk long, shard int, body binary")


def _cleaned(chunk: pd.DataFrame, answers: pd.DataFrame, length: int) -> pd.DataFrame:
    """A chunk's texts less what is covered."""
    c = _Chunk(chunk["body"].iat[0], length)
    own, fate = _fate_of(c, answers)
    p = own[fate == COVERED]
    begin, end = [c.start[p]], [c.start[p] + c.size[p]]
    for raw in _answers(answers, "span"):
        spans = unpack(raw)
        begin.append(spans["a"])
        end.append(spans["b"] + length - 1)
    mark = np.zeros(len(c.body) + 1, np.int32)
    np.add.at(mark, np.concatenate(begin), 1)
    np.add.at(mark, np.concatenate(end), -1)
    gone = np.cumsum(mark)[:-1] > 0
    rows, low = [], 0
    for name, null, high in zip(c.ids.tolist(), c.null.tolist(), c.ends.tolist(), strict=True):
        mask = gone[low:high]
        edge = _runs(mask)
        rows.append((None if null else name, c.bytes[low:high][~mask].tobytes(), high - low, int(mask.sum()), len(edge) // 2, edge.tolist()))
        low = high
    return pd.DataFrame(rows, columns=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "spans"]).astype({"doc_id": "Int64"})


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs(id, text) -> doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans, spans (pairs of bounds).

    Each byte goes that lies in a string of `length` bytes which also starts earlier: in a document of smaller id, or
    earlier in the same one. Null texts are empty. Null ids come last; rows that share an id follow one another in the order
    in which they are read. Texts shorter than the string stay. Other columns are not read; an empty table stays empty.
    """
    if not ANCHOR < length <= 2000:
        raise ValueError(f"strings of {ANCHOR + 1} to 2000 bytes")
    spark = docs.sparkSession
    tmp = Scratch(spark, "suffix")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    chunks = tmp.save(rows.mapInPandas(_chunks, "chunk long, bytes long, body binary"), "chunks")
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    shards, message = max(1, min(partitions(spark), total >> 20), total // ANCHOR_BYTES), "shard int, chunk long, body binary"
    answer = "kind string, chunk long, shard int, body binary"
    by_chunk = chunks.select("chunk", "body").groupBy("chunk")
    anchors = chunks.select("chunk", "body").mapInPandas(lambda b: _anchors(b, shards, length), message)
    often = tmp.save(anchors.groupBy("shard").applyInPandas(_often, answer), "often")
    crowd = CROWDED_BYTES
    copies = by_chunk.cogroup(often.groupBy("chunk")).applyInPandas(lambda c, a: _copies(c, a, shards, length), message)
    fates = tmp.save(copies.groupBy("shard").applyInPandas(lambda g: _fates(g, crowd), answer), "fates")
    del anchors, copies
    tmp.drop("none")
    # One number for each message: bytes to sort, and whether any anchor is crowded.
    sized = fates.select("body").mapInPandas(lambda b: (pd.DataFrame([(sum(unpack(x)["bytes"] for x in f["body"]), sum(unpack(x)["rows"] for x in f["body"]))], columns=["bytes", "rows"]) for f in b), "bytes long, rows long")
    sized = sized.agg(F.sum("bytes"), F.sum("rows")).first()
    sorts, scratch = max(1, min(partitions(spark), (sized[0] or 0) >> 16), (sized[0] or 0) // SHARD_BYTES), f"{shared_dir(spark)}/{tmp.root.split('/')[-1]}/queues"
    told = often.union(fates)
    texts = tmp.save(by_chunk.cogroup(told.groupBy("chunk")).applyInPandas(lambda c, a: _texts(c, a, sorts, length), message), "texts")
    spans = texts.filter("shard >= 0").groupBy("shard").applyInPandas(lambda g: _repeats(g, length, scratch), answer)
    if sized[1]:
        spans = spans.union(_crowded_spans(texts.filter("shard < 0"), tmp, length))
    spans = tmp.save(spans, "spans")
    tmp.keep("chunks", "often", "fates", "spans")
    tmp.drop("none")
    return by_chunk.cogroup(told.union(spans).groupBy("chunk")).applyInPandas(lambda c, a: _cleaned(c, a, length), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, spans array<bigint>")
