"""Best-fit packing: token ids of documents into as few sequences of a fixed length as can be found, cutting only documents
that are longer than a sequence.

What is worked out on the driver depends on the histogram of lengths alone, which has at most `capacity` rows however many
documents there are:

* Patterns are enumerated: one, two or three documents whose lengths fill a sequence exactly, or one length over and over
  with one document that fills the rest.
* How often each is repeated is fitted to the histogram by non-negative least squares. In each round the patterns that
  lower the error most, no two of which share a length, get their best counts, so few patterns come to be used.
* Counts are rounded, never beyond the documents there are. What is left is packed by best fit, longest first, on the
  histogram as well: sequences with the same room are one row.

The plan is a table of slots: documents of a length, from one rank on, go to sequences from one number on. A piece's rank
among the pieces of its length then tells its place; only short rows are sorted, and no ids are moved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ranked, slim

CAPACITY = 2048
#: Rounds of the fit, and patterns that are looked at in one.
ROUNDS, LOOKED_AT = 60, 8000


def patterns(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, times), three columns each, of the patterns that fill a sequence with lengths that occur; a length is in one
    column only, and columns that are not needed have length and times 0."""
    top = len(histogram) - 1
    there = histogram > 0
    there[[0, top]] = False
    have = np.flatnonzero(there)
    lengths, times = [np.zeros((0, 3), np.int64)], [np.zeros((0, 3), np.int64)]
    for a in have:
        b = have[(have >= a) & (2 * have <= top - a)]
        b = b[there[top - a - b]]
        lengths.append(np.stack([np.full(len(b), a), b, top - a - b], 1))
        times.append(np.ones((len(b), 3), np.int64))
        k = np.arange(1, top // a + 1)
        rest = top - k * a
        # What the three documents above hold already is left out, as is a rest of the same length.
        new = (rest == 0) & (k != 3) | there[rest] & (rest != a) & ((k > 2) | (k == 1) & (rest > a))
        k, rest = k[new], rest[new]
        lengths.append(np.stack([np.full(len(k), a), rest, np.zeros(len(k), np.int64)], 1))
        times.append(np.stack([k, rest > 0, np.zeros(len(k), np.int64)], 1))
    length, count = np.concatenate(lengths), np.concatenate(times)
    for i, j in ((1, 0), (2, 1), (2, 0)):
        same = (length[:, i] == length[:, j]) & (length[:, i] > 0)
        count[same, j] += count[same, i]
        length[same, i] = count[same, i] = 0
    return length, count


def fit(length: np.ndarray, times: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Repeat counts, zero or more, that bring the patterns' documents close to the histogram in least squares. Errors weigh
    by the square of the length: long documents are hard to place, short ones fill what is left."""
    weight = (np.arange(len(histogram)) / (len(histogram) - 1)) ** 2
    curve = (times * times * weight[length]).sum(1)
    error = -histogram.astype(float)
    error[0] = error[-1] = 0.0
    counts = np.zeros(len(length))
    for _ in range(ROUNDS if len(length) else 0):
        slope = (times * (weight * error)[length]).sum(1)
        step = np.maximum(-slope / curve, -counts)
        gain = -(slope + curve * step / 2) * step
        most = min(len(gain), LOOKED_AT)
        best = np.argpartition(-gain, most - 1)[:most]
        best = best[np.lexsort((best, -gain[best]))]
        taken: set[int] = set()
        picked = []
        for j, own in zip(best[gain[best] > 1e-9 * histogram.max()].tolist(), length[best].tolist(), strict=False):
            if taken.isdisjoint(own):
                taken.update(x for x in own if x)
                picked.append(j)
        if not picked:
            break
        counts[picked] += step[picked]
        np.add.at(error, length[picked], times[picked] * step[picked, None])
        error[0] = 0.0
    return counts


def plan(histogram: np.ndarray) -> np.ndarray:
    """Slots, one row each: length, first rank, documents, first sequence, offset of the first, documents side by side in a
    sequence. histogram: documents by length, from 0 to the capacity."""
    top = len(histogram) - 1
    left, rank = histogram.astype(np.int64), np.zeros(top + 1, np.int64)
    left[0] = 0
    slots, sequences = [], 0

    def put(size: int, n: int, first: int, offset: int, times: int) -> None:
        slots.append((size, rank[size], n, first, offset, times))
        rank[size] += n
        left[size] -= n

    if left[top]:
        put(top, left[top], sequences, 0, 1)
        sequences = int(rank[top])
    length, times = patterns(left)
    counts = fit(length, times, left)
    used = np.flatnonzero(counts > 0.01)
    used = used[np.lexsort((used, -counts[used]))]
    # Whole counts first, so that what is rounded up cannot take documents from them; then once more for the fractions.
    for fraction in (False, True):
        for j in used.tolist():
            own = [(a, m) for a, m in zip(length[j].tolist(), times[j].tolist(), strict=True) if m]
            n = min([1 if fraction else int(counts[j]), *(int(left[a]) // m for a, m in own)])
            offset = 0
            for a, m in own if n else ():
                put(a, n * m, sequences, offset, m)
                offset += a * m
            sequences += n
    # Sequences with room, by their room: (first, how many).
    room: dict[int, list[tuple[int, int]]] = {}
    for a in range(top, 0, -1):
        while left[a]:
            space = min((r for r in room if r >= a), default=top)
            if space not in room:
                room[space] = [(sequences, max(1, int(left[a]) // (top // a)))]
                sequences += room[space][0][1]
            first, n = room[space].pop()
            m = min(space // a, int(left[a]))
            many = min(n, int(left[a]) // m)
            put(a, many * m, first, top - space, m)
            if many < n:
                room[space].append((first + many, n - many))
            if not room[space]:
                del room[space]
            if space > m * a:
                room.setdefault(space - m * a, []).append((first, many))
    return np.array(slots, np.int64).reshape(-1, 6)


def pieces(tokenised: DataFrame, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of (doc_id, ids as u16, see idfiles.tokenise): documents of over
    `capacity` ids are cut, the others are one piece. ids_crc32 is that of the ids as little-endian u32. Without ids, rows
    are short, and sequences() has nothing to join."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim(batches):
            rows = []
            for name, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                all_ids = np.frombuffer(ids.as_buffer(), "<u2")
                for piece, at in enumerate(range(0, len(all_ids), capacity)):
                    own = all_ids[at : at + capacity]
                    rows.append((name, piece, at, len(own), zlib.crc32(own.astype("<u4")), own.tobytes() if with_ids else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return tokenised.select("doc_id", "ids").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def place(length: Column, rank: Column, slots: np.ndarray) -> Column:
    """(sequence_id, offset) of a piece by its length and its rank among the pieces of that length. Slots are bounded by the
    patterns that a fit can use, not by the documents."""
    order = np.lexsort((slots[:, 1], slots[:, 0]))
    slots = slots[order]
    # The slots of a length follow one another, by their first rank.
    starts = np.searchsorted(slots[:, 0], np.arange(slots[:, 0].max(initial=0) + 2))

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, nth = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.empty(len(size), np.int64)
        for a in np.unique(size):
            own = size == a
            at[own] = starts[a] + np.searchsorted(slots[starts[a] : starts[a + 1], 1], nth[own], "right") - 1
        _, base, _, first, offset, times = slots[at].T
        return pd.DataFrame({"sequence_id": first + (nth - base) // times, "offset": offset + (nth - base) % times * size})

    return find(length, rank)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id (from 0 on, none left out) and offset. Pieces without ids cannot be; extra columns stay. The
    places of pieces of one length are dealt by doc_id, null first, then piece, then the bytes' checksum: reruns agree, but
    for rows that are equal in all three, which may change places with each other. An empty table has no sequences."""
    tmp = Scratch(cut.sparkSession, "packing")
    cut = tmp.save(cut.withColumn("_tie", F.monotonically_increasing_id()), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():
        histogram[r["length"]] = r["count"]
    slots = plan(histogram)
    placed = ranked(cut, tmp, "ranked", ["length"], ["doc_id", "piece", "ids_crc32", "_tie"])
    tmp.keep("ranked", "ranked_firsts")
    return placed.withColumn("_at", place(F.col("length"), F.col("rank"), slots)).select(*[c for c in cut.columns if c != "_tie"], "_at.*")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences themselves, u16 ids without gaps."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("_p"))
    ids = F.aggregate("_p.ids", F.lit(b""), lambda done, own: F.concat(done, own))
    return rows.select("sequence_id", F.aggregate("_p.length", F.lit(0).cast("long"), lambda n, own: n + own).alias("n_tokens"), ids.alias("ids"))
