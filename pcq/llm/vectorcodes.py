"""Codes for vectors: product quantisation in integers, with codebooks kept up by Lloyd rounds that move only what changed.

A vector's components become integers, floor(256 x), and it is cut into consecutive parts; each position has a codebook of
its own. The table of integer vectors is written with the entry that each part has been assigned to, and the codebooks'
running sums and counts are a table as well. A round

* reads the vectors with their last assignment, assigns anew, and writes both assignments;
* sums, in each task, what the parts that changed add to their new entry and take from their old one, so that a task sends
  a row at most for each entry that it changed; parts that stay send nothing;
* adds these sums to the running ones, which give the next codebooks.

Everything is integer arithmetic, so results don't depend on the order of sums. Codebooks are bounded by their parameters
and are all that reaches the driver; an executor that is lost costs its tasks' share of one round.

A vector that is null, empty or holds a null or non-finite component takes no part, nor does one whose length differs from
that of the first by vec_id. If the length isn't a multiple of the parts, earlier parts are shorter by one component; a part
without components has code 0. Components beyond 2^18 count as that, which keeps sums of squares within 64 bits. A null
vec_id comes last; rows that share one are ordered by their components. Fewer vectors than entries make fewer entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SCALE, LIMIT = 256, float(1 << 18)
#: Vectors whose distances are worked out at a time.
BLOCK = 4096
#: Up to so many labels a row of one long for each is broadcast; beyond, a label's rows are dealt into SALTS.
BROADCAST_LABELS, SALTS = 100_000, 64


def cuts(dimension: int, parts: int) -> list[int]:
    """Where the parts begin and end."""
    return [k * dimension // parts for k in range(parts + 1)]


def nearest(vectors: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of the parts of integer vectors; ties go to the lower index."""
    codes, errors = np.zeros((len(vectors), len(books)), np.int64), np.zeros((len(vectors), len(books)), np.int64)
    for at in range(0, len(vectors), BLOCK):
        own, begin = vectors[at : at + BLOCK], 0
        for k, book in enumerate(books):
            part = own[:, begin : begin + book.shape[1]]
            begin += book.shape[1]
            far = (book * book).sum(1)[None, :] - 2 * (part @ book.T)
            codes[at : at + BLOCK, k] = best = far.argmin(1)
            errors[at : at + BLOCK, k] = far[np.arange(len(own)), best] + (part * part).sum(1)
    return codes, errors


def _integers(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dimension)


def _bytes(codes: np.ndarray) -> pa.Array:
    return pa.array([c.tobytes() for c in codes.astype("<u2")], pa.binary())


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").astype(np.int64).reshape(-1, parts)


@dataclass
class Codes:
    """books: an integer array (entries, components) for each part. rows: vec_id, label, code (u16 of each part), error (squared
    distance of the integer vector to its entries, over all parts); moved: parts that each round moved, the first included."""

    rows: DataFrame
    books: list[np.ndarray]
    moved: list[int]

    def books_sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()

    def decode(self) -> DataFrame:
        """rows with vector: the entries' components over 256, the middle of the steps that floor() leaves."""
        books, parts = self.books, len(self.books)

        @F.pandas_udf("array<double>")
        def join(code: pd.Series) -> pd.Series:
            own = np.frombuffer(b"".join(code), "<u2").reshape(-1, parts)
            return pd.Series(list(np.concatenate([(book[own[:, k]] + 0.5) / SCALE for k, book in enumerate(books)], axis=1)))

        return self.rows.withColumn("vector", join("code"))


def integers(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """(vec_id, label, q) of the vectors that take part."""
    x = F.col(vector).cast("array<double>")
    whole = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(F.least(F.greatest(v, F.lit(-LIMIT)), F.lit(LIMIT)) * SCALE).cast("int"))
    return df.filter(F.coalesce(whole, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), q.alias("q"))


def compress(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> Codes:
    """Fit codebooks on all vectors in the given number of rounds, and code all vectors with them."""
    tmp = Scratch(df.sparkSession, "codes")
    kept = tmp.save(integers(df, vector, key, label), "kept")
    order = [F.col("vec_id").asc_nulls_last(), "q"]
    first = kept.orderBy(*order).select(F.size("q")).first()
    dimension = first[0] if first else 0
    kept = kept.filter(F.size("q") == dimension)
    start = [r["q"] for r in kept.orderBy(*order).select("q").limit(entries).collect()]
    start = np.array(start, np.int64).reshape(len(start), dimension)
    cut = cuts(dimension, parts)
    books = [start[:, a:b] for a, b in zip(cut, cut[1:], strict=False)]
    now, sums, moved = kept.withColumn("code", F.lit(None).cast("binary")), None, []
    for k in range(rounds):
        now = tmp.save(_assign(now, books, dimension), f"round{k}")
        sums, changed = _add(_changes(now, parts, dimension), sums, tmp, f"sums{k}"), 0
        books = [book.copy() for book in books]
        for r in sums.collect():
            changed += r["moved"]
            if r["n"]:
                width = books[r["part"]].shape[1]
                books[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"][:width]]
        moved.append(changed)
        tmp.keep(f"round{k}", f"sums{k}")
    done = tmp.save(_assign(now, books, dimension, errors=True).select("vec_id", "label", "code", "error"), "coded")
    tmp.keep("coded")
    return Codes(done, books, moved)


def _assign(now: DataFrame, books: list[np.ndarray], dimension: int, errors: bool = False) -> DataFrame:
    """(vec_id, label, q, old, code, error): each vector with its assignment before and now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, far = nearest(_integers(batch.column("q"), dimension), books)
                columns = [batch.column(c) for c in ("vec_id", "label", "q", "code")]
                yield pa.RecordBatch.from_arrays([*columns, _bytes(codes), pa.array(far.sum(1))], names=["vec_id", "label", "q", "old", "code", "error"])

    kind = now.schema["label"].dataType.simpleString()
    out = now.select("vec_id", "label", "q", "code").mapInArrow(run, f"vec_id long, label {kind}, q array<int>, old binary, code binary, error long")
    return out if errors else out.drop("error")


def _changes(now: DataFrame, parts: int, dimension: int) -> DataFrame:
    """(part, entry, n, moved, sums): what a task's changed parts add and take, at most a row for each entry of each part."""
    cut = cuts(dimension, parts)
    width = max(b - a for a, b in zip(cut, cut[1:], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            q, new = _integers(batch.column("q"), dimension), _codes(batch.column("code"), parts)
            # Before the first round nothing has been assigned.
            old = None if batch.column("old").null_count else _codes(batch.column("old"), parts)
            for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                rows = np.arange(len(q)) if old is None else np.flatnonzero(old[:, k] != new[:, k])
                for sign, codes in ((1, new), (-1, old)):
                    if codes is not None:
                        own = codes[rows, k]
                        # Exact: whole numbers, added as such.
                        added = np.zeros((own.max(initial=-1) + 1, 2 + width), np.int64)
                        np.add.at(added[:, 2 : 2 + b - a], own, sign * q[rows, a:b])
                        np.add.at(added[:, 0], own, sign)
                        np.add.at(added[:, 1], own, int(sign > 0))
                        for e in np.unique(own).tolist():
                            total[k, e] = total.get((k, e), 0) + added[e]
        if total:
            keys, sums = zip(*total.items(), strict=True)
            part, entry = zip(*keys, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64()), pa.array([s[2:].tolist() for s in sums], pa.list_(pa.int64()))], names=["part", "entry", "n", "moved", "sums"])

    changed = now.filter(~F.col("old").eqNullSafe(F.col("code"))).select("q", "old", "code")
    return changed.mapInArrow(run, "part int, entry int, n long, moved long, sums array<bigint>")


def _add(changes: DataFrame, sums: DataFrame | None, tmp: Scratch, name: str) -> DataFrame:
    """The running sums, and what a round adds to them and takes; moved counts this round's parts only."""
    every = changes if sums is None else sums.withColumn("moved", F.lit(0).cast("long")).unionByName(changes)
    every = every.select("part", "entry", "n", "moved", F.posexplode("sums").alias("_i", "_s")).groupBy("part", "entry", "_i").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved"), F.sum("_s").alias("_s"))
    rows = every.groupBy("part", "entry").agg(F.first("n").alias("n"), F.first("moved").alias("moved"), F.array_sort(F.collect_list(F.struct("_i", "_s"))).alias("_p"))
    return tmp.save(rows.select("part", "entry", "n", "moved", F.col("_p._s").alias("sums")), name)


def label_errors(rows: DataFrame) -> DataFrame:
    """rows with label_error: the sum of error over the rows of the same label; null is a label."""
    totals = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if totals.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(totals), same).drop("_label")
    # A label may hold a third of all rows: its rows meet a copy of its total in each of the salts.
    totals = totals.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(totals, same & (F.col("_salt") == F.col("_s"))).drop("_label", "_salt", "_s")
