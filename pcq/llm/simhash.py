"""SimHash near-duplicates, found by an inverted index over byte positions with count filtering.

Two 64-bit fingerprints that differ in at most d bits agree in at least 8 - d of their 8 bytes. For d = 4 that is any 4
byte positions; each set of 4 positions holds one of 20 triples (Turan's system for 3 of 8). So postings are triples of
positional bytes, and a pair that meets in a posting list is tallied by comparing its fingerprints byte by byte: how many
positional bytes do they share? Pairs that reach the guaranteed minimum are verified by their differing bits. No link within the radius is lost.

Equal fingerprints are one entry. A crowded list is cut into blocks, and pairs of blocks are compared apart from each
other; a large block reports only a spanning forest of its links, which leaves the components as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions, slim
from .graph import components

SEED = 42
#: Byte positions in three groups; every 4 of the 8 positions hold one of the triples made below.
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
#: Shingles hashed at a time; bounds the memory for a very long text.
_CHUNK = 1 << 18
#: Most entries of a posting list, about, that are compared as one; longer lists are cut into blocks of that size.
BLOCK = 4096
#: Up to so many crowded lists (a row of a long and an int each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_LISTS = 100_000
#: A group of postings up to this size is compared by shifting, a larger one row by row with a forest.
SMALL = 64


def triples() -> list[tuple[int, int, int]]:
    """All triples within one group, and those with two positions in a group and one in the next."""
    group = {p: g for g, own in enumerate(_GROUPS) for p in own}
    out = []
    for t in combinations(range(8), 3):
        g = sorted(group[p] for p in t)
        if g in ([0, 0, 0], [1, 1, 1], [0, 0, 1], [1, 1, 2], [0, 2, 2]):
            out.append(t)
    return out


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many rows of a table of u64 have each bit set; summed as u8 over 255 rows at a time, which cannot overflow."""
    bits = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
    return sum(bits[at : at + 255].sum(0, dtype=np.uint8).astype(np.int64) for at in range(0, len(bits), 255))


def _shingles(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, in order, repeats included; some at a time. Nothing for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    starts, ends = starts[:n].tolist(), (ends[size - 1 :] if len(words) >= size else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)], np.uint64)


def fingerprint(text: str | None, size: int = 4) -> int:
    """The SimHash of a text's shingles, repeats included: a bit is set if it is in over half of the shingles' XXH64.
    Words are runs of anything but ASCII white space, A-Z lower-cased. A text shorter than a shingle is hashed as one; a
    text without words (or null) has fingerprint 0."""
    tally, n = np.zeros(64, np.int64), 0
    for h in _shingles(text, size):
        tally += _bit_counts(h.reshape(-1, 1))
        n += len(h)
    return int(np.packbits(tally * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", size: int = 4) -> DataFrame:
    """docs with a column _fp: the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def make(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in slim(texts):
            yield pd.Series(np.array([fingerprint(t, size) for t in batch], np.uint64).view(np.int64))

    return docs.withColumn("_fp", make(F.col(text_col)))


def _forest(fp: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, least_shared: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between two lists of places in fp (or within one, given twice)."""
    label = np.arange(len(fp))
    other = fp[right]
    u, v = [], []
    for i in left:
        x = fp[i] ^ other
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        near = right[(shared >= least_shared) & (np.bitwise_count(x) <= radius)]
        found = label[near]
        new = found != label[i]
        if new.any():
            roots, first = np.unique(found[new], return_index=True)
            u += [int(fp[i])] * len(roots)
            v += fp[near[new][first]].tolist()
            label[np.isin(label, roots)] = label[i]
    return u, v


def _links(groups: pd.DataFrame, radius: int, least_shared: int) -> pd.DataFrame:
    """Links within each group of rows (key, lo, hi, block, fp), which are sorted by key, lo, hi."""
    ids = groups[["key", "lo", "hi"]].to_numpy()
    fp = groups["fp"].to_numpy().view(np.uint64)
    block = groups["block"].to_numpy()
    cut = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]).any(1), [True])))
    sizes = np.diff(cut)
    us, vs = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    small = np.repeat(sizes <= SMALL, sizes)
    at, own, group = np.flatnonzero(small), block[small], np.repeat(np.arange(len(sizes)), sizes)[small]
    cross = (groups["lo"].to_numpy() != groups["hi"].to_numpy())[small]
    for d in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        same = (group[d:] == group[:-d]) & (~cross[d:] | (own[d:] != own[:-d]))
        if not same.any():
            continue
        a, b = fp[at[:-d][same]], fp[at[d:][same]]
        x = a ^ b
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        near = (shared >= least_shared) & (np.bitwise_count(x) <= radius)
        us.append(a[near])
        vs.append(b[near])
    for g in np.flatnonzero(sizes > SMALL):
        part, side = fp[cut[g] : cut[g + 1]], block[cut[g] : cut[g + 1]]
        lo, hi = int(ids[cut[g], 1]), int(ids[cut[g], 2])
        a, b = _forest(part, np.flatnonzero(side == lo), np.flatnonzero(side == hi), radius, least_shared)
        us.append(np.array(a, np.uint64))
        vs.append(np.array(b, np.uint64))
    return pd.DataFrame({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)})


def _blocked(posted: DataFrame, id_col: str) -> DataFrame:
    """posted with (lo, hi, block): lists of more than BLOCK entries are cut into blocks by a hash of the id,
    and an entry goes to each pair (lo, hi) of blocks of its list that holds its own block."""
    crowded = posted.groupBy(F.col("key").alias("_k")).count().filter(F.col("count") > BLOCK).select("_k", F.ceil(F.col("count") / BLOCK).cast("int").alias("_blocks"))
    # A crowded list has over BLOCK entries, so this table is small beside the postings; its size is still checked.
    crowded = Scratch(posted.sparkSession, "crowded").save(crowded, "lists")
    crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST_LISTS else crowded
    posted = posted.join(crowded, posted["key"] == crowded["_k"], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    posted = posted.withColumn("block", F.pmod(F.xxhash64(id_col, F.lit("block")), F.col("_blocks")).cast("int"))
    posted = posted.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return posted.withColumn("lo", F.least("block", "_with")).withColumn("hi", F.greatest("block", "_with")).drop("_k", "_blocks", "_with")


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """fps(fp long, distinct) -> (u, v): links that connect all fingerprints within `radius` (at most 4) bits as the full
    set of links would. Small groups report every link, large blocks a spanning forest of theirs."""
    if not 0 <= radius <= 4:
        raise ValueError("the byte index guarantees radii from 0 to 4")
    least_shared = 8 - radius
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    keys = F.array(*[F.lit(k << 24).bitwiseOR(F.shiftleft(byte[a], 16)).bitwiseOR(F.shiftleft(byte[b], 8)).bitwiseOR(byte[c]).cast("long") for k, (a, b, c) in enumerate(triples())])
    posted = fps.select("fp", F.explode(keys).alias("key"))
    posted = _blocked(posted, "fp")
    posted = posted.select("key", "lo", "hi", "block", "fp").repartition(partitions(fps.sparkSession), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = batch[["key", "lo", "hi"]].iloc[-1]
            ends = ((batch["key"] == last["key"]) & (batch["lo"] == last["lo"]) & (batch["hi"] == last["hi"])).to_numpy()
            first = int(ends.argmax())
            if first:
                yield _links(batch.iloc[:first].reset_index(drop=True), radius, least_shared)
            rest = batch.iloc[first:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield _links(rest, radius, least_shared)

    return posted.mapInPandas(compare, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id, the smallest id reachable over links.

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id take part; they never name a
    component, and one that holds only such rows has a null component_id. Repeated rows each get a row. An empty table
    gives no rows. Other columns are neither read nor kept.
    """
    tmp = Scratch(docs.sparkSession, "simhash")
    made = tmp.save(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text", size).select("doc_id", "_fp"), "fps")
    distinct = tmp.save(made.groupBy("_fp").agg(F.min("doc_id").alias("_least")), "distinct")
    found = components(links(distinct.select(F.col("_fp").alias("fp")), radius), tmp)
    classed = distinct.join(found, distinct["_fp"] == found["node"], "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    classed = tmp.save(classed, "classed")
    names = classed.groupBy("_root").agg(F.min("_least").alias("component_id")).withColumnRenamed("_root", "_r")
    named = tmp.save(classed.join(names, classed["_root"] == names["_r"]).select(F.col("_fp").alias("_f"), "component_id"), "named")
    tmp.keep("fps", "named")
    out = made.join(named, made["_fp"] == named["_f"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
