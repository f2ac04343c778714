"""Merkle manifest of a table: digests of rows, of runs of eight nodes, of whole trees, and proofs that a row is part of it.

Each tree (a language, say) has its rows as leaves, ascending by id; the trees' roots, in the order of the trees, are the
leaves of one more tree. The nodes live in Parquet, a folder for each level, and no task holds more than a batch of them:

* Leaves are dealt into sorted runs on disk, which gives each its coordinate: its tree and its place there.
* A level is made by reading the one below in the order in which it was written. Nodes that follow one another are packed,
  eight to a row, as they stream by; the few packs that are cut where a task's share ends are put together by a shuffle.
* Proofs are extracted from the top down, by merging each level with the one above on the coordinate: a pack meets the proof
  of the node that it is hashed to, once for its eight nodes. So no key is hot, and what is merged is an eighth of the rows.

Fixed rules: H is the SHA-256 of its inputs, one after another, as lowercase hex; digests enter as that text. A value enters
as its number of bytes in UTF-8, a colon and the value; null as "-". A null id sorts first; rows that share an id are
ordered by their digests; a null tree is a tree, and the first. An empty table has no root and no proofs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ranked

#: Nodes that make one node of the next level.
FAN = 8
#: The order of a document's values in its leaf.
DOCUMENT = ("doc_id", "source", "lang", "n_chars", "text")
_PACK = "tree string, pack long, members long, first int, digests array<string>, rows array<struct<id:long,claim:string>>"
_ARROW = pa.schema([
    ("tree", pa.string()), ("pack", pa.int64()), ("members", pa.int64()), ("first", pa.int32()), ("digests", pa.list_(pa.string())),
    ("rows", pa.list_(pa.struct([("id", pa.int64()), ("claim", pa.string())]))),
])
#: Packs in an Arrow batch.
BATCH = 4096


def leaf(values: list[Column]) -> Column:
    """H of the values."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*parts), 256)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (tree, idx, members, digest, row) that follow one another, by the pack that they belong to."""
    out: list[tuple] = []
    key = held = None

    def flush() -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)
        out.clear()
        return made

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("tree", "idx", "members", "digest", "row")), strict=True)
        for now, nodes in groupby(rows, lambda r: (r[0], r[1] // FAN, r[2])):
            for _, idx, _, digest, row in nodes:
                if held is not None and (now != key or idx != held[0] + len(held[1])):
                    out.append((*key, held[0] % FAN, held[1], held[2]))
                    held = None
                if held is None:
                    key, held = now, (idx, [], [])
                held[1].append(digest)
                held[2].append(row)
            if len(out) >= BATCH:
                yield flush()
    if held is not None:
        out.append((*key, held[0] % FAN, held[1], held[2]))
    if out:
        yield flush()


def _level(nodes: DataFrame, tmp: Scratch, name: str) -> DataFrame:
    """The packs of a level, written: (tree, pack, members, digests, rows)."""
    parts = tmp.save(nodes.select("tree", "idx", "members", "digest", "row").mapInArrow(_packs, _PACK), f"cut/{name}")
    whole = F.size("digests") == F.least(F.lit(FAN).cast("long"), F.col("members") - F.col("pack") * FAN)
    # Cut where a task's share of the level below began or ended; up to eight pieces make a pack.
    pieces = parts.filter(~whole).groupBy("tree", "pack", "members").agg(F.array_sort(F.collect_list(F.struct("first", "digests", "rows"))).alias("_p"))
    pieces = pieces.select("tree", "pack", "members", F.flatten("_p.digests").alias("digests"), F.flatten("_p.rows").alias("rows"))
    return tmp.save(parts.filter(whole).drop("first").unionByName(pieces), name)


def _tree(nodes: DataFrame, tmp: Scratch, name: str) -> list[DataFrame]:
    """The levels over these leaves; a tree has one row at its last level, of one node, and none above."""
    levels = [_level(nodes, tmp, f"{name}/level=0")]
    most = levels[0].agg(F.max("members")).first()[0] or 0
    while most > 1:
        above = levels[-1].filter("members > 1").select("tree", F.col("pack").alias("idx"), F.ceil(F.col("members") / FAN).alias("members"), F.sha2(F.array_join("digests", ""), 256).alias("digest"), F.lit(None).cast("struct<id:long,claim:string>").alias("row"))
        levels.append(_level(above, tmp, f"{name}/level={len(levels)}"))
        most = -(-most // FAN)
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, top, height): the node that remains of each tree."""
    tops = None
    for k, level in enumerate(levels):
        own = level.filter("members = 1").select("tree", F.col("digests")[0].alias("top"), F.lit(k).alias("height"))
        tops = own if tops is None else tops.unionByName(own)
    return tops


def _proofs(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Nodes of level 0 with path, from the node up: what stands left and right of it in its pack, then of what its pack is
    hashed to, and so on. tops: (tree, height, path) and what else its nodes shall carry."""
    carried = [c for c in tops.columns if c not in ("tree", "height", "path")]
    above = None
    for k in range(len(levels) - 1, -1, -1):
        # The proofs of this level's nodes: of those that remain, and of those below the level above.
        own = tops.filter(F.col("height") == k).select(F.col("tree").alias("_tree"), F.lit(0).cast("long").alias("_idx"), F.lit(True).alias("_is_top"), "path", *carried)
        above = own if above is None else own.unionByName(above)
        level = levels[k]
        # A pack of one node that remains is that node; all others are hashed to a node of the next level.
        met = level.join(above, (F.col("members") == 1).eqNullSafe(F.col("_is_top")) & F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("pack") == F.col("_idx")))
        left, right = F.expr("array_join(slice(digests, 1, _place), '')"), F.expr(f"array_join(slice(digests, _place + 2, {FAN}), '')")
        beside = F.array(F.struct(left.alias("left"), right.alias("right")))
        nodes = met.select("tree", "pack", "digests", "rows", "_is_top", "path", *carried, F.posexplode("digests").alias("_place", "digest"))
        nodes = nodes.select("tree", (F.col("pack") * FAN + F.col("_place")).alias("idx"), "digest", F.col("rows")[F.col("_place")].alias("row"), F.when(F.col("_is_top"), F.col("path")).otherwise(F.concat(beside, "path")).alias("path"), *carried)
        above = nodes.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.lit(False).alias("_is_top"), "path", *carried) if k else None
    return nodes


@dataclass
class Manifest:
    """trees: the levels over the rows of each tree; top: the levels over the trees' roots; root: None for an empty table."""

    trees: list[DataFrame]
    top: list[DataFrame]
    root: str | None
    store: Scratch

    def proofs(self) -> DataFrame:
        """A row for each leaf: id, tree, idx (its coordinate), leaf, subroot, root, path (array of left and right siblings, each
        as text, from the leaf up) and claim."""
        path = "cast(array() as array<struct<left:string,right:string>>)"
        roots = _proofs(self.top, _tops(self.top).select("tree", "height", F.expr(path).alias("path")))
        roots = roots.select(F.col("row.id").alias("_nth"), F.col("row.claim").alias("tree"), F.col("digest").alias("subroot"), "path")
        tops = _tops(self.trees)
        tops = tops.join(roots.withColumnRenamed("tree", "_t"), F.col("tree").eqNullSafe(F.col("_t"))).drop("_t", "_nth", "top")
        found = _proofs(self.trees, tops)
        return found.select(F.col("row.id").alias("id"), "tree", "idx", F.col("digest").alias("leaf"), "subroot", F.lit(self.root).alias("root"), "path", F.col("row.claim").alias("claim"))


def folded(path: Column, digest: Column) -> Column:
    """The root that a leaf's digest comes to along a path."""
    return F.aggregate(path, digest, lambda at, beside: F.sha2(F.concat(beside["left"], at, beside["right"]), 256))


def digest(path: Column) -> Column:
    """H of the siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda beside: F.concat(beside["left"], beside["right"])), ""), 256)


def build(df: DataFrame, tree: str = "lang", key: str = "doc_id", columns: tuple[str, ...] = DOCUMENT, claim: Column | None = None) -> Manifest:
    """The manifest of df. claim: a digest that travels with each leaf, to be held against the root; the leaf's own if none is
    given. Other columns are not read."""
    tmp = Scratch(df.sparkSession, "merkle")
    own = leaf([F.col(c) for c in columns])
    leaves = df.select(F.col(tree).cast("string").alias("tree"), F.col(key).cast("long").alias("id"), own.alias("digest"), (own if claim is None else claim).alias("claim"))
    leaves = tmp.save(leaves.withColumn("tie", F.monotonically_increasing_id()), "hashed")
    placed = ranked(leaves, tmp, "runs", ["tree"], ["id", "digest", "tie"]).withColumnRenamed("rank", "idx")
    trees = _tree(placed.withColumn("row", F.struct("id", "claim")), tmp, "trees")
    tops = tmp.save(_tops(trees).withColumns({"all": F.lit(0), "nth": F.lit(None).cast("long")}), "tops")
    roots = ranked(tops, tmp, "roots", ["all"], ["tree"]).select(F.lit(None).cast("string").alias("_none"), F.col("rank").alias("idx"), "members", F.col("top").alias("digest"), F.struct(F.col("nth").alias("id"), F.col("tree").alias("claim")).alias("row"))
    top = _tree(roots.withColumnRenamed("_none", "tree"), tmp, "top")
    found = _tops(top).first()
    tmp.keep("trees", "top")
    return Manifest(trees, top, found and found["top"], tmp)
