"""Mixing sources to target weights, by hash-threshold histograms.

A source's target is its share of the budget. Whole passes over a source are taken by arithmetic; what is left of the
target is a budget for one more, partial pass. That pass takes the documents whose hash lies below a threshold. The
threshold is found from sums of sizes by source and hash bucket: buckets below the budget are taken whole, and only the
bucket in which the budget ends is split further by the next bits of the hash. No rows are sorted and none are collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, words

#: Bits of the hash, and of one level of the histogram.
HASH_BITS, LEVEL_BITS = 60, 12
#: Up to so many sources (each a short row) a table with one row a source is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text (null: of the empty text): equal on every engine and every run."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sizes(source, source_size) -> with target: share of all sizes, by the repeating weights in code-point order (null
    last), none above `most` times its source's size; what is cut off there goes to the others by weight, until none is above."""
    ranked = sizes.withColumn("_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * F.lit(float(most))).alias("_cap"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, budget = 0.0, share * total
    while budget > 0:
        # Sources that the present level would lift above their cap keep the cap; the rest share what remains.
        full = F.col("_w") * F.lit(level) > F.col("_cap")
        got = ranked.agg(F.sum(F.when(full, F.col("_cap"))).alias("c"), F.sum(F.when(~full, F.col("_w"))).alias("w")).first()
        if not got["w"]:
            break
        new = (budget - (got["c"] or 0.0)) / got["w"]
        if new == level:
            break
        level = new
    # One window over all sources: a short row for each, of a table that is written.
    out = ranked.select("source", "source_size", F.least(F.col("_cap"), F.col("_w") * F.lit(level)).alias("target"))
    return out


def _join_source(left: DataFrame, right: DataFrame, n_sources: int) -> DataFrame:
    """Join on the source, null to null; the small side is broadcast only below a checked number of sources."""
    right = right.withColumnRenamed("source", "_source")
    side = F.broadcast(right) if n_sources <= BROADCAST_SOURCES else right
    return left.join(side, left["source"].eqNullSafe(side["_source"]), "left").drop("_source")


def cuts_of(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, DataFrame, int]:
    """Sizes of all rows (doc_id, source, size, _h), and for each source (one row, source_size, target, _whole, _from): a row is
    taken _whole times, and once more if its hash is below _from. With the number of sources."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "mix")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"))
    rows = tmp.save(rows.withColumn("_h", hash60(F.col("doc_id"))), "rows")
    sizes = tmp.save(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    targets = tmp.save(source_targets(sizes, weights, share, most), "targets")
    n_sources = targets.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    cuts = targets.select("source", "source_size", "target", whole.alias("_whole"), (F.col("target") - whole * F.col("source_size")).alias("_left"), F.lit(0).cast("long").alias("_from"))
    # _from: hashes below are taken; _left: the budget above it; _open: the bucket in which the budget ends.
    cuts = cuts.withColumn("_open", F.col("_left") > 0)
    by_bucket = W.partitionBy("source").orderBy("_b")
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        joined = _join_source(rows, cuts.filter("_open").select("source", "_from", "_left"), n_sources)
        inside = F.shiftright(F.col("_h"), shift + LEVEL_BITS) == F.shiftright(F.col("_from"), shift + LEVEL_BITS)
        hist = joined.filter(F.col("_left").isNotNull() & inside).groupBy("source", "_from", "_left", F.shiftright(F.col("_h"), shift).alias("_b"))
        hist = hist.agg(F.sum("size").alias("_s"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
        hist = hist.withColumn("_cum", F.sum("_s").over(by_bucket.rowsBetween(W.unboundedPreceding, 0)))
        # The boundary: the first bucket whose end is beyond the budget. A bucket of one hash is settled here.
        edge = hist.filter(F.col("_cum") > F.col("_left")).groupBy("source").agg(F.min_by(F.struct("_b", "_s", "_lo", "_hi", "_cum"), "_b").alias("_e"))
        cuts = _join_source(cuts, edge, n_sources)
        before = F.col("_e._cum") - F.col("_e._s")
        single = F.col("_e._lo") == F.col("_e._hi")
        goes = before + F.col("_e._s") / 2 <= F.col("_left")
        cuts = cuts.select(
            "source", "source_size", "target", "_whole",
            F.when(~F.col("_open") | F.col("_e").isNotNull(), F.col("_left") - F.when(F.col("_open"), before).otherwise(0)).otherwise(F.col("_left")).alias("_left"),
            F.when(~F.col("_open"), F.col("_from"))
            .when(F.col("_e").isNull(), F.lit(1 << HASH_BITS))
            .when(single, F.col("_e._lo") + F.when(goes, 1).otherwise(0))
            .otherwise(F.shiftleft(F.col("_e._b"), shift)).alias("_from"),
            (F.col("_open") & F.coalesce(~single, F.lit(False))).alias("_open"),
        )
        cuts = tmp.save(cuts, f"cuts{level}")
        if not cuts.filter("_open").head(1):
            break
    tmp.keep("rows", f"cuts{level}")
    return rows, cuts.select("source", "source_size", "target", "_whole", "_from"), n_sources


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, passes (times the document is taken), taken.

    Options: weights (3, 1, 2), share (1.5), most (2.0), id_col, text_col, source_col. A document of a source with target T
    and size S is taken floor(T / S) times, and once more if its hash falls in the partial pass: the sizes of the source's
    documents with smaller hashes, plus half its own (equal hashes stand or fall together), fit in T - floor(T / S) * S. The
    taken words so miss the target by at most half of one document. Null and empty texts have size 0 and take nothing. A null
    source is a source of its own, last in order. Repeated rows share a hash, hence a fate. An empty table gives no rows.
    Other columns are neither read nor kept.
    """
    rows, cuts, n_sources = cuts_of(docs, **options)
    out = _join_source(rows, cuts, n_sources).withColumn("passes", _passes(F.col("_h")))
    return out.select("doc_id", "source", "size", "source_size", "target", "passes", (F.col("passes") * F.col("size")).alias("taken"))


def _passes(h: Column) -> Column:
    return F.col("_whole") + F.when(h < F.col("_from"), 1).otherwise(0)


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with its columns. Rows that share an id share a fate. A row's
    own hash and its source's threshold decide, so that texts are not moved."""
    _, cuts, n_sources = cuts_of(docs, id_col=id_col, source_col=source_col, **options)
    cuts = cuts.select(F.col("source").alias("_cut_source"), "_whole", "_from")
    cuts = F.broadcast(cuts) if n_sources <= BROADCAST_SOURCES else cuts
    names = list(docs.columns)
    held = docs.select(*[F.col(c).alias(f"_doc{k}") for k, c in enumerate(names)])
    own = lambda c: F.col(f"_doc{names.index(c)}")
    out = held.join(cuts, own(source_col).cast("string").eqNullSafe(F.col("_cut_source"))).withColumn("_passes", _passes(hash60(own(id_col)))).filter("_passes > 0")
    return out.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_passes").cast("long")))).select(*[F.col(f"_doc{k}").alias(c) for k, c in enumerate(names)])
