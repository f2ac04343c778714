"""Benchmark decontamination with DataFrame functions only.

Windows of a document that are as long as some benchmark item get a SimHash of their word shingles. Hamming blocks then find
the items of that length whose fingerprints lie within the radius: of 8 bytes, one differs in at most radius // 8 bits, so
items are indexed under their length, each byte, and every value within that many bits, and a window looks up its 8 bytes as
they are. No item within the radius is missed. The exact similarity, the weighted Jaccard of the two multisets of shingles,
verifies each candidate.

Windows that cannot reach the similarity with any item of their length are not built: similarity s needs at least s * n of a
window's n shingles to be shingles of items of that length, wherever they come from. This loses none, and says nothing about
which item it is.

Items of fewer than five words match whole texts only: they are one hash, and longer texts have hashes of five words.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Words are runs of letters and digits, lower-cased, so that punctuation and case do not hide a passage.
NOT_WORD = r"[^\p{L}\p{N}]+"
SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 23
#: Up to so many rows (two longs and two ints each) benchmark shingles are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def shingle_hashes(w: Column, size: int = SHINGLE) -> Column:
    """Hashes of all shingles in order, repeats included; a text shorter than one shingle is one; no words, no shingle."""
    each = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    return F.when(F.size(w) >= size, each).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))


def simhash(h: Column) -> Column:
    """The bits set in over half of the hashes, as a long."""
    at = lambda x, b: F.call_function("shiftrightunsigned", x, b).bitwiseAND(F.lit(1)).cast("int")
    over = lambda b: F.aggregate(h, F.lit(0), lambda n, x: n + at(x, b)) * 2 > F.size(h)
    one = lambda b: F.when(over(b), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda out, b: out.bitwiseOR(one(b)))


def byte(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255)).cast("int")


def common_weight(a: Column, b: Column) -> Column:
    """The weight two multisets share: for each shingle the smaller of its two counts."""
    count = lambda h, x: F.size(F.filter(h, lambda y: y == x))
    return F.aggregate(F.array_distinct(b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): for each document and item the best, then first, window of the
    item's length that reaches the similarity; start counts words from 0.

    A document shorter than the item is one window as a whole. Null and empty texts, and items without a word, match
    nothing. Rows with null ids take part and report a null id. Repeated rows of documents or items report once. Empty
    tables give no rows. Other columns are not read; names that clash between the tables do not matter.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "decontaminate")
    items = benchmark.select(F.col(item_col).alias("item_id"), word_array(F.col(item_text_col)).alias("_w")).filter(F.size("_w") > 0).distinct()
    items = items.select("item_id", F.size("_w").alias("_words"), shingle_hashes(F.col("_w")).alias("_item"))
    items = items.withColumn("_ik", F.xxhash64("item_id", "_item")).withColumn("_n", F.size("_item"))
    items = tmp.save(items.withColumn("_ifp", simhash(F.col("_item"))), "items")
    # The shingles of all items of a length (in words), whichever item they are of.
    parts = tmp.save(items.select("_words", "_n", F.explode("_item").alias("_h")).distinct(), "parts")
    small = parts.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)

    # A row is known by its id and its text, so rows that share an id (or have none) stay apart.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).withColumn("_dk", F.xxhash64("doc_id", "_text"))

    def shingled(df: DataFrame) -> DataFrame:
        df = df.withColumn("_w", word_array(F.col("_text")))
        return df.select("doc_id", "_dk", F.size("_w").alias("_len"), shingle_hashes(F.col("_w")).alias("_doc"))

    # The outer form keeps the optimiser from testing the array's size in the scan, which would work it out twice.
    at = shingled(texts).select("_dk", "_len", F.posexplode_outer("_doc").alias("_pos", "_dh"))
    hits = at.join(hint(parts), at["_dh"] == parts["_h"]).groupBy("_dk", "_len", "_n", "_words").agg(F.array_sort(F.collect_set("_pos")).alias("_hits"))
    # From a hit, `_need` hits must lie within the window's _n places; the window starts at most _n - _need before it.
    need = F.greatest(F.lit(1), F.ceil(F.lit(similarity) * F.least("_n", F.greatest(F.col("_len") - SHINGLE + 1, F.lit(1)))).cast("int"))
    hits = hits.withColumn("_need", need)
    seeds = F.filter("_hits", lambda p, i: F.get(F.col("_hits"), i + F.col("_need") - 1) <= p + F.col("_n") - 1)
    last = F.greatest(F.col("_len") - F.col("_words"), F.lit(0))
    spread = lambda p: F.sequence(F.least(last, F.greatest(F.lit(0), p - (F.col("_n") - F.col("_need")))), F.least(last, p))
    starts = hits.withColumn("_starts", F.array_distinct(F.flatten(F.transform(seeds, spread)))).filter(F.size("_starts") > 0)
    starts = tmp.save(starts.select("_dk", "_words", "_n", "_starts"), "starts")

    # The second pass builds windows for the few documents that have any.
    found = starts.select("_dk").distinct()
    few = found.count() <= BROADCAST_ROWS
    chosen = shingled(texts.join((F.broadcast if few else (lambda df: df))(found), "_dk", "left_semi").dropDuplicates(["_dk"]))
    windows = chosen.join(starts, "_dk").select("doc_id", "_dk", "_words", "_n", "_doc", F.explode("_starts").alias("start"))
    windows = windows.withColumn("_win", F.slice("_doc", F.col("start") + 1, F.col("_n"))).drop("_doc")
    windows = tmp.save(windows.withColumn("_fp", simhash(F.col("_win"))), "windows")
    ball = [sum(1 << b for b in bits) for k in range(radius // 8 + 1) for bits in combinations(range(8), k)]
    keys = F.array(*[F.struct(F.lit(k).alias("k"), byte(F.col("_ifp"), k).alias("v")) for k in range(8)])
    index = items.select("_ik", "_ifp", "_words", F.explode(keys).alias("_b"), F.lit(ball).alias("_ball")).select("_ik", "_ifp", "_words", F.col("_b.k").alias("_k"), F.col("_b.v").alias("_v"), F.explode("_ball").alias("_x"))
    index = index.select("_ik", "_ifp", F.col("_words").alias("_jw"), F.col("_k").alias("_jb"), F.col("_v").bitwiseXOR(F.col("_x")).alias("_jv"))
    probes = F.array(*[F.struct(F.lit(k).alias("k"), byte(F.col("_fp"), k).alias("v")) for k in range(8)])
    probed = windows.withColumn("_p", F.explode(probes))
    near = probed.join(index, (probed["_words"] == index["_jw"]) & (probed["_p.k"] == index["_jb"]) & (probed["_p.v"] == index["_jv"]))
    apart = F.col("_fp").bitwiseXOR(F.col("_ifp"))
    # A pair that meets under several bytes counts under the first of them.
    meets = F.coalesce(*[F.when(F.bit_count(byte(apart, k)) <= radius // 8, k) for k in range(8)])
    near = near.filter((F.bit_count(apart) <= radius) & (meets == F.col("_p.k"))).select("doc_id", "_ik", "start", "_win")
    tmp.keep("items", "windows")
    full = items.select(F.col("_ik").alias("_fk"), "item_id", "_item", "_words")
    verified = near.join(full, near["_ik"] == full["_fk"]).withColumn("_both", common_weight(F.col("_win"), F.col("_item")))
    verified = verified.withColumn("similarity", F.col("_both") / (F.size("_win") + F.size("_item") - F.col("_both"))).filter(F.col("similarity") >= similarity)
    best = verified.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), F.col("_words").alias("w"))).alias("_best"))
    return best.select("doc_id", "item_id", F.col("_best.similarity").alias("similarity"), (-F.col("_best.s")).cast("int").alias("start"), F.col("_best.w").alias("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose id is not that of a contaminated document; all columns stay. Null ids are compared as equal."""
    hit = contaminated(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("_hit")).distinct()
    hit = Scratch(docs.sparkSession, "decontaminated").save(hit, "hit")
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit
    return docs.join(hit, docs[id_col].eqNullSafe(hit["_hit"]), "left_anti")
