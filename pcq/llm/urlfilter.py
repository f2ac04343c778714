"""URL filtering by association rules, with DataFrame functions and Spark's FP-growth only.

A list of host and path rules judges the urls that it covers. Those verdicts are the labels: FP-growth mines the
combinations of url tokens that come with them, rules of enough support and confidence remain, and they judge the rest.
A url meets a rule through an inverted index: each rule is posted under the rarest of its tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# Fixed values: (verdict, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@dataclass(frozen=True)
class UrlParams:
    """support: of all labelled urls, the part that a rule must be right about. most_tokens: in a rule's condition."""

    support: float = 0.005
    confidence: float = 0.8
    most_tokens: int = 3
    default: str = "allow"
    #: Up to so many mined rules are broadcast; beyond, they are joined by shuffle.
    broadcast_rules: int = 20_000
    #: Up to so many judged token sets (some hundred bytes each) are broadcast; beyond, they are joined by shuffle.
    broadcast_sets: int = 100_000


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Marked tokens: scheme, the host's labels and its last two together, path segments with numbers made alike, the
    suffix of the last segment, names of parameters, and whether there is a fragment."""
    url = F.lower(F.coalesce(url, F.lit("")))
    mark = lambda name, arr: F.transform(F.filter(arr, lambda x: x != ""), lambda x: F.concat(F.lit(name), F.regexp_replace(x, r"[0-9]+", "0")))
    labels, segments = F.split(host, r"\."), F.split(F.lower(path), "/")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    parts = [
        mark("scheme=", F.array(F.regexp_extract(url, r"^([a-z][a-z0-9+.-]*)://", 1))),
        mark("host=", labels),
        mark("site=", F.array(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))),
        mark("path=", segments),
        mark("suffix=", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)/?$", 1))),
        mark("param=", F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0])),
        F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    ]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def listed(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits: its host or a subdomain, and a path that starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        cut = (r + "/").index("/")
        fits = ((host == r[:cut]) | host.endswith("." + r[:cut])) & path.startswith(r[cut:])
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def mine(labelled: DataFrame, params: UrlParams = UrlParams()) -> DataFrame:
    """labelled(tokens, verdict) -> rules (antecedent, verdict, confidence, hits, under): hits is how often a rule is
    right, under its rarest token. A rule is dropped if a part of its condition implies as much with no less confidence."""
    p, spark = params, labelled.sparkSession
    empty = spark.createDataFrame([], "antecedent array<string>, verdict string, confidence double, hits long, under string")
    n = labelled.count()
    if not n:
        return empty
    mark = "verdict="
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(mark), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=p.support, minConfidence=p.confidence).fit(baskets)
    tmp = Scratch(spark, "rules")
    sets = tmp.save(model.freqItemsets, "sets")
    is_label = lambda x: x.startswith(mark)
    split = sets.select(F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("antecedent"), F.filter("items", is_label).alias("_l"), "freq")
    split = split.filter((F.size("antecedent") >= 1) & (F.size("antecedent") <= p.most_tokens) & (F.size("_l") <= 1))
    bare = split.filter(F.size("_l") == 0).select(F.col("antecedent").alias("_a"), F.col("freq").alias("_n"))
    right = split.filter(F.size("_l") == 1).select("antecedent", F.substring(F.get("_l", F.lit(0)), len(mark) + 1, 1000).alias("verdict"), F.col("freq").alias("hits"))
    rules = right.join(bare, right["antecedent"] == bare["_a"]).withColumn("confidence", F.col("hits") / F.col("_n")).filter(F.col("confidence") >= p.confidence)
    rules = tmp.save(rules.select("antecedent", "verdict", "confidence", "hits"), "all")
    # Proper parts of up to three tokens: each one, and each with one left out.
    parts = F.array_distinct(F.concat(F.transform("antecedent", lambda x: F.array(x)), F.transform("antecedent", lambda x: F.array_remove("antecedent", x))))
    parts = F.filter(parts, lambda a: (F.size(a) > 0) & (F.size(a) < F.size("antecedent")))
    whole = rules.select(F.col("antecedent").alias("_a"), F.col("verdict").alias("_v"), F.col("confidence").alias("_c"))
    asked = rules.withColumn("_part", F.explode(parts))
    worse = asked.join(whole, (asked["_part"] == whole["_a"]) & (asked["verdict"] == whole["_v"]) & (whole["_c"] >= asked["confidence"]))
    worse = worse.select(F.col("antecedent").alias("_wa"), F.col("verdict").alias("_wv")).distinct()
    kept = rules.join(worse, (rules["antecedent"] == worse["_wa"]) & (rules["verdict"] == worse["_wv"]), "left_anti")
    single = bare.filter(F.size("_a") == 1).select(F.get("_a", F.lit(0)).alias("_t"), "_n")
    each = kept.withColumn("_x", F.explode("antecedent"))
    each = each.join(single, each["_x"] == single["_t"])
    out = each.groupBy("antecedent", "verdict", "confidence", "hits").agg(F.min(F.struct("_n", "_t")).alias("_r"))
    return tmp.save(out.select("antecedent", "verdict", "confidence", "hits", F.col("_r._t").alias("under")), "rules")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, params: UrlParams = UrlParams(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (null if none fits), verdict, confidence (1 for listed urls; of
    the mined rule otherwise; 0 where none fires and the default stands), because (the mined rule's tokens).

    Of the mined rules that fire, the most confident decides, then the one more often right, then the first in order.
    Null urls and urls without :// have an empty host and path and are judged by what tokens they have. Repeated rows
    are judged alike; an empty table gives no rows. Other columns are not read.
    """
    spark = pages.sparkSession
    tmp = Scratch(spark, "urls")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    rows = rows.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_v", verdict).withColumn("tokens", tokens_of(F.col("_url"), F.col("host"), F.col("path")))
    rows = tmp.save(rows.drop("_url").withColumn("_key", F.array_join("tokens", " ")), "rows")
    mined = mine(rows.filter("_v is not null").select("tokens", F.col("_v").alias("verdict")), params)
    small = mined.count() <= params.broadcast_rules
    # Urls with the same tokens are judged once.
    asked = rows.filter("_v is null").groupBy("_key").agg(F.first("tokens").alias("tokens"))
    met = asked.withColumn("_t", F.explode("tokens")).join(F.broadcast(mined) if small else mined, F.col("_t") == F.col("under"))
    met = met.filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("hits")).alias("h"), F.col("antecedent").alias("a"), F.col("verdict").alias("v")))
    best = tmp.save(met.groupBy(F.col("_key").alias("_k")).agg(best.alias("_b")), "best")
    # One row for each different set of tokens that a rule fits: a common set would crowd one task of a shuffled join.
    best = F.broadcast(best) if best.count() <= params.broadcast_sets else best
    out = rows.join(best, (rows["_key"] == best["_k"]) & rows["_v"].isNull(), "left")
    listed_here = F.col("_v").isNotNull()
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("_v", "_b.v", F.lit(params.default)).alias("verdict"),
        F.when(listed_here, 1.0).otherwise(F.coalesce(-F.col("_b.c"), F.lit(0.0))).alias("confidence"),
        F.array_join("_b.a", " ").alias("because"),
    )
