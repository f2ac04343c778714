"""Approximate nearest neighbours by learned partitions.

On a bounded sample: the neighbour graph is cut into balanced partitions that few edges cross; a small network learns to
tell from a vector how its neighbours spread over the partitions; the number of partitions to search is the least that
reaches the wanted recall on sample queries. Then every vector is put into its most probable partition, and a query is
compared, exactly, with all vectors of its most probable ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch


@dataclass(frozen=True)
class AnnParams:
    """sample: vectors that the index is fitted on; one in share of all vectors, if these are more, up to most_sample. cell:
    sample vectors in a partition, so that partitions grow in number with the corpus, from 32 to 256. recall: wanted on the
    sample."""

    sample: int = 8192
    share: int = 64
    most_sample: int = 65_536
    cell: int = 256
    most_partitions: int = 256
    neighbours: int = 16
    hidden: int = 96
    epochs: int = 25
    recall: float = 0.97
    slack: float = 1.1
    seed: int = 1
    block_rows: int = 8192
    block_queries: int = 2048


class Router:
    """A network with one hidden layer: vector -> probabilities of partitions."""

    def __init__(self, mean, scale, w1, b1, w2, b2, probes: int):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.probes = mean, scale, w1, b1, w2, b2, probes

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.mean) * self.scale) @ self.w1 + self.b1, 0.0) @ self.w2 + self.b2


def knn(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row, in blocks."""
    norm = (x * x).sum(1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        d = norm[None, :] - 2 * x[at : at + 512] @ x.T
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float, rng: np.random.Generator) -> np.ndarray:
    """A partition of the graph into parts of at most slack times the mean size: a start from balanced centres, then moves
    of single vertices to where most of their neighbours are, while there is room."""
    n = len(x)
    room = int(np.ceil(n / parts * slack))
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(6):
        d = (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
        best = np.sort(d, 1)
        part, size = np.full(n, -1), np.zeros(parts, np.int64)
        for i in np.argsort(best[:, 0] - best[:, min(1, parts - 1)]):
            for q in np.argsort(d[i]):
                if size[q] < room:
                    part[i], size[q] = q, size[q] + 1
                    break
        centres = np.array([x[part == q].mean(0) if size[q] else x[rng.integers(n)] for q in range(parts)])
    ends = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    starts = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    order = np.argsort(starts, kind="stable")
    ends, cut = ends[order], np.searchsorted(starts[order], np.arange(n + 1))
    for _ in range(8):
        moved = 0
        for i in rng.permutation(n):
            near = np.bincount(part[ends[cut[i] : cut[i + 1]]], minlength=parts)
            near[(size >= room) & (np.arange(parts) != part[i])] = -1
            q = int(near.argmax())
            if near[q] > near[part[i]]:
                size[part[i]] -= 1
                size[q] += 1
                part[i] = q
                moved += 1
        if moved < n // 200:
            break
    return part


def train(x: np.ndarray, p: AnnParams, k: int) -> Router:
    """Fit partitions and router on sample vectors."""
    rng = np.random.default_rng(p.seed)
    n, dim = x.shape
    parts = int(min(p.most_partitions, max(1, n // p.cell)))
    mean, scale = x.mean(0), 1.0 / np.maximum(x.std(0), 1e-12)
    if parts < 2 or n <= p.neighbours + 1:
        return Router(mean, scale, np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = knn(x, p.neighbours)
    part = balanced_parts(x, graph, parts, p.slack, rng)
    goal = np.zeros((n, parts))
    np.add.at(goal, (np.repeat(np.arange(n), p.neighbours), part[graph.ravel()]), 1.0)
    goal[np.arange(n), part] += p.neighbours / 4
    goal /= goal.sum(1, keepdims=True)
    z = (x - mean) * scale
    ws = [rng.normal(0, np.sqrt(2 / dim), (dim, p.hidden)), np.zeros(p.hidden), rng.normal(0, np.sqrt(1 / p.hidden), (p.hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(w) for w in ws], [np.zeros_like(w) for w in ws], 0
    for epoch in range(p.epochs):
        for at in np.split(rng.permutation(n), np.arange(256, n, 256)):
            h = np.maximum(z[at] @ ws[0] + ws[1], 0)
            s = h @ ws[2] + ws[3]
            s = np.exp(s - s.max(1, keepdims=True))
            e = (s / s.sum(1, keepdims=True) - goal[at]) / len(at)
            back = (e @ ws[2].T) * (h > 0)
            t += 1
            rate = 3e-3 * (1 - epoch / p.epochs) + 1e-4
            for i, g in enumerate((z[at].T @ back, back.sum(0), h.T @ e, e.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                ws[i] = ws[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    router = Router(mean, scale, *ws, 1)
    # The least number of partitions with the wanted recall, by sample queries against the sample.
    asked = rng.choice(n, min(n, 500), replace=False)
    order = np.argsort(-router.scores(x), axis=1)
    home, near = order[:, 0], knn(x, min(k, n - 1))[asked]
    place = np.argsort(order[asked], axis=1)
    ranks = np.take_along_axis(place, home[near], 1)
    router.probes = int(min(parts, 1 + np.quantile(ranks, p.recall, method="higher")))
    return router


def _usable(vec: Column, dim: int) -> Column:
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vec.isNotNull() & (F.size(vec) == dim) & finite & F.exists(vec, lambda v: v != 0)


def _nearest(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of each query, exactly. Squared distances by products only preselect; all within rounding of the
    k-th are measured again."""
    ids, x = rows["vec_id"].to_numpy(), np.vstack(rows["vec"].to_numpy())
    norm = (x * x).sum(1)
    out = []
    for at in range(0, len(queries), 256):
        part = queries.iloc[at : at + 256]
        q = np.vstack(part["vec"].to_numpy())
        own = (q * q).sum(1)
        d = norm[None, :] - 2 * q @ x.T + own[:, None]
        far = np.partition(d, min(k, len(x) - 1), axis=1)[:, : k + 1].max(1) + 1e-9 * (norm.max() + own)
        for i, name in enumerate(part["query_id"].to_numpy()):
            near = np.flatnonzero((d[i] <= far[i]) & (ids != name))
            score = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
            best = np.lexsort((ids[near], score))[:k]
            out.append(pd.DataFrame({"query_id": name, "vec_id": ids[near][best], "score": score[best]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(vectors: DataFrame, is_query: Column, k: int = 10, params: AnnParams = AnnParams(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, searched): the k nearest rows found for each row of vectors where is_query holds, itself
    excepted; score is the Euclidean distance in double precision, ties go to the smaller id; searched is the part of all
    partitions that a query looks into. A query whose partitions hold fewer than k rows is asked of all partitions.

    Vectors that are null, zero, of another length than most of the sample, or with a null or non-finite component, and
    rows with a null id, take no part. Rows that share an id are not neighbours of each other; a repeated row counts once.
    Queries and rows of a partition meet block by block, so that a crowded partition is many tasks. Empty tables give no rows.
    """
    spark, p = vectors.sparkSession, params
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("_q"))
    # A sample by the hash of the id; the threshold keeps what is sorted near the sample's size.
    total = rows.count()
    key = F.xxhash64("vec_id", F.lit(p.seed))
    size = min(p.most_sample, max(p.sample, total // p.share))
    taken = rows.filter(F.col("vec").isNotNull() & (F.pmod(key, F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.5 * size / max(1, total)))))
    got = taken.orderBy(key, "vec_id").limit(size).select("vec").toPandas()["vec"].tolist()
    dims = pd.Series([len(v) for v in got], dtype="int64")
    dim = int(dims.mode().max()) if len(dims) else 0
    got = np.array([np.asarray(v, float) for v in got if len(v) == dim and not any(a is None for a in v)]).reshape(-1, max(dim, 1))
    got = got[np.isfinite(got).all(1) & (got != 0).any(1)] if len(got) else got
    router = train(np.unique(got, axis=0), p, k) if len(got) else Router(np.zeros(dim), np.ones(dim), np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    shared = spark.sparkContext.broadcast(router)

    @F.pandas_udf("array<int>")
    def route(vecs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        r = shared.value
        for batch in vecs:
            s = r.scores(np.vstack(batch.to_numpy())) if len(batch) else np.empty((0, 1))
            yield pd.Series(list(np.argsort(-s, axis=1, kind="stable")[:, : r.probes].astype(np.int32)))

    rows = rows.filter(_usable(F.col("vec"), dim)).dropDuplicates(["vec_id", "vec"]).withColumn("_parts", route("vec"))
    rows = Scratch(spark, "ann").save(rows, "routed")
    # One short row for each partition, most_partitions at most.
    sizes = {r["p"]: r["n"] for r in rows.groupBy(F.get("_parts", F.lit(0)).alias("p")).agg(F.count("*").alias("n")).collect()}
    tmp = Scratch(spark, "ann-found")
    found = tmp.save(_meet(rows, rows.filter("_q"), sizes, k, p), "found")
    # Queries that found too few, though there are more rows to find: these look everywhere.
    enough = min(k, sum(sizes.values()) - 1)
    full = found.groupBy("query_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= enough).select(F.col("query_id").alias("_full"))
    short = rows.filter("_q").join(full, F.col("vec_id") == F.col("_full"), "left_anti") if enough > 0 else rows.filter("false")
    short = tmp.save(short, "short")
    if short.head(1):
        wide = short.withColumn("_parts", F.array(*[F.lit(q) for q in sorted(sizes)]).cast("array<int>"))
        found = found.union(_meet(rows, wide, sizes, k, p)).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")).cast("int"))
    searched = router.probes / max(1, router.w2.shape[1])
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.lit(float(searched)).alias("searched"))


def _meet(rows: DataFrame, queries: DataFrame, sizes: dict[int, int], k: int, p: AnnParams) -> DataFrame:
    """(query_id, vec_id, score): the k nearest rows of each query (vec_id, vec, _parts) in each block of its partitions."""
    asked = {r["p"]: r["n"] for r in queries.select(F.explode("_parts").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    parts = sorted(set(sizes) & set(asked))
    row_blocks = F.create_map(*[F.lit(x) for q in parts for x in (q, -(-sizes[q] // p.block_rows))]) if parts else F.create_map(F.lit(0), F.lit(1))
    query_blocks = F.create_map(*[F.lit(x) for q in parts for x in (q, -(-asked[q] // p.block_queries))]) if parts else F.create_map(F.lit(0), F.lit(1))
    block = lambda name, n: F.pmod(F.xxhash64(F.lit(name), "vec_id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.withColumn("p", F.get("_parts", F.lit(0))).withColumn("_n", F.try_element_at(row_blocks, F.col("p"))).filter("_n is not null")
    left = left.withColumn("rb", block("r", F.col("_n"))).withColumn("qb", each(F.element_at(query_blocks, F.col("p")))).select("p", "rb", "qb", "vec_id", "vec")
    right = queries.withColumn("p", F.explode("_parts")).withColumn("_n", F.try_element_at(query_blocks, F.col("p"))).filter("_n is not null")
    right = right.withColumn("qb", block("q", F.col("_n"))).withColumn("rb", each(F.element_at(row_blocks, F.col("p")))).select("p", "rb", "qb", F.col("vec_id").alias("query_id"), "vec")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _nearest(a, b, k).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"}) if len(a) and len(b) else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    found = left.groupBy("p", "rb", "qb").cogroup(right.groupBy("p", "rb", "qb")).applyInPandas(compare, "query_id long, vec_id long, score double")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
