"""Language-model scoring by a hierarchical Pitman-Yor model of word pairs.

Each word has a restaurant for what follows it; all restaurants share one parent, and the parent draws from a base in
which every draw is a new word. In a restaurant a dish (the next word) is served at some tables; each table is a customer
of the parent. Numbers of tables are sampled by Gibbs: a dish's tables given all others, the parent held for a round of
sweeps, then counted anew. The predictive probability is the mean over the samples kept.

Data moves as compressed arrays. Documents form chunks with their own numbering of words. Words are counted in shards by
hash, which number them; pairs are counted in shards by first word, and those of very frequent first words by both. Each
shard answers every chunk in the chunk's own order, so no hashes travel back, and what a task holds is bounded by the
size of a chunk or a shard; the numbers of both grow with the corpus.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions

END = b"\n"  # no word holds white space


@dataclass(frozen=True)
class LmParams:
    chunk_tokens: int = 1_500_000
    shard_tokens: int = 2_500_000
    #: Rounds of sweeps; the first `burn` of them are not kept, each of the others gives a sample.
    rounds: int = 3
    burn: int = 1
    sweeps: int = 3
    theta: float = 1.0
    #: Dishes of up to so many customers are sampled from their exact conditional, larger ones from its limit.
    exact: int = 512
    seed: int = 10


def pack(**arrays) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def unpack(raw: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(raw))


def _rise(sorted_ids: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers, which pack better."""
    return np.diff(sorted_ids, prepend=sorted_ids.dtype.type(0))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _chunks(batches: Iterator[pd.DataFrame], shards: int, most: int) -> Iterator[pd.DataFrame]:
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    seqs, names, train, size, k = [], [], [], 0, 0
    task = TaskContext.get().partitionId()

    def row() -> pd.DataFrame:
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in number], np.uint64)
        shard = (hashes % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        lengths = np.array([len(s) for s in seqs], np.int64)
        body = pack(seq=place[np.concatenate(seqs)], lengths=lengths, train=np.array(train, bool), end=int(place[number[END]]))
        counts = np.bincount(place[np.concatenate([s for s, t in zip(seqs, train, strict=True) if t] or [np.empty(0, np.int64)])].astype(np.int64), minlength=len(order))
        sizes = np.bincount(shard, minlength=shards)
        words = pack(hashes=hashes[order], counts=counts.astype(np.uint32), sizes=sizes)
        return pd.DataFrame({"kind": ["chunk", "words"], "chunk": [task << 20 | k] * 2, "docs": [names, None], "body": [body, words]})

    for batch in batches:
        for name, text, learn in zip(batch["_id"], batch["_text"], batch["_train"], strict=True):
            if size >= most:
                yield row()
                number.clear()
                seqs, names, train, size, k = [], [], [], 0, k + 1
            seqs.append(np.array([*map(number.__getitem__, words_of(text)), number[END]], np.int64))
            names.append(None if pd.isna(name) else int(name))
            train.append(bool(learn))
            size += len(seqs[-1])
    if seqs:
        yield row()


def _split_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for chunk, raw in zip(batch["chunk"], batch["body"], strict=True):
            w = unpack(raw)
            cut = np.concatenate(([0], np.cumsum(w["sizes"])))
            rows = [(s, chunk, pack(h=w["hashes"][cut[s] : cut[s + 1]], c=w["counts"][cut[s] : cut[s + 1]])) for s in np.flatnonzero(w["sizes"])]
            yield pd.DataFrame(rows, columns=["shard", "chunk", "body"])


def _count_words(rows: pd.DataFrame, shards: int) -> pd.DataFrame:
    """One shard of words: numbers (local number * shards + shard) and training counts, in each chunk's order; and, in the
    row of chunk -1, what the shard holds."""
    rows = rows.sort_values("chunk")
    shard = int(rows["shard"].iloc[0])
    parts = [unpack(b) for b in rows["body"]]
    known, where = np.unique(np.concatenate([p["h"] for p in parts]), return_inverse=True)
    count = np.bincount(where, weights=np.concatenate([p["c"] for p in parts]), minlength=len(known)).astype(np.int64)
    ids = np.arange(len(known), dtype=np.uint64) * np.uint64(shards) + np.uint64(shard)
    if len(ids) and ids[-1] >= 1 << 32:
        raise ValueError("more words than 32-bit numbers")
    out, at = [], 0
    for chunk, p in zip(rows["chunk"], parts, strict=True):
        own = where[at : at + len(p["h"])]
        at += len(own)
        out.append((shard, int(chunk), pack(id=ids[own].astype(np.uint32), c=count[own])))
    top = np.argsort(-count)[:1024]
    out.append((shard, -1, pack(types=int((count > 0).sum()), tokens=int(count.sum()), top=ids[top].astype(np.uint32), top_count=count[top])))
    return pd.DataFrame(out, columns=["shard", "chunk", "body"])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _pair_shards(pairs: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    first = pairs >> np.uint64(32)
    key = np.where(np.isin(first.astype(np.uint32), hot), pairs, first)
    return (_mix(key) % np.uint64(shards)).astype(np.int64)


def _chunk_pairs(seq: np.ndarray, lengths: np.ndarray, end: int, ids: np.ndarray) -> np.ndarray:
    """Each token's pair (word before << 32 | word); a text's first token stands after the end."""
    before = np.empty_like(seq)
    before[1:] = seq[:-1]
    before[np.cumsum(lengths) - lengths] = end
    return ids[before].astype(np.uint64) << np.uint64(32) | ids[seq].astype(np.uint64)


def _local(rows: pd.DataFrame, kind: str) -> dict[str, np.ndarray]:
    """The answers of all shards of a kind, joined in the chunk's order of words."""
    parts = [unpack(b) for b in rows[rows["kind"] == kind].sort_values("shard")["body"]]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _split_pairs(rows: pd.DataFrame, hot: np.ndarray, shards: int) -> pd.DataFrame:
    c = unpack(rows[rows["kind"] == "chunk"]["body"].iloc[0])
    words = _local(rows, "word")
    pairs = _chunk_pairs(c["seq"], c["lengths"], c["end"], words["id"])
    learn = np.repeat(c["train"], c["lengths"])
    known, where = np.unique(pairs, return_inverse=True)
    count = np.bincount(where[learn], minlength=len(known)).astype(np.uint32)
    shard = _pair_shards(known, hot, shards)
    chunk = int(rows["chunk"].iloc[0])
    out = [(int(s), chunk, pack(d=_rise(known[shard == s]), c=count[shard == s])) for s in np.unique(shard)]
    return pd.DataFrame(out, columns=["shard", "chunk", "body"])


def _count_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard of pairs: its pairs with counts and one table each, and which of them each chunk asks for."""
    rows = rows.sort_values("chunk")
    parts = [unpack(b) for b in rows["body"]]
    each = [np.cumsum(p["d"]) for p in parts]
    known, where = np.unique(np.concatenate(each), return_inverse=True)
    count = np.bincount(where, weights=np.concatenate([p["c"] for p in parts]), minlength=len(known)).astype(np.int64)
    cut = np.cumsum([len(e) for e in each])[:-1]
    asks = [_rise(w.astype(np.int32)) for w in np.split(where, cut)]
    body = pack(d=_rise(known), c=count.astype(np.uint32), chunks=rows["chunk"].to_numpy(), asks=asks)
    return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "body": [body], "tables": [pack(t=np.minimum(count, 1).astype(np.uint32))], "kept": [[]], "n1": [int((count == 1).sum())], "n2": [int((count == 2).sum())]})


def _by_word(batches: Iterator[pd.DataFrame], shards: int) -> Iterator[pd.DataFrame]:
    """What the parent needs: by word shard, each word's tables in this shard of pairs, and whether its number is asked for."""
    for batch in batches:
        for shard, body, tables in zip(batch["shard"], batch["body"], batch["tables"], strict=True):
            s, t = unpack(body), unpack(tables)["t"]
            word = np.cumsum(s["d"]) & np.uint64(0xFFFFFFFF)
            seated = s["c"] > 0
            known, where = np.unique(word[seated], return_inverse=True)
            total = np.bincount(where, weights=t[seated], minlength=len(known)).astype(np.int64)
            ask = np.isin(known, word[s["c"] > 1])
            home = (known % np.uint64(shards)).astype(np.int64)
            rows = [(int(h), int(shard), pack(d=_rise(known[home == h]), t=total[home == h], ask=ask[home == h])) for h in np.unique(home)]
            yield pd.DataFrame(rows, columns=["wshard", "shard", "body"])


def _parent(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard of the parent: its customers by word (the row of shard -1), and the answers to shards of pairs."""
    rows = rows.sort_values("shard")
    home = int(rows["wshard"].iloc[0])
    parts = [unpack(b) for b in rows["body"]]
    each = [np.cumsum(p["d"]) for p in parts]
    known, where = np.unique(np.concatenate(each), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate([p["t"] for p in parts]), minlength=len(known)).astype(np.int64)
    out, at = [], 0
    for shard, p, e in zip(rows["shard"], parts, each, strict=True):
        own = where[at : at + len(e)]
        at += len(e)
        out.append((home, int(shard), pack(d=_rise(e[p["ask"]]), r=total[own][p["ask"]]), 0, 0, 0, 0))
    out.append((home, -1, pack(d=_rise(known), r=total), int(total.sum()), len(known), int((total == 1).sum()), int((total == 2).sum())))
    return pd.DataFrame(out, columns=["wshard", "shard", "body", "customers", "types", "n1", "n2"])


def log_stirling(n: int, d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S[c, t] up to n, by their recursion."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(n):
            stay = s[c] + np.log(np.maximum(c - np.arange(n + 1) * d, 0.0))
            s[c + 1, 1:] = np.logaddexp(s[c, :-1], stay[1:])
    return s


def resample(count: np.ndarray, tables: np.ndarray, others: np.ndarray, base: np.ndarray, d: float, theta: float, exact: int, rng: np.random.Generator) -> np.ndarray:
    """New numbers of tables for dishes of `count` customers each: from the conditional given the restaurant's `others`
    tables and the parent's probability `base`. A dish of one customer has one table."""
    out = tables.copy()
    stirling = log_stirling(exact, d)
    for c in np.unique(count[(count > 1) & (count <= exact)]):
        own = np.flatnonzero(count == c)
        t = np.arange(1, c + 1)
        for at in np.array_split(own, 1 + len(own) * int(c) // 4_000_000):
            grow = np.cumsum(np.log(theta + d * (others[at][:, None] + t - 1)), axis=1)
            w = stirling[c, 1 : c + 1] + t * np.log(base[at])[:, None] + grow
            w = np.cumsum(np.exp(w - w.max(1, keepdims=True)), axis=1)
            out[at] = 1 + (w < rng.random(len(at))[:, None] * w[:, -1:]).sum(1)
    many = np.flatnonzero(count > exact)
    # For many customers S[c, t + 1] / S[c, t] tends to 1 / (d t), and the conditional to a negative binomial of t - 1.
    if len(many):
        extra = rng.negative_binomial(theta / d + others[many] + 1, 1 - np.minimum(base[many], 1 - 1e-9))
        out[many] = np.minimum(1 + extra, count[many])
    return out


def _sweep(rows: pd.DataFrame, hot_tables: dict[int, int], d: float, root_d: float, customers: int, p: LmParams, turn: int) -> pd.DataFrame:
    """A round of Gibbs sweeps over one shard of pairs; its tables are kept as a sample behind the burn-in."""
    state = rows[rows["kind"] == "state"].iloc[0]
    s, t = unpack(state["body"]), unpack(state["tables"])["t"].astype(np.int64)
    pairs, count = np.cumsum(s["d"]), s["c"].astype(np.int64)
    answers = [unpack(b) for b in rows[rows["kind"] == "parent"]["body"]]
    word = np.concatenate([np.cumsum(a["d"]) for a in answers]) if answers else np.empty(0, np.uint64)
    r = np.concatenate([a["r"] for a in answers]) if answers else np.empty(0, np.int64)
    order = np.argsort(word)
    word, r = word[order], r[order]
    many = np.flatnonzero(count > 1)
    if len(many):
        base = (r[np.searchsorted(word, pairs[many] & np.uint64(0xFFFFFFFF))] - root_d) / (p.theta + customers)
        first, place = np.unique(pairs >> np.uint64(32), return_inverse=True)
        elsewhere = np.zeros(len(first))
        now = np.bincount(place, weights=t, minlength=len(first))
        for k, u in enumerate(first.tolist() if len(hot_tables) else []):
            if u in hot_tables:
                elsewhere[k] = max(0, hot_tables[u] - now[k])
        rng = np.random.default_rng([p.seed, turn, int(state["shard"])])
        for _ in range(p.sweeps):
            total = np.bincount(place, weights=t, minlength=len(first)) + elsewhere
            t[many] = resample(count[many], t[many], total[place[many]] - t[many], base, d, p.theta, p.exact, rng)
    new = pack(t=t.astype(np.uint32))
    return pd.DataFrame({"shard": [int(state["shard"])], "body": [state["body"]], "tables": [new], "kept": [[*state["kept"], new] if turn > p.burn else list(state["kept"])], "n1": [0], "n2": [0]})


def _answer_pairs(batches: Iterator[pd.DataFrame], hot_tables: list[dict[int, int]]) -> Iterator[pd.DataFrame]:
    """For each chunk, in the order of its pairs in a shard: counts, and by sample tables of the dish and the restaurant."""
    for batch in batches:
        for shard, body, samples in zip(batch["shard"], batch["body"], batch["kept"], strict=True):
            s = unpack(body)
            first, place = np.unique(np.cumsum(s["d"]) >> np.uint64(32), return_inverse=True)
            kept = []
            for raw, hot in zip(samples, hot_tables, strict=True):
                t = unpack(raw)["t"]
                total = np.bincount(place, weights=t, minlength=len(first)).astype(np.int64)
                for k, u in enumerate(first.tolist() if hot else []):
                    total[k] = hot.get(u, total[k])
                kept.append((t, total[place]))
            for chunk, ask in zip(s["chunks"], s["asks"], strict=True):
                own = np.cumsum(ask)
                answer = pack(c=s["c"][own], **{f"t{k}": t[own] for k, (t, _) in enumerate(kept)}, **{f"u{k}": _rise(u[own]) for k, (_, u) in enumerate(kept)})
                yield pd.DataFrame({"kind": ["pair"], "shard": [int(shard)], "chunk": [int(chunk)], "docs": [None], "body": [answer]})


def _answer_words(rows: pd.DataFrame, samples: int) -> pd.DataFrame:
    """For each chunk, in the order of its words in this shard: the parent's customers, by sample."""
    # A shard has customers in all samples or in none: each dish keeps at least one table.
    roots = [unpack(b) for b in rows[rows["kind"] == "root"].sort_values("turn")["body"]]
    roots = [(np.cumsum(x["d"]), x["r"]) for x in roots]
    out = []
    asked = rows[rows["kind"] == "word"]
    for shard, chunk, raw in zip(asked["shard"], asked["chunk"], asked["body"], strict=True):
        ids = unpack(raw)["id"].astype(np.uint64)
        got = {f"r{k}": np.zeros(len(ids), np.int64) for k in range(samples)}
        for k, (known, r) in enumerate(roots):
            at = np.minimum(np.searchsorted(known, ids), max(0, len(known) - 1))
            got[f"r{k}"] = np.where(known[at] == ids, r[at], 0) if len(known) else np.zeros(len(ids), np.int64)
        out.append(("root", int(shard), int(chunk), None, pack(**got)))
    return pd.DataFrame(out, columns=["kind", "shard", "chunk", "docs", "body"])


def _score(rows: pd.DataFrame, p: LmParams, d: float, roots: list[tuple[int, int, float]], tokens: int, types: int, hot: np.ndarray, shards: int) -> pd.DataFrame:
    own = rows[rows["kind"] == "chunk"].iloc[0]
    c = unpack(own["body"])
    words, root = _local(rows, "word"), _local(rows, "root")
    seq, lengths = c["seq"], c["lengths"]
    pairs = _chunk_pairs(seq, lengths, c["end"], words["id"])
    known, where = np.unique(pairs, return_inverse=True)
    shard = _pair_shards(known, hot, shards)
    answers = {int(r.shard): unpack(r.body) for r in rows[rows["kind"] == "pair"].itertuples()}
    order = np.argsort(shard, kind="stable")
    sizes = [int(s) for s in np.unique(shard)]
    joined = {k: np.concatenate([np.cumsum(answers[s][k]) if k[0] == "u" else answers[s][k] for s in sizes]).astype(np.float64) for k in answers[sizes[0]]}
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    joined = {k: v[back] for k, v in joined.items()}
    # One probability for each different pair of the chunk.
    first_of = np.empty(len(known), np.int64)
    first_of[where[::-1]] = np.arange(len(seq))[::-1]
    last = seq[first_of]
    start = np.zeros(len(seq), bool)
    start[np.cumsum(lengths) - lengths] = True
    before = np.where(start[first_of], c["end"], seq[np.maximum(first_of - 1, 0)])
    context = words["c"][before].astype(np.float64)
    prob = np.zeros(len(known))
    for k, (customers, dishes, root_d) in enumerate(roots):
        r = root[f"r{k}"][last].astype(np.float64)
        parent = np.where(r > 0, r - root_d, p.theta + root_d * dishes) / (p.theta + customers)
        direct = np.where(joined["c"] > 0, joined["c"] - d * joined[f"t{k}"], 0.0)
        prob += np.where(context > 0, (direct + (p.theta + d * joined[f"u{k}"]) * parent) / (p.theta + context), parent) / len(roots)
    count = words["c"][seq]
    base = np.log10((count + 0.1) / (tokens + 0.1 * (types + 1)))
    cut = np.cumsum(lengths) - lengths
    return pd.DataFrame(
        {
            "doc_id": pd.array([None if pd.isna(x) else int(x) for x in own["docs"]], "Int64"), "held_out": ~c["train"], "n_tokens": lengths, "n_known": np.add.reduceat((count > 0).astype(np.int64), cut),
            "train_tokens": tokens, "base_score": np.add.reduceat(base, cut), "score": np.add.reduceat(np.log10(prob)[where], cut),
        }
    )


def score(docs: DataFrame, learn: Column, params: LmParams = LmParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out (learn does not hold), n_tokens (words and one end), n_known (tokens
    with training counts), train_tokens, base_score (add-0.1 unigram) and score, both log10 of the whole text's
    probability; perplexity is 10 ** (-score / n_tokens). A word without training counts has the probability that the
    parent gives to new words as a class, as the base does.

    Null and empty texts are one end. Without training rows the base gives every token 0.1 / 0.1 and the model, which then
    knows nothing, probability 1 to the class of new words. Repeated rows are scored each. An empty table gives no rows.
    """
    spark, p = docs.sparkSession, params
    tmp = Scratch(spark, "lm")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.coalesce(learn, F.lit(False)).alias("_train"))
    # About one token for six bytes: this only sets the number of shards.
    size = rows.agg(F.sum(F.length("_text"))).first()[0] or 0
    shards = max(partitions(spark), size // 6 // p.shard_tokens)
    chunks = tmp.save(rows.mapInPandas(lambda b: _chunks(b, shards, p.chunk_tokens), "kind string, chunk long, docs array<bigint>, body binary"), "chunks", by=["kind"])
    words = chunks.filter("kind = 'words'").select("chunk", "body").mapInPandas(_split_words, "shard int, chunk long, body binary").groupBy("shard").applyInPandas(lambda g: _count_words(g, shards), "shard int, chunk long, body binary")
    words = tmp.save(words, "words")
    tmp.drop("chunks/kind=words")
    chunks = chunks.filter("kind = 'chunk'")
    heads = [unpack(r["body"]) for r in words.filter("chunk = -1").select("body").toLocalIterator()]
    tokens, types = sum(h["tokens"] for h in heads), sum(h["types"] for h in heads)
    # First words with more than a quarter of a shard's share of the tokens: at most four for each shard.
    top = np.concatenate([h["top"] for h in heads] or [np.empty(0, np.uint32)]), np.concatenate([h["top_count"] for h in heads] or [np.empty(0)])
    hot = np.sort(top[0][top[1] > max(1, tokens / (4 * shards))])
    words = words.filter("chunk >= 0")

    schema = "kind string, shard int, chunk long, docs array<bigint>, body binary"
    kind = lambda df, name, *cols: df.select(F.lit(name).alias("kind"), *cols)
    no_docs = F.lit(None).cast("array<bigint>").alias("docs")
    chunk_rows = kind(chunks, "chunk", F.lit(-1).alias("shard"), "chunk", "docs", "body")
    word_rows = kind(words, "word", "shard", "chunk", no_docs, "body")
    pairs = chunk_rows.withColumn("docs", no_docs).union(word_rows).groupBy("chunk").applyInPandas(lambda g: _split_pairs(g, hot, shards), "shard int, chunk long, body binary")
    state_schema = "shard int, body binary, tables binary, kept array<binary>, n1 long, n2 long"
    state = tmp.save(pairs.groupBy("shard").applyInPandas(_count_pairs, state_schema), "state0")
    del pairs
    ones = state.agg(F.sum("n1"), F.sum("n2")).first()
    discount = lambda a, b: min(0.95, max(0.05, (a or 0) / max(1.0, (a or 0) + 2.0 * (b or 0))))
    d = discount(*ones)

    def hot_totals(state: DataFrame) -> dict[int, int]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for body, tables in zip(batch["body"], batch["tables"], strict=True):
                    first = (np.cumsum(unpack(body)["d"]) >> np.uint64(32)).astype(np.uint32)
                    own = np.isin(first, hot)
                    known, where = np.unique(first[own], return_inverse=True)
                    yield pd.DataFrame({"u": known.astype(np.int64), "t": np.bincount(where, weights=unpack(tables)["t"][own], minlength=len(known)).astype(np.int64)})

        return {r["u"]: r["t"] for r in state.mapInPandas(run, "u long, t long").groupBy("u").agg(F.sum("t").alias("t")).collect()} if len(hot) else {}

    parent_schema = "wshard int, shard int, body binary, customers long, types long, n1 long, n2 long"
    parent_of = lambda st, name: tmp.save(st.select("shard", "body", "tables").mapInPandas(lambda b: _by_word(b, shards), "wshard int, shard int, body binary").groupBy("wshard").applyInPandas(_parent, parent_schema), name)
    parent = parent_of(state, "parent0")
    roots, kept, tables_hot = [], [], hot_totals(state)
    all_hot = []

    def round_of(hot_tables: dict[int, int], root_d: float, customers: int, turn: int):
        return lambda g: _sweep(g, hot_tables, d, root_d, customers, p, turn)

    for turn in range(1, p.rounds + 1):
        root = parent.filter("shard = -1").agg(F.sum("customers").alias("n"), F.sum("n1").alias("a"), F.sum("n2").alias("b")).first()
        root_d, customers = discount(root["a"], root["b"]), root["n"] or 0
        both = state.select(F.lit("state").alias("kind"), "shard", "body", "kept", "tables").union(parent.filter("shard >= 0").select(F.lit("parent"), "shard", "body", F.lit(None).cast("array<binary>"), F.lit(None).cast("binary")))
        swept = both.groupBy("shard").applyInPandas(round_of(tables_hot, root_d, customers, turn), state_schema)
        done, state = f"state{turn - 1}", tmp.save(swept, f"state{turn}")
        # The state carries the samples of all rounds.
        del both, swept
        tmp.drop(done)
        tables_hot = hot_totals(state)
        parent = parent_of(state, f"parent{turn}")
        if turn <= p.burn:
            continue
        root = parent.filter("shard = -1").agg(F.sum("customers").alias("n"), F.sum("types").alias("v"), F.sum("n1").alias("a"), F.sum("n2").alias("b")).first()
        roots.append((root["n"] or 0, root["v"] or 0, discount(root["a"], root["b"])))
        kept.append(kind(parent.filter("shard = -1"), "root", F.col("wshard").alias("shard"), F.lit(-1).cast("long").alias("chunk"), "body", F.lit(turn).alias("turn")))
        all_hot.append(tables_hot)
    pair_rows = state.select("shard", "body", "kept").mapInPandas(lambda b: _answer_pairs(b, all_hot), schema)
    asked = kind(words, "word", "shard", "chunk", "body", F.lit(0).alias("turn"))
    for k in kept:
        asked = asked.union(k)
    root_rows = asked.groupBy("shard").applyInPandas(lambda g: _answer_words(g, p.rounds - p.burn), schema)
    everything = chunk_rows.union(word_rows).union(root_rows).union(pair_rows)
    out_schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return everything.groupBy("chunk").applyInPandas(lambda g: _score(g, p, d, roots, tokens, types, hot, shards), out_schema)
