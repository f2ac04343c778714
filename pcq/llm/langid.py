"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

n-grams of 1 to 4 letters (lower case, any run of other characters is one blank) are hashed into buckets. Document
frequencies are counted over every training document. The weights are fitted by follow-the-regularised-leader (FTRL-
proximal) with elastic-net penalties on a bounded sample of labelled documents; a temperature, fitted on another part
of that sample, calibrates the probabilities.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, slim, small_batches

#: The answer for texts without a letter.
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
#: Characters hashed at a time; bounds the memory for a very long text.
_CHUNK = 1 << 20


@dataclass(frozen=True)
class LangParams:
    """sample: most labelled documents that the weights are fitted on. min_confidence: below it, judge() rejects."""

    bits: int = 16
    orders: int = 4
    sample: int = 3000
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-5
    held_back: float = 0.2
    seed: int = 9


def counts(text: str, p: LangParams) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur in a text, and how often; nothing for a text without letters."""
    clean = _NOT_LETTERS.sub(" ", text.lower())
    # Powers, fractions and numbers in circles count as word characters, but are no letters.
    if not any(map(str.isalpha, clean)):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    clean = f" {clean} "
    total = np.zeros(1 << p.bits, np.int64)
    shift = np.uint64(64 - p.bits)
    for at in range(0, len(clean), _CHUNK):
        # Neighbouring chunks overlap, so that an n-gram counts once wherever the cut falls.
        part = clean[at : at + _CHUNK + p.orders - 1]
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        h = np.zeros(len(code), np.uint64)
        for n in range(p.orders):
            h = (h[: len(code) - n] if n else h) * _MIX[0] + code[n:] * _MIX[1] + _MIX[2]
            mixed = (h ^ (h >> np.uint64(29))) * _MIX[3]
            total += np.bincount((mixed >> shift)[:_CHUNK].astype(np.int64), minlength=1 << p.bits)
    at = np.flatnonzero(total)
    return at, total[at]


def _features(text: str, idf: np.ndarray, p: LangParams) -> tuple[np.ndarray, np.ndarray]:
    at, n = counts(text, p)
    x = (1.0 + np.log(n)) * idf[at] if len(at) else np.empty(0)
    norm = math.sqrt(float(x @ x)) if len(at) else 0.0
    return at, x / norm if norm else x


class LanguageModel:
    """Weights [bucket, language], inverse document frequencies and a temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float, params: LangParams):
        self.langs, self.weights, self.idf, self.temperature, self.params = langs, weights, idf, temperature, params

    def score(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        at, x = _features(text, self.idf, self.params)
        if not len(at):
            return UNKNOWN, 0.0
        z = (x @ self.weights[at]) / self.temperature
        prob = np.exp(z - z.max())
        prob /= prob.sum()
        best = int(prob.argmax())
        return self.langs[best], float(prob[best])


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, p: LangParams) -> np.ndarray:
    """FTRL-proximal, one document at a time: per-coordinate rates, and weights of exactly zero within the L1 bound."""
    z = np.zeros((1 << p.bits, n_langs))
    n = np.zeros_like(z)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= p.l1, 0.0, (np.sign(zz) * p.l1 - zz) / ((p.beta + np.sqrt(nn)) / p.alpha + p.l2))

    order = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(at)
            s = x @ w
            prob = np.exp(s - s.max())
            prob /= prob.sum()
            prob[y] -= 1.0
            g = np.outer(x, prob)
            nn = n[at]
            z[at] += g - (np.sqrt(nn + g * g) - np.sqrt(nn)) / p.alpha * w
            n[at] = nn + g * g
    return weights(slice(None))


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss, by a golden-section search over its logarithm."""

    def loss(log_t: float) -> float:
        z = logits / math.exp(log_t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]).mean())

    lo, hi, cut = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - cut * (hi - lo), lo + cut * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def fit(docs: DataFrame, learn: Column, params: LangParams = LangParams(), text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from the rows where `learn` holds and the language is not null.

    Document frequencies cover all of them. The sample for the weights is the different texts with the smallest hash,
    so reruns agree. Without any such row the model knows no language and answers `und`.
    """
    p = params
    small_batches(docs.sparkSession)
    train = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(1 << p.bits, np.int64), 0
        for batch in slim(batches):
            for text in batch["text"]:
                at, _ = counts(text, p)
                df[at] += 1
                n += len(at) > 0
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(df[at], n)})

    # One row a bucket reaches the driver: at most 2^bits + 1.
    seen = train.select("text").mapInPandas(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << p.bits)
    total = 0
    for bucket, n in zip(seen["bucket"], seen["n"], strict=True):
        if bucket < 0:
            total = int(n)
        else:
            df[bucket] = n
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    # Copies of a text are one, or the many copies of one could fill the sample.
    train = train.withColumn("_k", F.xxhash64("text"))
    texts = train.select("_k", "lang").distinct().count()
    if texts > p.sample:
        # A threshold on a uniform hash first, so that no more than about twice the sample is sorted.
        train = train.filter(F.pmod("_k", F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.5 * p.sample / texts)))
    sample = train.select("_k", "text", "lang").dropDuplicates(["_k", "text", "lang"]).orderBy("_k", "lang").limit(p.sample)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [counts(t, p) for t in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"], "at": [a.astype(np.uint16 if p.bits <= 16 else np.uint32).tobytes() for a, _ in got], "n": [n.astype(np.uint32).tobytes() for _, n in got]})

    rows, langs = [], {}
    for r in sample.mapInPandas(extract, "lang string, at binary, n binary").toLocalIterator():
        at = np.frombuffer(r["at"], np.uint16 if p.bits <= 16 else np.uint32)
        if len(at):
            x = (1.0 + np.log(np.frombuffer(r["n"], np.uint32))) * idf[at]
            rows.append((at, (x / math.sqrt(float(x @ x))).astype(np.float32), langs.setdefault(r["lang"], len(langs))))
    if not rows:
        return LanguageModel([], np.zeros((1 << p.bits, 0)), idf, 1.0, p)
    names = list(langs)
    back = rows[: max(1, int(len(rows) * p.held_back))]
    w = _ftrl(rows[len(back) :] or rows, len(names), p)
    temperature = _temperature(np.array([x @ w[at] for at, x, _ in back]), np.array([y for *_, y in back]))
    del rows, back
    give_back()
    return LanguageModel(names, w.astype(np.float32), idf, temperature, p)


def judge(model: LanguageModel, docs: DataFrame) -> Callable[[Column], Column]:
    """A function from a text column to a struct lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.idf, model.temperature, model.params))

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = LanguageModel(*shared.value)
        for batch in slim(texts):
            yield pd.DataFrame([m.score(t) for t in batch], columns=["lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (the calibrated probability); null, empty and letterless texts get `und` and 0.

    Columns of docs named lang_pred or score are replaced. Repeated rows are judged alike; an empty table stays empty.
    """
    out = docs.drop("lang_pred", "score").withColumn("_judged", judge(model, docs)(F.col(text_col)))
    return out.withColumn("lang_pred", F.col("_judged.lang_pred")).withColumn("score", F.col("_judged.score")).drop("_judged")


def keep_known(docs: DataFrame, learn: Column | None = None, min_confidence: float = 0.5, params: LangParams = LangParams(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs less the documents that the model rejects: no letter, or no language with at least min_confidence. The model
    learns from the rows where `learn` holds (all, if not given). All columns stay as they are."""
    model = fit(docs, F.lit(True) if learn is None else learn, params, text_col, lang_col)
    judged = docs.withColumn("_judged", judge(model, docs)(F.col(text_col)))
    return judged.filter((F.col("_judged.lang_pred") != UNKNOWN) & (F.col("_judged.score") >= min_confidence)).select(*docs.columns)
