"""Toxicity by a grammar of weighted finite-state transducers.

Terms are found in the lower-cased text by one automaton. The clause around each insult or threat becomes a string of
classes (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER). Four transducers read it: one joins insults and threats with
their targets, one weakens what stands after a negation, one weakens what is reported speech, one adds weights up. They are
composed once; the best path through the composition says by its weights what each term of a clause counts for. A threat is a
listed verb, in English, French, German or Spanish, in a clause that names a target; forms that stand apart ("bringe dich um")
are not listed. A logistic function of the clauses'
weights, fitted to labels, gives the score. Which further terms insult, and how much, is learned from labels as well.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slim

# Words of the grammar's classes, in English, French, German and Spanish.
INSULTS = "idiot moron stupid loser scum trash clown pathetic worthless disgusting imbecile fool dumb jerk filth vermin cretin garbage bastard".split()
THREATS = """kill hurt destroy beat stab shoot strangle burn
tuer tuerai blesser blesserai détruire frapper frapperai poignarder abattre étrangler égorger brûler
töten umbringen verletzen zerstören schlagen verprügeln erstechen erschießen erwürgen verbrennen
matar mataré herir destruir golpear apuñalar disparar estrangular degollar quemar""".split()
TARGETS = """you your yours he him she her they them their these those all every
tu toi te ton ta tes vous votre vos il elle ils elles eux leur ces tous
du dich dir dein deine ihr euch euer sie ihnen diese alle
tú tu te ti tus usted ustedes vosotros él ella ellos ellas estos esos todos""".split()
NEGATIONS = """not no never nobody isn't aren't wasn't don't doesn't without hardly
ne n' pas jamais personne sans aucun guère
nicht nie niemals niemand kein keine keinen ohne kaum
nunca jamás nadie sin ningún ninguna tampoco""".split()
REPORTS = """said says say wrote writes claimed claims reported reports quoted according alleged called calls
dit disait écrit écrivait prétend prétendait selon cité appelé
sagte sagt schrieb schreibt behauptet behauptete laut zitierte nannte
dijo dice escribió escribe afirmó según citó llamó""".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
#: Up to so many labels (a long and an int each) are broadcast to their documents; beyond, both are shuffled.
BROADCAST_LABELS = 1_000_000
_BREAK = re.compile(r"[.!?;\n]")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
#: French elisions: "n'es" is the negation n' and a word.
_ELIDED = re.compile(r"\bn'(?=[^\W_])")
#: A clause is read this far to each side of a term at most when a text has no breaks; terms beyond start clauses of their own.
_REACH = 300


class Transducer:
    """A weighted transducer: arcs[state][input] = (output, weight, next). Larger weights are better; None passes all."""

    def __init__(self, arcs: dict, final: set):
        self.arcs, self.final = arcs, final

    def compose(self, other: Transducer) -> Transducer:
        """This one first, then the other: pairs of states that can be reached."""
        arcs: dict = {}
        todo = [(0, 0)]
        names = {(0, 0): 0}
        final = set()
        while todo:
            pair = todo.pop()
            a, b = pair
            own = arcs.setdefault(names[pair], {})
            if a in self.final and b in other.final:
                final.add(names[pair])
            for symbol, ways in self.arcs.get(a, {}).items():
                for out, weight, a2 in ways:
                    for out2, weight2, b2 in other.arcs.get(b, {}).get(out, ()):
                        if (a2, b2) not in names:
                            names[a2, b2] = len(names)
                            todo.append((a2, b2))
                        own.setdefault(symbol, []).append((out2, weight + weight2, names[a2, b2]))
        return Transducer(arcs, final)

    def best(self, symbols: tuple[int, ...]) -> tuple[float, tuple[tuple[int, float], ...]]:
        """Weight of the best path over the input, and its output and weight for each symbol; minus infinity if there is none."""
        # Steps point back to those before them, so that a long clause costs no copies of its path.
        now: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for s in symbols:
            nxt: dict[int, tuple[float, tuple | None]] = {}
            for state, (weight, path) in now.items():
                for out, w, to in self.arcs.get(state, {}).get(s, ()):
                    if to not in nxt or weight + w > nxt[to][0]:
                        nxt[to] = (weight + w, (out, w, path))
            now = nxt
        weight, path = max((x for state, x in now.items() if state in self.final), key=lambda x: x[0], default=(-math.inf, None))
        steps = []
        while path is not None:
            steps.append(path[:2])
            path = path[2]
        return weight, tuple(reversed(steps))


# Outputs between the transducers: what became of a term. Weights are logarithms of what a term's own weight is multiplied by.
PLAIN, AIMED, WEAK = 10, 11, 12
AT_TARGET, NEGATED, REPORTED = math.log(1.5), math.log(0.3), math.log(0.4)


def grammar() -> Transducer:
    """targets o negation o report. Inputs are classes, outputs PLAIN, AIMED, WEAK or OTHER for each word. An arc that reads a
    term weighs what the term is multiplied by; along the composition these weights add up, so that an aimed, denied and
    reported insult is all three."""
    rest = (TARGET, NEGATION, REPORT, OTHER)
    # A term is aimed if its clause names a target before it, or after it (a guess that state 2 must see confirmed).
    loop = lambda to: {c: [(c, 0.0, to)] for c in rest}
    insult = lambda out, w, to: {c: [(out, w, to)] for c in (INSULT, THREAT)}
    guess = {c: [(PLAIN, 0.0, 0), (AIMED, AT_TARGET, 2)] for c in (INSULT, THREAT)}
    targets = Transducer(
        {
            0: guess | loop(0) | {TARGET: [(TARGET, 0.0, 1)]},
            1: insult(AIMED, AT_TARGET, 1) | loop(1),
            2: insult(AIMED, AT_TARGET, 2) | loop(2) | {TARGET: [(TARGET, 0.0, 1)]},
        },
        {0, 1},
    )
    # After a negation the next term within four words is weak ("no te voy a matar").
    keep = lambda to: {c: [(c, 0.0, to)] for c in (TARGET, REPORT, OTHER)}
    strong = {x: [(x, 0.0, 0)] for x in (PLAIN, AIMED)}
    weak = {x: [(WEAK, NEGATED, 0)] for x in (PLAIN, AIMED)}
    negation = Transducer({0: strong | keep(0) | {NEGATION: [(OTHER, 0.0, 1)]}} | {k: weak | keep((k + 1) % 5) | {NEGATION: [(OTHER, 0.0, 1)]} for k in (1, 2, 3, 4)}, {0, 1, 2, 3, 4})
    # Once a clause reports speech, what follows is weak.
    passed = {x: [(x, 0.0, 0)] for x in (PLAIN, AIMED, WEAK)} | {c: [(OTHER, 0.0, 0)] for c in (TARGET, OTHER)}
    told = {x: [(WEAK, REPORTED, 1)] for x in (PLAIN, AIMED, WEAK)} | {c: [(OTHER, 0.0, 1)] for c in (TARGET, OTHER, REPORT)}
    report = Transducer({0: passed | {REPORT: [(OTHER, 0.0, 1)]}, 1: told}, {0, 1})
    return targets.compose(negation).compose(report)


@dataclass(frozen=True)
class ToxicParams:
    """sample: most labelled documents that terms and the score are learned from. candidates: terms of the sample's toxic texts,
    the most frequent first, whose odds are looked at. least_count, least_odds: toxic texts of the sample that hold a learned
    term, and the lower bound of its log odds, at least. prefix: lengths of stems. most_terms: terms learned, the strongest
    first. These bound what is learned from the sample; every document is scored whole."""

    sample: int = 6000
    candidates: int = 50_000
    least_count: int = 3
    least_odds: float = 2.0
    prefix: tuple[int, ...] = (4, 5, 6, 7, 8)
    most_terms: int = 2000


@dataclass
class ToxicModel:
    """terms: weight by whole word or by prefix ('stem*'); beta: intercept and slopes of the logistic function."""

    terms: dict[str, float]
    beta: np.ndarray = field(default_factory=lambda: np.array([-3.0, 2.0, 1.0, 1.0]))


class Scorer:
    def __init__(self, model: ToxicModel):
        self.model, self.grammar, self.known = model, grammar(), {}
        self.classes = {w: c for c, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws}
        self.whole = {t: w for t, w in model.terms.items() if not t.endswith("*")}
        self.stems = {t[:-1]: w for t, w in model.terms.items() if t.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.find = ahocorasick.Automaton()
        for t in [*self.whole, *self.stems, *THREATS]:
            self.find.add_word(t, t)
        self.find.make_automaton()

    def term(self, word: str) -> float:
        """A word's own weight as an insult: its entry, or that of its longest listed prefix."""
        if word in self.whole:
            return self.whole[word]
        return next((self.stems[word[:n]] for n in self.lengths if word[:n] in self.stems), 0.0)

    def clauses(self, text: str) -> Iterator[tuple[list[str], tuple[int, ...]]]:
        """The words and classes of each clause with a term; each term is in one clause."""
        low = text.lower()
        done = 0
        for end, t in self.find.iter(low):
            at = end - len(t) + 1
            if at < done or (at and (low[at - 1].isalnum() or low[at - 1] == "'")):
                continue
            start = max(done, at - _REACH)
            for m in _BREAK.finditer(low, start, at):
                start = m.end()
            stop = _BREAK.search(low, end, min(len(low), at + _REACH))
            stop = stop.start() if stop else min(len(low), at + _REACH)
            while stop < len(low) and low[stop].isalnum():
                stop += 1
            words = _WORD.findall(_ELIDED.sub("ne ", low[start:stop]))
            classes = tuple(INSULT if self.term(w) else self.classes.get(w, OTHER) for w in words)
            done = stop
            if INSULT in classes or (THREAT in classes and TARGET in classes):
                yield words, classes

    def features(self, text: str | None) -> tuple[float, float, float]:
        """The largest clause weight, the logarithm of their sum, and of their sum for each thousand characters."""
        most = total = 0.0
        for words, classes in self.clauses(text or ""):
            if classes not in self.known:
                if len(self.known) > 50_000:
                    self.known.clear()
                self.known[classes] = self.grammar.best(classes)[1]
            # The path's weight at each term multiplies the term's own.
            value = sum(math.exp(step[1]) * (self.term(w) if c == INSULT else 1.0) for w, c, step in zip(words, classes, self.known[classes], strict=False) if c in (INSULT, THREAT))
            most, total = max(most, value), total + value
        return most, math.log1p(total), math.log1p(1000 * total / max(200, len(text or "")))

    def score(self, x: tuple[float, float, float]) -> float:
        z = float(self.model.beta[0] + self.model.beta[1:] @ np.array(x))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        beta += np.linalg.solve(h, x.T @ (y - p) - 0.05 * beta)
    return beta


def fit(labelled: DataFrame, params: ToxicParams = ToxicParams(), text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """Learn from rows with a text and a label of 0 or 1; a bounded sample of different texts by hash, so reruns agree. Without rows of both
    labels the fixed terms and weights stand."""
    p = params
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("toxic"))
    rows = rows.withColumn("_k", F.xxhash64("text"))
    # Copies of a text are one, or the many copies of one could fill the sample.
    texts = rows.select("_k", "toxic").distinct().count()
    if texts > p.sample:
        rows = rows.filter(F.pmod("_k", F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.5 * p.sample / texts)))
    sample = Scratch(labelled.sparkSession, "toxic").save(rows.dropDuplicates(["_k", "text", "toxic"]).orderBy("_k", "toxic").limit(p.sample), "sample")

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words = set(_WORD.findall(text.lower()))
                for t in words | {w[:n] + "*" for w in words for n in p.prefix if len(w) >= n}:
                    seen.setdefault(t, [0, 0])[toxic] += 1
            yield pd.DataFrame([(t, n[0], n[1]) for t, n in seen.items() if n[1]], columns=["term", "clean", "toxic"])

    both = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = {w: 3.0 for w in INSULTS}
    if len(both) < 2:
        return ToxicModel(chosen)
    # Clean counts of terms that a batch saw in no toxic text are missing there, so count them in a second pass.
    counted = sample.mapInPandas(terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("toxic").alias("toxic"))
    counted = counted.filter(F.col("toxic") >= p.least_count).orderBy(F.desc("toxic"), "term").limit(p.candidates).toPandas()
    wanted = set(counted["term"])

    def clean_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, int] = {}
            for text in batch["text"]:
                words = set(_WORD.findall(text.lower()))
                for t in (words | {w[:n] + "*" for w in words for n in p.prefix if len(w) >= n}) & wanted:
                    seen[t] = seen.get(t, 0) + 1
            yield pd.DataFrame(list(seen.items()), columns=["term", "clean"])

    clean = sample.filter("toxic = 0").mapInPandas(clean_counts, "term string, clean long").groupBy("term").agg(F.sum("clean").alias("clean")).toPandas()
    clean = dict(zip(clean["term"], clean["clean"], strict=True))
    scored = []
    for t, n in zip(counted["term"], counted["toxic"], strict=True):
        odds = math.log((n + 0.5) / (both[1] + 1)) - math.log((clean.get(t, 0) + 0.5) / (both[0] + 1))
        # A lower bound of the odds: few sightings prove little.
        odds -= 1.0 / math.sqrt(n)
        if odds >= p.least_odds:
            scored.append((odds, int(n), t))
    scored.sort(key=lambda x: (-x[0] * math.log1p(x[1]), x[2]))
    for odds, _, t in scored[: p.most_terms]:
        stem = t.rstrip("*")
        # A longer prefix or a word under a listed prefix of no less weight adds nothing.
        if not any(chosen.get(stem[:n] + "*", 0.0) >= odds - 0.3 for n in p.prefix if n <= len(stem)):
            chosen[t] = max(chosen.get(t, 0.0), min(odds, 5.0))
    model = ToxicModel(chosen)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            yield pd.DataFrame([(*scorer.features(t), y) for t, y in zip(batch["text"], batch["toxic"], strict=True)], columns=["a", "b", "c", "y"])

    seen = sample.mapInPandas(look, "a double, b double, c double, y int").toPandas()
    model.beta = _logistic(seen[["a", "b", "c"]].to_numpy(), seen["y"].to_numpy())
    return model


def predict(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on), replacing columns of these names. Null and empty texts have
    no clause and get the score of such texts. Repeated rows score alike; an empty table stays empty."""

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for batch in slim(texts):
            yield pd.Series([scorer.score(scorer.features(t)) for t in batch], dtype="float64")

    out = docs.drop("score", "predicted").withColumn("score", run(F.col(text_col)))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def matched(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, clause, outputs): the clauses that count, and what the grammar made of each of their terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            rows = [(i, " ".join(w), [out for out, _ in scorer.grammar.best(c)[1]]) for i, t in zip(batch["_id"], batch["_text"], strict=True) for w, c in scorer.clauses(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "clause", "outputs"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, "doc_id long, clause string, outputs array<int>")
