"""Vector codes, packing and the manifest, each against brute force, and on awkward tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pcq.llm import common, idfiles, merkle, packing, vectorcodes

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
VECTORS = "vec_id long, embedding array<float>, label int, code string, q int, error long"
DOCS = "doc_id long, text string, lang string, source string, n_chars int, idx long, tree string, leaf string"


def brute_codes(rows, parts, entries, rounds):
    kept = [(v, x, lab) for v, x, lab in rows if x and all(c is not None and math.isfinite(c) for c in x)]
    kept = [(v, [math.floor(min(max(c, -(2.0**18)), 2.0**18) * 256) for c in x], lab) for v, x, lab in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    cut = [k * len(kept[0][1]) // parts for k in range(parts + 1)] if kept else []
    books = [[r[1][a:b] for r in kept[:entries]] for a, b in zip(cut, cut[1:], strict=False)]

    def assign():
        out = []
        for _, q, _ in kept:
            own = []
            for book, a, b in zip(books, cut, cut[1:], strict=False):
                far = [sum((s - t) ** 2 for s, t in zip(e, q[a:b], strict=True)) for e in book]
                own.append((far.index(min(far)), min(far)))
            out.append(own)
        return out

    moved, last = [], None
    for _ in range(rounds):
        now = assign()
        moved.append(sum(last is None or last[i][k][0] != now[i][k][0] for i in range(len(kept)) for k in range(parts)))
        last = now
        for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            for e in range(len(books[k])):
                own = [q[a:b] for (_, q, _), c in zip(kept, now, strict=True) if c[k][0] == e]
                if own:
                    books[k][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    done = [(v, lab, tuple(c for c, _ in own), sum(d for _, d in own)) for (v, _, lab), own in zip(kept, assign(), strict=True)]
    return Counter(done), books, moved


def coded(codes, parts):
    return Counter((r.vec_id, r.label, tuple(np.frombuffer(r.code, "<u2").tolist()) if parts else (), r.error) for r in codes.rows.collect())


@pytest.mark.parametrize(("dimension", "parts", "entries", "rounds"), [(8, 4, 5, 2), (7, 3, 9, 3), (2, 4, 3, 1)])
def test_codes(spark, dimension, parts, entries, rounds):
    r = random.Random(dimension)
    rows = [(k, [r.choice([-0.5, 0.003, 0.7, r.gauss(0, 1)]) for _ in range(dimension)], r.choice([None, 1, 2])) for k in range(90)]
    rows = [(v, [float(np.float32(c)) for c in x], lab) for v, x, lab in rows]
    rows += [rows[3], (None, rows[4][1], None), (3, rows[9][1], 7), (200, None, 1), (201, [], 1), (202, [float("nan")] * dimension, 1), (203, [math.inf] * dimension, 1)]
    rows += [(204, [None] + [0.0] * (dimension - 1), 1), (-1, None, 1), (205, [1.0] * (dimension + 1), 1), (206, [2.0**20] * dimension, 1), (207, [-(2.0**20)] * dimension, 1)]
    df = spark.createDataFrame([(v, x, lab, "a", 1, 5) for v, x, lab in rows], VECTORS).repartition(5)
    got = vectorcodes.compress(df, parts, entries, rounds)
    want, books, moved = brute_codes(rows, parts, entries, rounds)
    assert coded(got, parts) == want
    assert [b.tolist() for b in got.books] == books
    assert got.moved == moved
    assert got.books_sha256() == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = defaultdict(int)
    for (_, lab, _, e), n in want.items():
        errors[lab] += e * n
    for most in (vectorcodes.BROADCAST_LABELS, 0):
        vectorcodes.BROADCAST_LABELS, kept = most, vectorcodes.BROADCAST_LABELS
        found = vectorcodes.label_errors(got.rows).collect()
        vectorcodes.BROADCAST_LABELS = kept
        assert len(found) == want.total() and all(errors[x.label] == x.label_error for x in found)


def test_codes_move_only_what_changed(spark):
    """On clusters that are found at once, the second round moves next to nothing; decoding comes close to the vectors."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(8, 16)) * 4
    rows = [(k, (centres[k % 8] + r.normal(size=16) / 50).tolist(), k % 8, "", 0, 0) for k in range(800)]
    got = vectorcodes.compress(spark.createDataFrame(rows, VECTORS).repartition(7), parts=4, entries=8)
    assert got.moved[0] == 800 * 4 and got.moved[1] == 0
    for x in got.decode().collect():
        assert np.abs(np.array(x.vector) - rows[x.vec_id][1]).max() < 0.2


def test_codes_of_nothing(spark):
    got = vectorcodes.compress(spark.createDataFrame([(1, None, 1, "", 0, 0)], VECTORS))
    assert got.rows.collect() == [] and vectorcodes.label_errors(got.rows).collect() == [] and got.moved == [0, 0]


def expanded(slots):
    """sequence -> (offset, length), sorted, of a plan."""
    out = defaultdict(list)
    for size, _, n, first, offset, times in slots.tolist():
        for i in range(n):
            out[first + i // times].append((offset + i % times * size, size))
    return {s: sorted(x) for s, x in out.items()}


@pytest.mark.parametrize("seed", range(12))
def test_packing_plan(seed):
    r = np.random.default_rng(seed)
    top = int(r.choice([8, 64, 512]))
    sizes = [*np.clip(r.geometric(float(r.choice([0.02, 0.1, 0.5])), r.integers(1, 3000)), 1, top), *[top] * int(r.integers(0, 9)), *[top // 2] * int(r.integers(0, 99))]
    histogram = np.bincount(sizes, minlength=top + 1)
    slots = packing.plan(histogram)
    found = expanded(slots)
    assert sorted(found) == list(range(len(found)))
    for own in found.values():
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own]).tolist()[:-1]] and sum(n for _, n in own) <= top
    assert Counter(n for own in found.values() for _, n in own) == Counter(sizes)
    # Ranks of a length are dealt once each.
    for size in set(sizes):
        assert sorted(x for s, a, n, *_ in slots.tolist() if s == size for x in range(a, a + n)) == list(range(histogram[size]))
    lower = max(-(-sum(sizes) // top), sum(n > top / 2 for n in sizes))
    assert len(found) <= lower * 1.01 + 2


def test_patterns_are_all():
    """Every way to fill a sequence of 12 with up to three documents of these lengths, or with one length and one more."""
    histogram = np.zeros(13, np.int64)
    histogram[[1, 2, 4, 5, 6, 7, 10, 12]] = 3
    length, times = packing.patterns(histogram)
    got = {tuple(sorted(a for a, m in zip(x, t, strict=True) for _ in range(m))) for x, t in zip(length.tolist(), times.tolist(), strict=True)}
    have = [1, 2, 4, 5, 6, 7, 10]
    few = {tuple(sorted(c)) for a in have for b in [0, *have] for c in [[x for x in (a, b, 12 - a - b) if x]] if 12 - a - b in [0, *have] and sum(c) == 12}
    many = {tuple(sorted([a] * k + [x for x in [12 - a * k] if x])) for a in have for k in range(1, 13) if 12 - a * k in [0, *have]}
    assert got == few | many and len(got) == len(length)
    assert all(m == 0 or list(x).count(a) == 1 for x, t in zip(length.tolist(), times.tolist(), strict=True) for a, m in zip(x, t, strict=True))


def test_packing_fits_the_histogram():
    """Counts come close to a histogram that patterns can make exactly; most documents are packed by patterns."""
    r = np.random.default_rng(5)
    histogram = np.zeros(257, np.int64)
    for _ in range(20_000):
        a, b = r.integers(20, 100, 2)
        np.add.at(histogram, [a, b, 256 - a - b], 1)
    length, times = packing.patterns(histogram)
    counts = packing.fit(length, times, histogram)
    made = np.zeros(257)
    np.add.at(made, length, times * counts[:, None])
    assert np.abs(made - histogram)[1:256].sum() < 0.03 * histogram.sum()
    assert len(expanded(packing.plan(histogram))) <= 20_010


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    out = [" ".join(r.choice(["river", "stone", "Être", "x1", "Zug,", "42"]) for _ in range(r.randint(1, 400))) for _ in range(120)]
    return [*out, None, "", " \n", out[0], "word " * 5000, out[1].upper()]


def test_packing_query(spark, texts):
    rows = [(k, t, "en", "s", 1, 9, "x", "y") for k, t in enumerate(texts)]
    rows += [rows[3], (None, "null id", "en", "s", 1, 9, "x", "y"), (None, "null id", "en", "s", 1, 9, "x", "y")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    cut = packing.pieces(idfiles.tokenise(docs, TOKENIZER, end_id=0))
    packed = packing.pack(cut)
    got = packed.collect()
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for k, t, *_ in rows:
        ids = [*inner.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[at : at + 2048], "<u4")
            want[k, piece, at, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length, r.ids))
    for own in by.values():
        own.sort()
        assert [o for o, *_ in own] == [0, *np.cumsum([n for _, n, _ in own]).tolist()[:-1]] and own[-1][0] + own[-1][1] <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1
    made = {r.sequence_id: (r.n_tokens, bytes(r.ids)) for r in packing.sequences(packed).collect()}
    assert made == {s: (sum(n for _, n, _ in own), b"".join(bytes(x) for *_, x in own)) for s, own in by.items()}
    assert Counter(tuple(r) for r in packing.pack(cut).collect()) == Counter(tuple(r) for r in got)
    none = packing.pieces(idfiles.tokenise(docs.limit(0), TOKENIZER, end_id=0), with_ids=False)
    assert packing.pack(none).collect() == []


def test_ranked(spark):
    """Ranks and members of groups over many runs, with null groups, a hot one and rows that tie."""
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(40)]), k) for k in range(3000)]
    tmp = common.Scratch(spark, "test")
    df = tmp.save(spark.createDataFrame(rows, "g string, o int, t long").repartition(9), "in")
    kept = common.RANGE, common.BROADCAST_RANGES
    for size, most in ((10**6, 10**6), (100, 10**6), (100, 0)):
        common.RANGE, common.BROADCAST_RANGES = size, most
        got = common.ranked(df, tmp, f"r{size}-{most}", ["g"], ["o", "t"]).collect()
        common.RANGE, common.BROADCAST_RANGES = kept
        assert len(got) == len(rows)
        for g in ("a", "b", None):
            own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
            found = sorted((x for x in got if x.g == g), key=lambda x: x["rank"])
            assert [(x.g, x.o, x.t, x["rank"], x.members) for x in found] == [(*x, i, len(own)) for i, x in enumerate(own)]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(leaves):
    """Levels, from the leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute_path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 8 * 8
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 8])))
        i //= 8
    return out


def brute_manifest(rows):
    """Rows: (doc_id, text, lang, source, n_chars)."""
    by = defaultdict(list)
    for d, t, lang, source, n in rows:
        by[lang].append((d, h(*(value(v) for v in (d, source, lang, n, t)))))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = brute_tree([x for _, x in by[lang]])
    top = brute_tree([trees[x][-1][0] for x in langs])
    out = Counter()
    for nth, lang in enumerate(langs):
        for i, (d, leaf) in enumerate(by[lang]):
            out[d, lang, i, leaf, trees[lang][-1][0], top[-1][0], tuple(brute_path(trees[lang], i) + brute_path(top, nth))] += 1
    return out


def manifest_rows(name):
    r = random.Random(name)
    if name == "langs":
        return [(k, f"text {k}", r.choice([f"l{r.randint(0, 30)}", "é", "Z", "", None]), "s", k) for k in range(400)]
    if name == "hot":
        out = [(k, f"Text {k} " * r.randint(0, 40), r.choice(["en", "en", "en", "de", None]), r.choice(["s", None]), r.choice([None, k])) for k in range(1400)]
        return [*out, *out[:40], *[(None, None, None, None, None)] * 9, *[(None, "a", "en", "s", 1)] * 9, (7, "ünï", "en", "s", 1), (2, "é" * 50_000, "fr", "s", 1)]
    return {"one": [(5, "A", "en", "s", 1)], "eight": [(k, "", None, "s", 1) for k in range(8)], "nine": [(k, "", "x", "s", 1) for k in range(9)], "none": []}[name]


@pytest.mark.parametrize("name", ["one", "eight", "nine", "langs", "hot", "none"])
def test_manifest(spark, name):
    rows = manifest_rows(name)
    docs = spark.createDataFrame([(d, t, lang, s, n, 3, "x", "y") for d, t, lang, s, n in rows], DOCS).repartition(6)
    tampered = F.translate("text", "AT", "at")
    claim = merkle.leaf([tampered if c == "text" else F.col(c) for c in merkle.DOCUMENT])
    found = merkle.build(docs, claim=claim)
    proofs = found.proofs().withColumns({"folded": merkle.folded(F.col("path"), F.col("claim")), "back": merkle.folded(F.col("path"), F.col("leaf")), "digest": merkle.digest(F.col("path"))}).collect()
    want = brute_manifest(rows) if rows else Counter()
    assert Counter((r.id, r.tree, r.idx, r.leaf, r.subroot, r.root, tuple((x.left, x.right) for x in r.path)) for r in proofs) == want
    changed = Counter((d, lang, h(*(value(v) for v in (d, s, lang, n, t and t.replace("A", "a").replace("T", "t"))))) for d, t, lang, s, n in rows)
    assert Counter((r.id, r.tree, r.claim) for r in proofs) == changed
    for r in proofs:
        assert r.back == r.root and r.digest == h(*(x.left + x.right for x in r.path))
        assert (r.folded == r.root) == (r.claim == r.leaf)
    assert found.root == (next(iter(want))[5] if want else None)
    # Every pack is whole, and once in its level.
    for level in [*found.trees, *found.top]:
        packs = level.collect()
        assert len({(p.tree, p.pack) for p in packs}) == len(packs)
        assert all(len(p.digests) == min(8, p.members - 8 * p.pack) for p in packs)


def test_packs_out_of_order(spark):
    """Nodes that stream by in any order, cut anywhere, make the same packs."""
    r = random.Random(8)
    tmp = common.Scratch(spark, "test")
    nodes = [(t, i, n, f"{t}{i}", (i, str(i))) for t, n in (("a", 70), (None, 9), ("b", 1)) for i in range(n)]
    r.shuffle(nodes)
    df = spark.createDataFrame(nodes, "tree string, idx long, members long, digest string, row struct<id:long,claim:string>").repartition(5)
    got = {(p.tree, p.pack): (p.digests, [x.id for x in p.rows]) for p in merkle._level(df, tmp, "level").collect()}
    assert got == {(t, k): ([f"{t}{i}" for i in range(8 * k, min(n, 8 * k + 8))], list(range(8 * k, min(n, 8 * k + 8)))) for t, n in (("a", 70), (None, 9), ("b", 1)) for k in range(-(-n // 8))}
