"""SimHash near copies by similarity: the byte-position index of operator 5 for texts of Jaccard similarity 0.8 or more.

Such texts differ in some 10 of 64 bits, too many for a guarantee by 8 bytes. So a text has a fingerprint of 512 bits, 64
bytes, over its set of word shingles, and is posted under the values of pairs of byte positions: all pairs within groups
of positions, so that fingerprints which share more bytes than there are groups are certain to meet (see `probes`). Pairs
that meet are tested on 128 bits, then their shared bytes are tallied; pairs that reach LEAST_SHARED are verified by the
exact similarity. Lists of many near texts (copies of one text, or pages of one template) report their nearest pairs first;
what verified links leave apart is then told by sketches of 4,096 bits, so that few pairs but true ones are verified. Two bits of a pair of similarity s agree with probability 1 - acos(2s / (1 + s)) / pi, 0.85 at 0.8: 17 of
64 bytes are shared on average there, and the rare pairs that share too few are what this index can miss.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, partitions, slim
from .graph import components
from .simhash import BLOCK, _bit_counts

#: Words of 64 bits in a fingerprint, and in the sketch that tells the pairs of crowded lists apart.
WIDE, SKETCH = 8, 64
#: Candidates differ in at most so many of the first 128 bits, and share so many of the 64 bytes.
NEAR_HEAD, LEAST_SHARED = 44, 4
#: Standard deviations beyond the expected number of differing bits at which a pair is given up.
SLACK = 4.3
#: Of the candidates that crowded lists guess, each text keeps so many nearest ones; the others are looked at again.
NEAREST = 3
#: Positions are probed by pairs, however many texts there are, so that what is found does not depend on their number. Only
#: whoever sets this to 0 probes by threes: shorter lists for more of them, and other chances to meet.
PAIRS_UP_TO = 4_000_000
#: Texts of one set of candidates that a task verifies together, about; larger sets are cut into pairs of blocks.
GROUP = 256
#: Up to so many ids (a long each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Shingles spread at a time.
_CHUNK = 1 << 16
#: Up to so many candidate pairs a list reports all of them; beyond, a forest, for one probe in so many. More guesses would
#: find little that is new: copies of one text meet under many probes, and all lists are looked at again. Texts that have
#: nothing in common are within NEAR_HEAD by chance (1 of CHANCE pairs), so a list may report twice that more.
FEW_PAIRS, GUESSING, CHANCE = 3, 4, 3_600
#: Entries of a list that are all compared with one another at first. Lists grow with the number of texts (1,000 entries at 65
#: million texts), and so does what a text is compared with: 96 lists of some nanoseconds an entry.
LISTED = 1024
#: Postings compared at once, at least.
ROWS = 40_000
_SPREAD = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SKETCH)], np.uint64)
_WORD = np.array([pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64) for k in range(16)], np.uint64)
_S32, _S29, _M = np.uint64(32), np.uint64(29), np.uint64(0x165667B19E3779F9)


def probes(order: int) -> np.ndarray:
    """Sets of `order` byte positions under which a fingerprint is posted: all that lie within one group of positions, with
    16 groups for pairs (96 sets) and 8 for threes (448). Any 17 positions hold one of the sets in both cases."""
    groups = 16 // (order - 1)
    own = np.arange(8 * WIDE).reshape(-1, groups).T
    return np.array([c for g in own.tolist() for c in combinations(g, order)])


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of the different shingles of words, in rising order; words too few for a shingle are one; none have none."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(h))
    n = len(h) - size + 1
    x = h[:n] * _WORD[0]
    for k in range(1, size):
        x = x + h[k : k + n] * _WORD[k]
    x = (x ^ (x >> _S32)) * _M
    return np.unique(x ^ (x >> _S29))


def fingerprint(shingles: np.ndarray, words: int = WIDE) -> bytes:
    """The SimHash of 64 bits a word of a set of shingles: a bit is set if it is in over half of their spread hashes."""
    tally = np.zeros(64 * words, np.int64)
    for at in range(0, len(shingles), _CHUNK * WIDE // words):
        wide = shingles[at : at + _CHUNK * WIDE // words, None] * _SPREAD[:words]
        tally += _bit_counts(wide ^ (wide >> _S32))
    return np.packbits(tally * 2 > len(shingles), bitorder="little").tobytes()


def most_apart(bits: int, least: float, shingles: np.ndarray) -> np.ndarray:
    """In how many of the bits texts of similarity `least` differ at most, but for chance: SLACK deviations more than expected.
    Sets of few shingles differ somewhat more, since halves of them are tied more often."""
    p = np.arccos(2 * least / (1 + least)) / np.pi + 0.15 / np.maximum(shingles, 1)
    return bits * p + SLACK * np.sqrt(bits * p * (1 - p))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _near(h: np.ndarray, a, b) -> np.ndarray:
    return np.bitwise_count(h[a] ^ h[b]).sum(-1, dtype=np.uint8) <= NEAR_HEAD


def _nearest_forest(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j): each entry with the nearest one of every other component found so far within NEAR_HEAD bits."""
    label = np.arange(len(h))
    u, v = [], []
    for i in range(len(h)):
        far = np.bitwise_count(h[i] ^ h).sum(1, dtype=np.uint8)
        near = np.flatnonzero((far <= NEAR_HEAD) & (label != label[i]))
        if len(near):
            near = near[np.argsort(far[near], kind="stable")]
            roots, first = np.unique(label[near], return_index=True)
            u.append(np.full(len(roots), i))
            v.append(near[first])
            label[np.isin(label, roots)] = label[i]
    return (np.concatenate(u), np.concatenate(v)) if u else (np.empty(0, np.int64), np.empty(0, np.int64))


def _heads(rows: pd.DataFrame) -> np.ndarray:
    return rows[["h0", "h1"]].to_numpy().view(np.uint64)


def _ordered(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)}).drop_duplicates()


def _candidates(rows: pd.DataFrame, order: int) -> pd.DataFrame:
    """Candidate pairs within each run of rows (key, h0, h1, id) of equal key: all, if they are few; else a forest that joins
    each entry to its nearest ones, so that what a list reports grows with its entries only. The key, size and ids of such a list
    come with them (u and v null), since the forest is only a first guess at what its links are. One probe in GUESSING guesses."""
    key, h, ids = rows["key"].to_numpy(), _heads(rows), rows["id"].to_numpy()
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    sizes = np.diff(cut)
    group = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= LISTED), sizes))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    d, met, most = 1, np.zeros(len(sizes), np.int64), FEW_PAIRS + sizes * sizes // CHANCE
    while len(at):
        # Entries whose d-th next one is in the same list.
        at = at[at < len(key) - d]
        at = at[group[at] == group[at + d]]
        near = at[_near(h, at, at + d)]
        if len(near):
            a.append(near)
            b.append(near + d)
            # A list that has too many pairs by now is left to the forest.
            np.add.at(met, group[near], 1)
            at = at[(met <= most)[group[at]]]
        d += 1
    a, b = np.concatenate(a), np.concatenate(b)
    crowded = (sizes > LISTED) | (met > most)
    long, few = np.flatnonzero(crowded), ~crowded[group[a]]
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for g in long[(key[cut[long]] >> (8 * order)) % GUESSING == 0]:
        i, j = _nearest_forest(h[cut[g] : cut[g + 1]])
        us.append(ids[cut[g] + i])
        vs.append(ids[cut[g] + j])
    sure, guess = _ordered(ids[a[few]], ids[b[few]]), _ordered(np.concatenate(us), np.concatenate(vs))
    lists = pd.DataFrame({"key": key[cut[long]], "entries": sizes[long]})
    found = pd.concat([sure.assign(guess=0), guess.assign(guess=1)], ignore_index=True).astype("Int64")
    out = pd.concat([found, lists], ignore_index=True).reindex(columns=["u", "v", "guess", "key", "entries"]).astype("Int64")
    return out.assign(ids=pd.Series([None] * len(found) + [ids[cut[g] : cut[g + 1]] for g in long], dtype=object))


def _whole_keys(batches: Iterator[pd.DataFrame], by: tuple[str, ...], at_once: int = 1, most: int | None = None) -> Iterator[pd.DataFrame]:
    """Rows sorted by the columns `by`, at_once or more together, cut where these change; with `most`, longer runs go out in
    overlapping pieces."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < at_once:
            continue
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else batch
        own = rows[list(by)].to_numpy()
        first = int((own == own[-1]).all(1).argmax())
        if first:
            yield rows.iloc[:first].reset_index(drop=True)
        rest = rows.iloc[first:].reset_index(drop=True)
        while most and len(rest) > 2 * most:
            yield rest.iloc[:most].reset_index(drop=True)
            rest = rest.iloc[most // 2 :].reset_index(drop=True)
        held = [rest]
    if held and sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def _met(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Of rows (key, lo, hi, block, h0, h1, id, label, n, fp) those that have a near one with another label in their run. Near ones
    are told by the whole fingerprint, as the tally would tell them later on."""
    if rows.empty:
        return rows
    own, h, n = rows[["key", "lo", "hi"]].to_numpy(), _heads(rows), rows["n"].to_numpy()
    label, block = rows["label"].to_numpy(), rows["block"].to_numpy()
    whole = np.frombuffer(b"".join(rows["fp"]), np.uint64).reshape(len(rows), -1)
    cut = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]).any(1), [True])))
    live = np.zeros(len(rows), bool)
    for start, end in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        cross = own[start, 1] != own[start, 2]
        for i in range(start, end - 1):
            other = np.flatnonzero(label[i + 1 : end] != label[i]) + i + 1
            if cross:
                other = other[block[other] != block[i]]
            near = other[_near(h, i, other)]
            if len(near):
                near = near[np.bitwise_count(whole[i] ^ whole[near]).sum(1, dtype=np.int64) <= most_apart(64 * WIDE, least, np.minimum(n[i], n[near]))]
            live[near] = True
            live[i] |= len(near) > 0
    return rows[live]


def _still_apart(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Of whole lists (rows of _met, with _blocks), what is to be looked at again: those entries of lists of one block that have a
    near one with another label, and all entries of larger lists that have several labels."""
    key, label = rows["key"].to_numpy(), rows["label"].to_numpy()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    mixed = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)
    rows = rows[np.repeat(mixed, np.diff(np.append(first, len(key))))]
    single = rows["_blocks"].to_numpy() == 1
    return pd.concat([_met(rows[single].reset_index(drop=True), least), rows[~single]]) if len(rows) else rows


def _apart(rows: pd.DataFrame, least: float) -> Iterator[pd.DataFrame]:
    """Of each run of rows (key, lo, hi, block, h0, h1, id, label, n, sketch) of equal key, lo and hi a forest (u, v, d, a, b) that
    joins all labels a and b which pairs near by their sketches join: each entry with its nearest one of every other tree found so
    far, d bits apart. Within one block where lo is hi, else from one block to the other. A run has fewer such rows than entries."""
    own, h, ids, n = rows[["key", "lo", "hi"]].to_numpy(), _heads(rows), rows["id"].to_numpy(), rows["n"].to_numpy()
    label, block = rows["label"].to_numpy(), rows["block"].to_numpy()
    sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1)
    cut = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]).any(1), [True])))
    mixed = np.minimum.reduceat(label, cut[:-1]) != np.maximum.reduceat(label, cut[:-1])
    us, vs, ds = [], [], []
    for g in np.flatnonzero(mixed):
        start, end = int(cut[g]), int(cut[g + 1])
        cross, tree = own[start, 1] != own[start, 2], label[start:end].copy()
        for i in range(start, end):
            other = np.flatnonzero(tree != tree[i - start]) + start
            if not len(other):
                break
            if cross:
                other = other[block[other] != block[i]]
            other = other[_near(h, i, other)]
            differ = np.bitwise_count(sketch[i] ^ sketch[other]).sum(1, dtype=np.int64)
            near = np.flatnonzero(differ <= most_apart(64 * sketch.shape[1], least, np.minimum(n[i], n[other])))
            if len(near):
                near = near[np.argsort(differ[near], kind="stable")]
                roots, first = np.unique(tree[other[near] - start], return_index=True)
                us.append(np.full(len(roots), i))
                vs.append(other[near[first]])
                ds.append(differ[near[first]])
                tree[np.isin(tree, roots)] = tree[i - start]
    if us:
        u, v = np.concatenate(us), np.concatenate(vs)
        ends, labels = np.sort(ids[[u, v]], 0), np.sort(label[[u, v]], 0)
        yield pd.DataFrame({"u": ends[0], "v": ends[1], "d": np.concatenate(ds), "a": labels[0], "b": labels[1]}).drop_duplicates()


def _near_pairs(rows: pd.DataFrame, least: float) -> list[tuple[int, int, int]]:
    """Pairs (bits apart, i, j) of places in rows (piece, label, n, sketch) of one set that have different labels and are near by
    their sketches, nearest first: from one piece to the other, if there are two."""
    label, n, piece = rows["label"].to_numpy(), rows["n"].to_numpy(), rows["piece"].to_numpy()
    sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1)
    cross, found = piece[0] != piece[-1], []
    for i in range(len(rows) - 1):
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if cross:
            other = other[piece[other] != piece[i]]
        differ = np.bitwise_count(sketch[i] ^ sketch[other]).sum(1, dtype=np.int64)
        near = differ <= most_apart(64 * sketch.shape[1], least, np.minimum(n[i], n[other]))
        found += zip(differ[near].tolist(), [i] * int(near.sum()), other[near].tolist(), strict=True)
    return sorted(found)


def _asked_pairs(rows: pd.DataFrame) -> list[tuple[int, int, int]]:
    """The pairs (bits apart, i, j) that rows(node, partners) of one set ask for, nearest first."""
    place = {int(x): k for k, x in enumerate(rows["node"])}
    return sorted((int(p["d"]), i, place[int(p["v"])]) for i, own in enumerate(rows["partners"]) for p in own)


def _verify(rows: pd.DataFrame, pairs: list[tuple[int, int, int]], size: int, least: float) -> tuple[list[int], list[int]]:
    """rows(node, text) of one set, and pairs of them, nearest first -> links: pairs whose exact similarity is enough. A pair that
    verified links (or labels, where rows have them) already join is not looked at again."""
    root, sets = list(range(len(rows))), {}
    if "label" in rows:
        first: dict[int, int] = {}
        root = [first.setdefault(int(x), k) for k, x in enumerate(rows["label"])]

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def shingles(x: int) -> np.ndarray:
        if x not in sets:
            sets[x] = shingle_set(words_of(rows["text"].iat[x]), size)
        return sets[x]

    us, vs = [], []
    for _, i, j in pairs:
        if top(i) == top(j):
            continue
        s, t = shingles(i), shingles(j)
        both = len(s) + len(t) - len(np.unique(np.concatenate((s, t))))
        if both >= least * max(1, len(s) + len(t) - both):
            root[top(i)] = top(j)
            us.append(int(rows["node"].iat[i]))
            vs.append(int(rows["node"].iat[j]))
    return us, vs


def _linked(pairs: DataFrame, texts: DataFrame, saved: DataFrame, tmp: Scratch, name: str, size: int, least: float) -> DataFrame:
    """Links (u, v) among candidate pairs (u, v, guess) that connect what all links among them would. Pairs are tallied first."""

    @F.pandas_udf("int")
    def apart(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        """Bits in which two fingerprints differ; null if they differ in too many or share too few bytes."""
        x, y = (np.frombuffer(b"".join(c), np.uint8).reshape(len(c), -1) for c in (a, b))
        d = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
        ok = ((x == y).sum(1) >= LEAST_SHARED) & (d <= most_apart(64 * WIDE, least, n.to_numpy()))
        return pd.Series(np.where(ok, d, 0), dtype="Int64").mask(~ok)

    fps = texts.select(F.col("id").alias("_i"), "fp", "n")
    pairs = tmp.save(pairs, f"met-{name}")
    tallied = pairs.join(fps.select(F.col("_i").alias("u"), F.col("fp").alias("_a"), F.col("n").alias("_na")), "u")
    tallied = tallied.join(fps.select(F.col("_i").alias("v"), F.col("fp").alias("_b"), F.col("n").alias("_nb")), "v")
    # Not to be worked out a second time by a filter that is pushed below it.
    apart = apart.asNondeterministic()
    tallied = tallied.select("u", "v", "guess", apart("_a", "_b", F.least("_na", "_nb")).alias("d")).filter("d is not null")
    # Guesses of crowded lists count only if they are among a text's nearest, on either side; the rest is looked at again.
    rank = lambda c, d: F.row_number().over(W.partitionBy(c, "guess").orderBy("d", d))
    tallied = tallied.withColumn("_r", rank("u", "v")).withColumn("_s", rank("v", "u"))
    pairs = tmp.save(tallied.filter((F.col("guess") == 0) | (F.least("_r", "_s") <= NEAREST)).select("u", "v", "d"), f"pairs-{name}")
    return _confirmed(pairs, saved, tmp, name, size, least)


def _confirmed(pairs: DataFrame, saved: DataFrame, tmp: Scratch, name: str, size: int, least: float) -> DataFrame:
    """Links (u, v) among pairs (u, v, d) that connect what all links among them would. Pairs that hang together are verified
    together, each text read once; sets of more than GROUP texts in pairs of blocks."""
    inner = Scratch(saved.sparkSession, f"near-loose-{name}")
    loose = components(pairs, inner)
    sizes = loose.groupBy(F.col("root").alias("_root")).agg(F.ceil(F.count("*") / GROUP).cast("int").alias("_blocks"))
    placed = loose.join(sizes, loose["root"] == sizes["_root"]).select("node", "root", F.pmod(F.xxhash64("node", F.lit("group")), F.col("_blocks")).cast("int").alias("block"))
    placed = tmp.save(placed, f"placed-{name}")
    sided = pairs.join(placed.select(F.col("node").alias("u"), "root", F.col("block").alias("_bu")), "u").join(placed.select(F.col("node").alias("v"), F.col("block").alias("_bv")), "v")
    sided = sided.select("root", F.least("_bu", "_bv").alias("lo"), F.greatest("_bu", "_bv").alias("hi"), "u", F.struct("v", "d").alias("p"))
    # An entry has at most the texts of two blocks as partners here.
    asked = sided.select("root", "lo", "hi", F.col("u").alias("node"), "p").union(sided.select("root", "lo", "hi", "p.v", F.lit(None).cast("struct<v:bigint,d:int>")))
    asked = tmp.save(asked.groupBy("root", "lo", "hi", "node").agg(F.collect_list("p").alias("partners")), f"asked-{name}")
    ids = tmp.save(placed.select(F.col("node").alias("_id")), f"ids-{name}")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    bodies = saved.join(ids, saved["_uid"] == ids["_id"], "left_semi")
    rows = asked.join(bodies, asked["node"] == bodies["_uid"]).select("root", "lo", "hi", "node", "partners", F.col("_text").alias("text"))
    linked = tmp.save(_in_sets(rows, _asked_pairs, size, least), f"linked-{name}")
    inner.drop()
    return linked


def _in_sets(rows: DataFrame, pairs_of: Callable[[pd.DataFrame], list[tuple[int, int, int]]], size: int, least: float) -> DataFrame:
    """Verified links (u, v) within the sets (root, lo, hi) of rows (node, text and what pairs_of reads)."""
    rows = rows.repartition(partitions(rows.sparkSession), "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "node")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        us: list[int] = []
        vs: list[int] = []
        for part in _whole_keys(slim(batches), ("root", "lo", "hi")):
            own = part[["root", "lo", "hi"]].to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]).any(1), [True])))
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                one = part.iloc[i:j]
                u, v = _verify(one, pairs_of(one), size, least)
                us += u
                vs += v
        yield pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})

    return rows.mapInPandas(check, "u long, v long")


def _left_apart(members: DataFrame, told: DataFrame, saved: DataFrame, tmp: Scratch, size: int, least: float) -> DataFrame:
    """Links (u, v) among texts (id, root, label, n) of one root and different labels: all pairs that are near by their sketches.
    Such pairs are told where they are verified, so none of them is a row. Texts are dealt into pieces of some GROUP texts, those
    of a label that has so many into pieces of their own, and sets are pairs of pieces: a large label meets the others only."""
    many = members.groupBy("root").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).filter("_a <> _b").select(F.col("root").alias("_root"))
    left = tmp.save(members.join(many, members["root"] == many["_root"], "left_semi"), "left")
    pools = left.groupBy(F.col("root").alias("_root"), F.col("label").alias("_label")).agg(F.count("*").alias("_n"))
    pools = tmp.save(pools.withColumn("_pool", F.when(F.col("_n") >= GROUP, F.col("_label"))), "pools")
    blocks = pools.groupBy(F.col("_root").alias("_r"), F.col("_pool").alias("_p")).agg(F.ceil(F.sum("_n") / GROUP).cast("int").alias("_blocks"))
    pools = pools.join(blocks, (F.col("_root") == F.col("_r")) & F.col("_pool").eqNullSafe(F.col("_p")))
    dealt = left.join(pools, (left["root"] == pools["_root"]) & (left["label"] == pools["_label"]))
    block = F.pmod(F.xxhash64("id", F.lit("apart")), F.col("_blocks")).cast("int")
    dealt = tmp.save(dealt.withColumn("piece", F.concat_ws(":", "_pool", block)).select("root", "_pool", "piece", "id", "label", "n"), "dealt")
    pieces = tmp.save(dealt.select("root", "_pool", "piece").distinct(), "pieces")
    lo, hi = (pieces.select(F.col("root").alias(f"_{k}"), F.col("_pool").alias(f"_pool_{k}"), F.col("piece").alias(k)) for k in ("lo", "hi"))
    sets = lo.join(hi, (F.col("_lo") == F.col("_hi")) & (F.col("lo") <= F.col("hi"))).filter("_pool_lo is null or _pool_hi is null or _pool_lo <> _pool_hi")
    sides = sets.select(F.col("_lo").alias("_root"), "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("_piece"))
    asked = dealt.join(sides, (dealt["root"] == sides["_root"]) & (dealt["piece"] == sides["_piece"])).select("root", "lo", "hi", "piece", F.col("id").alias("node"), "label", "n")
    ids = left.select(F.col("id").alias("_id"))
    ids = F.broadcast(ids) if left.count() <= BROADCAST_IDS else ids
    bodies = saved.join(ids, saved["_uid"] == ids["_id"], "left_semi").join(told.select(F.col("_uid").alias("_t"), "sketch"), F.col("_uid") == F.col("_t"))
    rows = asked.join(bodies, asked["node"] == bodies["_uid"]).select(*asked.columns, "sketch", F.col("_text").alias("text"))
    return tmp.save(_in_sets(rows, lambda one: _near_pairs(one, least), size, least), "linked-left")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """docs less near copies: of each group the row with the smallest id stays, with all its columns.

    Texts whose words are the same (A-Z lower-cased) are one; other texts are linked if their sets of word shingles
    reach the Jaccard similarity. Groups follow links. Texts without words (null, empty) are alike. A null id is larger
    than any other; of repeated rows one stays. An empty table stays empty. Lists of many candidate pairs
    report first a forest that joins each entry to its nearest one of every other component, which is verified; then such a forest by
    sketches, of what verified links leave apart; then all pairs that are still apart are told and verified, set by set.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "near")
    saved = tmp.save(docs.withColumn("_uid", F.monotonically_increasing_id()), "docs")

    @F.pandas_udf("fp binary, exact binary, n int")
    def make(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in slim(texts):
            split = ((w, shingle_set(w, size)) for w in map(words_of, batch))
            yield pd.DataFrame([(fingerprint(s), xxhash.xxh3_128_digest(b" ".join(w)), len(s)) for w, s in split], columns=["fp", "exact", "n"])

    @F.pandas_udf("binary")
    def sketch(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in slim(texts):
            yield pd.Series([fingerprint(shingle_set(words_of(t), size), SKETCH) for t in batch])

    rows = saved.select("_uid", F.col(id_col).alias("_id"), make(F.col(text_col)).alias("_f"))
    rows = tmp.save(rows.select("_uid", "_id", "_f.fp", "_f.exact", "_f.n"), "rows")
    best = F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_uid").alias("u")))
    texts = tmp.save(rows.groupBy("exact").agg(best.alias("_best"), F.first("fp").alias("fp"), F.first("n").alias("n")).select("_best", F.col("_best.u").alias("id"), "fp", "n"), "texts")
    bodies = saved.select("_uid", F.col(text_col).alias("_text"))
    order = 2 if PAIRS_UP_TO else 3

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = probes(order)
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                fp = np.frombuffer(b"".join(part["fp"]), np.uint8).reshape(len(part), -1)
                key = np.arange(len(sets), dtype=np.int64)[None, :] << (8 * order)
                for k in range(order):
                    key = key | fp[:, sets[:, k]].astype(np.int64) << (8 * k)
                head = np.ascontiguousarray(fp[:, :16]).view(np.int64)
                out = {"key": key.ravel(), **{c: np.repeat(x, len(sets)) for c, x in (("h0", head[:, 0]), ("h1", head[:, 1]))}}
                yield pd.DataFrame(out | {c: np.repeat(part[c].to_numpy(), len(sets)) for c in part.columns if c != "fp"})

    def repost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["keys"].map(len).to_numpy()
            for at in range(0, len(batch), 2000):
                part, many = batch.iloc[at : at + 2000], sizes[at : at + 2000]
                head = np.frombuffer(b"".join(x[:16] for x in part["fp"]), np.int64).reshape(-1, 2)
                out = {"key": np.concatenate(part["keys"].tolist()), "_blocks": np.concatenate(part["blocks"].tolist()), "h0": np.repeat(head[:, 0], many), "h1": np.repeat(head[:, 1], many)}
                out |= {c: np.repeat(part[c].to_numpy(), many) for c in ("id", "label", "n", "fp")}
                yield pd.DataFrame(out)[["key", "h0", "h1", "id", "label", "n", "_blocks", "fp"]]

    posted = texts.select("id", "fp").mapInPandas(post, "key long, h0 long, h1 long, id long")
    posted = posted.repartition(partitions(spark), "key").sortWithinPartitions("key")
    met = tmp.save(posted.mapInPandas(lambda b: map(lambda rows: _candidates(rows, order), _whole_keys(b, ("key",), ROWS, BLOCK)), "u long, v long, guess int, key long, entries long, ids array<bigint>"), "met")
    first = met.filter("key is null").groupBy("u", "v").agg(F.min("guess").alias("guess"))
    linked = _linked(first, texts, bodies, tmp, "first", size, least)
    found = components(linked, tmp)
    # Pieces of a list overlap, so its entries are counted from above.
    lists = met.filter("key is not null")
    if lists.head(1):
        # Crowded lists again, now all of their pairs that verified links don't join yet, told by sketches. Only texts of such
        # lists are posted, each under the keys of its own: a row for each text is joined with its label, not one for each posting.
        long = lists.groupBy(F.col("key").alias("_k")).agg(F.ceil(F.sum("entries") / BLOCK).cast("int").alias("_blocks"))
        own = lists.join(long, lists["key"] == long["_k"]).select(F.explode("ids").alias("_id"), F.struct("key", F.col("_blocks").alias("blocks")).alias("_list"))
        own = tmp.save(own.groupBy("_id").agg(F.collect_set("_list").alias("_lists")), "crowded")
        named = own.join(texts, own["_id"] == texts["id"]).join(found, F.col("id") == found["node"], "left")
        named = named.select("id", "fp", F.coalesce("root", "id").alias("label"), "n", F.col("_lists.key").alias("keys"), F.col("_lists.blocks").alias("blocks"))
        # Texts of many lists stand side by side where they were grouped; dealt anew, each task posts its share (96 rows a text at most).
        again = named.repartition("id").mapInPandas(repost, "key long, h0 long, h1 long, id long, label long, n int, _blocks int, fp binary")
        in_runs = lambda df, *by: df.repartition(partitions(spark), *by).sortWithinPartitions(*by)
        # Only entries that meet a near one of another label need a sketch, which is longer than all the rest of a row. Lists of
        # one block are looked through at once; larger ones with several labels are cut into pairs of blocks first.
        again = in_runs(again.select("key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("block"), "h0", "h1", "id", "label", "n", "_blocks", "fp"), "key")
        again = tmp.save(again.mapInPandas(lambda b: (_still_apart(rows, least) for rows in _whole_keys(b, ("key",), ROWS)), again.schema), "again")
        cut = again.filter("_blocks > 1").withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.col("_blocks")).cast("int"))
        cut = cut.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        cut = cut.select("key", F.least("block", "_with").alias("lo"), F.greatest("block", "_with").alias("hi"), "block", "h0", "h1", "id", "label", "n", "fp")
        cut = tmp.save(in_runs(cut, "key", "lo", "hi").mapInPandas(lambda b: (_met(rows, least) for rows in _whole_keys(b, ("key", "lo", "hi"), ROWS)), cut.schema), "live")
        again = again.filter("_blocks = 1").drop("_blocks").unionByName(cut).drop("fp")
        crowd = tmp.save(again.select("id", "label", "n").distinct(), "crowd")
        ids = crowd.select(F.col("id").alias("_id"))
        ids = F.broadcast(ids) if crowd.count() <= BROADCAST_IDS else ids
        told = tmp.save(bodies.join(ids, bodies["_uid"] == ids["_id"], "left_semi").select("_uid", sketch("_text").alias("sketch")), "sketches")
        again = in_runs(again.join(told, again["id"] == told["_uid"]).drop("_uid"), "key", "lo", "hi")

        def meet_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in _whole_keys(slim(batches), ("key", "lo", "hi")):
                yield from _apart(part, least)

        # First the nearest pairs that join what hangs together, which leaves little of a group of near copies apart; then all
        # pairs of what is left, set by set. All that is near by sketches hangs together by labels (a, b), whichever pairs stand for it.
        forest = tmp.save(again.mapInPandas(meet_apart, "u long, v long, d int, a long, b long").distinct(), "forest")
        linked = linked.union(_confirmed(forest.select("u", "v", "d"), bodies, tmp, "again", size, least))
        found = components(linked, Scratch(spark, "near-again"))
        trees = components(forest.select(F.col("a").alias("u"), F.col("b").alias("v")), Scratch(spark, "near-trees"))
        members = crowd.select("id", "n", F.col("label").alias("_was")).join(trees.select(F.col("node").alias("_node"), F.col("root").alias("_tree")), F.col("_was") == F.col("_node"))
        members = members.join(found, members["id"] == found["node"], "left").select("id", F.col("_tree").alias("root"), F.coalesce(found["root"], "id").alias("label"), "n")
        linked = linked.union(_left_apart(members, told, bodies, tmp, size, least))
        found = components(linked, Scratch(spark, "near-left"))
    classed = texts.join(found, texts["id"] == found["node"], "left").select("_best", F.coalesce("root", "id").alias("_root"))
    stays = classed.groupBy("_root").agg(F.min("_best").alias("_best")).select(F.col("_best.u").alias("_k"))
    gone = tmp.save(rows.select("_uid").join(stays, rows["_uid"] == stays["_k"], "left_anti").select(F.col("_uid").alias("_g")), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    tmp.keep("docs", "gone")
    return saved.join(gone, saved["_uid"] == gone["_g"], "left_anti").select(*docs.columns)
