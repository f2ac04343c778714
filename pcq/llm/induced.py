"""Suffixes and their common prefixes in order, by external induced sorting.

Suffixes are of two types: larger than the one behind them (L), or smaller (S); an S behind an L is a star. Stars are sorted
by recursion: the strings between them get names in order, and the string of names is sorted the same way. From the stars
in order follow the L suffixes: whenever a suffix comes up, the one before it, if it is an L, is queued under its first
letter. From the L suffixes, in falling order, follow all S in the same way.

The queues are priority queues of tuples (letter, arrival, place, common prefix). What comes up next is a sorted block of the
smallest tuples, as long as nothing that it queues belongs inside it. Sorted runs of tuples go to disk (the folder that is
given: one that outlives the task) when more than MEMORY tuples are held, as do the lists of sorted suffixes; queues and
lists so need no memory that grows with the text. The text itself, its types and some numbers for each letter are held.

The common prefix of two neighbours in a queue is one more than the least among the suffixes that came up between their
sources; it is carried in the tuple and never counted letter by letter, but where L and S of one letter meet. From a string
of names it becomes the letters of the names that are alike plus those that two different names share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np

#: Tuples that a queue or a list holds in memory, and most that come up at once.
MEMORY, BLOCK = 1_500_000, 1 << 16
#: Strings up to this length are sorted in memory, which ends the recursion.
SHORT = 1 << 21
_FEW = 8


class Store:
    """Arrays of int64 rows in files of a folder that pyarrow knows how to reach; the folder goes with close()."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        self.path, self.made = f"{path}/{uuid.uuid4().hex}", 0

    def write(self, rows: np.ndarray) -> tuple[str, int, int]:
        if not self.made:
            self.fs.create_dir(self.path, recursive=True)
        self.made += 1
        with self.fs.open_output_stream(f"{self.path}/{self.made}") as f:
            f.write(np.ascontiguousarray(rows))
        return f"{self.path}/{self.made}", *rows.shape

    def read(self, at: tuple[str, int, int], first: int, last: int) -> np.ndarray:
        name, _, width = at
        with self.fs.open_input_file(name) as f:
            raw = f.read_at((last - first) * 8 * width, first * 8 * width)
        return np.frombuffer(raw, np.int64).reshape(-1, width)

    def close(self) -> None:
        if self.made:
            self.fs.delete_dir(self.path)


class Spool:
    """A list of rows that grows at its end, in memory or on disk, and is read forwards or backwards."""

    def __init__(self, store: Store, width: int):
        self.store, self.width, self.parts, self.held, self.size = store, width, [], 0, 0

    def add(self, rows: np.ndarray) -> None:
        if len(rows):
            self.parts.append(rows)
            self.held += len(rows)
            self.size += len(rows)
        if self.held > MEMORY:
            own = [p for p in self.parts if isinstance(p, np.ndarray)]
            self.parts = [p for p in self.parts if not isinstance(p, np.ndarray)] + [self.store.write(np.concatenate(own))]
            self.held = 0

    def blocks(self, backwards: bool = False) -> Iterator[np.ndarray]:
        for part in reversed(self.parts) if backwards else self.parts:
            n = len(part) if isinstance(part, np.ndarray) else part[1]
            for at in range(0, n, BLOCK):
                a, b = (max(0, n - at - BLOCK), n - at) if backwards else (at, min(n, at + BLOCK))
                rows = part[a:b] if isinstance(part, np.ndarray) else self.store.read(part, a, b)
                yield rows[::-1] if backwards else rows


class Queue:
    """A priority queue of rows (key, arrival, ...), smallest first: sorted runs, merged while they are few and short, and on
    disk when they are many."""

    def __init__(self, store: Store, width: int):
        self.store, self.width, self.runs, self.size = store, width, [], 0

    def push(self, rows: np.ndarray) -> None:
        """Rows in order of key and arrival, which are later than all before."""
        if not len(rows):
            return
        self.size += len(rows)
        self.runs.append([rows, 0, None])
        # Runs of like length are merged, so that each row is merged a logarithmic number of times.
        while len(self.runs) > _FEW:
            short = sorted((r for r in self.runs if r[2] is None), key=lambda r: len(r[0]) - r[1])[:_FEW]
            if len(short) < 2:
                break
            self.runs = [r for r in self.runs if not any(r is s for s in short)]
            self.runs.append([_sorted(np.concatenate([r[0][r[1] :] for r in short])), 0, None])
        if sum(len(r[0]) - r[1] for r in self.runs if r[2] is None) > MEMORY:
            rows = _sorted(np.concatenate([r[0][r[1] :] for r in self.runs if r[2] is None]))
            self.runs = [r for r in self.runs if r[2] is not None] + [[None, 0, self.store.write(rows)]]

    def head(self, n: int) -> np.ndarray:
        """The n smallest rows, or somewhat more or fewer, with the number of their run behind."""
        parts, bound = [], None
        for k, (rows, at, disk) in enumerate(self.runs):
            total = len(rows) if disk is None else disk[1]
            some = rows[at : at + n] if disk is None else self.store.read(disk, at, min(total, at + n))
            if at + len(some) < total and (bound is None or tuple(some[-1, :2]) < bound):
                bound = tuple(some[-1, :2])
            parts.append(np.column_stack((some, np.full(len(some), k))))
        if not parts:
            return np.empty((0, self.width + 1), np.int64)
        rows = _sorted(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        if bound is not None:
            rows = rows[(rows[:, 0] < bound[0]) | ((rows[:, 0] == bound[0]) & (rows[:, 1] <= bound[1]))]
        return rows

    def drop(self, run: np.ndarray) -> None:
        """Rows of the head, by the numbers of their runs, are done."""
        self.size -= len(run)
        for k, n in enumerate(np.bincount(run, minlength=len(self.runs)).tolist()):
            self.runs[k][1] += n
        self.runs = [r for r in self.runs if r[1] < (len(r[0]) if r[2] is None else r[2][1])]


def _sorted(rows: np.ndarray) -> np.ndarray:
    """Rows in order of key and arrival; a stable sort merges the sorted runs that they consist of."""
    last, least = int(rows[:, 1].max()) + 1, int(rows[:, 1].min())
    if int(rows[:, 0].max()) < (1 << 62) // (last - least):
        return rows[np.argsort(rows[:, 0] * (last - least) + (rows[:, 1] - least), kind="stable")]
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end counts as such."""
    n = len(t)
    sign = np.sign(t[1:].astype(np.int64) - t[:-1])
    last = np.where(sign != 0, np.arange(n - 1), n)
    last = np.minimum.accumulate(last[::-1])[::-1]
    return np.append(np.where(last < n, sign[np.minimum(last, n - 2)] > 0, False), True) if n > 1 else np.ones(1, bool)


def _common(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many letters the suffixes at a and b share, up to most."""
    out = np.zeros(len(a), np.int64)
    live, k, n = np.arange(len(a)), 0, len(t)
    while len(live) and k < most:
        x, y = a[live] + k, b[live] + k
        ok = (x < n) & (y < n)
        ok[ok] = t[x[ok]] == t[y[ok]]
        live = live[ok]
        k += 1
        out[live] = k
    return out


class _Least:
    """The least of any stretch of an array: tables of the least of 1, 2, 4, ... neighbours."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Over first to last, both counted in."""
        size = last - first + 1
        level = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(first), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.levels[k][first[own]], self.levels[k][last[own] - (1 << k) + 1])
        return out


def _induce(t: np.ndarray, small: np.ndarray, source: Iterator[np.ndarray], store: Store, most: int, falling: bool, take) -> None:
    """Suffixes in order (falling order, if so): those of the source, rows (place, common prefix with the row before), and the
    ones induced from them, L in rising and S in falling order. take(places, common prefixes, induced) gets them in blocks."""
    top = int(t.max()) + 1
    # The key tells letter and type; L stand before S of the same letter, the other way round in falling order.
    letter = (lambda c: 2 * (top - c)) if falling else (lambda c: 2 * c)
    queue, arrival = Queue(store, 4), 0
    waiting = np.empty((0, 2), np.int64)
    ended, previous = False, None
    wanted = 1024
    # By letter: the block of the last push, and the least common prefix behind it in that block.
    last_block, after = np.full(top + 1, -1, np.int64), np.zeros(top + 1, np.int64)
    # The least common prefix from the start of each earlier block to the end of the last one.
    tail, blocks = np.full(1024, most, np.int64), 0
    while True:
        while not ended and len(waiting) < wanted:
            rows = next(source, None)
            ended = rows is None
            waiting = waiting if ended else np.concatenate((waiting, rows))
        head = queue.head(wanted)
        if not len(head) and not len(waiting):
            return
        key = np.concatenate((head[:, 0], letter(t[waiting[:, 0]].astype(np.int64)) + 1))
        place, lcp = np.concatenate((head[:, 2], waiting[:, 0])), np.concatenate((head[:, 3], waiting[:, 1]))
        order = np.argsort(key, kind="stable")
        # Beyond what both have shown, either may have something smaller.
        bound = min([key[len(head) - 1] if len(head) < queue.size else np.inf, key[-1] if not ended and len(waiting) else np.inf])
        order = order[: np.searchsorted(key[order], bound, side="right")]
        if bound < np.inf:
            # At the bound itself, only the side that ends there has shown all that comes first.
            edge = key[order] == bound
            if len(head) and len(head) < queue.size and bound == key[len(head) - 1]:
                order = order[~edge | (order < len(head))]
        key, place, lcp = key[order], place[order], lcp[order]
        child = place - 1
        ok = child >= 0
        ok[ok] = small[child[ok]] if falling else ~small[child[ok]]
        letters = t[np.maximum(child, 0)].astype(np.int64)
        queued = np.where(ok, letter(letters), np.iinfo(np.int64).max)
        # The block ends before anything that a row of it queues would come up.
        n = len(key) if len(key) < 2 else int(np.argmax(np.append(key[1:] > np.minimum.accumulate(queued)[:-1], True))) + 1
        wanted = min(BLOCK, 2 * wanted) if n == len(key) else max(1024, min(wanted, 4 * n))
        order, key, place, lcp, ok, letters = order[:n], key[:n], place[:n], lcp[:n].copy(), ok[:n], letters[:n]
        # Neighbours of one key carry their common prefix; different letters share nothing; L and S of a letter are compared.
        before_key = np.concatenate(([-1 if previous is None else previous[0]], key[:-1]))
        before = np.concatenate(([-1 if previous is None else previous[1]], place[:-1]))
        lcp[(before_key >> 1) != (key >> 1)] = 0
        meet = np.flatnonzero((before_key != key) & ((before_key >> 1) == (key >> 1)))
        if len(meet):
            lcp[meet] = _common(t, before[meet], place[meet], most)
        previous = int(key[-1]), int(place[-1])
        induced = order < len(head)
        take(place, lcp, induced)
        queue.drop(head[order[induced], 4])
        waiting = waiting[int((~induced).sum()) :]
        # Queue the suffixes before these.
        push = np.flatnonzero(ok)
        if len(push):
            by = push[np.argsort(letters[push], kind="stable")]
            own = letters[by]
            first = np.concatenate(([True], own[1:] != own[:-1]))
            least = _Least(lcp)
            since = np.concatenate(([0], by[:-1] + 1))
            value = least.of(np.where(first, 0, since), by)
            # The first push of a letter here goes back to the last one before this block.
            far = np.minimum(after[own[first]], tail[last_block[own[first]] + 1])
            value[first] = np.minimum(value[first], far)
            rows = np.column_stack((letter(own), arrival + np.arange(len(by)), place[by] - 1, np.minimum(most, value + 1)))
            arrival += len(by)
            queue.push(rows[np.argsort(rows[:, 0], kind="stable")])
            final = np.append(np.flatnonzero(first)[1:] - 1, len(by) - 1)
            last_block[own[final]] = blocks
            end = len(lcp) - 1
            rest = by[final] < end
            after[own[final]] = most
            if rest.any():
                after[own[final][rest]] = least.of(by[final][rest] + 1, np.full(int(rest.sum()), end))
        if blocks + 2 > len(tail):
            tail = np.concatenate((tail, np.full(len(tail), most, np.int64)))
        np.minimum(tail[: blocks + 1], int(lcp.min()), out=tail[: blocks + 1])
        blocks += 1


def _names(t: np.ndarray, small: np.ndarray, star: np.ndarray) -> np.ndarray:
    """A number for the string from each star to the next, equal for equal ones, in order: letters with types, one after
    another, refine groups of strings that are alike so far."""
    size = np.append(np.diff(star), 0)
    coded = t.astype(np.int64) * 2 + small
    base = int(coded.max()) + 2
    name = np.zeros(len(star), np.int64)
    live, step = np.arange(len(star)), 0
    while len(live):
        # A string that has ended sorts before one that goes on; with types, neither is a part of the other.
        value = name[live] * base + np.where(size[live] >= step, coded[np.minimum(star[live] + step, len(t) - 1)] + 1, 0)
        order = np.argsort(value, kind="stable")
        value, live = value[order], live[order]
        group = name[live]
        new = np.concatenate(([True], value[1:] != value[:-1]))
        first = np.concatenate(([True], group[1:] != group[:-1]))
        # A group's number is the place of its first string, so what is refined keeps clear of other groups.
        at = np.arange(len(live))
        start = np.maximum.accumulate(np.where(first, at, 0))
        place = group + np.maximum.accumulate(np.where(new, at, 0)) - start
        name[live] = place
        alone = new & np.append(new[1:], True)
        live = live[~alone & (size[live] > step)]
        live.sort()
        step += 1
    return name


def _direct(t: np.ndarray) -> np.ndarray:
    """The suffixes of a short string in order, where recursion ends: ranks by pairs of ranks, twice as long each time."""
    _, rank = np.unique(t, return_inverse=True)
    step = 1
    while True:
        pair = rank * (len(t) + 1) + np.append(rank[step:] + 1, np.zeros(min(step, len(t)), np.int64))[: len(t)]
        _, rank = np.unique(pair, return_inverse=True)
        if int(rank.max()) == len(t) - 1:
            return np.argsort(rank)
        step *= 2


def _sort(t: np.ndarray, store: Store, most: int) -> Spool:
    """Rows (place, common prefix with the one before, up to most) of all suffixes but the end's own, in falling order. t ends
    with its only 0."""
    n = len(t)
    out = Spool(store, 2)
    if n < 2:
        return out
    if n <= SHORT:
        order = _direct(t)[::-1]
        lcp = np.append(_common(t, order[1:], order[:-1], most), 0)
        # In falling order, a row's common prefix is with the larger suffix before it.
        out.add(np.column_stack((order[:-1], np.concatenate(([0], lcp[:-2])))))
        return out
    small = _types(t)
    star = np.flatnonzero(small & ~np.concatenate(([True], small[:-1])))
    name = _names(t, small, star)
    count = len(np.unique(name))
    stars = Spool(store, 2)
    if count == len(star):
        sorted_stars = iter([np.column_stack((np.argsort(name), np.zeros(len(star), np.int64)))])
    else:
        # The end's own string is the least, and the only one of its name.
        reduced = np.unique(name, return_inverse=True)[1]
        rest = _sort(reduced, store, most)
        sorted_stars = _rising(rest, len(reduced) - 1)
    before = -1
    for rows in sorted_stars:
        at, alike = rows[:, 0], rows[:, 1]
        left = np.concatenate(([before], at[:-1]))
        before = int(at[-1])
        place, ahead = star[at], star[np.maximum(left, 0)]
        # Names that are alike, and the letters that the first different ones share.
        stop = np.minimum(at + alike, len(star) - 1)
        lcp = star[stop] - place
        go = (left >= 0) & (lcp < most)
        lcp[go] += _common(t, ahead[go] + lcp[go], place[go] + lcp[go], most)
        lcp = np.minimum(most, np.where(left < 0, 0, lcp))
        stars.add(np.column_stack((place, lcp)))
    larger = Spool(store, 2)

    def take_l(place, lcp, induced) -> None:
        # An L's common prefix with the L before it: the least over the stars between as well.
        nonlocal carried
        least = lcp if carried is None else np.concatenate(([min(carried, lcp[0])], lcp[1:]))
        own = np.flatnonzero(induced)
        if len(own):
            begin = np.concatenate(([0], own[:-1] + 1))
            larger.add(np.column_stack((place[own], _Least(least).of(begin, own))))
            carried = int(least[own[-1] + 1 :].min()) if own[-1] + 1 < len(least) else None
        else:
            carried = int(least.min())

    carried = None
    _induce(t, small, stars.blocks(), store, most, False, take_l)
    # Read backwards, a row's common prefix is with the row behind it.
    _induce(t, small, _turned(larger), store, most, True, lambda place, lcp, induced: out.add(np.column_stack((place, lcp))))
    return out


def _turned(rows: Spool) -> Iterator[np.ndarray]:
    """Rows backwards, each with its common prefix with the one read before it."""
    carry = 0
    for block in rows.blocks(backwards=True):
        yield np.column_stack((block[:, 0], np.concatenate(([carry], block[:-1, 1]))))
        carry = int(block[-1, 1])


def _rising(rows: Spool, end: int) -> Iterator[np.ndarray]:
    """Falling rows turned round, behind the end's own suffix."""
    yield np.array([[end, 0]])
    yield from _turned(rows)


def suffixes(t: np.ndarray, most: int, folder: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, common prefixes with the suffix before, up to most) of all suffixes of t, in order, block by block. t ends
    with its only 0. Files go to folder (a path or a URI) and are gone at the end."""
    store = Store(folder)
    try:
        for block in _rising(_sort(np.asarray(t), store, most), len(t) - 1):
            yield block[:, 0], block[:, 1]
    finally:
        store.close()
