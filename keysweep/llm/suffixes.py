"""Suffix array and common-prefix values of one shard by external induced sorting.

Suffixes that begin a rise after a fall (S*) are ordered by recursion on the string of their substrings' names; all others are
induced from them. Induced tuples (character, order, position, rank of the next suffix) wait in a priority queue whose
sorted runs lie on disk beyond a bound, and are taken out in bulk: up to the smallest character that what is taken out
can still induce. Common-prefix values travel along: two suffixes induced side by side share one character more than the
range minimum between the suffixes that induced them, and those of the recursion's names are turned into characters.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Tuples that a queue keeps in memory; larger runs go to disk.
IN_MEMORY = 1 << 22
#: Tuples taken out at a time, at most (but for one character's own).
BULK = 1 << 18
#: Ranks of one block of the range minima.
BLOCK = 32


class Queue:
    """Bulk priority queue of (character, position, rank); equal characters come out in the order they went in."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def push(self, chars: np.ndarray, positions: np.ndarray, ranks: np.ndarray) -> None:
        if not len(chars):
            return
        order = np.argsort(chars, kind="stable")
        run = chars[order], positions[order], ranks[order]
        while self.runs and len(self.runs[-1][0]) <= 2 * len(run[0]):  # sizes stay geometric: few runs at any time
            older = self.runs.pop()
            merged = [np.concatenate(x) for x in zip(older, run)]
            order = np.argsort(merged[0], kind="stable")
            run = tuple(x[order] for x in merged)
        self.runs.append(tuple(map(_spilled, run)) if len(run[0]) > IN_MEMORY else run)

    def least(self) -> int | None:
        return min((int(r[0][0]) for r in self.runs), default=None)

    def bound(self, many: int) -> int | None:
        """A character up to which about so many tuples wait."""
        return max((int(r[0][min(len(r[0]), many) - 1]) for r in self.runs), default=None)

    def pop(self, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tuples with characters up to ``last``, in order."""
        parts, rest = [], []
        for run in self.runs:
            k = int(np.searchsorted(run[0], last, side="right"))
            if k:
                parts.append(tuple(np.asarray(x[:k]) for x in run))
            if k < len(run[0]):
                rest.append(tuple(x[k:] for x in run))
        self.runs = rest
        if not parts:
            return (np.zeros(0, dtype=np.int32),) * 3
        if len(parts) == 1:
            return parts[0]
        merged = [np.concatenate(x) for x in zip(*parts)]
        order = np.argsort(merged[0], kind="stable")  # older runs come first
        return tuple(x[order] for x in merged)


def _spilled(x: np.ndarray) -> np.ndarray:
    """The same numbers in a file that has no name: it goes with its last reader, however the task ends."""
    if isinstance(x, np.memmap):
        return x
    with tempfile.TemporaryFile() as file:
        x.tofile(file)
        file.flush()
        return np.memmap(file, dtype=x.dtype, mode="r", shape=x.shape)


class Minima:
    """Range minima over values that are appended: for each value the least of the 2**j up to it, within blocks' reach, and
    the same over whole blocks for what lies further apart."""

    def __init__(self, size: int, kind: type):
        self.n = self.blocks = 0
        self.near = [np.zeros(size, dtype=kind) for _ in range(BLOCK.bit_length())]
        count = size // BLOCK + 1
        self.far = [np.zeros(count, dtype=kind) for _ in range(count.bit_length())]

    @staticmethod
    def _extend(levels: list[np.ndarray], a: int, b: int) -> None:
        for j in range(1, len(levels)):
            begin, half = max(a, (1 << j) - 1), 1 << j - 1
            if begin >= b:
                return
            np.minimum(levels[j - 1][begin:b], levels[j - 1][begin - half:b - half], out=levels[j][begin:b])

    def append(self, values: np.ndarray) -> None:
        a, self.n = self.n, self.n + len(values)
        self.near[0][a:self.n] = values
        self._extend(self.near, a, self.n)
        a, self.blocks = self.blocks, self.n // BLOCK
        if self.blocks > a:
            self.far[0][a:self.blocks] = self.near[-1][a * BLOCK + BLOCK - 1:self.blocks * BLOCK:BLOCK]
            self._extend(self.far, a, self.blocks)

    @staticmethod
    def _pairs(levels: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.empty(len(low), dtype=np.int64)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        for j in range(int(level.max(initial=-1)) + 1):
            at = np.flatnonzero(level == j)
            if len(at):
                out[at] = np.minimum(levels[j][high[at]], levels[j][low[at] + (1 << j) - 1])
        return out

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least of the values at low..high (low <= high < n) for each pair."""
        is_near = high - low < 2 * BLOCK - 1
        if is_near.all():
            return self._pairs(self.near, low, high) if len(low) else low
        out = np.empty(len(low), dtype=np.int64)
        out[is_near] = self._pairs(self.near, low[is_near], high[is_near])
        lo, hi = low[~is_near], high[~is_near]
        first, last = -(-lo // BLOCK), hi // BLOCK  # whole blocks: first .. last - 1
        best = self._pairs(self.far, first, last - 1)
        best = np.minimum(best, self.near[-1][lo + BLOCK - 1])  # the first and the last BLOCK values cover the rest
        out[~is_near] = np.minimum(best, self.near[-1][hi])
        return out


def index_type(size: int) -> type:
    """Of positions and ranks in a text of this size: half the memory for all but huge ones."""
    return np.int32 if size < 1 << 30 else np.int64


def types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: whether its suffix is smaller than the next one (S), and how often its character repeats on."""
    n, kind = len(text), index_type(len(text))
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1).astype(kind)
    lengths = np.diff(ends, prepend=-1)
    rises = np.append(text[ends[:-1] + 1] > text[ends[:-1]], True)
    runs = np.repeat(ends, lengths)
    runs -= np.arange(n, dtype=kind)
    runs += 1
    return np.repeat(rises, lengths), runs


def induce(chars: np.ndarray, wanted: np.ndarray, runs: np.ndarray, given: np.ndarray,
           given_lcp: np.ndarray, produced: int, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges ``given`` (positions in order, with their common prefixes) with all positions whose type is ``wanted``, each
    produced when the suffix behind it comes out. Of equal characters the produced come before the given. Returns positions
    and common prefixes (``most`` for longer ones) in order, and which were produced."""
    total, kind = len(given) + produced, index_type(len(chars))
    order, made = np.empty(total, dtype=kind), np.zeros(total, dtype=bool)
    minima, queue, at, n = Minima(total, np.int32 if most is None else np.uint16), Queue(), 0, 0
    many = 1024  # how much to try to take out: it follows what could be taken before
    given_chars = chars[given]
    last_char, last_pos, last_made, last_rank = -1, -1, False, -1

    def settle(c: np.ndarray, p: np.ndarray, r: np.ndarray, m: np.ndarray, g_lcp: np.ndarray) -> None:
        """Gives the next ranks to these, and pushes what they induce."""
        nonlocal n, last_char, last_pos, last_made, last_rank
        pc, pp = np.concatenate(([last_char], c[:-1])), np.concatenate(([last_pos], p[:-1]))
        pm, pr = np.concatenate(([last_made], m[:-1])), np.concatenate(([last_rank], r[:-1]))
        lcp = np.zeros(len(c), dtype=np.int64)
        same = pc == c
        both = same & m & pm
        if both.any():
            lcp[both] = 1 + minima.least(pr[both] + 1, r[both])
        border = same & ~m & pm
        lcp[border] = np.minimum(runs[p[border]], runs[pp[border]])
        stay = same & ~m & ~pm
        lcp[stay] = g_lcp[stay]
        order[n:n + len(c)], made[n:n + len(c)] = p, m
        minima.append(lcp if most is None else np.minimum(lcp, most))
        ranks = np.arange(n, n + len(c), dtype=kind)
        n += len(c)
        last_char, last_pos, last_made, last_rank = int(c[-1]), int(p[-1]), bool(m[-1]), int(r[-1])
        before = p - 1
        some = (before >= 0) & wanted[before]
        before, ranks = before[some], ranks[some]
        queue.push(chars[before], before, ranks)

    while True:
        heads = [x for x in (queue.least(), int(given_chars[at]) if at < len(given) else None) if x is not None]
        if not heads:
            break
        head = min(heads)
        # Take out as much as can't be overtaken by what it induces.
        bounds = [x for x in (queue.bound(many), int(given_chars[min(len(given), at + many) - 1]) if at < len(given) else None)
                  if x is not None]
        last = max(head, min(bounds))
        if last > head:
            c, p, r = queue.pop(last)
            k = at + int(np.searchsorted(given_chars[at:], last, side="right"))
            everything = np.concatenate((p, given[at:k])) - 1
            everything = everything[everything >= 0]
            induced = chars[everything[wanted[everything]]]
            limit = int(induced.min()) - 1 if len(induced) else last
            if limit < last:
                keep = int(np.searchsorted(c, limit, side="right")) if limit >= head else 0
                queue.push(c[keep:], p[keep:], r[keep:])
                c, p, r = c[:keep], p[:keep], r[:keep]
                k = at + int(np.searchsorted(given_chars[at:], limit, side="right")) if limit >= head else at
            taken = len(c) + k - at
            many = min(BULK, 4 * many) if limit >= last else max(256, min(BULK, 2 * taken))
            if taken:
                keys = np.concatenate((2 * c.astype(np.int64), 2 * given_chars[at:k].astype(np.int64) + 1))
                sort = np.argsort(keys, kind="stable")
                settle((keys[sort] >> 1).astype(chars.dtype), np.concatenate((p, given[at:k]))[sort],
                       np.concatenate((r, np.full(k - at, -1, dtype=kind)))[sort], keys[sort] & 1 == 0,
                       np.concatenate((np.zeros(len(c), dtype=np.int64), given_lcp[at:k]))[sort])
                at = k
                continue
        # One character alone: what it induces with the same character follows at once.
        while queue.least() == head:
            c, p, r = queue.pop(head)
            settle(c, p, r, np.ones(len(c), dtype=bool), np.zeros(len(c), dtype=np.int64))
        k = at + int(np.searchsorted(given_chars[at:], head, side="right"))
        if k > at:
            settle(given_chars[at:k], given[at:k], np.full(k - at, -1, dtype=kind), np.zeros(k - at, dtype=bool), given_lcp[at:k])
            at = k
    return order, minima.near[0], made


def name(text: np.ndarray, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ranks of the substrings of ``keys`` (equal for equal ones): as many characters at a time as fit a number."""
    bits = max(1, int(keys.max()).bit_length())
    per = max(1, 62 // bits)
    rank = np.zeros(len(starts), dtype=np.int64)
    active, offset = np.arange(len(starts)), 0
    size = len(keys)
    while len(active):
        packed = np.zeros(len(active), dtype=np.int64)
        for j in range(per):
            where = starts[active] + offset + j
            inside = offset + j < lengths[active]
            packed = (packed << bits) | np.where(inside, keys[np.minimum(where, size - 1)], 0)
        order = np.lexsort((packed, rank[active]))
        r, k = rank[active][order], packed[order]
        fresh = np.concatenate(([True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])))
        group = np.cumsum(fresh) - 1
        begin = np.flatnonzero(fresh)
        # a group's rank is its members' old rank plus how many of them are smaller
        old = np.concatenate(([True], r[1:] != r[:-1]))
        old_begin = np.flatnonzero(old)[np.cumsum(old) - 1]
        rank[active[order]] = r + begin[group] - old_begin
        many = np.diff(np.append(begin, len(group)))[group] > 1
        offset += per
        active = active[order][many]
        active = active[lengths[active] > offset]
    return rank


def suffix_array(text: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a non-empty text of non-negative numbers whose last one is its only smallest, and the common prefix
    of each suffix with the one before it (0 for the first). ``most`` (below 2 ** 16): a longer prefix is given as this one. What
    is induced from such values is as long at least, so nothing shorter changes; names of the recursion keep theirs whole."""
    n, top = len(text), int(text.max())
    kind = index_type(2 * max(n, top + 1))
    if n == 1:
        return np.zeros(1, dtype=kind), np.zeros(1, dtype=kind)
    text = text.astype(np.int16 if 2 * top + 1 < 1 << 15 else kind, copy=False)
    small, runs = types(text)
    starts = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(kind)
    rank = name(text, 2 * text + small, starts, np.append(np.diff(starts) + 1, 1))
    sort = np.argsort(rank, kind="stable").astype(kind)
    fresh = np.diff(rank[sort], prepend=-1) != 0
    del rank
    if fresh.all():
        inner, inner_lcp = sort, np.zeros(len(sort), dtype=kind)
    else:
        dense = np.empty(len(sort), dtype=kind)
        dense[sort] = np.cumsum(fresh, dtype=kind) - 1
        del sort, fresh
        inner, inner_lcp = suffix_array(dense)
        del dense
    stars = starts[inner]
    star_lcp = np.zeros(len(stars), dtype=kind)
    a, b = inner[:-1] + inner_lcp[1:], inner[1:] + inner_lcp[1:]  # the first names that differ
    star_lcp[1:] = starts[a] - stars[:-1] + _common(text, starts[a], starts[b])
    del inner, inner_lcp, a, b, starts
    falls = ~small
    order, lcp, made = induce(text, falls, runs, stars, star_lcp, int(falls.sum()), most)
    del stars, star_lcp, falls
    # large suffixes of one character stand together; across characters nothing is shared
    large, large_lcp = order[made], lcp[made]
    del order, lcp, made
    if len(large):
        large_lcp[np.concatenate(([True], text[large[1:]] != text[large[:-1]]))] = 0
    text = text.dtype.type(top) - text
    small[n - 1] = False  # the end itself is produced by nothing
    large = np.ascontiguousarray(large[::-1])
    large_lcp = np.append(large_lcp[:1], large_lcp[:0:-1])
    down, down_lcp, _ = induce(text, small, runs, large, large_lcp, int(small.sum()), most)
    del text, small, runs, large, large_lcp
    array = np.empty(n, dtype=kind)
    array[0], array[1:] = n - 1, down[::-1]
    shared = np.zeros(n, dtype=kind)
    shared[2:] = down_lcp[:0:-1]
    return array, shared


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal characters from a and from b on, of pairs that soon differ."""
    out = np.zeros(len(a), dtype=a.dtype)
    active, k = np.arange(len(a)), 0
    n = len(text)
    while len(active):
        x, y = a[active] + k, b[active] + k
        active = active[(x < n) & (y < n) & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])]
        k += 1
        out[active] = k
    return out
