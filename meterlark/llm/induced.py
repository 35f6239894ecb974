"""Suffix order and common prefixes of a shard by external induced sorting.

The text's S* suffixes (S-type after L-type) are sorted first: their substrings up to the next S*
suffix are named in order, and the sequence of names is sorted by the same naming over pairs, pairs of
pairs and so on, until names differ or cover ``depth`` symbols. From them all L-type suffixes are induced
in ascending, and then all S-type suffixes in descending order. A tuple (suffix, common prefix with the
tuple before it) waits in a priority queue whose priority is the suffix's first symbol and whose order
within a symbol is that of insertion, so the queue is one disk-backed run of tuples for each symbol, and
tuples are extracted and induced a run at a time. Common prefixes come along: two suffixes induced one
after the other into the same run share one symbol more than the least common prefix between their
sources. Prefix lengths stop counting at ``depth``.

Memory holds the shard's symbols and types and the runs up to ``held`` bytes; beyond that runs are written
to unnamed files in Spark's own scratch folder, read back once and gone with the task.
"""

from __future__ import annotations

import os
import tempfile
from collections import deque

import numpy as np

#: Symbols: 0 ends the text, 1 ends a snippet, others are bytes of UTF-8 plus 2 (never over 0xF6).
END, BREAK, SHIFT, PAD = 0, 1, 2, 0xFF


class Runs:
    """The priority queue: tuples (suffix, common prefix) in first-in first-out runs by symbol."""

    def __init__(self, held: int = 256 << 20):
        self.runs = [deque() for _ in range(256)]
        self.held, self.size, self.file = held, 0, None

    def put(self, symbol: int, suffixes: np.ndarray, common: np.ndarray) -> None:
        if self.size + suffixes.nbytes + common.nbytes <= self.held:
            self.size += suffixes.nbytes + common.nbytes
            self.runs[symbol].append((suffixes, common))
            return
        if self.file is None:
            folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
            self.file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
        self.file.seek(0, os.SEEK_END)
        at = self.file.tell()
        self.file.write(suffixes.astype(np.int64).tobytes() + common.tobytes())
        self.runs[symbol].append((at, len(suffixes)))

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        if not self.runs[symbol]:
            return None
        first, second = self.runs[symbol].popleft()
        if isinstance(first, np.ndarray):
            self.size -= first.nbytes + second.nbytes
            return first, second
        self.file.seek(first)
        data = self.file.read(9 * second)
        return np.frombuffer(data, np.int64, second), np.frombuffer(data, np.uint8, second, 8 * second)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Minima:
    """Least values of ranges, by a table of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least of values[low..high], both included."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.uint8)
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            table = self.levels[k]
            out[own] = np.minimum(table[low[own]], table[high[own] - (1 << int(k)) + 1])
        return out


def _windows8(text: np.ndarray) -> np.ndarray:
    """A view of the eight symbols from each place (the text is padded for it)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)


def common_prefixes(eight: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix lengths of suffixes a and b, up to ``depth``, eight symbols at a time."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    most = len(eight) - 1
    for at in range(0, depth, 8):
        x = eight[np.minimum(a[live] + at, most)]
        y = eight[np.minimum(b[live] + at, most)]
        same = x == y
        whole = same.all(axis=1)
        out[live[~whole]] = at + np.argmin(same[~whole], axis=1)
        live = live[whole]
        if not len(live):
            break
    out[live] = depth
    return np.minimum(out, depth).astype(np.uint8)


def _refine(rank: np.ndarray, some: np.ndarray, key: np.ndarray) -> None:
    """Split ties: rank is a group's first place; ``some`` holds whole groups, ``key`` orders inside them."""
    own = rank[some]
    order = np.lexsort((key, own))
    r, k = own[order], key[order]
    group = np.r_[True, r[1:] != r[:-1]]
    piece = group | np.r_[True, k[1:] != k[:-1]]
    at = np.arange(len(r))
    rank[some[order]] = r + np.maximum.accumulate(np.where(piece, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))


def _tied(rank: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is S-type (smaller than the next)."""
    step = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    n = len(step)
    known = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(known[::-1])[::-1]
    return np.r_[step[following] > 0, True] if n else np.ones(1, bool)


def _sorted_stars(text: np.ndarray, eight: np.ndarray, stars: np.ndarray, depth: int) -> np.ndarray:
    lens = np.r_[np.diff(stars) + 1, 1]
    rank = np.zeros(len(stars), np.int64)
    every, at = np.arange(len(stars)), 0
    while len(every):
        word = np.ascontiguousarray(eight[np.minimum(stars[every] + at, len(text) - 1)]).view(">u8").ravel().astype(np.uint64)
        # past its end a substring is larger than one that goes on
        left = np.clip(8 - (lens[every] - at), 0, 8).astype(np.uint64)
        word = np.where(left >= 8, ~np.uint64(0), word | ((np.uint64(1) << (np.uint64(8) * np.minimum(left, np.uint64(7)))) - np.uint64(1)))
        _refine(rank, every, word)
        at += 8
        ties = _tied(rank)
        longer = np.zeros(len(stars), bool)
        longer[rank[ties[lens[ties] > at]]] = True  # groups in which some substring goes on
        every = ties[longer[rank[ties]]]
    span = 1
    while 2 * span < depth + 8 and len(ties := _tied(rank)):
        following = np.where(ties + span < len(rank), rank[np.minimum(ties + span, len(rank) - 1)], -1)
        _refine(rank, ties, following)
        span *= 2
    return stars[np.argsort(rank, kind="stable")]


class _Inducer:
    """One pass: takes runs in order and puts the induced predecessors into their runs."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, runs: Runs, depth: int):
        self.text, self.wanted, self.runs, self.depth = text, wanted, runs, depth
        self.carry = np.zeros(256, np.int64)  # least common prefix since the last insertion, by symbol
        self.fresh = np.ones(256, bool)  # nothing inserted yet

    def feed(self, suffixes: np.ndarray, common: np.ndarray) -> None:
        """``common[0]`` is with the last suffix fed before."""
        from_ = np.flatnonzero(suffixes > 0)
        before = suffixes[from_] - 1
        keep = self.wanted[before]
        from_, before = from_[keep], before[keep]
        if len(before):
            symbol = self.text[before]
            order = np.argsort(symbol, kind="stable")
            symbol, source, before = symbol[order], from_[order], before[order]
            first = np.r_[True, symbol[1:] != symbol[:-1]]
            minima = _Minima(common)
            low = np.where(first, 0, np.r_[0, source[:-1] + 1])
            least = minima.of(low, source).astype(np.int64)
            heads = np.flatnonzero(first)
            least[heads] = np.where(self.fresh[symbol[heads]], -1, np.minimum(least[heads], self.carry[symbol[heads]]))
            shared = np.minimum(least + 1, self.depth).astype(np.uint8)
            tails = np.r_[heads[1:], len(symbol)] - 1
        self.carry = np.minimum(self.carry, int(common.min()))
        if len(before):
            after = np.minimum.accumulate(np.r_[common[1:], self.depth][::-1])[::-1]
            self.carry[symbol[tails]] = np.where(source[tails] + 1 < len(suffixes), after[np.minimum(source[tails], len(after) - 1)], self.depth)
            self.fresh[symbol[heads]] = False
            for a, b in zip(heads.tolist(), (tails + 1).tolist()):
                self.runs.put(int(symbol[a]), before[a:b], shared[a:b])


def suffix_array(snippets: np.ndarray, depth: int, held: int = 256 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before it, up to ``depth``).

    ``snippets`` are symbols from ``BREAK`` up; the result leaves out the end symbol's suffix.
    """
    text = np.concatenate([np.asarray(snippets, np.uint8), np.zeros(1, np.uint8)])
    if len(text) == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    small, eight = _types(text), _windows8(text)
    stars = np.flatnonzero(small & np.r_[False, ~small[:-1]]).astype(np.int32 if len(text) < 1 << 31 else np.int64)
    stars = _sorted_stars(text, eight, stars, depth)
    shared = np.r_[np.uint8(0), common_prefixes(eight, stars[:-1], stars[1:], depth)].astype(np.uint8)
    edges = np.searchsorted(text[stars], np.arange(257))
    symbols = np.flatnonzero(np.bincount(text, minlength=256)).tolist()
    pair = lambda a, b: common_prefixes(eight, np.array([a]), np.array([b]), depth)

    runs, large = Runs(held), [[] for _ in range(256)]
    try:
        pass_l = _Inducer(text, ~small, runs, depth)
        for c in symbols:
            last = None
            while (run := runs.pop(c)) is not None:
                large[c].append(run)
                pass_l.feed(run[0], run[1] if last is not None else np.r_[np.uint8(0), run[1][1:]])
                last = run[0][-1]
            own = stars[edges[c] : edges[c + 1]]
            if len(own):
                common = shared[edges[c] : edges[c + 1]].copy()
                common[0] = pair(last, own[0])[0] if last is not None else 0
                pass_l.feed(own, common)
    finally:
        runs.close()
    runs, parts, shares = Runs(held), [], []
    try:
        pass_s = _Inducer(text, small, runs, depth)
        for c in reversed(symbols):
            last, down = None, []
            while (run := runs.pop(c)) is not None:
                down.append(run)
                pass_s.feed(run[0], run[1] if last is not None else np.r_[np.uint8(0), run[1][1:]])
                last = run[0][-1]
            up_l = np.concatenate([r[0] for r in large[c]]) if large[c] else np.zeros(0, stars.dtype)
            lcp_l = np.concatenate([r[1] for r in large[c]]) if large[c] else np.zeros(0, np.uint8)
            between = pair(up_l[-1], last)[0] if len(up_l) and last is not None else np.uint8(0)
            if len(up_l):
                # descending: each one's common prefix with the one processed before it
                pass_s.feed(up_l[::-1], np.r_[between, lcp_l[:0:-1]].astype(np.uint8))
            if down:
                up_s = np.concatenate([r[0] for r in down])[::-1]
                lcp_s = np.concatenate([r[1] for r in down])
                parts.append(up_s)
                shares.append(np.r_[between, lcp_s[:0:-1]].astype(np.uint8))
            if len(up_l):
                parts.append(up_l)
                shares.append(np.r_[np.uint8(0), lcp_l[1:]])
            large[c] = []
    finally:
        runs.close()
    return np.concatenate(parts[::-1]), np.concatenate(shares[::-1])
