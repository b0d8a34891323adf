"""Periodic runs of words: stretches that repeat their first words over and over.

Each Arrow slice of texts becomes one string of word numbers. First, words that can't be in a run are made separators: a
run of exponent x has each of its words x times at least, so a word seen less often between two separators is one itself,
again and again until nothing changes. What is left goes the way of the LPF method: prefix doubling gives the suffix
array (and the ranks of all runs of 2^k words, by which the longest common extension of any two places is found exactly),
neighbours in the suffix array that begin earlier give the longest previous factor of each place, these the blocks of the
Lempel-Ziv factorisation. A run touches the border of a block or lies inside one. Those at a border are found by extending
each period that can stand there to both sides (Main); those inside are copies of runs of the block's earlier occurrence
and are taken from buckets by their start.
"""

from __future__ import annotations

from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_slices, keyed_text

LEAST, EXPONENT = 6, 4
RUN = "struct<start: bigint, length: bigint, period: bigint>"
RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Ranks:
    """The suffix array of an int array and its longest common extensions. Its last number must be unique, as must be
    every number that no extension may pass."""

    def __init__(self, s: np.ndarray):
        n = len(s)
        order = np.argsort(s, kind="stable")
        rank = np.empty(n, np.int32)
        rank[order] = self._firsts(s[order])
        self.levels, width, active = [rank], 1, order
        while True:
            # Only places whose rank others share are sorted further; the window of such a place ends before s does.
            active = active[self._shared(rank[active])]
            if not len(active):
                break
            key = rank[active].astype(np.int64) * (n + 1) + rank[active + width]
            by = np.argsort(key, kind="stable")
            active, key = active[by], key[by]
            group = rank[active]
            rank = rank.copy()
            rank[active] = group + self._firsts(key) - self._firsts(group)
            self.levels.append(rank)
            width *= 2
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[rank] = np.arange(n)

    @staticmethod
    def _firsts(x: np.ndarray) -> np.ndarray:
        """Of each number of a sorted array, the index of the first like it."""
        return np.maximum.accumulate(np.where(np.r_[True, x[1:] != x[:-1]], np.arange(len(x)), 0)).astype(np.int32)

    @staticmethod
    def _shared(x: np.ndarray) -> np.ndarray:
        same = x[1:] == x[:-1]
        return np.r_[False, same] | np.r_[same, False]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i on equal those from j on (i <> j)."""
        n, out = len(self.suffixes), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = np.minimum(i + out, n - 1), np.minimum(j + out, n - 1)
            out += (self.levels[k][a] == self.levels[k][b]).astype(np.int64) << k
        return out

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i backwards equal those from j backwards (i < j)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - out - (1 << k) + 1, j - out - (1 << k) + 1
            same = (a >= 0) & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])
            out += same.astype(np.int64) << k
        return out


def previous_factors(ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Of each place the length of the longest previous factor (0: none) and where it begins."""
    suffixes = ranks.suffixes
    n, places = len(suffixes), suffixes.tolist()
    before, after, stack = np.full(n, -1), np.full(n, -1), []
    for place in places:  # the nearest suffixes in order, to both sides, that begin earlier
        while stack and stack[-1] > place:
            after[stack.pop()] = place
        if stack:
            before[place] = stack[-1]
        stack.append(place)
    length, source = np.zeros(n, np.int64), np.full(n, -1)
    for other in (before, after):
        at = np.nonzero(other >= 0)[0]
        common = ranks.ahead(at, other[at])
        better = common > length[at]
        length[at[better]], source[at[better]] = common[better], other[at[better]]
    return length, source


def runs_of(s: np.ndarray, separator: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """start, end, period of all runs of at least that length and exponent, by start and period.

    separator: numbers that occur once; the last one is one of them.
    """
    ranks = Ranks(s)
    length, source = previous_factors(ranks)
    lengths, starts, at, n = length.tolist(), [], 0, len(s)
    while at < n:
        starts.append(at)
        at += max(1, lengths[at])
    begin = np.array(starts)
    size = np.where(separator[begin], 0, np.diff(np.r_[begin, n]))
    found: dict[tuple[int, int], int] = {}
    # A run that touches the border of two blocks: its period is less than their length over exponent - 1, since the earlier
    # block would else be longer.
    most = (np.r_[0, size[:-1]] + size) // (exponent - 1)
    for a in range(0, len(begin), 1 << 16):
        border = np.repeat(begin[a : a + (1 << 16)], most[a : a + (1 << 16)])
        period = np.arange(len(border)) - np.repeat(np.cumsum(most[a : a + (1 << 16)]) - most[a : a + (1 << 16)], most[a : a + (1 << 16)]) + 1
        for left in (0, 1):
            i, j = (border - period, border) if left else (border, border + period)
            ok = (i >= 0) & (j < n)
            if exponent > 2:  # more than one period lies on one of the sides
                ok &= s[np.maximum(i - left, 0)] == s[np.minimum(j, n - 1) - left]
            i, j, p = i[ok], j[ok], period[ok]
            ahead, back = ranks.ahead(i, j), ranks.back(i - 1, j - 1)
            ok = (ahead + back >= (exponent - 1) * p) & (ahead + back + p >= least)
            for x, y, q in zip((i - back)[ok].tolist(), (j + ahead)[ok].tolist(), p[ok].tolist()):
                found[x, y] = min(q, found.get((x, y), q))
    # A run inside a block is one of the block's earlier occurrence.
    bucket: dict[int, list[tuple[int, int]]] = {}
    for (x, y), q in found.items():
        bucket.setdefault(x, []).append((y, q))
    for b in begin[size > least + 1].tolist():
        if not bucket:
            break
        end, move = int(source[b]) + lengths[b], b - int(source[b])
        for x in range(int(source[b]) + 1, end - least):
            for y, q in tuple(bucket.get(x, ())):
                if y < end and (x + move, y + move) not in found:
                    found[x + move, y + move] = q
                    bucket.setdefault(x + move, []).append((y + move, q))
    return sorted(((x, y, q) for (x, y), q in found.items()), key=lambda r: (r[0], r[2]))


def candidates(texts: list[list[bytes]], least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in one array, -1 where no run can be; and the text's number of each."""
    numbers, sizes, upto = [], [], 0
    for words in texts:
        kept = {}
        if len(words) >= max(least, exponent):
            for word, times in Counter(words).items():
                if times >= exponent:
                    kept[word] = upto
                    upto += 1
        numbers.append(np.fromiter(map(kept.get, words, [-1] * len(words)), np.int64, len(words)) if kept else np.full(len(words), -1))
        sizes.append(len(words))
    return np.concatenate([np.zeros(0, np.int64), *numbers]), np.repeat(np.arange(len(texts)), sizes)


def pruned(numbers: np.ndarray, text: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Where a run may be: stretches of at least that many words, each of which is in its stretch often enough."""
    at = np.nonzero(numbers >= 0)[0]
    while len(at):
        new = np.r_[True, (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])]
        stretch = np.cumsum(new) - 1
        key = stretch * (int(numbers.max()) + 1) + numbers[at]
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        keep = (np.bincount(stretch)[stretch] >= least) & (times[inverse] >= exponent)
        if keep.all():
            break
        at = at[keep]
    return at


def text_runs(texts: list[list[bytes]], least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """start, length, period of each text's runs, by start and period."""
    numbers, text = candidates(texts, least, exponent)
    at, out = pruned(numbers, text, least, exponent), [[] for _ in texts]
    if not len(at):
        return out
    # The stretches one after another, a number of its own behind each.
    new = np.r_[False, (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])]
    place = np.arange(len(at)) + np.cumsum(new)
    s, separator, back = np.full(place[-1] + 2, -1), np.ones(place[-1] + 2, bool), np.zeros(place[-1] + 2, np.int64)
    s[place], separator[place], back[place] = numbers[at], False, at
    s[separator] = int(numbers.max()) + 1 + np.arange(separator.sum())
    first = np.searchsorted(text, np.arange(len(texts)))
    for x, y, q in runs_of(s, separator, least, exponent):
        k = text[back[x]]
        out[k].append((int(back[x] - first[k]), y - x, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period."""
    if not runs:
        return b" ".join(words)
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    return b" ".join(w for w, d in zip(words, np.cumsum(dropped)) if not d)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length over period; of such the first, then that of the least period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start and length in words, period; by start, then period), strongest (one of them), collapsed.

    A run: a stretch of words with that smallest period, at least `least` words and `exponent` (2 or more) periods long,
    which no neighbouring word goes on with. Words are what white space separates. collapsed: the words, less those a run
    has after its first period, joined by one space. One row per row of df, repeated ids and rows too; a null text is
    empty and has no words, no runs (an empty list), a null strongest run and an empty collapsed text. Other columns don't
    matter. Texts are taken whole; memory is some dozen bytes a word of a slice of texts, and for words that may be in
    runs as many times as the longest repetition's length doubles.
    """
    if exponent < 2 or least < 2:
        raise ValueError("runs have two periods and two words at least")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.encode().split() for t in batch.column(1).to_pylist()]
        runs = text_runs(texts, least, exponent)
        as_rows = lambda rs: [dict(zip(("start", "length", "period"), r)) for r in rs]
        best = [r and as_rows([r])[0] for r in map(strongest, runs)]
        flat = pa.array([r for rs in runs for r in as_rows(rs)], RUN_TYPE)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(map(len, texts), pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), flat),
                pa.array(best, RUN_TYPE),
                pa.array([collapsed(w, r).decode() for w, r in zip(texts, runs)], pa.string()),
            ],
            ["doc_id", "n_words", "runs", "strongest", "collapsed"],
        )

    kind = df.schema[id_col].dataType.simpleString()
    return keyed_text(df, id_col, text_col).mapInArrow(by_slices(each), f"doc_id {kind}, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string")
