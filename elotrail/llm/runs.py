"""Operator 13: periodic runs of words, caught online by dyadic square catchers.

A run is a stretch of words with smallest period q that neither neighbour extends; it is
asked for if its length is at least max(least, 2 q).  Words q apart agree along a run, in a
stretch of length - q words, and a stretch of 2 b - 1 words holds a whole block of b words
that starts at a multiple of b.  So each completed block [k b, (k + 1) b), b a power of two,
is a catcher for the periods whose stretches are that long and shorter than the next
level's: it looks for its own words at each of these distances among the words appended
after it.  A catch opens a suffix comparison of this period, which grows to both sides and is
carried on with every further append; once it spans two periods it is a square, and all
squares of one comparison are one run.

Blocks are compared by polynomial hashes of their word numbers modulo 2^64, many catchers at
a time, and each catch is compared word by word, so a hash only saves time.  Catches inside a
known run of a period q <= b are passed over: the block then lies at multiples of q, and the
stretch belongs to that run.  A stretch that a run of smaller period covers has no period of
its own and is passed over too.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

LEAST = 12           # words of the shortest run
RUN = "struct<start:long,length:long,period:long>"
_CHUNK = 1 << 16     # words appended at once
_CELLS = 1 << 20     # hash comparisons at once
_FEW = 6             # catchers that are looked at one by one
_NARROW = 8          # blocks whose many catches are sorted out together first
_ROWS = 1 << 14      # catches sorted out at once
_STEP = 1 << 12
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _table(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = {base: _table(base, _STEP) for base in (_BASE, _INVERSE)}


def _powers(base: int, lo: int, hi: int) -> np.ndarray:
    """base ** lo up to base ** (hi - 1), modulo 2^64."""
    low = _POWERS[base]
    if hi <= _STEP:
        return low[lo:hi]
    i = np.arange(lo, hi)
    return low[i % _STEP] * _table(pow(base, _STEP, 1 << 64), hi // _STEP + 1)[i // _STEP]


def block_of(p: int, least: int = LEAST) -> int:
    """The largest power of two b with 2 b - 1 words in the shortest stretch of period p."""
    return 1 << ((max(least - p, p) + 1).bit_length() - 2)


def levels(top: int, least: int = LEAST) -> Iterator[tuple[int, int, int]]:
    """(block, first period, last period) of the catchers for periods up to ``top``, smaller
    periods first."""
    p = 1
    while p <= top:
        b, last = block_of(p, least), p
        if p >= least:
            last = min(top, 4 * b - 2)
        while last < min(top, least) and block_of(last + 1, least) == b:
            last += 1
        yield b, p, last
        p = last + 1


class SquareCatcher:
    """Runs of a sequence of word numbers that is appended piece by piece.

    ``longest`` bounds the periods asked for (half of the final length says enough)."""

    def __init__(self, least: int = LEAST, longest: int | None = None):
        if least < 3:
            raise ValueError("a run has at least three words")
        self.least, self.longest = least, longest
        self.n = 0
        self._words = np.zeros(0, np.int64)
        self._sums = np.zeros(1, np.uint64)       # sums of word * base ** position
        self._open: dict[int, list[int]] = {}     # period: its latest stretch [start, end)
        self._runs: dict[int, list[list[int]]] = {}  # period: its runs [start, end), ascending

    def append(self, words: np.ndarray) -> list[tuple[int, int]]:
        """Append word numbers; the (start, period) of runs whose first square ends in them."""
        n0, n = self.n, self.n + len(words)
        if n == n0:
            return []
        if n > len(self._words):
            room = max(n, 2 * n0)
            self._words = np.concatenate((self._words[:n0], np.empty(room - n0, np.int64)))
            self._sums = np.concatenate((self._sums[:n0 + 1], np.empty(room - n0, np.uint64)))
        self._words[n0:n] = words
        mixed = (self._words[n0:n].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        mixed ^= mixed >> np.uint64(29)
        self._sums[n0 + 1:n + 1] = self._sums[n0] + np.cumsum(mixed * _powers(_BASE, n0, n), dtype=np.uint64)
        self.n = n
        grown: list[tuple[int, list[int]]] = []
        for p, stretch in self._open.items():
            if stretch[1] + p == n0:  # it reached the last word and goes on
                stretch[1] = self._forward(stretch[1], p)
                own = self._runs.get(p)
                if own and own[-1][0] == stretch[0]:
                    own[-1][1] = stretch[1] + p
                else:
                    grown.append((p, stretch))
        new: list[tuple[int, int]] = []
        for b, low, high in levels(min(n - 1, self.longest or n), self.least):
            caught = [(p, stretch) for p, stretch in grown if low <= p <= high]
            for i, p in self._catches(b, low, high, n0):
                self._compare(b, i, p, caught)
            for p, (start, end) in sorted(caught):  # smaller periods are all known by now
                if self._is_run(start, end + p, p):
                    self._runs.setdefault(p, []).append([start, end + p])
                    new.append((start, p))
        return new

    def runs(self) -> np.ndarray:
        """Rows start, length, period of all runs, by start, then period."""
        out = np.array([(s, e - s, p) for p, own in self._runs.items() for s, e in own],
                       np.int64).reshape(-1, 3)
        return out[np.lexsort((out[:, 2], out[:, 0]))]

    def _hashes(self, lo: int, hi: int, b: int) -> np.ndarray:
        """Hashes of the b words from each start lo to hi - 1."""
        sums = self._sums
        return (sums[lo + b:hi + b] - sums[lo:hi]) * _powers(_INVERSE, lo, hi)

    def _catches(self, b: int, low: int, high: int, n0: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Starts of blocks and the periods at which words appended after ``n0`` complete a copy."""
        new, stop = max(0, n0 - b + 1), self.n - b + 1  # starts of the copies that are complete now
        first, last = max(0, -((high - new) // b)), (stop - 1 - low) // b
        if last < first:
            return
        if last - first < _FEW:
            copies = self._hashes(new, stop, b)
            for k in range(first * b, last * b + 1, b):
                lo, hi = max(new, k + low), min(stop, k + high + 1)
                if lo < hi:
                    at = np.flatnonzero(copies[lo - new:hi - new] == self._hashes(k, k + 1, b)[0])
                    if len(at):
                        yield np.full(len(at), k), at + (lo - k)
            return
        base, width = first * b, high - low + 1
        h = self._hashes(base, stop, b)
        h = np.concatenate((h, np.zeros(max(0, (last - first) * b + low + width - len(h)), np.uint64)))
        ahead = np.lib.stride_tricks.as_strided(  # row k: the copies of block k, one each period
            h[low:], (last - first + 1, width), (b * h.itemsize, h.itemsize), writeable=False)
        own = h[::b][:last - first + 1, None]
        step = max(1, _CELLS // width)
        for k in range(0, len(ahead), step):
            row, col = np.nonzero(ahead[k:k + step] == own[k:k + step])
            if len(row):
                i, p = base + (row + k) * b, col + low
                now = (i + p >= new) & (i + p < stop)
                yield i[now], p[now]

    def _compare(self, b: int, i: np.ndarray, p: np.ndarray, caught: list[tuple[int, list[int]]]) -> None:
        """Open a comparison for the catches, but for those inside a run of a period up to b."""
        apart = self._reach(i, b) < i + p + b
        i, p = i[apart], p[apart]
        if b <= _NARROW:
            long = self._long_enough(i, p, b)
            i, p = i[long], p[long]
        order = np.lexsort((i, p))
        i, p = i[order], p[order]
        bounds = np.flatnonzero(np.diff(p, prepend=-1, append=-1)) if len(p) else []
        for x, y in zip(bounds[:-1], bounds[1:]):
            own, q, k = i[x:y], int(p[x]), 0
            while k < len(own):
                stretch, at = self._open.get(q), int(own[k])
                if stretch and at < stretch[1]:  # part of the comparison before
                    k += int(np.searchsorted(own[k:], stretch[1]))
                    continue
                k += 1
                if np.array_equal(self._words[at:at + b], self._words[at + q:at + q + b]):
                    self._open[q] = [self._back(at, q), self._forward(at + b, q)]
                    caught.append((q, self._open[q]))

    def _long_enough(self, i: np.ndarray, p: np.ndarray, b: int) -> np.ndarray:
        """Whether the stretches around catches can have the length a run of the period needs;
        words to come count as agreeing."""
        out, w, n = np.zeros(len(i), bool), self._words, self.n
        need = np.maximum(self.least - p, p)
        for x in range(0, len(i), _ROWS):
            at, q, most = i[x:x + _ROWS, None], p[x:x + _ROWS, None], need[x:x + _ROWS]
            side = np.arange(int(most.max()))
            right, left = at + b + side, at - 1 - side
            agree = (right + q >= n) | (w[np.minimum(right, n - 1)] == w[np.minimum(right + q, n - 1)])
            total = b + np.minimum.accumulate(agree, axis=1).sum(axis=1)
            agree = (left >= 0) & (w[np.maximum(left, 0)] == w[np.maximum(left, 0) + q])
            out[x:x + _ROWS] = total + np.minimum.accumulate(agree, axis=1).sum(axis=1) >= most
        return out

    def _is_run(self, start: int, end: int, p: int) -> bool:
        """Whether words of period p are long enough, and in no run of a smaller period (which
        then divides p, since two periods fit in)."""
        if end - start < max(self.least, 2 * p):
            return False
        small = [q for q in range(1, int(p ** 0.5) + 1) if p % q == 0]
        for q in {*small, *(p // q for q in small)} - {p}:
            own = self._runs.get(q)
            at = bisect_right(own, start, key=lambda r: r[0]) if own else 0
            if at and own[at - 1][1] >= end:
                return False
        return True

    def _reach(self, i: np.ndarray, b: int) -> np.ndarray:
        """For each start, where the runs of periods up to b that began by then end at last."""
        own = sorted(r for p, runs in self._runs.items() if p <= b for r in runs)
        if not own:
            return np.zeros(len(i), np.int64)
        s, e = np.array(own).T
        at = np.searchsorted(s, i, "right") - 1
        return np.where(at < 0, 0, np.maximum.accumulate(e)[at])

    def _forward(self, i: int, p: int) -> int:
        """First place from i on whose word differs from the one p later."""
        n, step, w = self.n - p, 32, self._words
        while i < n:
            j = min(n, i + step)
            apart = np.flatnonzero(w[i:j] != w[i + p:j + p])
            if len(apart):
                return i + int(apart[0])
            i, step = j, step * 2
        return n

    def _back(self, i: int, p: int) -> int:
        """First place of the stretch before i whose words agree with those p later."""
        step, w = 32, self._words
        while i > 0:
            j = max(0, i - step)
            apart = np.flatnonzero(w[j:i] != w[j + p:i + p])
            if len(apart):
                return j + int(apart[-1]) + 1
            i, step = j, step * 2
        return 0


def find_runs(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows start, length, period of the runs of a sequence of word numbers."""
    catcher = SquareCatcher(least, max(1, len(words) // 2))
    for k in range(0, len(words), _CHUNK):
        catcher.append(words[k:k + _CHUNK])
    return catcher.runs()


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those of a run go after its first period."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, runs[:, 0] + runs[:, 2], 1)
    np.add.at(delta, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(delta[:n]) == 0


def text_runs(text: str, least: int = LEAST) -> tuple[int, np.ndarray, str]:
    """Number of words, runs, and the kept words joined by one space, of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    # a word that is not repeated is in no run
    runs = find_runs(ids, least) if len(words) >= least and len(numbers) < len(words) else np.zeros((0, 3), np.int64)
    if len(runs):
        words = [words[k] for k in np.flatnonzero(kept_words(len(words), runs)).tolist()]
    return len(ids), runs, b" ".join(words).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, runs (start, length, period; by start, then period) and collapsed,
    the text without the words that repeat a run's first period, one space between words.

    Words are the maximal stretches without ASCII white space, compared byte by byte.  One pass,
    no shuffle; whole texts, whose words are appended in pieces, so memory follows the longest
    text.  Null and empty texts have no words, no runs and an empty collapsed text; rows that
    repeat are treated alike; an empty table gives no rows.  Columns of ``docs`` stay as they are;
    set ``prefix`` where one is named like a new one, which would replace it."""
    found = f"struct<n_words:long,runs:array<{RUN}>,collapsed:string>"
    kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct(
        [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])

    @F.arrow_udf(found)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            counts, bounds, rows, kept = [], [0], [], []
            for t in texts:
                n, runs, rest = text_runs(t.as_py(), least)
                counts.append(n)
                rows.append(runs)
                bounds.append(bounds[-1] + len(runs))
                kept.append(rest)
            flat = np.concatenate([np.zeros((0, 3), np.int64), *rows])
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)],
                                                 fields=list(kind.field("runs").type.value_type))
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs),
                 pa.array(kept, pa.string())], fields=list(kind))

    whole = docs.withColumn("__runs", scan(text_of(text)))
    return whole.withColumns({f"{prefix}{c}": F.col(f"__runs.{c}") for c in ("n_words", "runs", "collapsed")}
                             ).drop("__runs")
