"""Periodic runs of words, found while a text is read: dyadic square catching.

For every power of two ``b`` a catcher stands over each completed block of ``b``
words that begins at a multiple of ``b``, and waits for the block to come again
``b`` to ``2 b - 1`` words on.  A place of the text lies in the reach of one block
per size (two of the smallest), so each appended word costs one comparison per
size.  A repeated block is the core of squares of that distance: comparing
suffixes before it and words after it tells how far text and shifted text agree,
and squares of one distance that touch merge into one run.

Blocks are compared by fingerprints over prefix sums; a reported run is compared
word by word, and a text on which fingerprints err is read again with others.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.spaced import Words, spaced_words
from caselight.llm.words import mix, worker_state
from caselight.shipping import ship_by_value

ship_by_value(__name__)

APPENDED = 1 << 18  # words handed over together
_U = np.uint64
_PRIME = (1 << 31) - 1


class _Erred(Exception):
    """Two stretches with equal fingerprints differ."""


class _Wrapping:
    """Fingerprints in 64-bit integers that wrap around: cheap, but texts can be built on which they err."""

    def __init__(self):
        self.powers = worker_state("wrapping powers", lambda: {"held": np.ones(1, _U)})

    def first(self, n: int) -> np.ndarray:
        held = self.powers["held"]
        if len(held) <= n:
            held = np.full(max(n + 1, 2 * len(held), 4096), 0x9E3779B97F4A7C15, _U)
            held[0] = 1
            self.powers["held"] = held = np.multiply.accumulate(held)
        return held

    def values(self, ids: np.ndarray) -> np.ndarray:
        return mix(ids.astype(_U) + _U(1))

    def reduced(self, x: np.ndarray) -> np.ndarray:
        return x

    def span(self, difference: np.ndarray) -> np.ndarray:
        return difference


class _Prime:
    """Fingerprints modulo a prime, with a base of their own per trial."""

    def __init__(self, trial: int):
        self.base = int(np.random.default_rng(trial).integers(1 << 20, _PRIME - 1))
        self.held = np.ones(1, _U)

    def first(self, n: int) -> np.ndarray:
        while len(self.held) <= n:
            step = _U(pow(self.base, len(self.held), _PRIME))
            self.held = np.concatenate([self.held, self.held * step % _U(_PRIME)])
        return self.held

    def values(self, ids: np.ndarray) -> np.ndarray:
        return mix(ids.astype(_U) + _U(1)) % _U(_PRIME)

    def reduced(self, x: np.ndarray) -> np.ndarray:
        return x % _U(_PRIME)

    def span(self, difference: np.ndarray) -> np.ndarray:
        return (difference + _U(_PRIME)) % _U(_PRIME)  # two sums below the prime, the first maybe smaller


class SquareCatcher:
    """Runs of one text, to which words are appended: at least ``times`` periods and ``least`` words long.

    ``append`` takes word numbers as they come; ``runs`` has what has ended so
    far, and ``close`` ends the rest.  Every run of period ``q`` agrees with itself
    for at least ``2 q`` words (``times`` 3), so it holds a whole block of its size.
    """

    def __init__(self, least: int = 24, times: int = 3, prints=None):
        self.smallest = 8
        if times < 3 or least < 3 * self.smallest:
            raise ValueError("runs need three periods and 24 words")
        self.least, self.times = least, times
        self.prints = prints or _Wrapping()
        self.ids = np.zeros(0, np.int64)
        self.sums = np.zeros(1, _U)
        self.looked: dict[int, int] = {}  # per block size: the next place to look at
        self.open: list[tuple[int, int, int]] = []  # (period, first, end) of agreement that reaches the last word
        self.runs: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period

    def append(self, ids: np.ndarray) -> None:
        old, n = len(self.ids), len(self.ids) + len(ids)
        self.powers = self.prints.first(n)
        grown = self.prints.values(ids) * self.powers[old:n]
        grown = np.cumsum(self.prints.reduced(grown), dtype=_U) + self.sums[-1]
        self.ids = np.concatenate([self.ids, ids]) if old else ids.astype(np.int64)
        self.sums = np.concatenate([self.sums, self.prints.reduced(grown)])
        waiting, self.open = self.open, []
        if waiting:
            period, first, end = (np.array(x) for x in zip(*waiting))
            self._keep(period, first, end + self._forward(end, end + period, n - end - period))
        size = self.smallest
        while 3 * size <= n or size == self.smallest:
            self._look(size, n)
            size *= 2

    def close(self) -> list[tuple[int, int, int]]:
        """All runs ``(start, length, period)`` by start, then period."""
        for period, first, end in self.open:
            self._report(period, first, end)
        self.open = []
        return sorted((start, end - start, period) for (start, end), period in self.runs.items())

    def _same(self, a: np.ndarray, b: np.ndarray, length) -> np.ndarray:
        """Whether the fingerprints of ``length`` words at ``a`` and, later, at ``b`` are equal."""
        here, there = self.sums[a + length] - self.sums[a], self.sums[b + length] - self.sums[b]
        return self.prints.reduced(self.prints.span(here) * self.powers[b - a]) == self.prints.span(there)

    def _look(self, size: int, n: int) -> None:
        """The places whose block of ``size`` words has been completed by the words appended last."""
        low = self.looked.get(size, size if size > self.smallest else 1)
        high = n - size + 1
        if high <= low:
            return
        self.looked[size] = high
        for start in range(low, high, APPENDED):
            self._compare(size, np.arange(start, min(high, start + APPENDED)), n)

    def _compare(self, size: int, place: np.ndarray, n: int) -> None:
        for back in ((1, 0) if size == self.smallest else (1,)):
            block = (place // size - back) * size
            can = (block >= 0) & (place > block)
            at, block = place[can], block[can]
            hit = self._same(block, at, size)
            at, block = at[hit], block[hit]
            before = np.maximum(block - size, 0)  # touching squares of one distance: only the first is followed
            begins = ~((block >= size) & self._same(before, before + (at - block), size))
            self._follow(block[begins], at[begins], size, n)

    def _follow(self, block: np.ndarray, at: np.ndarray, size: int, n: int) -> None:
        period = at - block
        # a square inside a run whose period divides its own has that smaller period
        known = [(s, e, p) for (s, e), p in self.runs.items() if p < 2 * size] + [(f, e + p, p) for p, f, e in self.open]
        for start, end, p in known:
            if not len(at):
                return
            a, b = np.searchsorted(at, [start, end])
            covered = np.zeros(len(at), bool)
            covered[a:b] = ((block[a:b] >= start) & (at[a:b] + size <= end) & (period[a:b] > p) & (period[a:b] % p == 0))
            if covered.any():
                at, block, period = at[~covered], block[~covered], period[~covered]
        if len(at):
            first = block - self._backward(block, at)
            self._keep(period, first, block + size + self._forward(block + size, at + size, n - at - size))

    def _forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and from ``b`` on agree."""
        k = np.zeros(len(a), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step:
            can = np.flatnonzero(k + step <= most)
            k[can] += step * self._same(a[can] + k[can], b[can] + k[can], step)
            step //= 2
        return k

    def _backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How long the suffixes that end before ``a`` and before ``b`` agree."""
        k = np.zeros(len(a), np.int64)
        step = 1 << int(a.max(initial=0)).bit_length()
        while step:
            can = np.flatnonzero(k + step <= a)
            k[can] += step * self._same(a[can] - k[can] - step, b[can] - k[can] - step, step)
            step //= 2
        return k

    def _keep(self, period: np.ndarray, first: np.ndarray, end: np.ndarray) -> None:
        n = len(self.ids)
        for q, a, b in set(zip(period.tolist(), first.tolist(), end.tolist())):
            if b + q == n:
                self.open.append((q, a, b))
            else:
                self._report(q, a, b)

    def _report(self, period: int, first: int, end: int) -> None:
        if end + period - first < max(self.least, self.times * period):
            return
        for a in range(first, end, APPENDED):
            b = min(a + APPENDED, end)
            if not np.array_equal(self.ids[a:b], self.ids[a + period:b + period]):
                raise _Erred
        place = first, end + period
        self.runs[place] = min(period, self.runs.get(place, period))


def runs_of(ids: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a word sequence, by start, then period."""
    if len(ids) < least:
        return []
    trial = 0
    while True:
        catcher = SquareCatcher(least, times, _Prime(trial) if trial else None)
        try:
            for start in range(0, len(ids), APPENDED):
                catcher.append(ids[start:start + APPENDED])
            return catcher.close()
        except _Erred:
            trial += 1


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: of each run the first period."""
    drop = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return np.cumsum(drop[:-1]) == 0


def _strongest(runs: list[tuple[int, int, int]]) -> dict | None:
    """The run of most periods; of equals the first, then the one of smallest period."""
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return best and dict(zip(("start", "length", "period"), best))


def _of_slice(words: Words, least: int, times: int):
    ids = words.ids()
    plain, places = words.joined()
    for row in range(words.stop - words.first):
        own = ids[words.offsets[row]:words.offsets[row + 1]]
        runs = runs_of(own, least, times)
        if runs:
            kept = kept_words(len(own), runs)
            text = b" ".join([w for w, k in zip(words.of_text(row), kept.tolist()) if k])
        else:
            text = plain[places[row]:places[row + 1]].tobytes()
        yield len(own), runs, text


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """``(id, n_words, runs, strongest, collapsed)`` per row.

    ``runs`` are all maximal stretches of words with a smallest period, ``times``
    periods and ``least`` words long at least, as ``(start, length, period)`` in
    words, by start and period; ``strongest`` is the one of most periods.
    ``collapsed`` is the text with one blank between words and of each run only the
    first period.  Map-only.  A null or empty text has no words and no runs; a long
    one is read a stretch at a time, with its word numbers and prefix sums in memory
    (16 bytes a word); repeated rows give one row each, a null id stays null, an
    empty table gives none, and other columns are not read.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in spaced_words(batch.column(1)):
                counts, runs, texts = zip(*_of_slice(words, least, times))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.first, words.stop - words.first), pa.array(counts, pa.int64()),
                     pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs], pa.list_(run_type)),
                     pa.array([_strongest(x) for x in runs], run_type), pa.array(texts, pa.binary()).cast(pa.string())],
                    [id_col, "n_words", "runs", "strongest", "collapsed"])

    one = "struct<start: long, length: long, period: long>"
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {id_type}, n_words long, runs array<{one}>, strongest {one}, collapsed string")
