"""Word and shingle hashes of whole text columns, computed on Arrow buffers without per-word Python.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the
lower-cased text, so white space and ASCII punctuation divide words.  Memory is
bounded by ``SLICE`` bytes of text at a time; a longer text is read piece by
piece, and a run without any divider is cut every ``SLICE`` bytes.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from caselight.shipping import ship_by_value

ship_by_value(__name__)

SLICE = 1 << 20
_U = np.uint64


def worker_state(key: str, make: Callable):
    """A value that stays in this Python worker from task to task, until a task of another kind asks for its own.

    Workers outlive a stage, so tables of earlier stages must not lie beside those of the present one.
    """
    held = sys.modules.setdefault("_caselight_worker", types.ModuleType("_caselight_worker")).__dict__.setdefault("held", {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit integers over all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables():
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(SLICE + 1, base, _U), np.full(SLICE + 1, inverse, _U)
    up[0] = down[0] = 1
    inside = np.zeros(256, bool)
    inside[128:] = True
    for low, high in ((48, 58), (65, 91), (97, 123)):
        inside[low:high] = True
    return np.multiply.accumulate(up), np.multiply.accumulate(down), inside


def _piece(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray, up, down):
    """Hash, first and last byte of each word in at most SLICE bytes; ``bounds`` are starts of texts."""
    n = len(data)
    is_word = inside[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = is_word[:-1], is_word[1:]
    first = np.flatnonzero(is_word & (~before | cut[:-1]))
    last = np.flatnonzero(is_word & (~after | cut[1:])) + 1
    sums = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:n], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first]), first, last


def word_hashes(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column: ``(first row, end row, hashes, offsets)``.

    ``offsets`` has one entry more than the slice has rows; the hashes of its row
    ``i`` are ``hashes[offsets[i]:offsets[i + 1]]``.  Nulls have no words.
    """
    up, down, inside = worker_state("word tables", _tables)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + SLICE // 2, "right")) - 1)
        part = texts.slice(row, stop - row)
        part = pa.concat_arrays([pc.utf8_lower(part) if lower else part])
        at = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1, part.offset * 8)
        buffer = part.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[at[0]:at[-1]] if buffer is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        if not len(data):
            yield row, stop, np.zeros(0, _U), np.zeros(len(part) + 1, np.int64)
        elif len(data) <= SLICE:
            hashes, first, _ = _piece(data, at[:-1], inside, up, down)
            yield row, stop, hashes, np.searchsorted(first, at)
        else:  # one long text
            found, start = [], 0
            while start < len(data):
                end = min(start + SLICE, len(data))
                if end < len(data):
                    dividers = np.flatnonzero(~inside[data[start:end]])
                    end = start + int(dividers[-1]) + 1 if len(dividers) else end
                found.append(_piece(data[start:end], np.zeros(1, np.int64), inside, up, down)[0])
                start = end
            hashes = np.concatenate(found)
            yield row, stop, hashes, np.array([0, len(hashes)])
        row = stop


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` words in a row within each text, with offsets; a text of 1 to n-1 words is one shingle."""
    count = np.diff(offsets)
    made = np.maximum(count - n + 1, np.minimum(count, 1))
    out_at = np.concatenate([[0], np.cumsum(made)])
    if not len(hashes):
        return np.zeros(0, _U), out_at
    text = np.repeat(np.arange(len(count)), made)
    start = np.arange(out_at[-1]) - out_at[text] + offsets[text]
    have = np.minimum(count, n)[text]
    total = np.zeros(len(start), _U)
    factor = 1
    for j in range(n):
        factor = factor * 0xD1342543DE82EF95 % (1 << 64)
        word = hashes[np.minimum(start + j, len(hashes) - 1)]
        total += np.where(j < have, word * _U(factor), _U(0))
    return mix(total), out_at


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
