"""Words between white space, found on Arrow buffers.

A word is a maximal run of bytes other than blank, tab, line feed, vertical tab,
form feed and carriage return.  A slice holds texts of about ``SLICE`` bytes, or
one longer text; memory is a small multiple of that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from caselight.shipping import ship_by_value

ship_by_value(__name__)

SLICE = 1 << 20
BLANK = (32, 9, 10, 11, 12, 13)


@dataclass(frozen=True)
class Words:
    """The words of the texts ``first`` to ``stop`` of a column; text ``i`` of them has the bytes ``at[i]:at[i + 1]``."""

    first: int
    stop: int
    data: np.ndarray     # bytes of all texts
    at: np.ndarray
    inside: np.ndarray   # per byte: part of a word
    starts: np.ndarray   # per word: its first byte
    ends: np.ndarray     # per word: the byte behind it
    offsets: np.ndarray  # words of text i: offsets[i]:offsets[i + 1]

    def ids(self) -> np.ndarray:
        """A number per word; equal words of the slice, and no others, have equal numbers."""
        if not len(self.starts):
            return np.zeros(0, np.int32)
        bounds = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts),
                                                 [None, pa.py_buffer(bounds), pa.py_buffer(self.data[self.inside])])
        return words.dictionary_encode().indices.to_numpy()

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The texts with one blank between words and none around them: their bytes, and where each begins."""
        keep = self.inside.copy()
        last = self.offsets[1:][np.diff(self.offsets) > 0] - 1
        followed = np.ones(len(self.ends), bool)
        followed[last] = False
        keep[self.ends[followed]] = True
        out = self.data[keep]
        out[~self.inside[keep]] = 32
        counted = np.concatenate([[0], np.cumsum(keep)]) if len(keep) <= 2 * SLICE else None
        places = counted[self.at] if counted is not None else np.array([np.count_nonzero(keep[:a]) for a in self.at])
        return out, places

    def of_text(self, row: int) -> list[bytes]:
        """The words of one text."""
        raw, base = self.data[self.at[row]:self.at[row + 1]].tobytes(), self.at[row]
        some = slice(self.offsets[row], self.offsets[row + 1])
        return [raw[a:b] for a, b in zip((self.starts[some] - base).tolist(), (self.ends[some] - base).tolist())]


def spaced_words(texts: pa.Array) -> Iterator[Words]:
    """The words of a text column, slice by slice; a null text has none."""
    blank = np.zeros(256, bool)
    blank[list(BLANK)] = True
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    every = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    buffer = texts.buffers()[2]
    whole = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(every, every[row] + SLICE, "right")) - 1)
        at = every[row:stop + 1] - every[row]
        data = whole[every[row]:every[stop]]
        inside = ~blank[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        begins, closes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        closes[:-1] &= ~inside[1:] | cut[1:-1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        yield Words(row, stop, data, at, inside, starts, ends, np.searchsorted(starts, at))
        row = stop


def per_text(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    out = np.zeros(len(at) - 1, np.int64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = np.add.reduceat(marks, at[some], dtype=np.int64)
    return out
