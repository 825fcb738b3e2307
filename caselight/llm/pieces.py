"""Encoding and decoding with a merge-type piece vocabulary.

The merge order is kept in an agenda: every adjacent pair of symbols whose
concatenation is a piece waits with the score of that piece; the best score is
merged first, the leftmost on a tie, until no pair is left.  Short segments step
through their agendas together, as rows of one array; a long one has a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.words import worker_state
from caselight.shipping import ship_by_value

ship_by_value(__name__)

SPACE = "▁"
MEMO_SEGMENTS = 100_000
MEMO_CHARS = 48  # longer segments are not kept
SHORT = 40  # characters of a segment that is merged together with others
TOGETHER = 4096  # segments merged together: some 160,000 symbols
CHECK_EVERY = 1 << 18  # characters of new segments checked with the library in one call


class _Pairs:
    """Which two symbols side by side make which piece, as an open hash table for whole arrays of pairs.

    Symbols are piece ids; a character of no own piece has a number behind them.
    Pieces that share their score are left out, as an order does not name one of them.
    """

    NONE = np.int32(1 << 30)

    def __init__(self, ids: dict[str, int], rank: dict[str, float], size: int):
        symbol = dict(ids)
        for piece in ids:
            for c in piece:
                symbol.setdefault(c, size + len(symbol))
        self.of_char = np.full(0x110000, -1, np.int32)
        for c, number in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = number
        shared = Counter(score for p, score in rank.items() if len(p) > 1)
        by_rank = sorted((p for p in ids if len(p) > 1 and shared[rank[p]] == 1), key=rank.get)
        beginnings = sorted({p[:2] for p in ids if len(p) > 1 and shared[rank[p]] > 1})
        self.left_out = re.compile("|".join(map(re.escape, beginnings)) or "(?!)").search  # in any segment such pieces could come up in
        self.piece = np.array([ids[p] for p in by_rank], np.int32)
        keys, orders = [], []
        for order, piece in enumerate(by_rank):
            for at in range(1, len(piece)):
                left, right = symbol.get(piece[:at]), symbol.get(piece[at:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    orders.append(order)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.found = np.full(1 << self.bits, self.NONE, np.int32)
        keys, orders = np.array(keys, np.int64), np.array(orders, np.int32)
        slot = self._slot(keys)
        while len(keys):  # all that meet a free slot take it, the others go on to the next one
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.found[slot[placed]] = orders[placed]
            keys, orders, slot = keys[~placed], orders[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def orders(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The order of the piece that each pair makes, or NONE."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.found[slot], self.NONE)
        at = np.flatnonzero((held != keys) & (held >= 0) & (left >= 0) & (right >= 0))
        slot = slot[at]
        while len(at):  # another pair holds the slot: look on
            slot = (slot + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot]
            hit = held == keys[at]
            out[at[hit]] = self.found[slot[hit]]
            go = ~hit & (held >= 0)
            at, slot = at[go], slot[go]
        return out


class PieceCodec:
    """A vocabulary read through the library, with its own merge agenda and decoder."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.unknown = self.library.unk_id()
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes_of: dict[int, int] = {}
        self.byte_ids: dict[int, int] = {}
        self.silent = set()
        self.surface: list[bytes] = []
        for i in range(size):
            piece = self.library.id_to_piece(i)
            self.surface.append(piece.replace(SPACE, " ").encode())
            if self.library.is_control(i) or self.library.is_unused(i):
                self.silent.add(i)
            elif self.library.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_of[i], self.byte_ids[value] = value, i
            elif i != self.unknown:
                self.ids[piece], self.rank[piece] = i, -self.library.get_score(i)
        # Safe places to cut: before a space mark if no piece goes on past one, around a character of no longer piece,
        # and between letters and the rest where no piece holds both.
        self.spaces_lead = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        beside: dict[str, set[str]] = {}
        for piece in self.ids:
            for a, b in zip(piece, piece[1:]):
                beside.setdefault(a, set()).add(b)
                beside.setdefault(b, set()).add(a)
        alone = [chr(c) for c in range(128) if chr(c) not in beside]
        letters = {c for c in beside if c.isalpha()}
        while mixed := {c for c in letters if not beside[c] <= letters | {SPACE}}:
            letters -= mixed
        alone, letters = ("".join(map(re.escape, sorted(x))) for x in (alone, letters))
        kinds = [f"[{alone}]"] * bool(alone) + [f"{SPACE}*[{letters}]+"] * bool(letters)
        self.cutter = re.compile("|".join([*kinds, f"{SPACE}*[^{SPACE}{alone}{letters}]+", f"{SPACE}+"]))
        self.mark = self.ids[SPACE]
        self.pairs = _Pairs(self.ids, self.rank, size)
        self.plain = [i not in self.bytes_of and i not in self.silent for i in range(size)]
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def segments(self, text: str) -> list[str]:
        marked = SPACE + text.replace(" ", SPACE)
        return self.cutter.findall(marked) if self.spaces_lead else [marked]

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment by the agenda."""
        symbols = self._symbols(segment)
        try:
            return [self.ids[symbol] for symbol in symbols]
        except KeyError:  # a character without a piece
            out: list[int] = []
            for symbol in symbols:
                if symbol in self.ids:
                    out.append(self.ids[symbol])
                elif self.byte_ids:
                    out += [self.byte_ids[b] for b in symbol.encode()]
                else:
                    out.append(self.unknown)
            return out

    def merge_many(self, segments: list[str]) -> list[list[int]]:
        """Ids of many segments: short ones of like length step through their agendas together."""
        out: list = [None] * len(segments)
        order = sorted((at for at, s in enumerate(segments) if 1 < len(s) <= SHORT and not self.pairs.left_out(s)),
                       key=lambda at: len(segments[at]))
        for start in range(0, len(order), TOGETHER):
            some = order[start:start + TOGETHER]
            for at, ids in zip(some, self._merge_together([segments[at] for at in some])):
                out[at] = ids
        return [self.merge(s) if ids is None else ids for s, ids in zip(segments, out)]

    def _merge_together(self, segments: list[str]) -> list[list[int] | None]:
        """One row per segment: symbols, and per left symbol the order of the pair it begins; None where a character has no piece.

        In each round every segment merges the first smallest entry of its row,
        which is the best pair and the leftmost of equals.
        """
        pairs = self.pairs
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        rows, width = len(segments), int(lengths.max()) + 1
        symbols = np.full((rows, width), -1, np.int32)  # the last column stays empty and ends every chain
        inside = np.arange(width)[None, :] < lengths[:, None]
        symbols[inside] = pairs.of_char[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        known = (symbols[:, :-1] >= 0).sum(1) == lengths
        agenda = np.full((rows, width), pairs.NONE, np.int32)
        agenda[:, :-1] = pairs.orders(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(rows, width - 1)
        after = np.broadcast_to(np.minimum(np.arange(width) + 1, width - 1).astype(np.int16), (rows, width)).copy()
        before = np.broadcast_to((np.arange(width) - 1).astype(np.int16), (rows, width)).copy()  # -1: the last column, which is empty
        row = np.flatnonzero(known)
        while len(row):
            left = agenda[row].argmin(1)
            best = agenda[row, left]
            going = best < pairs.NONE
            row, left, best = row[going], left[going], best[going]
            right = after[row, left]
            made = pairs.piece[best]
            symbols[row, left], symbols[row, right] = made, -1
            agenda[row, right] = pairs.NONE
            beyond, ahead = after[row, right], before[row, left]
            after[row, left] = beyond
            before[row, beyond] = left
            agenda[row, left] = pairs.orders(made, symbols[row, beyond])
            agenda[row, ahead] = pairs.orders(symbols[row, ahead], made)
            agenda[row, -1] = pairs.NONE
        kept = symbols >= 0
        flat, ends = symbols[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        fine = known & ~((symbols >= len(self.surface)).any(1))
        return [flat[a:b] if ok else None for a, b, ok in zip([0, *ends], ends, fine.tolist())]

    def _symbols(self, segment: str) -> list[str]:
        """Symbols of one segment: the agenda is a heap, whose entries are checked when their turn comes."""
        symbols: list[str | None] = list(segment)
        n = len(symbols)
        rank = self.rank.get
        agenda = []
        for i in range(n - 1):
            joined = symbols[i] + symbols[i + 1]
            order = rank(joined)
            if order is not None:
                agenda.append((order, i, i + 1, joined))
        if agenda:
            heapq.heapify(agenda)
            before, after = list(range(-1, n - 1)), list(range(1, n + 1))
            while agenda:
                _, left, right, joined = heapq.heappop(agenda)
                a, b = symbols[left], symbols[right]
                if a is None or b is None or after[left] != right or a + b != joined:
                    continue  # one of the two has been merged since
                symbols[left], symbols[right] = joined, None
                right = after[left] = after[right]
                if right < n:
                    before[right] = left
                    wider = joined + symbols[right]
                    order = rank(wider)
                    if order is not None:
                        heapq.heappush(agenda, (order, left, right, wider))
                right, left = left, before[left]
                if left >= 0:
                    wider = symbols[left] + joined
                    order = rank(wider)
                    if order is not None:
                        heapq.heappush(agenda, (order, left, right, wider))
        return [symbol for symbol in symbols if symbol is not None]

    def learn(self, segments: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Packed ids and decoded bytes of distinct segments, each compared with the library's."""
        out, call, size = {}, [], 0
        for at, segment in enumerate(segments):
            call.append(segment)
            size += len(segment)
            if size < CHECK_EVERY and at + 1 < len(segments):
                continue
            # the library puts a space mark before every text and takes it off again
            theirs = self.library.encode([s[1:] if s[0] == SPACE else s for s in call], num_threads=1)
            made = []
            for ours, ids, wanted in zip(call, self.merge_many(call), theirs):
                lead = [] if ours[0] == SPACE else self.merge(SPACE + ours)
                if ours == SPACE:  # the library leaves out the mark of an empty text
                    wanted = [self.mark]
                if (lead or ids) != wanted:
                    raise ValueError(f"the agenda and the library differ on {ours[:80]!r}")
                made.append([self.mark] + ids)
            for ours, ids, wanted in zip(call, made, self.library.decode(made, num_threads=1)):
                text = self.decode(ids)
                if text != wanted:
                    raise ValueError(f"the decoder and the library differ on {ours[:80]!r}")
                out[ours] = struct.pack(f"<{len(ids) - 1}I", *ids[1:]), text.encode()
            call, size = [], 0
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Little-endian 32-bit ids with begin and end, and their decoded UTF-8 bytes, of each text."""
        cut = [self.segments(t) if t else [] for t in texts]
        memo, old = self.memo, self.old
        wanted = {s for c in cut for s in c}
        known = {s: memo[s] if s in memo else old[s] for s in wanted if s in memo or s in old}
        known.update(self.learn([s for s in wanted if s not in known]))
        first, last = (np.array([i], "<u4").tobytes() if i >= 0 else b"" for i in (self.begin, self.end))
        out = []
        for c in cut:
            pairs = [known[s] for s in c]
            out.append((first + b"".join([p[0] for p in pairs]) + last, b"".join([p[1] for p in pairs])[1:]))
        memo.update((s, p) for s, p in known.items() if len(s) <= MEMO_CHARS)
        if len(memo) > MEMO_SEGMENTS:  # what the next texts do not ask for again goes
            self.memo, self.old = {}, memo
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids are silent, runs of byte ids are read as UTF-8, the leading mark is dropped."""
        if all(map(self.plain.__getitem__, ids)):
            return b"".join(map(self.surface.__getitem__, ids)).decode().removeprefix(" ")
        out: list[bytes] = []
        run = bytearray()
        fresh = True
        for i in ids:
            if i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            if run:
                out.append(_repaired(bytes(run)))
                run, fresh = bytearray(), False
            if i in self.silent:
                continue
            piece = self.surface[i]
            if fresh and piece[:1] == b" ":
                piece = piece[1:]
            fresh = False
            out.append(piece)
        if run:
            out.append(_repaired(bytes(run)))
        return b"".join(out).decode()


def _repaired(run: bytes) -> bytes:
    """Valid UTF-8 as it is; each byte that belongs to no character becomes U+FFFD."""
    try:
        run.decode()
        return run
    except UnicodeDecodeError as error:
        return run[:error.start] + "�".encode() + _repaired(run[error.start + 1:])


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  with_ids: bool = False) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` per row, with begin and end ids; ``with_ids`` adds ids and decoded text.

    Every distinct segment is merged by the agenda, decoded again, and both are
    compared with the library's results; a difference stops the job.  Texts are
    cut only where no piece of the vocabulary can reach across, so the ids are
    those of the whole text.
    Map-only.  A null text counts as empty (begin and end only); repeated rows
    give one row each, a null id stays null, and other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_state(f"piece codec {model_path}", lambda: PieceCodec(model_path))
        for batch in batches:
            start, size = 0, 0
            texts = batch.column(1)
            for at in range(len(texts)):
                size += len(texts[at].as_buffer() or b"") if texts[at].is_valid else 0
                if size < 1 << 20 and at + 1 < len(texts):
                    continue
                part = [t or "" for t in texts.slice(start, at + 1 - start).to_pylist()]
                packed, decoded = zip(*codec.encode(part))
                columns = [batch.column(0).slice(start, at + 1 - start), pa.array([len(p) // 4 for p in packed], pa.int64()),
                           pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                           pa.array([hashlib.sha256(d).hexdigest() for d in decoded])]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in packed], pa.list_(pa.int32())),
                                pa.array([d.decode() for d in decoded])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)
                start, size = at + 1, 0

    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_ids else ""
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
