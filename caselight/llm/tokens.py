"""Token counts of whole texts with a public tokenizer file."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.words import worker_state
from caselight.shipping import ship_by_value

ship_by_value(__name__)

BATCH_BYTES = 1 << 18  # text handed to the library in one call
MEMO_WORDS = 200_000
MEMO_BYTES = 64  # longer words are not kept


def _pieces(text: bytes, limit: int) -> Iterator[bytes]:
    """A text cut after white space into pieces of about ``limit`` bytes."""
    start = 0
    while len(text) - start > limit:
        end = max(text.rfind(space, start, start + limit) for space in (b" ", b"\n", b"\t", b"\r")) + 1
        if end <= start:  # a run without white space cannot be cut safely
            after = [at for space in (b" ", b"\n", b"\t", b"\r") if (at := text.find(space, start + limit)) >= 0]
            end = min(after) + 1 if after else len(text)
        yield text[start:end]
        start = end
    yield text[start:]


def _counter(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    memo: dict[bytes, int] = {}

    def lengths(words: list[bytes]) -> list[int]:
        """Token counts of distinct words, in calls of about BATCH_BYTES."""
        out, call, size = [], [], 0
        for word in words:
            call.append(word.decode("utf-8", "replace"))
            size += len(word) + 8
            if size >= BATCH_BYTES:
                out += [len(e) for e in tokenizer.encode_batch(call, add_special_tokens=False)]
                call, size = [], 0
        return out + [len(e) for e in tokenizer.encode_batch(call, add_special_tokens=False)]

    def count(texts: list[bytes]) -> list[int]:
        words = [Counter(w for piece in _pieces(t, BATCH_BYTES) for w in piece.split()) for t in texts]
        new = list({w for c in words for w in c if w not in memo})
        known = dict(zip(new, lengths(new)))
        totals = [sum(n * (known[w] if w in known else memo[w]) for w, n in c.items()) for c in words]
        if len(memo) + len(known) > MEMO_WORDS:
            memo.clear()
        memo.update((w, n) for w, n in known.items() if len(w) <= MEMO_BYTES)
        return totals

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` per row, without begin, end or added special tokens.

    Made for tokenizers that drop white space (words never join across it): a
    text is cut at ASCII white space, each distinct word of a batch is encoded
    once, and only lengths come back.  Batches are balanced by bytes, not rows.
    Map-only: no shuffle, and repeated rows or ids give one row each.  A null text
    counts as empty (0 bytes, 0 tokens); a null id stays null; columns other than
    the two named are not read, so their names cannot clash.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = worker_state(f"token counter {tokenizer_path}", lambda: _counter(tokenizer_path))
        for batch in batches:
            ids, n_bytes, n_tokens, held, size = batch.column(0), [], [], [], 0
            for text in batch.column(1):
                held.append((text.as_py() or "").encode())
                n_bytes.append(len(held[-1]))
                size += len(held[-1])
                if size >= 4 * BATCH_BYTES:
                    n_tokens += count(held)
                    held, size = [], 0
            n_tokens += count(held)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()),
                                              pa.array([n > limit for n in n_tokens], pa.bool_())],
                                             [id_col, "n_bytes", "n_tokens", "over_limit"])

    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
