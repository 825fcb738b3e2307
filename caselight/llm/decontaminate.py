"""Benchmark passages inside documents: size-partitioned MinHash containment search, confirmed on exact shingles.

Items are partitioned by size (powers of two of their shingle count).  For each
partition a document is read in overlapping windows as long as two of its
largest items, so that an item that stands in the document lies whole in a
window and makes up at least a quarter of it: containment becomes a similarity
that MinHash can see, however long the document is.  A window is a candidate
when one of its minima is a minimum of an item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.bits import bit_field, holds
from caselight.llm.links import settled
from caselight.llm.words import as_long, mix, shingles, word_hashes
from caselight.shipping import ship_by_value

ship_by_value(__name__)

HASHES = 64  # a window of similarity 0.2 misses all minima with probability 6e-7
_U = np.uint64


def size_class(count: np.ndarray) -> np.ndarray:
    """Exponent of the least power of two that is not below the count."""
    return np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)


def minima(shingle: np.ndarray, starts: np.ndarray, j: int) -> np.ndarray:
    """The least value of hash function ``j`` from each start to the next."""
    odd = _U((0x9E3779B97F4A7C15 * (2 * j + 1)) % (1 << 64) | 1)
    return np.minimum.reduceat((shingle ^ (shingle >> _U(31))) * odd, starts)


def minimum_keys(value: np.ndarray, j: int, size: int, n: int) -> np.ndarray:
    """What a minimum is looked up by: its hash function, size partition and shingle length belong to it."""
    return mix(value + _U((j * 0xD1342543DE82EF95 + size * 0xA24BAED4963EE407 + n) % (1 << 64)))


def window_keys(shingle: np.ndarray, offsets: np.ndarray, sizes: list[int], n: int):
    """``(text, key)`` arrays, hash function by hash function, of the minima of all windows of the given partitions."""
    count = np.diff(offsets)
    step = 1 << sizes[0]
    blocks = -(-count // step)
    block_at = np.concatenate([[0], np.cumsum(blocks)])
    if not block_at[-1]:
        return
    text = np.repeat(np.arange(len(count)), blocks)
    starts = offsets[text] + (np.arange(block_at[-1]) - block_at[text]) * step
    plan = []  # per partition: the pairs of blocks that make a window, and those that make the next partition's blocks
    for size in range(sizes[0], sizes[-1] + 1):
        following = np.append(text[1:] == text[:-1], False)
        place = np.arange(len(text)) - np.searchsorted(text, text)
        even = place % 2 == 0
        plan.append((size, text, following, even))
        text = text[even]
    for j in range(HASHES):
        least = minima(shingle, starts, j)
        for size, texts, following, even in plan:
            joined = least.copy()
            joined[:-1][following[:-1]] = np.minimum(least[:-1], least[1:])[following[:-1]]
            if size in sizes:
                yield texts, minimum_keys(joined, j, size, n)
            least = joined[even]


def _items(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, hashes, offsets in word_hashes(batch.column(1)):
                for row in range(stop - start):
                    words = hashes[offsets[row]:offsets[row + 1]]
                    if not len(words):
                        continue
                    own = min(n, len(words))
                    unique = np.unique(shingles(words, np.array([0, len(words)]), own)[0])
                    size = int(size_class(len(unique)))
                    keys = [minimum_keys(minima(unique, np.array([0]), j), j, size, own)[0] for j in range(HASHES)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start + row, 1), pa.array([own], pa.int32()), pa.array([size], pa.int32()),
                         pa.array([np.array(keys, _U).view(np.int64)], pa.list_(pa.int64())),
                         pa.array([unique.view(np.int64)], pa.list_(pa.int64()))], ["copy", "n", "size", "keys", "shingles"])
    return run


def _scan(partitions: dict[int, list[int]], minimum_bits, shingle_bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, hashes, offsets in word_hashes(batch.column(1)):
                keys: dict[int, set[int]] = {}
                held: dict[int, list[np.ndarray]] = {}
                for n, sizes in partitions.items():
                    shingle, at = shingles(hashes, offsets, n)
                    for text, key in window_keys(shingle, at, sizes, n):
                        hit = np.flatnonzero(holds(minimum_bits, key))
                        for t, k in zip(text[hit].tolist(), key[hit].view(np.int64).tolist()):
                            keys.setdefault(t, set()).add(k)
                    for t in keys:
                        own = np.unique(shingle[at[t]:at[t + 1]])
                        held.setdefault(t, []).append(own[holds(shingle_bits, mix(own))])
                found = [t for t in sorted(keys) if any(len(x) for x in held.get(t, []))]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, stop - start).take(pa.array(found)),
                         pa.array([sorted(keys[t]) for t in found], pa.list_(pa.int64())),
                         pa.array([np.unique(np.concatenate(held[t])).view(np.int64) for t in found], pa.list_(pa.int64()))],
                        ["id", "keys", "shingles"])
    return run


def find_contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``(id, item, n_shared, n_shingles, containment)``: documents that hold at least ``threshold`` of an item's shingles.

    Shingles are ``n`` words in a row, counted once; an item of fewer words is one
    shingle of all its words, and an item without words is held by nothing.
    Documents are read once and only those with a candidate window and a shared
    shingle leave the scan; pairs are then confirmed by an exact count over the
    whole document.  Equal items are searched once.  A null text counts as empty,
    rows with a null id take no part, an id that repeats is one document, other
    columns are not read, and empty tables give no rows.
    """
    wanted = items.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    wanted = wanted.withColumn("copy", F.md5(F.lower("text").cast("binary")))
    known = settled(wanted.groupBy("copy").agg(F.first("text").alias("text")).select("copy", "text")
                    .mapInArrow(_items(n), "copy string, n int, size int, keys array<long>, shingles array<long>"))
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    partitions: dict[int, list[int]] = {}
    for row in known.select("n", "size").distinct().orderBy("n", "size").collect():  # at most n x 64 rows
        partitions.setdefault(row["n"], []).append(row["size"])
    item_keys = known.select("copy", F.explode("keys").alias("key"))
    item_shingles = known.select("copy", F.explode("shingles").alias("shingle"))
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if not partitions:
        found = docs.sparkSession.createDataFrame([], f"id {id_type}, keys array<long>, shingles array<long>")
    else:
        # the filter of shingles looks at mixed values: as bits of a hash they must be spread
        mixed = item_shingles.select("shingle").distinct().mapInArrow(_mixed, "key long")
        found = settled(base.mapInArrow(_scan(partitions, bit_field(item_keys.select("key").distinct()), bit_field(mixed)),
                                        f"id {id_type}, keys array<long>, shingles array<long>"))
    candidates = found.select("id", F.explode("keys").alias("key")).join(item_keys, "key").select("id", "copy").distinct()
    shared = (found.select("id", F.explode("shingles").alias("shingle")).distinct().join(item_shingles, "shingle")
              .groupBy("id", "copy").agg(F.count("*").alias("n_shared")))
    sizes = known.select("copy", F.size("shingles").cast("long").alias("n_shingles"))
    return (candidates.join(shared, ["id", "copy"]).join(sizes, "copy")
            .withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= threshold)
            .join(wanted.select("copy", "item").distinct(), "copy")
            .select(F.col("id").alias(id_col), F.col("item").alias(item_col if item_col != id_col else f"{item_col}_item"),
                    "n_shared", "n_shingles", "containment"))


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([as_long(mix(batch.column(0).to_numpy().view(_U)))], ["key"])
