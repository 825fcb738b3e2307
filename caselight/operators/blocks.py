"""Exact all-against-all work in blocks of bounded size.

Rows are dealt to blocks by a hash of their id, so no value of the data can make a
block hot.  Every (query block, corpus block) pair becomes one group of an Arrow
cogroup; a group holds two bounded blocks, computes its products with numpy, and
returns only what can matter (k rows per query), never the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselight.operators.ordering import head_per_group
from caselight.shipping import ship_by_value

ship_by_value(__name__)

BLOCK_ROWS = 20_000
BLOCK_ENTRIES = 4_000_000
_CELLS = 4_000_000      # score cells held at once inside a task
_EXPANDED = 16_000_000  # posting entries expanded at once inside a task


@dataclass(frozen=True)
class Limits:
    """Rows and vector entries of a block."""

    rows: int
    entries: int


@dataclass(frozen=True)
class Size:
    """Rows of a frame and an upper bound on the vector entries they hold."""

    rows: int
    entries: int

    def blocks(self, limits: Limits | None = None) -> int:
        limits = limits or Limits(BLOCK_ROWS, BLOCK_ENTRIES)
        return max(1, math.ceil(self.rows / limits.rows), math.ceil(self.entries / limits.entries))


def plan_blocks(queries: Size, corpus: Size, groups: int) -> tuple[int, int]:
    """(query blocks, corpus blocks): within the size bounds, and enough pairs to keep every core busy.

    A side is sent once per block of the other, so the cut that repeats fewer
    entries is taken each time.
    """
    q, d = queries.blocks(), corpus.blocks()
    while q * d < groups:
        can_q, can_d = 32 * q < queries.rows, 32 * d < corpus.rows
        if can_q and (corpus.entries * q <= queries.entries * d or not can_d):
            q *= 2
        elif can_d:
            d *= 2
        else:
            break
    return q, d


def text_size(docs: DataFrame, text_col: str) -> Size:
    """Sizes for texts to be turned into term vectors: a token takes three characters with its gap."""
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()
    return Size(row[0], 2 * (row[1] // 3 + row[0]))


def vector_size(vectors: DataFrame, vector_col: str) -> Size:
    row = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(vector_col)), F.lit(0))).first()
    return Size(row[0], row[1])


def usual_width(vectors: DataFrame, vector_col: str) -> int:
    """The most frequent length of the vectors, the smaller one of a tie; 0 without any."""
    return vectors.where(F.col(vector_col).isNotNull()).agg(F.mode(F.size(vector_col), True)).first()[0] or 0


def usable(vectors: DataFrame, vector_col: str, width: int) -> DataFrame:
    """Rows with ``width`` numbers; a vector that is null, of another length or holds null, NaN or infinity takes no part."""
    def fails(x):
        return x.isNull() | F.isnan(x) | F.abs(x).eqNullSafe(float("inf"))
    v = F.col(vector_col)
    return vectors.where(v.isNotNull() & (F.size(v) == width) & ~F.exists(v, fails))


def _lists(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and concatenated values of a list column."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lengths, lists.flatten().to_numpy(zero_copy_only=False)


def dense_rows(table: pa.Table, vector_col: str) -> np.ndarray:
    """Rows of an array column as L2-normalised float64; a zero vector stays zero."""
    lengths, values = _lists(table.column(vector_col).combine_chunks())
    matrix = values.astype(np.float64).reshape(len(lengths), -1)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(norms == 0, 1.0, norms)


def sparse_parts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries per row, term numbers and weights, of a column of sparse vectors or of two list columns."""
    if "features" in table.schema.names:
        indices, values = (pc.struct_field(table.column("features"), part) for part in ("indices", "values"))
    else:
        indices, values = table.column("indices"), table.column("values")
    lengths, numbers = _lists(indices.combine_chunks())
    return lengths, numbers, _lists(values.combine_chunks())[1]


def _dense_scores(queries: pa.Table, corpus: pa.Table):
    q, d = dense_rows(queries, "features"), dense_rows(corpus, "features")
    step = max(1, _CELLS // max(1, len(d)))
    for start in range(0, len(q), step):
        yield start, q[start:start + step] @ d.T


def _sparse_scores(queries: pa.Table, corpus: pa.Table):
    """Score rows from an inverted list over the corpus block."""
    n_docs = corpus.num_rows
    d_len, d_idx, d_weight = sparse_parts(corpus)
    by_term = np.argsort(d_idx, kind="stable")
    doc_of, w_of = np.repeat(np.arange(n_docs), d_len)[by_term], d_weight[by_term]
    known, first = np.unique(d_idx[by_term], return_index=True)
    last = np.append(first[1:], len(by_term))

    q_len, q_idx, q_weight = sparse_parts(queries)
    slot = np.searchsorted(known, q_idx)
    hit = (slot < len(known)) & (known[np.minimum(slot, max(len(known) - 1, 0))] == q_idx) if len(known) else \
        np.zeros(len(q_idx), bool)
    q_of = np.repeat(np.arange(queries.num_rows), q_len)[hit]
    slot, q_weight = slot[hit], q_weight[hit]
    lo, hi = (first[slot], last[slot]) if len(known) else (slot, slot)
    cost = np.bincount(q_of, weights=hi - lo, minlength=queries.num_rows)

    step = max(1, _CELLS // max(1, n_docs))
    start = 0
    while start < queries.num_rows:
        reach = np.searchsorted(np.cumsum(cost[start:start + step]), _EXPANDED, side="right")
        stop = min(queries.num_rows, start + max(1, min(step, int(reach))))
        a, b = np.searchsorted(q_of, [start, stop])
        spans = hi[a:b] - lo[a:b]
        offset = np.repeat(lo[a:b] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
        cell = np.repeat((q_of[a:b] - start) * n_docs, spans) + doc_of[offset]
        value = np.repeat(q_weight[a:b], spans) * w_of[offset]
        scores = np.bincount(cell, weights=value, minlength=(stop - start) * n_docs).astype(np.float64)
        yield start, scores.reshape(-1, n_docs)
        start = stop


_SCORERS: dict[str, Callable] = {"dense": _dense_scores, "sparse": _sparse_scores}


REPEATED = "values of %s repeat: every row of a search needs its own id"


def check_unique(table: pa.Table, id_col: str) -> None:
    """Equal ids share a block, so a repeat is seen here whatever the number of blocks."""
    if pc.count_distinct(table.column(id_col), mode="all").as_py() < table.num_rows:
        raise ValueError(REPEATED % id_col)


def best_k(k: int, scorer: str, query_id: str, doc_id: str, schema: pa.Schema):
    def run(key, queries: pa.Table, corpus: pa.Table) -> pa.Table:
        check_unique(queries, query_id)
        check_unique(corpus, doc_id)
        if queries.num_rows == 0 or corpus.num_rows == 0:
            return schema.empty_table()
        corpus = corpus.sort_by(doc_id)
        take = min(k, corpus.num_rows)
        q_rows, d_rows, scores, ranks = [], [], [], []
        for start, block in _SCORERS[scorer](queries, corpus):
            rows = np.arange(len(block))
            ranked = np.round(block, 9)
            for rank in range(take):  # argmax takes the first of equals, i.e. the smaller id
                best = np.argmax(ranked, axis=1)
                q_rows.append(start + rows)
                d_rows.append(best)
                scores.append(block[rows, best])
                ranks.append(np.full(len(rows), rank + 1, np.int32))
                ranked[rows, best] = -np.inf
        q_rows, d_rows = np.concatenate(q_rows), np.concatenate(d_rows)
        out = {query_id: queries.column(query_id).take(q_rows), "rank": pa.array(np.concatenate(ranks)),
               doc_id: corpus.column(doc_id).take(d_rows), "score": pa.array(np.concatenate(scores))}
        return pa.table(out).select(schema.names).cast(schema)
    return run


def block_top_k(queries: DataFrame, corpus: DataFrame, k: int, scorer: str, query_id: str, doc_id: str,
                query_size: Size, corpus_size: Size, payload: Sequence[str] = (), width: int = 0,
                limits: Limits | None = None) -> DataFrame:
    """``(query_id, rank, doc_id, score, *payload)``: the exact k best corpus rows of every query.

    Ties (scores equal to nine digits) go to the smaller corpus id; rows with score
    zero fill up to k.  Ids must not repeat on either side; a repeat raises an error.
    Only ids and vectors enter the blocks, whose size is bounded by them; the hits
    fetch their payload afterwards, where adaptive splitting cuts a popular corpus row.
    A corpus that needs more than one block is searched by impact-ordered lists
    (``impact``) or by a tree of balls (``balls``), with the same result; ``width`` is
    the length of the vectors, ``limits`` the size of a block.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if corpus_size.blocks(limits) > 1:
        if scorer == "sparse":
            from caselight.operators.impact import impact_top_k

            hits = impact_top_k(queries, corpus, k, query_id, doc_id, query_size, corpus_size, width, limits)
        else:
            from caselight.operators.balls import nearest_top_k

            hits = nearest_top_k(queries, corpus, k, query_id, doc_id, corpus_size, limits)
        return _with_payload(hits, corpus, query_id, doc_id, payload)

    parallelism = queries.sparkSession.sparkContext.defaultParallelism
    query_blocks, corpus_blocks = plan_blocks(query_size, corpus_size, 2 * parallelism)
    groups = query_blocks * corpus_blocks
    tasks = min(groups, max(2 * parallelism, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def dealt(df: DataFrame, own: str, id_col: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        """Rows with their own block, repeated for every block of the other side."""
        return (df.withColumn(own, F.pmod(F.xxhash64(id_col), F.lit(own_blocks)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))))
                .repartition(tasks, "_qb", "_db"))

    left = dealt(queries.select(query_id, "features"), "_qb", query_id, query_blocks, "_db", corpus_blocks)
    right = dealt(corpus.select(doc_id, "features"), "_db", doc_id, corpus_blocks, "_qb", query_blocks)
    schema = T.StructType([queries.schema[query_id], T.StructField("rank", T.IntegerType()), corpus.schema[doc_id],
                           T.StructField("score", T.DoubleType())])
    hits = left.groupBy("_qb", "_db").cogroup(right.groupBy("_qb", "_db")).applyInArrow(
        best_k(k, scorer, query_id, doc_id, to_arrow_schema(schema)), schema)
    if corpus_blocks > 1:  # with one block a query met the whole corpus in its one group
        order = [F.desc(F.round("score", 9)), F.asc(doc_id)]
        hits = head_per_group(hits.drop("rank"), [query_id], order, k, "rank").select(query_id, "rank", doc_id, "score")
    return _with_payload(hits, corpus, query_id, doc_id, payload)


def _with_payload(hits: DataFrame, corpus: DataFrame, query_id: str, doc_id: str, payload: Sequence[str]) -> DataFrame:
    if not payload:
        return hits
    return hits.join(corpus.select(doc_id, *payload), doc_id).select(query_id, "rank", doc_id, "score", *payload)
