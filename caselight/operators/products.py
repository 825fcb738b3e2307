"""All sparse products of many queries with a block of rows: frequent terms as a matrix, the others as lists.

A term that many rows of both sides hold costs less as one more column of a matrix
product than as a list read once per query; a rare one costs less as a list.  Scores are
added in single precision, whose error is bounded by the number of terms; all rows
within that error of the k-th best score are multiplied again in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from caselight.shipping import ship_by_value

ship_by_value(__name__)

MANY = 256            # queries from which a block is multiplied
BLOCK_QUERIES = 2_048  # no smaller blocks of queries are made to keep cores busy
_CELLS = 4_000_000    # scores held at once inside a task
_ENTRIES = 2_000_000  # list entries expanded at once inside a task
_COLUMNS = 16_000_000  # numbers of the matrix of frequent terms
_LISTED = 600         # a list entry costs as much as so many numbers of a matrix product
_GROUP = 64           # neighbouring rows whose best score is looked at first
_SLACK = 1e-8         # scores are compared by nine digits


def _spans(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places ``first``, ``first + 1``, ... of every span, one after the other."""
    return np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())


def pieces(length: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose lengths add up to ``most`` at the most, or single ones."""
    ends, a = np.cumsum(length), 0
    while a < len(length):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def search_products(corpus: tuple, queries: tuple, least: np.ndarray, k: int) -> Iterator[tuple]:
    """Chunks of ``(start, query, row, score)``: all rows that can be among the k best of a query.

    Both sides are (entries per row, terms, weights).  A row whose score is below ``least``
    of its query, or which has no common term, may be left out.
    """
    (d_len, d_term, d_weight), (q_len, q_term, q_weight) = corpus, queries
    rows, n = len(d_len), len(q_len)
    # terms of the block are numbered from here on; a query's other terms go
    held = np.bincount(d_term, minlength=int(q_term.max(initial=0)) + 1)
    known = np.flatnonzero(held)
    if not len(known) or not n:
        return
    shared = held[q_term] > 0
    q_owner, q_term, q_weight = np.repeat(np.arange(n), q_len)[shared], q_term[shared], q_weight[shared]
    d_owner = np.repeat(np.arange(rows), d_len)

    # the frequent terms, numbered first
    asked = np.bincount(q_term, minlength=len(held))
    held, work = held[known], (asked[known] * held[known].astype(float))
    order = np.argsort(-work, kind="stable")
    width = rows + -rows % _GROUP
    columns = int(min((work * _LISTED > float(n) * rows).sum(), max(1, _COLUMNS // width)))
    number = np.zeros(len(asked), np.int64)
    number[known[order]] = np.arange(len(known))
    d_term, q_term = number[d_term], number[q_term]
    matrix = np.zeros((columns, width), np.float32)
    frequent = d_term < columns
    matrix[d_term[frequent], d_owner[frequent]] = d_weight[frequent]
    by_list = np.flatnonzero(~frequent)[np.argsort(d_term[~frequent], kind="stable")]
    listed, list_weight = d_owner[by_list], d_weight[by_list].astype(np.float32)
    list_ends = np.cumsum(np.where(np.arange(len(known)) < columns, 0, held[order]))
    list_first = np.concatenate([[0], list_ends])

    norm = lambda owner, weight, size: np.sqrt(np.bincount(owner, weights=weight * weight, minlength=size).max())
    adds = min(np.bincount(q_owner, minlength=n).max(), d_len.max()) + 4
    error = 2.0 ** -23 * adds * norm(q_owner, q_weight, n) * norm(d_owner, d_weight, rows)
    d_first = np.concatenate([[0], np.cumsum(d_len)])
    q_first = np.searchsorted(q_owner, np.arange(n + 1))

    step = min(n, max(1, _CELLS // width))
    exact = np.zeros((step, len(known)))
    for start in range(0, n, step):
        size = min(step, n - start)
        own = slice(q_first[start], q_first[start + size])
        query, term, weight = q_owner[own] - start, q_term[own], q_weight[own]
        exact[query, term] = weight
        scores = exact[:size, :columns].astype(np.float32) @ matrix
        flat = scores.reshape(-1)
        rare = term >= columns
        line, length = np.flatnonzero(rare), list_first[term[rare] + 1] - list_first[term[rare]]
        for a, b in pieces(length, _ENTRIES):
            some, spans = line[a:b], length[a:b]
            entry = _spans(list_first[term[some]], spans)
            np.add.at(flat, np.repeat(query[some] * width, spans) + listed[entry],
                      np.repeat(weight[some].astype(np.float32), spans) * list_weight[entry])
        # k groups of rows whose best reach a score are k rows that reach it
        best = scores.reshape(size, -1, _GROUP).max(axis=2)
        floor = np.full(size, -np.inf)
        if best.shape[1] >= k:
            floor = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k].astype(float)
        floor = np.maximum(floor, least[start:start + size]) - 2 * error - _SLACK
        query, group = np.nonzero((best > 0) & (best >= floor[:, None]))
        found = []
        for a, b in pieces(np.full(len(query), _GROUP), _ENTRIES):
            cells = scores.reshape(size, -1, _GROUP)[query[a:b], group[a:b]]
            pair, inside = np.nonzero((cells > 0) & (cells >= floor[query[a:b], None]))
            found.append((query[a:b][pair], group[a:b][pair] * _GROUP + inside))
        query, row = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        score = np.zeros(len(query))
        for a, b in pieces(d_len[row], _ENTRIES):
            entry = _spans(d_first[row[a:b]], d_len[row[a:b]])
            pair = np.repeat(np.arange(b - a), d_len[row[a:b]])
            score[a:b] = np.bincount(pair, weights=exact[query[a:b][pair], d_term[entry]] * d_weight[entry], minlength=b - a)
        yield start, query, row, score
        exact[q_owner[own] - start, term] = 0.0
