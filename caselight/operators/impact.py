"""Exact sparse top-k over a corpus of many blocks: impact-ordered lists that are read only as far as they matter.

Rows are dealt to blocks of bounded size by a hash of their id.  Inside a task the
entries of a block are dealt by (term, weight band), heaviest band first, and every
band has its largest weight.  For a query the bands are read in the order of what
they can still add per entry, until the bands not read cannot lift an unseen row to
the score that a k-th hit is already known to reach.  Rows seen are then probed for
their missing terms, heaviest first, and leave as soon as they cannot reach it either.

That score is known early: a query first meets the blocks that hold the heaviest
entries of its strongest terms, and carries its k-th best score from there to the others.

Where many queries meet a block, reading lists for each of them costs more than
multiplying them all with the block at once (``products``): then every query meets every block in one pass.
Both sides are dealt once, each block is packed into one row of the shared checkpoint, and a task
reads one block of either side from there: nothing is repeated on disk, however many blocks there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from caselight.operators import blocks as B
from caselight.operators import products as M
from caselight.operators.ordering import head_per_group
from caselight.session import ensure_checkpoint_dir
from caselight.shipping import ship_by_value

ship_by_value(__name__)

BANDS = 48         # half powers of two; the last one holds all lighter entries
HOMES = 3          # blocks a query meets first
_CELLS = 4_000_000  # score cells held at once inside a task
_ENTRIES = 8_000_000  # entries read or probed at once inside a task
_SLACK = 1e-8      # scores are compared by nine digits
_FIRST = 0.1       # share of a query's entries read before any score is known
_LEADING = 8       # times k rows at most are then scored in full
_PROBED = 0.3      # share of the missing terms that a row is probed for before it leaves, as a guess
_PACKED = 1_000_000  # entries packed into one row
_REST = 0.55      # reading goes on until the unread bands cannot reach this share of the known score


class Lists:
    """The entries of one block by (term, band), and by row for probing."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.rows = len(lengths)
        owner = np.repeat(np.arange(self.rows), lengths)
        self.known = np.unique(terms)  # terms of the block, numbered from here on
        term = np.searchsorted(self.known, terms)
        band = _band(weights)
        by_row = np.lexsort((term, owner))
        self.keys, self.weights = owner[by_row] * max(1, len(self.known)) + term[by_row], weights[by_row]
        place = term * BANDS + band
        by_list = np.argsort(place, kind="stable")
        self.owner, self.weight = owner[by_list], weights[by_list]
        self.starts = np.searchsorted(place[by_list], np.arange(len(self.known) * BANDS + 1))
        top = np.zeros(len(self.known) * BANDS)
        np.maximum.at(top, place, weights)
        # the largest weight from a band on
        self.top = np.maximum.accumulate(top.reshape(-1, BANDS)[:, ::-1], axis=1)[:, ::-1]
        self.count = np.diff(self.starts).reshape(-1, BANDS)

    def probe(self, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        """The weight of a term in a row, 0.0 without an entry."""
        key = row * max(1, len(self.known)) + term
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == key, self.weights[at], 0.0) if len(self.keys) else np.zeros(len(key))


def _band(weights: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(-2.0 * np.log2(np.abs(weights))), 0, BANDS - 1).astype(np.int64)


class _Asked:
    """Some queries against the lists of a block: one line per known query term."""

    def __init__(self, lists: Lists, lengths: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        at = np.minimum(np.searchsorted(lists.known, terms), max(len(lists.known) - 1, 0))
        known = (lists.known[at] == terms) if len(lists.known) else np.zeros(len(terms), bool)
        self.lists, self.n = lists, len(lengths)
        self.query = np.repeat(np.arange(self.n), lengths)[known]
        self.term, self.weight = at[known], weights[known]
        self.gain = lists.top[self.term] * self.weight[:, None]  # what the bands from one on can add
        self.read = np.zeros(len(self.term), np.int64)  # bands read, the heaviest first
        self.held = lists.count[self.term].sum(1) if len(self.term) else np.zeros(0, np.int64)
        after = np.concatenate([self.gain[:, 1:], np.zeros((len(self.term), 1))], axis=1)
        entries = lists.count[self.term]
        with np.errstate(divide="ignore", invalid="ignore"):
            worth = np.where(entries > 0, (self.gain - after) / np.maximum(entries, 1), np.inf)
        worth = np.minimum.accumulate(worth, axis=1)  # a band is not read before a heavier one
        line, band = np.divmod(np.arange(worth.size), BANDS)
        order = np.lexsort((band, -worth.ravel(), self.query[line]))
        self.line, self.band, self.drop, self.entries = line[order], band[order], (self.gain - after).ravel()[order], entries.ravel()[order]
        self.first = np.searchsorted(self.query[self.line], np.arange(self.n + 1))

    def rest(self) -> np.ndarray:
        """Per query, what all unread bands together can add to a score."""
        return np.bincount(self.query, weights=self.unread(), minlength=self.n)

    def unread(self) -> np.ndarray:
        """Per line, what its unread bands can add."""
        padded = np.concatenate([self.gain, np.zeros((len(self.gain), 1))], axis=1)
        return padded[np.arange(len(padded)), self.read]

    def _before(self, values: np.ndarray) -> np.ndarray:
        """Sums of the segments of the same query that stand in front."""
        total = np.concatenate([[0.0], np.cumsum(values)])
        return total[:-1] - np.repeat(total[self.first[:-1]], np.diff(self.first))

    def _until(self, wanted: np.ndarray) -> np.ndarray:
        """Bands to have read per line, if these segments are."""
        upto = np.zeros(len(self.term), np.int64)
        np.maximum.at(upto, self.line[wanted], self.band[wanted] + 1)
        return np.maximum(upto, self.read)

    def first_share(self, share: float) -> np.ndarray:
        total = np.bincount(self.query, weights=self.held, minlength=self.n)
        return self._until(self._before(self.entries) < np.repeat(total * share, np.diff(self.first)))

    def enough_for(self, score: np.ndarray) -> np.ndarray:
        """Bands after which the rest of a query is less than ``score``; all of them if it is not positive."""
        whole = np.bincount(self.query, weights=self.gain[:, 0], minlength=self.n)
        left = np.repeat(whole, np.diff(self.first)) - self._before(self.drop)
        return self._until((left >= np.repeat(score, np.diff(self.first)) - _SLACK) | np.repeat(score <= 0, np.diff(self.first)))

    def add(self, scores: np.ndarray, upto: np.ndarray) -> int:
        """Read on to ``upto`` bands per line into ``scores`` (queries x rows); the entries read."""
        lo, hi = (self.lists.starts[self.term * BANDS + x] for x in (self.read, upto))  # BANDS: all, as the next term begins there
        self.read, spans = upto, hi - lo
        flat, a, ends = scores.reshape(-1), 0, np.cumsum(spans)
        while a < len(spans):  # a bounded number of entries at a time
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _ENTRIES, "right")))
            some = spans[a:b]
            at = np.repeat(lo[a:b] - (np.cumsum(some) - some), some) + np.arange(some.sum())
            cell = np.repeat(self.query[a:b] * self.lists.rows, some) + self.lists.owner[at]
            value = np.repeat(self.weight[a:b], some) * self.lists.weight[at]
            if len(cell) * 4 > len(flat):
                flat += np.bincount(cell, weights=value, minlength=len(flat))
            else:
                np.add.at(flat, cell, value)
            a = b
        return int(spans.sum())


    def full(self, query: np.ndarray, row: np.ndarray, partial: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whole scores of rows whose read entries add up to ``partial``, and the probes per query."""
        first = np.searchsorted(self.query, np.arange(self.n + 1))
        lines = np.diff(first)[query]
        out, a, ends = partial.copy(), 0, np.cumsum(lines)
        while a < len(query):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _ENTRIES, "right")))
            n = lines[a:b]
            pair = np.repeat(np.arange(a, b), n)
            line = np.repeat(first[query[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out += np.bincount(pair, weights=self.missing_weight(row[pair], line), minlength=len(out))
            a = b
        return out, np.bincount(query, weights=lines, minlength=self.n)

    def missing_weight(self, row: np.ndarray, line: np.ndarray) -> np.ndarray:
        """What a query term adds to a row's score, 0 if the entry has been read already."""
        weight = self.lists.probe(row, self.term[line])
        fresh = (weight != 0) & (_band(np.where(weight == 0, 1.0, weight)) >= self.read[line])
        return np.where(fresh, weight * self.weight[line], 0.0)


def _kth(query: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th best score per query, minus infinity for a query with fewer."""
    order = np.lexsort((-score, query))
    first = np.searchsorted(query[order], np.arange(n + 1))
    at = first[:-1] + k - 1
    held = at < first[1:]
    out = np.full(n, -np.inf)
    out[held] = score[order][at[held]]
    return out


def search_block(lists: Lists, lengths: np.ndarray, terms: np.ndarray, weights: np.ndarray, least: np.ndarray,
                 k: int) -> Iterator[tuple]:
    """Chunks of ``(start, query, row, score, entries held, entries read)``: all rows that can be among the k best of a query.

    A row whose score is below ``least`` of its query, or which has no common term,
    may be left out.  Each chunk begins with the number of its first query; the last two
    have a number per query of the chunk.
    """
    ends = np.cumsum(lengths)
    step = max(1, _CELLS // max(1, lists.rows))
    for start in range(0, len(lengths), step):
        stop = min(len(lengths), start + step)
        own = slice(ends[start] - lengths[start], ends[stop - 1])
        yield (start, *_search_some(_Asked(lists, lengths[start:stop], terms[own], weights[own]), least[start:stop], k))


def _search_some(asked: _Asked, least: np.ndarray, k: int):
    lists, n = asked.lists, asked.n
    scores = np.zeros((n, lists.rows))
    held = np.bincount(asked.query, weights=asked.held, minlength=n)
    # a block whose heaviest entries cannot reach the score is left at once
    hopeful = asked.rest() >= least - _SLACK
    hope = hopeful[asked.query]
    upto = np.where(hope, asked.first_share(_FIRST), 0)
    read = np.zeros(n)

    def go(upto: np.ndarray) -> None:
        nonlocal read
        upto = np.where(hope, upto, 0)
        spans = asked.lists.starts[asked.term * BANDS + upto] - asked.lists.starts[asked.term * BANDS + asked.read]
        read = read + np.bincount(asked.query, weights=spans, minlength=n)
        asked.add(scores, upto)

    go(upto)
    # the rows that lead so far are scored in full: their k-th best is a score that hits are known to reach
    lines = np.bincount(asked.query, minlength=n)
    most = np.where(np.isfinite(least), 0, np.clip(_FIRST * held / np.maximum(lines, 1), k, _LEADING * k)).astype(np.int64)
    leading = min(_LEADING * k, lists.rows)
    row = np.argpartition(-scores, leading - 1, axis=1)[:, :leading]
    row = np.take_along_axis(row, np.argsort(-np.take_along_axis(scores, row, 1), axis=1), 1)
    query, row = np.repeat(np.arange(n), leading), row.ravel()
    some = hopeful[query] & (scores[query, row] > 0) & (np.tile(np.arange(leading), n) < most[query])
    query, row = query[some], row[some]
    full, probes = asked.full(query, row, scores[query, row])
    read += probes
    score = np.maximum(least, _kth(query, full, n, k))
    go(asked.enough_for(np.where(np.isfinite(score), score, 0.0) * _REST))
    # where many rows are left to probe, reading the rest is less work
    rows_left = ((scores > 0) & (scores + asked.rest()[:, None] >= score[:, None] - _SLACK)).sum(1)
    unread = np.bincount(asked.query, weights=asked.held, minlength=n) - np.bincount(
        asked.query, weights=lists.starts[asked.term * BANDS + asked.read] - lists.starts[asked.term * BANDS], minlength=n)
    whole = rows_left * np.bincount(asked.query, weights=asked.unread() > 0, minlength=n) * _PROBED > unread
    go(np.where(whole[asked.query], BANDS, asked.read))
    rest = np.where(hopeful, asked.rest(), -np.inf)
    query, row = np.nonzero((scores > 0) & (scores + rest[:, None] >= score[:, None] - _SLACK))
    value = scores[query, row]
    # probe the missing terms of every query, heaviest first
    missing = np.where(hope, asked.unread(), 0.0)
    order = np.lexsort((-missing, asked.query))
    first = np.searchsorted(asked.query[order], np.arange(n + 1))
    rounds = int((missing > 0).sum() and np.bincount(asked.query, weights=missing > 0, minlength=n).max())
    for turn in range(rounds):
        if not len(query):
            break
        at = first[query] + turn
        line = order[np.minimum(at, max(len(order) - 1, 0))]
        can = (at < first[query + 1]) & (missing[line] > 0)
        for a in range(0, len(query), _ENTRIES):
            some = np.flatnonzero(can[a:a + _ENTRIES]) + a
            value[some] += asked.missing_weight(row[some], line[some])
        read += np.bincount(query, weights=can, minlength=n)
        turns = first[:-1] + turn
        used = (turns < first[1:])
        rest[used] -= missing[order[np.minimum(turns, max(len(order) - 1, 0))]][used]
        if turn & (turn + 1) == 0 or turn % 8 == 0:  # the score of the k-th best rises as terms are found
            score = np.maximum(score, _kth(query, value, n, k))
        stays = value + np.maximum(rest, 0)[query] >= score[query] - _SLACK
        query, row, value = query[stays], row[stays], value[stays]
    return query, row, value, held, read


def _lists_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths, terms, weights = B.sparse_parts(table)
    return lengths, terms.astype(np.int64), weights.astype(np.float64)


def _multiplied(corpus: tuple, queries: tuple, least: np.ndarray, k: int, counting: bool) -> Iterator[tuple]:
    """``search_products`` with the entries held per query, all of which count as read."""
    none = np.zeros(0, np.int64)
    if counting:
        lengths, terms, _ = queries
        count = np.bincount(corpus[1], minlength=int(terms.max(initial=0)) + 1)
        held = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=count[terms], minlength=len(lengths))
        yield 0, none, none, np.zeros(0), held, held
    for start, query, row, score in M.search_products(corpus, queries, least, k):
        yield start, query, row, score, none, none


def _best_in_block(k: int, query_id: str, doc_id: str, schema: pa.Schema, counting: bool, many: bool):
    """The k best rows of a block for each query, with rank 0 for what was read if that is counted.

    Blocks of many queries come from ``_block_of``, which has looked for repeats and sorted the rows.
    """
    def run(key, queries: pa.Table, corpus: pa.Table) -> pa.Table:
        if not many:
            B.check_unique(queries, query_id)
            B.check_unique(corpus, doc_id)
        if queries.num_rows == 0 or corpus.num_rows == 0:
            return schema.empty_table()
        if many:
            found = _multiplied(_lists_of(corpus), _lists_of(queries), np.full(queries.num_rows, -np.inf), k, counting)
        else:
            corpus = corpus.sort_by(doc_id)
            least = queries.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
            least = np.where(np.isnan(least), -np.inf, least)
            found = search_block(Lists(*_lists_of(corpus)), *_lists_of(queries), least, k)
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), *[np.zeros(0, np.int64)] * 3)]
        for start, query, row, score, held, read in found:
            order = np.lexsort((row, -np.round(score, 9), query))  # ties go to the smaller id
            query, row, score = query[order], row[order], score[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
            kept = rank <= k
            parts.append((query[kept] + start, row[kept], score[kept], rank[kept], np.zeros(kept.sum(), np.int64), np.zeros(kept.sum(), np.int64)))
            if counting:
                some = np.arange(len(held))
                parts.append((some + start, np.full(len(some), -1), np.zeros(len(some)), np.zeros(len(some), np.int64), held.astype(np.int64), read.astype(np.int64)))
        query, row, score, rank, held, read = (np.concatenate(x) for x in zip(*parts))
        found = pa.array(np.where(row < 0, 0, row), mask=row < 0)
        return pa.table({query_id: queries.column(query_id).take(pa.array(query)), "rank": rank.astype(np.int32), doc_id: corpus.column(doc_id).take(found),
                         "score": score, "held": held, "read": read}).cast(schema)
    return run


def _heaviest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task the heaviest entry of every term, with its block."""
    best: dict[int, tuple[float, int]] = {}
    for batch in batches:
        lengths, terms, weights = _lists_of(pa.Table.from_batches([batch]))
        block = np.repeat(batch.column(batch.schema.get_field_index("_db")).to_numpy(), lengths)
        order = np.lexsort((block, -weights, terms))
        first = order[np.flatnonzero(np.diff(terms[order], prepend=-1))]
        for t, w, b in zip(terms[first].tolist(), weights[first].tolist(), block[first].tolist()):
            best[t] = max(best.get(t, (0.0, 0)), (w, -b))
    yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([w for w, _ in best.values()], pa.float64()),
                                      pa.array([-b for _, b in best.values()], pa.int32())], ["term", "weight", "_db"])


def _at_home(top: np.ndarray, block: np.ndarray):
    """Queries with the blocks that hold the heaviest entries of their strongest terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, weights = _lists_of(pa.Table.from_batches([batch]))
            gain, ends, homes = weights * top[terms], np.cumsum(lengths), []
            for a, b in zip((ends - lengths).tolist(), ends.tolist()):
                strongest = block[terms[a:b][np.argsort(-gain[a:b], kind="stable")]]
                homes.append(list(dict.fromkeys(strongest[strongest >= 0].tolist()))[:HOMES])
            features = batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), features.field("indices").cast(pa.list_(pa.int32())), features.field("values").cast(pa.list_(pa.float64())),
                 pa.array(homes, pa.list_(pa.int32()))], [batch.schema.names[0], "indices", "values", "_homes"])
    return run


def _as_lists(queries: DataFrame, query_id: str) -> DataFrame:
    """``(query_id, indices, values)`` of sparse vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), features.field("indices").cast(pa.list_(pa.int32())), features.field("values").cast(pa.list_(pa.float64()))],
                [batch.schema.names[0], "indices", "values"])

    return queries.select(query_id, "features").mapInArrow(run, T.StructType(
        [queries.schema[query_id], *T.StructType.fromDDL("indices array<int>, values array<double>").fields]))


def _block_of(id_col: str):
    """The rows of a task, sorted by id, in one row; in a few where they hold more entries than expected."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            table = pa.Table.from_batches(held).sort_by(id_col)
            B.check_unique(table, id_col)
            for a, b in M.pieces(B.sparse_parts(table)[0], _PACKED):
                out, part = pa.BufferOutputStream(), table.slice(a, b - a)
                with pa.ipc.new_stream(out, part.schema) as stream:
                    stream.write_table(part)
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["block"])
    return run


def _dealt(rows: DataFrame, id_col: str, blocks: int) -> DataFrame:
    """The rows dealt to blocks by their id, each block packed in its own partition; written to the shared checkpoint."""
    return _as_lists(rows, id_col).repartition(blocks, id_col).mapInArrow(_block_of(id_col), "block binary").checkpoint()


def _block_by_block(queries: DataFrame, corpus: DataFrame, meet, schema: T.StructType) -> DataFrame:
    """``meet(key, queries, corpus)`` for every pair of packed blocks: a task reads its two from the checkpoint, there is no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in zip(*batch.columns):
                yield from meet(None, *(pa.ipc.open_stream(block.as_buffer()).read_all() for block in pair)).combine_chunks().to_batches()

    # a row is a whole block here, so this product has a row per pair of blocks
    pairs = queries.hint("shuffle_replicate_nl").crossJoin(corpus.withColumnRenamed("block", "other"))
    return pairs.mapInArrow(run, schema)


def _sent_home(queries: DataFrame, placed: DataFrame, query_id: str, width: int) -> DataFrame:
    """The same with ``_homes``; the driver reads one row per term (the heaviest entry), at most ``width``."""
    top, block = np.zeros(width), np.full(width, -1)
    heaviest = (placed.select("features", "_db").mapInArrow(_heaviest, "term int, weight double, _db int").groupBy("term")
                .agg(F.max("weight").alias("weight"), F.max_by("_db", "weight").alias("_db")).toArrow())
    top[heaviest["term"].to_numpy()], block[heaviest["term"].to_numpy()] = heaviest["weight"].to_numpy(), heaviest["_db"].to_numpy()
    return queries.select(query_id, "features").mapInArrow(_at_home(top, block), T.StructType(
        [queries.schema[query_id], *T.StructType.fromDDL("indices array<int>, values array<double>, _homes array<int>").fields]))


def impact_top_k(queries: DataFrame, corpus: DataFrame, k: int, query_id: str, doc_id: str, query_size: B.Size, corpus_size: B.Size,
                 width: int, limits: B.Limits | None = None, counting: bool = False) -> DataFrame:
    """``(query_id, rank, doc_id, score)`` as ``blocks.block_top_k`` gives them, for a corpus of many blocks.

    With ``counting`` the result is ``(held, read)``: entries that a reading of all
    lists of all queries would meet, and entries read or probed.
    """
    spark = queries.sparkSession
    ensure_checkpoint_dir(spark)
    many = query_size.rows >= M.MANY
    n_db, n_qb = corpus_size.blocks(limits), query_size.blocks(limits)
    schema = T.StructType([queries.schema[query_id], T.StructField("rank", T.IntegerType()), corpus.schema[doc_id],
                           *T.StructType.fromDDL("score double, held long, read long").fields])
    best = _best_in_block(k, query_id, doc_id, to_arrow_schema(schema), counting, many)
    order = [F.desc(F.round("score", 9)), F.asc(doc_id)]
    if many:
        # a text has far fewer entries than its length allows
        n_qb = max(-(-n_qb // 2), min(-(-4 * spark.sparkContext.defaultParallelism // n_db), query_size.rows // M.BLOCK_QUERIES))
        asked, placed = queries, corpus
        found = _block_by_block(_dealt(queries, query_id, n_qb), _dealt(corpus, doc_id, n_db), best, schema)
    else:
        deal = lambda who, n: F.pmod(F.xxhash64(who), F.lit(n)).cast("int")
        placed = corpus.select(doc_id, "features").withColumn("_db", deal(doc_id, n_db)).checkpoint()
        asked = _sent_home(queries, placed, query_id, width).withColumn("_qb", deal(query_id, n_qb)).checkpoint()
        tasks = min(n_qb * n_db, max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        copies = placed.withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(n_qb - 1)))).repartition(tasks, "_qb", "_db")

        def compare(sent: DataFrame) -> DataFrame:
            return (sent.select(query_id, "indices", "values", "least", "_qb", "_db").repartition(tasks, "_qb", "_db").groupBy("_qb", "_db")
                    .cogroup(copies.groupBy("_qb", "_db")).applyInArrow(best, schema))

        unknown, every = F.lit(None).cast("double"), F.sequence(F.lit(0), F.lit(n_db - 1))
        first = compare(asked.withColumn("least", unknown).withColumn("_db", F.explode("_homes"))).checkpoint()
        known = head_per_group(first.where("rank > 0"), [query_id], order, k, "_n")
        least = known.where(F.col("_n") == k).select(F.col(query_id).alias("_of"), F.col("score").alias("least"))
        others = asked.join(least, F.col(query_id).eqNullSafe(F.col("_of")), "left").withColumn("_db", F.explode(
            F.array_except(every, F.coalesce("_homes", F.array().cast("array<int>")))))
        found = first.unionByName(compare(others))
    if counting:
        return found.where("rank = 0").agg(F.sum("held").alias("held"), F.sum("read").alias("read"))
    # rows without a common term score zero: the smallest ids fill up to k
    smallest = placed.orderBy(doc_id).limit(k).agg(F.collect_list(doc_id).alias("ids")).scalar()
    filling = asked.select(query_id, F.explode(smallest).alias(doc_id), F.lit(0.0).alias("score"))
    hits = found.where("rank > 0").select(query_id, doc_id, "score").unionByName(filling)
    hits = hits.groupBy(query_id, doc_id).agg(F.max("score").alias("score"))
    return head_per_group(hits, [query_id], order, k, "rank").select(query_id, "rank", doc_id, "score")
