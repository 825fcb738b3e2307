"""A tree of balls over unit vectors that grows with the rows, for exact search and exact neighbourhoods.

Every node with too many rows is split around some of its own rows, each row going
to the nearest of these pivots; so the number of leaves follows the number of rows.
A node has a pivot and a radius, the largest distance of one of its rows.  Distances
are those between the unit vectors, where ``score = 1 - distance ** 2 / 2``, and by
the triangle inequality no row of a ball is nearer to a point than the pivot's
distance less the radius.

Nodes live in a frame; a level's pivots come to the driver only while they are
few (``PIVOT_VALUES`` numbers), beyond that each node's rows meet their own pivots in
Arrow groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from caselight.operators import blocks as B
from caselight.operators.ordering import head_per_group
from caselight.session import ensure_checkpoint_dir
from caselight.shipping import ship_by_value

ship_by_value(__name__)

FANOUT = 64
DRAWN = 4                 # rows drawn per pivot
PIVOT_VALUES = 4_000_000  # numbers in the pivots of a level: 32 MB
GROUP_ROWS = 20_000
LEAF_ROWS = 2_000
SLACK = 1e-6              # distances are found from products, to about this
_DEEPEST = 9              # levels, 65 ** 9 nodes
_CELLS = 4_000_000        # scores held at once inside a task
_CHUNK_ROWS = 2_000       # rows of neighbouring leaves multiplied together
_EXACT = 200_000          # rows multiplied again in double precision at once
_SENT = 10_000            # rows sent on at once
_NUMBERS = T.ArrayType(T.DoubleType())


@dataclass(frozen=True)
class Tree:
    """Rows with their leaf, and the nodes ``(node, parent, pivot, radius, n, inner)``; the root, 0, has no pivot."""

    rows: DataFrame
    nodes: DataFrame
    depth: int

    def children(self) -> DataFrame:
        return self.nodes.where("parent IS NOT NULL")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between every row of ``a`` and every row of ``b``; rows are unit or zero vectors."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def unit(column) -> np.ndarray:
    return B.dense_rows(pa.table({"v": column}), "v")


def _nearest(vectors: np.ndarray, node: np.ndarray, pivots: dict[int, tuple[np.ndarray, np.ndarray]], away: np.ndarray) -> None:
    """Move rows to the nearest child of their node, in place."""
    order = np.argsort(node, kind="stable")
    names, first = np.unique(node[order], return_index=True)
    for name, rows in zip(names.tolist(), np.split(order, first[1:])):
        if name in pivots:
            matrix, numbers = pivots[name]
            gaps = distances(vectors[rows], matrix)
            best = gaps.argmin(axis=1)
            node[rows], away[rows] = name * (FANOUT + 1) + numbers[best], gaps[np.arange(len(rows)), best]


def _moved(vector_col: str, pivots: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            node, away = batch.column(at["node"]).to_numpy().copy(), batch.column(at["away"]).to_numpy().copy()
            if len(node):
                _nearest(unit(batch.column(at[vector_col])), node, pivots, away)
            columns = list(batch.columns)
            columns[at["node"]], columns[at["away"]] = pa.array(node), pa.array(away)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
    return run


def _spread(table):
    """Of the rows drawn from a node, at most ``DRAWN * FANOUT``, those that lie apart: each next one is the farthest from all before."""
    table = table.sort_by("child")
    vectors, wanted = unit(table.column("pivot")), table.column("wanted")[0].as_py()
    chosen = [0]
    gap = distances(vectors, vectors[:1])[:, 0]
    while len(chosen) < wanted and gap.max() > SLACK:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(vectors, vectors[chosen[-1:]])[:, 0])
    out = table.take(pa.array(chosen))
    return pa.table({"node": out.column("node"), "child": pa.array(range(1, len(chosen) + 1), pa.int32()), "pivot": out.column("pivot"), "n": out.column("n")})


def _pivots_of(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    if not table.num_rows:
        return {}
    table = table.sort_by([("node", "ascending"), ("child", "ascending")])
    node, child, matrix = table.column("node").to_numpy(), table.column("child").to_numpy().astype(np.int64), unit(table.column("pivot"))
    names, first = np.unique(node, return_index=True)
    return {n: x for n, x in zip(names.tolist(), zip(np.split(matrix, first[1:]), np.split(child, first[1:])))}


def grow(points: DataFrame, id_col: str, vector_col: str, leaf_rows: int = LEAF_ROWS) -> Tree:
    """The tree over all rows of ``points``; ``node`` and ``away`` are added to them.

    A node is split while it has more than ``leaf_rows`` rows that are not all the
    same.  Every level is written to the shared checkpoint.
    """
    ensure_checkpoint_dir(points.sparkSession)
    rows = points.withColumn("node", F.lit(0).cast("long")).withColumn("away", F.lit(2.0))
    counted = rows.agg(F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast(_NUMBERS).alias("pivot"),
                       F.lit(2.0).alias("radius"), F.count(F.lit(1)).alias("n"))
    inner = (F.col("n") > leaf_rows) & (F.col("radius") > SLACK)
    level = counted.withColumn("inner", inner).checkpoint()
    nodes, depth = level, 0
    while depth < _DEEPEST:
        split = level.where("inner").select("node", "n")
        if split.isEmpty():
            return Tree(rows, nodes, depth)
        depth += 1
        wanted = F.least(F.lit(FANOUT), 2 * F.ceil(F.col("n") / leaf_rows))
        own = rows.join(split, "node").select("node", "n", F.col(id_col).alias("_id"), F.col(vector_col).cast(_NUMBERS).alias("pivot"))
        drawn = head_per_group(own, ["node"], [F.xxhash64("_id", F.lit(depth)), F.col("_id")], DRAWN * FANOUT, "child").where(
            F.col("child") <= DRAWN * wanted).select("node", "child", "pivot", "n", wanted.cast("int").alias("wanted"))
        pivots = drawn.groupBy("node").applyInArrow(_spread, "node long, child int, pivot array<double>, n long").checkpoint()
        numbers = pivots.agg(F.sum(F.size("pivot"))).first()[0]
        if numbers <= PIVOT_VALUES:
            table = _pivots_of(pivots.toArrow())  # bounded: PIVOT_VALUES numbers
            rows = rows.mapInArrow(_moved(vector_col, table), rows.schema).checkpoint()
        else:
            rows = _moved_in_groups(rows, pivots, id_col, vector_col).checkpoint()
        stats = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))
        level = (pivots.select((F.col("node") * (FANOUT + 1) + F.col("child")).alias("node"), F.col("node").alias("parent"), "pivot")
                 .join(stats, "node").select("node", "parent", "pivot", "radius", "n").withColumn("inner", inner).checkpoint())
        nodes = nodes.unionByName(level)
    # the deepest nodes stay leaves, whatever their size
    deepest = level.select("node").withColumn("_last", F.lit(True))
    last = nodes.join(deepest, "node", "left").withColumn("inner", F.col("inner") & F.col("_last").isNull()).drop("_last")
    return Tree(rows, last.checkpoint(), depth)


def _moved_in_groups(rows: DataFrame, pivots: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """The same where a level has too many pivots for one task: a node's rows meet its pivots in groups of ``GROUP_ROWS``."""
    groups = pivots.groupBy("node").agg(F.ceil(F.max("n") / GROUP_ROWS).cast("int").alias("_groups"))
    going = rows.join(groups, "node").withColumn("_group", F.pmod(F.xxhash64(id_col), F.col("_groups")).cast("int")).drop("_groups")
    table = pivots.join(groups, "node").select("node", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)).alias("_group"), "child", "pivot")

    def run(key, here: pa.Table, there: pa.Table) -> pa.Table:
        if not here.num_rows:
            return rows_schema.empty_table()
        moved = _moved(vector_col, _pivots_of(there))(here.select(rows_schema.names).combine_chunks().to_batches())
        return pa.Table.from_batches(list(moved)).cast(rows_schema)

    rows_schema = to_arrow_schema(rows.schema)
    moved = going.groupBy("node", "_group").cogroup(table.groupBy("node", "_group")).applyInArrow(run, rows.schema)
    return moved.unionByName(rows.join(groups, "node", "left_anti").select(*rows.columns))


def small(frame: DataFrame, vector_col: str = "pivot") -> DataFrame:
    """The frame, to be broadcast if its vectors have no more than ``PIVOT_VALUES`` numbers in all."""
    numbers = frame.agg(F.coalesce(F.sum(F.size(vector_col)), F.lit(0))).first()[0]
    return F.broadcast(frame) if numbers <= PIVOT_VALUES else frame


# --- pairs of leaves ------------------------------------------------------------------------------------

def _pairs_within(eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = unit(batch.column(2)), unit(batch.column(3))
            gap = np.sqrt(np.maximum(((a - b) ** 2).sum(1), 0.0))
            reach = batch.column(4).to_numpy() + batch.column(5).to_numpy() + eps + SLACK
            near = (gap <= reach) | (batch.column(0).to_numpy() == batch.column(1).to_numpy())
            kept = batch.filter(pa.array(near))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])
    return run


def close_leaves(tree: Tree, eps: float) -> DataFrame:
    """``(a, b)``, a <= b: all pairs of leaves that can hold rows within ``eps`` of each other.

    Pairs of nodes are followed down from the root, level by level, and dropped as
    soon as their balls are further apart.
    """
    spark = tree.rows.sparkSession
    kids = tree.children().select(F.col("parent").alias("of"), "node", "pivot", "radius").unionByName(
        tree.nodes.where("NOT inner AND parent IS NOT NULL").select(F.col("node").alias("of"), "node", "pivot", "radius"))
    kids = small(kids.checkpoint())
    pairs = spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for _ in range(tree.depth):
        left = pairs.join(kids.select(F.col("of").alias("a"), F.col("node").alias("_a"), F.col("pivot").alias("_pa"), F.col("radius").alias("_ra")), "a")
        both = left.join(kids.select(F.col("of").alias("b"), F.col("node").alias("_b"), F.col("pivot").alias("_pb"), F.col("radius").alias("_rb")), "b")
        both = both.where("a < b OR _a <= _b").select("_a", "_b", "_pa", "_pb", "_ra", "_rb")
        found = both.mapInArrow(_pairs_within(eps), "a long, b long")
        pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).checkpoint()
    return pairs


# --- search ---------------------------------------------------------------------------------------------

def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a query and a child node that can still hold a hit, with the best score possible there and the pivot's own."""
    for batch in batches:
        if not len(batch):
            continue
        at = {name: i for i, name in enumerate(batch.schema.names)}
        gap = np.sqrt(np.maximum(((unit(batch.column(at["features"])) - unit(batch.column(at["pivot"]))) ** 2).sum(1), 0.0))
        least = batch.column(at["least"]).to_numpy(zero_copy_only=False).astype(np.float64)
        bound = 1.0 - np.maximum(gap - batch.column(at["radius"]).to_numpy() - SLACK, 0.0) ** 2 / 2
        can = np.isnan(least) | (bound >= least - 1e-8)
        out = [*[batch.column(i) for i in (0, 1)], batch.column(at["least"]), batch.column(at["child"]), batch.column(at["below"]), pa.array(bound), pa.array(1 - gap ** 2 / 2)]
        yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[:2], "least", "node", "inner", "bound", "near"]).filter(pa.array(can))


def _descend(asked: DataFrame, tree: Tree, kids: DataFrame, query_id: str, greedy: bool) -> DataFrame:
    """``(query, features, least, node, bound)``: the leaf that looks nearest, or all that can reach ``least``."""
    schema = T.StructType([asked.schema[query_id], asked.schema["features"], *T.StructType.fromDDL(
        "least double, node long, inner boolean, bound double, near double").fields])
    at = asked.withColumn("node", F.lit(0).cast("long"))
    found = None
    for _ in range(tree.depth):
        pairs = at.select(query_id, "features", "least", F.col("node").alias("_of")).join(kids, "_of")
        steps = pairs.select(query_id, "features", "least", "child", "below", "pivot", "radius").mapInArrow(_bounds, schema)
        if greedy:
            steps = head_per_group(steps, [query_id], [F.desc("near"), F.asc("node")], 1)
        steps = steps.checkpoint()
        leaves = steps.where("NOT inner").select(query_id, "features", "least", "node", "bound")
        found = leaves if found is None else found.unionByName(leaves)
        at = steps.where("inner").select(query_id, "features", "least", "node")
    return found


def cut(tree: Tree, most: int | None = None) -> Tree:
    """The tree down to its highest nodes of at most ``most`` rows (``GROUP_ROWS``), or leaves; rows keep their own leaf in ``leaf``."""
    below = F.col("inner") & (F.col("n") > (GROUP_ROWS if most is None else most))
    nodes = tree.nodes.withColumn("inner", below)
    tops = nodes.where("parent IS NULL").select("node", "inner")
    ends = tops.where("NOT inner").select("node")
    for _ in range(tree.depth):
        tops = nodes.join(tops.where("inner").select(F.col("node").alias("parent")), "parent").select("node", "inner")
        ends = ends.unionByName(tops.where("NOT inner").select("node"))
    kept = nodes.join(ends.withColumn("_end", F.lit(True)), "node", "left")
    going = ends.select(F.col("node").alias("leaf"), "node")
    found = going
    for _ in range(tree.depth):
        going = tree.nodes.select(F.col("node").alias("_kid"), F.col("parent").alias("leaf")).join(going, "leaf").select(F.col("_kid").alias("leaf"), "node")
        found = found.unionByName(going)
    rows = tree.rows.withColumnRenamed("node", "leaf").join(found, "leaf").checkpoint()
    return Tree(rows, kept.where("inner OR _end").drop("_end").checkpoint(), tree.depth)


def compare(sent: DataFrame, tree: Tree, k: int, query_id: str, doc_id: str) -> DataFrame:
    """The k best rows of every query in each node it is sent to ``(query, features, least, node)``, in groups of bounded size."""
    spark = sent.sparkSession
    blocks = lambda n: F.ceil(F.col(n) / GROUP_ROWS).cast("int")
    plan = sent.groupBy("node").agg(F.count(F.lit(1)).alias("_asked")).join(tree.nodes.select("node", "n"), "node").select(
        "node", blocks("_asked").alias("_nq"), blocks("n").alias("_nd")).checkpoint()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda who, n: F.pmod(F.xxhash64(who), F.col(n)).cast("int")
    keys = ("node", "_qb", "_db")
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = sent.join(F.broadcast(plan), "node").withColumn("_qb", deal(query_id, "_nq")).withColumn("_db", every("_nd")).select(query_id, "features", "least", *keys)
    right = tree.rows.join(F.broadcast(plan), "node").withColumn("_db", deal(doc_id, "_nd")).withColumn("_qb", every("_nq")).select(doc_id, "features", "leaf", *keys)
    schema = T.StructType([sent.schema[query_id], tree.rows.schema[doc_id], T.StructField("score", T.DoubleType())])
    return left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(
        _best_in_node(k, query_id, doc_id, to_arrow_schema(schema)), schema)


def _best_in_node(k: int, query_id: str, doc_id: str, schema: pa.Schema):
    def run(key, queries: pa.Table, corpus: pa.Table) -> pa.Table:
        if not queries.num_rows or not corpus.num_rows:
            return schema.empty_table()
        corpus = corpus.sort_by(doc_id)
        least = queries.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
        query, row, score = search_leaves(unit(queries.column("features")), unit(corpus.column("features")), corpus.column("leaf").to_numpy(),
                                          np.where(np.isnan(least), -np.inf, least), k)
        return pa.table({query_id: queries.column(query_id).take(pa.array(query)), doc_id: corpus.column(doc_id).take(pa.array(row)),
                         "score": score}).cast(schema)
    return run


def single_error(width: int) -> float:
    """More than a product of two unit vectors in single precision can be wrong by."""
    return (width + 8) * 2.0 ** -23


def balls_of(vectors: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """Of rows sorted by leaf: where leaves start, which begin a chunk (leaves multiplied together), their means and radii."""
    starts = np.append(np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])), len(leaf))
    centre = np.add.reduceat(vectors, starts[:-1]) / np.diff(starts)[:, None]
    owner = np.repeat(np.arange(len(centre)), np.diff(starts))
    radius = np.zeros(len(centre))
    np.maximum.at(radius, owner, np.sqrt(((vectors - centre[owner]) ** 2).sum(1)))
    chunks = [0]
    for at in range(1, len(centre) + 1):
        if at == len(centre) or starts[at + 1] - starts[chunks[-1]] > _CHUNK_ROWS:
            chunks.append(at)
    return starts, chunks, centre, radius


def meetings(can: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """``(rows, first, last)``: which rows are to meet which range of others, by leaf; all leaves of a chunk at once where most are wanted."""
    wanted = np.flatnonzero(can.any(1))
    if can.sum() * 4 > len(wanted) * can.shape[1]:
        yield wanted, starts[0], starts[-1]
    elif len(wanted):
        for at in np.flatnonzero(can.any(0)):
            yield np.flatnonzero(can[:, at]), starts[at], starts[at + 1]


def search_leaves(asked: np.ndarray, rows: np.ndarray, leaf: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, row, score)``: the k best rows of every query whose score is not below ``least``; ties go to the earlier row.

    Leaves are left out by the ball around their mean.  Products are made in single precision;
    what they show to be within their error of the k-th best score is multiplied in double precision.
    """
    # behind k copies with smaller ids a row is among the k best of nothing
    copy = np.unique(np.ascontiguousarray(rows + 0.0).view(np.dtype((np.void, rows.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel() if rows.shape[1] else np.zeros(len(rows), int)
    order = np.argsort(copy, kind="stable")
    first = np.searchsorted(copy[order], np.arange(copy.max() + 1))
    kept = order[np.arange(len(order)) - first[copy[order]] < k]
    kept = kept[np.lexsort((kept, leaf[kept]))]
    vectors = rows[kept]
    starts, chunks, centre, radius = balls_of(vectors, leaf[kept])
    small, slack = vectors.astype(np.float32), single_error(rows.shape[1])
    step = max(1, _CELLS // max(_CHUNK_ROWS, int(np.diff(starts).max()), len(centre)))
    out = []
    for a in range(0, len(asked), step):
        some = _Best(asked[a:a + step], vectors, kept, least[a:a + step], k, small, slack)
        bound = 1.0 - np.maximum(distances(some.asked, centre) - radius - SLACK, 0.0) ** 2 / 2
        near, new = bound.argmax(1), np.flatnonzero(~np.isfinite(some.least))
        new = new[np.argsort(near[new], kind="stable")]
        for part in np.split(new, np.flatnonzero(np.diff(near[new])) + 1) if len(new) else ():  # its nearest leaf tells a query a first score
            some.meet(part, starts[near[part[0]]], starts[near[part[0]] + 1])
        for lo, hi in zip(chunks[:-1], chunks[1:]):
            for query, first_row, last_row in meetings(bound[:, lo:hi] >= some.least[:, None] - 1e-8, starts[lo:hi + 1]):
                some.meet(query, first_row, last_row)
        out.append((some.query + a, kept[some.row], some.score))
    return tuple(np.concatenate(x) for x in zip(*out))


class _Best:
    """The k best rows so far of some queries; ``place`` is where a row stands among equals."""

    def __init__(self, asked: np.ndarray, vectors: np.ndarray, place: np.ndarray, least: np.ndarray, k: int, small: np.ndarray, slack: float):
        self.asked, self.vectors, self.place, self.least, self.k = asked, vectors, place, least.copy(), k
        self.low, self.small, self.slack = asked.astype(np.float32), small, slack
        self.query, self.row, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, query: np.ndarray, lo: int, hi: int) -> None:
        """Let queries see the rows from ``lo`` to ``hi``."""
        products = self.low[query] @ self.small[lo:hi].T
        floor = self.least[query] - self.slack - 1e-9
        new = np.flatnonzero(~np.isfinite(floor))
        if len(new) and hi - lo > self.k:  # the k-th best here
            floor[new] = np.partition(products[new], hi - lo - self.k, axis=1)[:, hi - lo - self.k].astype(np.float64) - 2 * self.slack - 1e-9
        found = np.flatnonzero((products >= floor.astype(np.float32)[:, None]).ravel())
        for a in range(0, len(found), _EXACT):
            at, row = np.divmod(found[a:a + _EXACT], hi - lo)
            self._add(query[at], row + lo)

    def _add(self, query: np.ndarray, row: np.ndarray) -> None:
        score = np.einsum("ij,ij->i", self.asked[query], self.vectors[row])
        able = score >= self.least[query] - 1e-8
        query, row, score = (np.concatenate(x) for x in ((self.query, query[able]), (self.row, row[able]), (self.score, score[able])))
        order = np.lexsort((self.place[row], -np.round(score, 9), query))
        query, row, score = query[order], row[order], score[order]
        fresh = np.append(True, (query[1:] != query[:-1]) | (row[1:] != row[:-1]))[:len(query)]  # a leaf may be met twice
        query, row, score = query[fresh], row[fresh], score[fresh]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        self.query, self.row, self.score = (x[rank < self.k] for x in (query, row, score))
        last = rank == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])


def _sent(pivots: np.ndarray, radius: np.ndarray, node: np.ndarray, schema: pa.Schema, nearest: bool):
    """Queries with the node of the nearest pivot, or once per node that can reach their known score, other than ``node``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.slice(start, step)
                gap = distances(unit(part.column(1)), pivots)
                if nearest:
                    to, query = gap.argmin(1), np.arange(len(part))
                else:
                    least = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                    bound = 1.0 - np.maximum(gap - radius - SLACK, 0.0) ** 2 / 2
                    can = np.isnan(least)[:, None] | (bound >= np.nan_to_num(least, nan=-2.0)[:, None] - 1e-8)
                    query, to = np.nonzero(can & (node[None, :] != part.column(3).to_numpy()[:, None]))
                for a in range(0, len(query), _SENT):
                    b = slice(a, a + _SENT)
                    taken = pa.Table.from_batches([part]).take(pa.array(query[b])).select([0, 1, 2])
                    yield from taken.append_column("node", pa.array(node[to[b]])).combine_chunks().cast(schema).to_batches()
    step = max(1, _CELLS // max(1, len(node)))
    return run


def _raise_on_repeats(rows: DataFrame, id_col: str) -> None:
    if not rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError(B.REPEATED % id_col)


def nearest_top_k(queries: DataFrame, corpus: DataFrame, k: int, query_id: str, doc_id: str, corpus_size: B.Size,
                  limits: B.Limits | None = None) -> DataFrame:
    """``(query_id, rank, doc_id, score)`` as ``blocks.block_top_k`` gives them, for a corpus of many blocks.

    Every query first searches the node it falls into, then, with the k-th score from there, all nodes
    whose bound still reaches it.  A node that is searched has at most ``GROUP_ROWS`` rows or is a leaf; inside it
    a query meets only the leaves that can hold a hit.  Leaves have at most the rows of a block, or ``LEAF_ROWS``.
    """
    _raise_on_repeats(queries, query_id)
    _raise_on_repeats(corpus, doc_id)
    tree = cut(grow(corpus.select(doc_id, "features"), doc_id, "features", min(LEAF_ROWS, limits.rows if limits else B.BLOCK_ROWS)))
    asked = queries.select(query_id, "features")
    some = F.exists("features", lambda x: x != 0)
    order = [F.desc(F.round("score", 9)), F.asc(doc_id)]
    smallest = corpus.select(doc_id).orderBy(doc_id).limit(k).agg(F.collect_list(doc_id).alias("ids")).scalar()
    hits = asked.where(~some).select(query_id, F.explode(smallest).alias(doc_id), F.lit(0.0).alias("score"))  # a zero vector scores zero everywhere
    asked = asked.where(some).withColumn("least", F.lit(None).cast("double"))

    ends = tree.nodes.where("NOT inner")
    if ends.where("parent IS NULL").count():  # the root is searched in one go
        hits = hits.unionByName(compare(asked.withColumn("node", F.lit(0).cast("long")), tree, k, query_id, doc_id))
        return head_per_group(hits, [query_id], order, k, "rank").select(query_id, "rank", doc_id, "score")
    schema = T.StructType([*asked.schema.fields, T.StructField("node", T.LongType())])
    few = ends.agg(F.sum(F.size("pivot"))).first()[0] <= PIVOT_VALUES
    if few:
        table = ends.select("node", "pivot", "radius").orderBy("node").toArrow()  # bounded: PIVOT_VALUES numbers
        nodes = unit(table.column("pivot")), table.column("radius").to_numpy(), table.column("node").to_numpy()
        home = asked.mapInArrow(_sent(*nodes, to_arrow_schema(schema), True), schema).checkpoint()
    else:
        kids = small(tree.children().select(F.col("parent").alias("_of"), F.col("node").alias("child"), F.col("inner").alias("below"), "pivot", "radius").checkpoint())
        home = _descend(asked, tree, kids, query_id, greedy=True).select(query_id, "features", "least", "node").checkpoint()
    hits = hits.unionByName(compare(home, tree, k, query_id, doc_id)).checkpoint()
    best = head_per_group(hits, [query_id], order, k, "_n")
    known = best.where(F.col("_n") == k).select(F.col(query_id).alias("_who"), F.col("score").alias("_score"))
    again = (home.join(known, F.col(query_id).eqNullSafe(F.col("_who")), "left")
             .select(query_id, "features", F.col("_score").alias("least"), F.col("node").alias("_home")).checkpoint())
    if few:
        far = again.mapInArrow(_sent(*nodes, to_arrow_schema(schema), False), schema)
    else:
        seen = again.select(F.col(query_id).alias("_who"), F.col("_home").alias("_at"))
        far = _descend(again.drop("_home"), tree, kids, query_id, greedy=False).select(query_id, "features", "least", "node")
        far = far.join(seen, F.col(query_id).eqNullSafe(F.col("_who")) & (F.col("node") == F.col("_at")), "left_anti").checkpoint()
    hits = hits.unionByName(compare(far, tree, k, query_id, doc_id))
    return head_per_group(hits, [query_id], order, k, "rank").select(query_id, "rank", doc_id, "score")
