"""Nearest neighbours by cosine with a vantage-point tree per shard.

On unit vectors the Euclidean distance is a metric that falls as the cosine
rises.  Each shard of bounded size holds one tree over its distinct vectors; a
branch is left out when the triangle inequality puts it farther away than
``factor`` times the k-th best distance so far.  Factor one is exact; a smaller
one visits less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselight.llm.links import settled
from caselight.shipping import ship_by_value

ship_by_value(__name__)

SHARD_VALUES = 2_000_000  # numbers per shard: 16 MB in double precision
BLOCK_VALUES = 500_000  # numbers per block of queries
LEAF = 64
_SLACK = 1e-9  # rounding of distances; keeps factor one exact


class Tree:
    """Distinct unit vectors ordered so that each node is a stretch: first its vantage point, then the near, then the far half."""

    def __init__(self, unit: np.ndarray, seed: int = 7):
        self.unit = unit
        self.order = np.arange(len(unit))
        self.nodes: list[tuple] = []  # (start, end, radius, near node, far node, bounds of both halves)
        self.random = np.random.default_rng(seed)
        self.root = self._build(0, len(unit)) if len(unit) else -1

    def _build(self, start: int, end: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if end - start <= LEAF:
            self.nodes[at] = (start, end)
            return at
        pick = start + int(self.random.integers(end - start))
        self.order[[start, pick]] = self.order[[pick, start]]
        rest = self.order[start + 1:end]
        away = np.sqrt(np.maximum(2 - 2 * (self.unit[rest] @ self.unit[self.order[start]]), 0))
        rank = np.argsort(away, kind="stable")
        self.order[start + 1:end], away = rest[rank], away[rank]
        half = len(rest) // 2
        middle = start + 1 + half
        near, far = self._build(start + 1, middle), self._build(middle, end)
        self.nodes[at] = (start, end, away[0], away[half - 1], away[half], away[-1], near, far)
        return at

    def visit(self, query: np.ndarray, k: int, factor: float, weights: np.ndarray) -> np.ndarray:
        """Places of all vectors that may belong to the k nearest rows; ``weights`` are rows per vector, at least one."""
        found, distance = [], []
        kept: list[tuple[float, int]] = []  # the best distances so far with their rows
        limit = np.inf

        def take(places: np.ndarray, away: np.ndarray) -> None:
            nonlocal kept, limit
            found.append(places)
            distance.append(away)
            near = np.argsort(away)[:k]
            kept = sorted(kept + [(float(away[i]), int(weights[places[i]])) for i in near if away[i] <= limit])
            rows = 0
            for at, (d, n) in enumerate(kept):
                rows += n
                if rows >= k:
                    kept, limit = kept[:at + 1], d
                    break

        waiting = [(0.0, self.root)]
        while waiting:
            bound, node = waiting.pop()
            if bound > factor * limit + _SLACK:
                continue
            parts = self.nodes[node]
            if len(parts) == 2:
                places = self.order[parts[0]:parts[1]]
                take(places, np.sqrt(np.maximum(2 - 2 * (self.unit[places] @ query), 0)))
                continue
            start, _, near_low, near_high, far_low, far_high, near, far = parts
            place = self.order[start:start + 1]
            away = float(np.sqrt(max(2 - 2 * float(self.unit[place[0]] @ query), 0)))
            take(place, np.array([away]))
            sides = [(max(bound, near_low - away, away - near_high), near), (max(bound, far_low - away, away - far_high), far)]
            waiting += sorted(sides, key=lambda x: -x[0])  # the nearer side is looked at first
        places, away = np.concatenate(found), np.concatenate(distance)
        return places[away <= limit + 1e-6]


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines row by row in double precision: equal vectors get equal values wherever they stand."""
    return (vectors * query).sum(1) / (np.sqrt((vectors * vectors).sum(1)) * np.sqrt((query * query).sum()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _search(k: int, factor: float):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not len(rows) or not len(queries):
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.float64()))})
        ids, vectors = rows.column("id").to_numpy(), _matrix(rows.column("v").combine_chunks())
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (vectors[1:] != vectors[:-1]).any(1)
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(ids))
        tree = Tree(vectors[first] / np.linalg.norm(vectors[first], axis=1, keepdims=True))
        out = [[], [], []]
        asked, points = queries.column("id").to_numpy(), _matrix(queries.column("v").combine_chunks())
        weights = last - first
        for query, point in zip(asked, points):
            places = tree.visit(point / np.linalg.norm(point), k + 1, factor, weights)
            score = cosines(vectors[first[places]], point)
            # of equal vectors the k + 1 smallest ids can matter: one of them may be the query itself
            taken = np.concatenate([np.arange(first[p], min(first[p] + k + 1, last[p])) for p in places])
            score = np.repeat(score, np.minimum(weights[places], k + 1))
            other = ids[taken] != query
            near, score = ids[taken][other], score[other]
            best = np.lexsort((near, -score))[:k]
            out[0].append(np.full(len(best), query))
            out[1].append(near[best])
            out[2].append(score[best])
        return pa.table(dict(zip(names, map(np.concatenate, out))))
    return run


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
            factor: float = 1.0) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest rows with another id, ties to the smaller id.

    Both sides need integer ids.  Rows with a null id, or with a vector that is null, empty,
    all zeros, or holds a null or a non-finite number, take no part; vectors
    are compared with those of the same length.  A row that repeats an id with the same vector
    counts once; ids repeated with other vectors are kept, but never match their own id.  Other columns are
    not read.  Rows are dealt to shards by a digest, so many equal vectors spread out;
    queries go to every shard in blocks of bounded size, and only ``k`` rows per query and shard come back.
    """
    def usable(df: DataFrame) -> DataFrame:
        numbers = F.transform(vector_col, lambda x: x.cast("double"))
        fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return (df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
                .select(F.col(id_col).cast("long").alias("id"), numbers.alias("v")).where(fit).withColumn("width", F.size("v")))

    rows = settled(usable(vectors).distinct())
    asked = settled(usable(queries).distinct())
    counts = rows.groupBy("width").count().collect()  # one row per vector length
    asks = {r[0]: r[1] for r in asked.groupBy("width").count().collect()}
    shards = {r["width"]: max(1, -(-r["count"] * r["width"] // SHARD_VALUES)) for r in counts}
    blocks = {r["width"]: max(1, -(-asks.get(r["width"], 0) * r["width"] // BLOCK_VALUES)) for r in counts}
    if not counts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_shards, n_blocks = (F.element_at(F.create_map(*[F.lit(int(x)) for kv in m.items() for x in kv]), F.col("width"))
                          for m in (shards, blocks))
    shard = F.pmod(F.xxhash64("id", F.lit(4)), n_shards).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(40)), n_blocks).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    left = rows.select("id", "v", "width", shard.alias("shard"), every(n_blocks).alias("block"))
    right = (asked.where(F.col("width").isin(*shards)).select("id", "v", "width", block.alias("block"), every(n_shards).alias("shard")))
    keys = ("width", "shard", "block")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k, factor), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
