"""Mixing sources to target weights in blocks of equal tokens.

Every source is cut into shards, every shard into blocks of ``block_words`` words.
Sainte-Laguë apportionment gives each source, then each of its shards, a whole
number of blocks: the next block always goes to the highest quotient
``weight / (2 given + 1)``.  Within a shard a seeded order of the blocks says which
are taken once more than the others.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from caselight.llm.links import settled
from caselight.llm.spaced import spaced_words
from caselight.shipping import ship_by_value

ship_by_value(__name__)

FANOUT = 1024  # shards that share one apportionment
TABLE_BYTES = 8 << 20  # a table of sources up to this size is broadcast


def sainte_lague(weights: Sequence[float], most: Sequence[int], seats: int) -> np.ndarray:
    """Seats per party: ``seats`` times the highest ``weight / (2 got + 1)`` gets one, the first of equals, up to ``most`` each.

    Quotients above a limit are counted, not listed, and the limit is halved in on;
    only what is left between the last two limits is handed out one by one.
    """
    weights, most = np.asarray(weights, np.float64), np.asarray(most, np.int64)
    most = np.where(weights > 0, most, 0)
    seats = int(min(seats, most.sum()))

    def above(limit: float) -> np.ndarray:
        """Per party the quotients greater than ``limit``."""
        with np.errstate(divide="ignore", over="ignore"):
            k = np.minimum(np.ceil(np.maximum(weights / limit - 1, 0) / 2), most.astype(np.float64)).astype(np.int64)
        k += (weights / (2 * k + 1) > limit).astype(np.int64)  # the division above may round either way
        k -= ((k > 0) & (weights / np.maximum(2 * k - 1, 1) <= limit)).astype(np.int64)
        return np.minimum(k, most)

    if not len(weights) or seats <= 0:
        return np.zeros(len(weights), np.int64)
    low, high = 0.0, float(weights.max())  # no quotient is greater than high
    while True:
        middle = (low + high) / 2
        if middle <= low or middle >= high:
            break
        count = above(middle).sum()
        if count == seats:
            return above(middle)
        low, high = (middle, high) if count > seats else (low, middle)
    given = above(high)
    agenda = [(-w / (2 * g + 1), at) for at, (w, g, m) in enumerate(zip(weights.tolist(), given.tolist(), most.tolist())) if g < m]
    heapq.heapify(agenda)
    for _ in range(seats - int(given.sum())):
        _, at = heapq.heappop(agenda)
        given[at] += 1
        if given[at] < most[at]:
            heapq.heappush(agenda, (-weights[at] / (2 * given[at] + 1), at))
    return given


def capped_shares(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> np.ndarray:
    """Targets by weight that add up to ``share`` of all sizes; above ``most`` times its size a source stops and the others share the rest."""
    sizes, weights = np.asarray(sizes, np.float64), np.asarray(weights, np.float64)
    caps, total = most * sizes, min(share, most) * sizes.sum()
    stopped = np.zeros(len(sizes), bool)
    targets = np.zeros(len(sizes))
    while not stopped.all():
        level = (total - caps[stopped].sum()) / weights[~stopped].sum()
        targets = np.where(stopped, caps, weights * level)
        over = ~stopped & (targets >= caps)
        if not over.any():
            break
        stopped |= over
        targets = np.where(stopped, caps, targets)
    return targets


def word_sizes(docs: DataFrame, columns: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The given columns and ``size``: words between white space of the whole text, 0 for null.  Map-only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.diff(w.offsets) for w in spaced_words(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(sizes) if sizes else [], pa.int64())],
                                             [*names, "size"])

    names = list(columns)
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *[c.alias(n) for n, c in columns.items()])
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], T.StructField("size", T.LongType())]))


def plan_sources(sizes: DataFrame, weights: Sequence[float], share: float, most: float, block_words: int, shard_words: int) -> DataFrame:
    """``(source, source_size, place, target, blocks, shards)`` from ``(source, source_size)``: one row per source, in one task.

    Sources stand by code point, null last, and take the weights in turn.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0] is None, r[0] or ""))
        if not rows:
            return
        size = [r[1] for r in rows]
        target = capped_shares(size, [weights[i % len(weights)] for i in range(len(rows))], share, most)
        blocks = sainte_lague(target, [math.ceil(most * s / block_words) for s in size], math.floor(target.sum() / block_words + 0.5))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array(size, pa.int64()), pa.array(range(1, len(rows) + 1), pa.int64()),
             pa.array(target), pa.array(blocks, pa.int64()), pa.array([max(1, math.ceil(s / shard_words)) for s in size], pa.int64())],
            ["source", "source_size", "place", "target", "blocks", "shards"])

    return sizes.select("source", "source_size").coalesce(1).mapInArrow(
        run, "source string, source_size long, place long, target double, blocks long, shards long")


def apportion(shards: DataFrame, blocks: DataFrame, levels: int) -> DataFrame:
    """``(place, shard, quota)``: the blocks of each place, ``(place, blocks)``, dealt to its shards ``(place, shard, words, most)``.

    With many shards the blocks go down a tree of at most ``FANOUT`` children per
    node, so no task meets more than that many rows of one source.
    """
    schema = T.StructType.fromDDL("place long, shard long, quota long")

    def deal(key, table):
        table = table.sort_by("node")
        quota = sainte_lague(table.column("words").to_numpy(), table.column("most").to_numpy(), table.column("blocks")[0].as_py())
        return pa.table({"place": table.column("place"), "shard": table.column("node"), "quota": pa.array(quota)}).cast(to_arrow_schema(schema))

    held = blocks.select("place", F.lit(0).cast("long").alias("above"), "blocks")
    dealt = None
    for level in reversed(range(levels)):
        width = FANOUT ** level
        nodes = (shards.groupBy("place", F.expr(f"shard div {width}L").alias("node"))
                 .agg(F.sum("words").alias("words"), F.sum("most").alias("most")))
        children = nodes.withColumn("above", F.expr(f"node div {FANOUT}L"))
        dealt = children.join(held, ["place", "above"]).groupBy("place", "above").applyInArrow(deal, schema)
        held = dealt.select("place", F.col("shard").alias("above"), F.col("quota").alias("blocks"))
    return dealt


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int = 64,
                shard_words: int = 1 << 16, seed: int = 12) -> DataFrame:
    """``(id, source, size, source_size, target, taken)`` per row: how many of its words the mix takes, repeats counted.

    The targets are ``capped_shares`` of the sources' sizes in words.  A shard is
    what a digest of seed, id and text deals together, about ``shard_words`` words;
    its texts lie end to end in the digest's order, cut into blocks of ``block_words``
    words (the last may be shorter).  With a quota of q blocks of n each block is
    taken q div n times, and the q mod n first in a seeded order once more; no word
    is taken more than ``most`` times, rounded up.  A source misses its target by half
    a block, and by one block per shard at most where last blocks are short.

    Null or empty texts have size 0 and nothing is taken of them; null is a source
    of its own, behind all others; a null id is dealt like any other; rows that
    repeat id and text share a shard and lie side by side; an empty table gives no
    row; other columns are not read.  Reruns agree, whatever the partitions.  One row
    per source passes through one task; that table is broadcast if its measured size
    is at most ``TABLE_BYTES``.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(text_col, F.lit("")).cast("binary"))))
    sized = settled(word_sizes(docs, {"id": F.col(id_col), "source": F.col(source_col).cast("string"), "key": key}, text_col))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = settled(plan_sources(totals, weights, share, most, block_words, shard_words))
    bytes_, widest = plan.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64), F.max("shards")).first()
    levels = max(1, math.ceil(math.log(widest or 1, FANOUT) - 1e-9))
    small = (bytes_ or 0) <= TABLE_BYTES

    of_source = plan.withColumnRenamed("source", "_of")
    placed = sized.join(F.broadcast(of_source) if small else of_source, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    number = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    some = placed.where("size > 0").withColumn("shard", F.pmod(number, F.col("shards")))
    end = "sum(size) OVER (PARTITION BY place, shard ORDER BY key, id, size ROWS UNBOUNDED PRECEDING)"
    laid = some.withColumn("end", F.expr(end)).withColumn("begin", F.col("end") - F.col("size"))

    shards = some.groupBy("place", "shard").agg(F.sum("size").alias("words")).withColumn("n", F.expr(f"(words + {block_words - 1}) div {block_words}"))
    shards = settled(shards.withColumn("most", F.ceil(F.lit(float(most)) * F.col("n")).cast("long")))
    quotas = apportion(shards, plan.select("place", "blocks"), levels)
    digest = f"md5(concat_ws(':', '{seed}', place, shard, j))"
    orders = shards.join(quotas, ["place", "shard"]).selectExpr(
        "place", "shard", "quota div n AS every", "CASE WHEN quota % n > 0 THEN "
        f"element_at(array_sort(transform(sequence(0L, n - 1), j -> {digest})), CAST(quota % n AS INT)) ELSE '' END AS cut")
    overlap = f"(least(end, (j + 1) * {block_words}L) - greatest(begin, j * {block_words}L))"
    again = f"CASE WHEN cut <> '' AND {digest} <= cut THEN 1L ELSE 0L END"
    taken = (f"aggregate(sequence(begin div {block_words}L, (end - 1) div {block_words}L), 0L, "
             f"(s, j) -> s + {overlap} * (every + {again}))")
    columns = [F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target"]
    mixed = laid.join(settled(orders), ["place", "shard"]).select(*columns, F.expr(taken).alias("taken"))
    return mixed.unionByName(placed.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))
