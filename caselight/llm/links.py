"""Steps shared by operators that link rows: fresh checkpoints and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.session import ensure_checkpoint_dir
from caselight.shipping import ship_by_value

ship_by_value(__name__)

ROWS_PER_TASK = 5_000  # narrow rows that one task of a round takes on at least
EDGES_PER_TASK = 100_000  # edges that one task joins on its own before the rounds
_SORTED_ALIKE = ("string", "bigint", "int", "smallint", "tinyint")  # ids that Arrow puts in Spark's order


def settled(df: DataFrame) -> DataFrame:
    """The frame written to the folder in ``spark.checkpoint.dir``, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def packed(df: DataFrame, rows: int, per_task: int | None = None) -> DataFrame:
    """The frame in no more partitions than its counted rows need: rounds over a small table must not start a task for every empty one."""
    return df.coalesce(max(1, -(-rows // (per_task or ROWS_PER_TASK))))


def _smallest_near(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of its component for each of ``n`` numbers; the larger root of a link goes below the smaller."""
    parent = np.arange(n)
    while len(a):
        up, down = parent[a], parent[b]
        apart = up != down
        a, b = np.maximum(up, down)[apart], np.minimum(up, down)[apart]
        np.minimum.at(parent, a, b)
        while not np.array_equal(parent[parent], parent):
            parent = parent[parent]
    return parent


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as one star per component that they make among themselves."""
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    ends = pa.concat_arrays(table.column("a").chunks + table.column("b").chunks).dictionary_encode()
    ids = ends.dictionary.take(pc.sort_indices(ends.dictionary))
    number = pc.index_in(ends.dictionary, ids).to_numpy()[ends.indices.to_numpy()]
    low = _smallest_near(number[:table.num_rows], number[table.num_rows:], len(ids))
    linked = np.flatnonzero(low != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(linked)), ids.take(pa.array(low[linked]))], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``(id, label)`` for every end of an edge ``(a, b)``: the smallest id of its component.

    Tasks first join what they hold of the edges; where one task holds them all, that is the result.
    Then large-star and small-star steps in turn: each node hands its larger, then all
    its neighbours to the smallest one near it.  Only a minimum per node is
    gathered, so a popular node makes no large group; it ends when nothing changes.
    """
    def tidy(df: DataFrame, rows: int | None = None) -> DataFrame:
        df = df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        return df if rows is None else packed(df, rows)

    def measured(df: DataFrame) -> tuple[int, object]:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = settled(tidy(edges))
    last = measured(edges)
    alone = False
    if edges.schema["a"].dataType.simpleString() in _SORTED_ALIKE:
        own = packed(edges, last[0], EDGES_PER_TASK)
        alone = last[0] <= EDGES_PER_TASK
        edges = settled(own.mapInArrow(_starred, own.schema))
        last = last if alone else measured(edges)
    while not alone:
        rows = last[0]
        edges = packed(edges, rows)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = packed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), rows)
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = tidy(packed(large, rows).unionByName(low.where("low < a").select("a", F.col("low").alias("b"))), rows)
        low = packed(large.groupBy("a").agg(F.min("b").alias("low")), rows)
        small = packed(large.join(low, "a"), rows).select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select("a", F.col("low").alias("b")))
        edges = settled(tidy(small, rows))
        state = measured(edges)
        if state == last:
            break
        last = state
    # settled edges form stars: each node names the smallest id of its component
    edges = packed(edges, last[0])
    return packed(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label"))
                  .unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()), last[0])
