"""Deterministic keep-first and sampling that stay distributed at any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselight.session import ensure_checkpoint_dir


def id_order(*ids: str) -> list[Column]:
    """Numeric order for ids that are digit strings, without parsing them."""
    return [c for i in ids for c in (F.length(F.col(i).cast("string")), F.col(i))]


def head_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int,
                   rank_col: str | None = None) -> DataFrame:
    """The first ``n`` rows of every group.

    Spark turns ``row_number() <= n`` (n up to 1000, its default) into a group limit
    that runs before the shuffle as well, so a hot group arrives as at most ``n``
    rows per map task.
    """
    rank = rank_col or "_rank"
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)
    return out if rank_col else out.drop(rank)


def sample_n(df: DataFrame, n: int | None, id_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """A uniform sample of ``n`` rows that depends only on the seed and the ids.

    Rows are ordered by a digest of (seed, ids).  A 65,536-bucket histogram finds the
    bucket in which row ``n`` lies; the rows of that one bucket, about a 65,536th of
    the input, are ranked to find the last row that stays.  The sample itself is a
    filter: nothing is sorted and it stays as spread as the input.  Rows that repeat
    all ids stay or go together.  ``None`` or 0 keeps all rows.
    """
    if not n:
        return df
    keyed = (df.withColumn("_digest", F.md5(F.concat_ws(":", F.lit(str(seed)), *id_cols)))
             .withColumn("_bucket", F.conv(F.substring("_digest", 1, 4), 16, 10).cast("int")))
    histogram = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = (histogram.withColumn("_before", before).where(F.col("_before") < n)
           .agg(F.max_by(F.struct("_bucket", "_before"), "_bucket").alias("cut")))
    key = F.struct("_digest", *id_cols)
    edge = (keyed.where(F.col("_bucket") == cut.select("cut._bucket").scalar())
            .select(key.alias("_key"), F.row_number().over(Window.orderBy("_digest", *id_cols)).alias("_rank"))
            .where(F.col("_rank") <= n - cut.select("cut._before").scalar())
            .agg(F.max("_key").alias("last")))
    return keyed.where(key <= edge.scalar()).drop("_digest", "_bucket")


def running_totals(df: DataFrame, group: Sequence[str], order: str, value: str, output: str) -> DataFrame:
    """The rows plus ``output``: the sum of ``value`` over the rows of the group that come before, by ``order``.

    No task sees a whole group: rows are range-partitioned, every range adds up its own part, and
    only the ranges' totals, one row per range and group, are run through in order.
    Rows with equal group and order stand in one range and in no particular order.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (df.repartitionByRange(*[F.col(c) for c in group], F.col(order)).withColumn("_range", F.spark_partition_id())
              .checkpoint())  # the ranges must not be dealt anew
    before = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy(*group, "_range").agg(F.sum(value).alias("_sum"))
               .withColumn("_offset", F.coalesce(F.sum("_sum").over(before(*group, by="_range")), F.lit(0))).drop("_sum"))
    inside = F.coalesce(F.sum(value).over(before(*group, "_range", by=order)), F.lit(0))
    return (ranged.withColumn("_inside", inside).join(offsets, [*group, "_range"])
            .withColumn(output, F.col("_inside") + F.col("_offset")).select(*df.columns, output))
