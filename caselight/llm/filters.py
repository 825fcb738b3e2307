"""How filters of a corpus act on one another, in every order they could be applied in.

Each text has a mask of the filters it fails.  Only counts per mask are folded
over the orders: a text is removed by the first filter of an order that it fails,
and later failures are redundant.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselight.llm.links import settled
from caselight.llm.spaced import per_text, spaced_words
from caselight.shipping import ship_by_value

ship_by_value(__name__)

LETTERS = "ABCDE"
SPECIAL = b"#$%&*|"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _masks(words) -> np.ndarray:
    """Bits 0 to 3 for the texts of a slice: too short, too repetitive, too many capitals, special signs."""
    data, at, rows = words.data, words.at, words.stop - words.first
    n = np.diff(words.offsets)
    ids = words.ids().astype(np.int64)
    if len(ids):  # words of the slice are numbered from 0
        pairs = np.unique(np.repeat(np.arange(rows), n) * (int(ids.max()) + 1) + ids)
        distinct = np.bincount(pairs // (int(ids.max()) + 1), minlength=rows)
    else:
        distinct = np.zeros(rows, np.int64)
    special = np.zeros(256, bool)
    special[list(SPECIAL)] = True
    fails = (n < 100, 100 * distinct < 80 * n,
             100 * per_text((data >= 65) & (data <= 90), at) > 10 * per_text((data & 0xC0) != 0x80, at), per_text(special[data], at) > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def text_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(id, part, digest, mask)`` per row: the SHA-256 of the text and a bit per filter A to D that it fails.  Map-only; null texts and parts are empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in spaced_words(batch.column(2)):
                rows = slice(words.first, words.stop - words.first)
                spans = zip(words.at[:-1].tolist(), words.at[1:].tolist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(rows.start, rows.stop), batch.column(1).slice(rows.start, rows.stop),
                     pa.array([hashlib.sha256(words.data[a:b]).digest() for a, b in spans], pa.binary()),
                     pa.array(_masks(words), pa.int32())], ["id", "part", "digest", "mask"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], *T.StructType.fromDDL("part string, digest binary, mask int").fields]))


def with_copies(failures: DataFrame, bit: int) -> DataFrame:
    """The rows with ``bit`` set in the mask where a smaller id has the same text.

    The first id of every text is found by a minimum that is combined before the
    shuffle; rows then look for themselves under text and id, so a text of many
    copies makes no large group.  A null id is no copy and makes none.
    """
    named = failures.where("id IS NOT NULL")
    first = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("_first", F.lit(True))
    marked = named.join(first, ["digest", "id"], "left").withColumn(
        "mask", F.when(F.col("_first").isNull(), F.col("mask").bitwiseOR(F.lit(1 << bit))).otherwise(F.col("mask"))).drop("_first")
    return marked.unionByName(failures.where("id IS NULL"))


def audit_orders(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`` from counted masks.

    ``cells`` has ``(part, mask, n, good, toxic)``, at most one row per part and mask.
    Every cell is folded over the array of all orders, which travels with the plan:
    ``aggregate`` walks the steps of an order, ``transform`` the orders, and the structs
    of all cells of a part, each weighted by its counts, are added up place by place.
    """
    steps, orders = len(letters), ["".join(p) for p in permutations(letters)]
    zero = "named_struct(" + ", ".join(f"'{c}', 0L" for c in COUNTS) + ")"
    told = ("named_struct('kept', if(s.alive AND NOT fails, c.n, 0L), 'removed', if(s.alive AND fails, c.n, 0L), "
            "'redundant', if(NOT s.alive AND fails, c.n, 0L), 'unique_fails', if(c.mask = shiftleft(1, at), c.n, 0L), "
            "'good_lost', if(s.alive AND fails, c.good, 0L), 'toxic_lost', if(s.alive AND fails, c.toxic, 0L))")
    # each let x = e in b is written as transform(array(e), x -> b)[0]
    step = (f"transform(array(instr('{letters}', substring(o, i, 1)) - 1), at -> transform(array(getbit(c.mask, at) = 1), fails -> "
            f"named_struct('alive', s.alive AND NOT fails, 'out', concat(s.out, array({told}))))[0])[0]")
    walk = f"aggregate(sequence(1, {steps}), named_struct('alive', true, 'out', slice(array({zero}), 1, 0)), (s, i) -> {step}, s -> s.out)"
    fold = f"flatten(transform(orders, o -> {walk}))"
    added = "zip_with(a, {}, (x, y) -> named_struct({}))".format(fold, ", ".join(f"'{c}', x.{c} + y.{c}" for c in COUNTS))
    places = len(orders) * steps
    gathered = (cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2 ** steps each
                .withColumn("orders", F.lit(orders)))
    folded = gathered.select("part", "orders", F.expr(f"aggregate(cells, array_repeat({zero}, {places}), (a, c) -> {added})").alias("told"))
    shapley = (f"transform(sequence(1, {steps}), f -> aggregate(sequence(0, {places - 1}), 0L, (s, i) -> s + "
               f"if(substring(orders[i div {steps}], i % {steps} + 1, 1) = substring('{letters}', f, 1), told[i].removed, 0L)))")
    return (folded.withColumn("_shapley", F.expr(shapley)).select("part", "orders", "_shapley", F.posexplode("told").alias("_at", "_c"))
            .withColumn("filter_order", F.expr(f"orders[_at div {steps}]"))
            .select("part", "filter_order", F.expr(f"CAST(_at % {steps} + 1 AS INT)").alias("step"), *[F.col(f"_c.{c}") for c in COUNTS],
                    F.expr(f"_shapley[instr('{letters}', substring(filter_order, _at % {steps} + 1, 1)) - 1]").alias("shapley")))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of five filters over whole texts, one row per part, order and step; see ``audit_orders`` for the columns.

    A: under 100 words; B: distinct words under 80 %; C: capitals A to Z over 10 % of
    the code points; D: any of ``#$%&*|``; E: same text as a row of smaller id.
    ``labels`` has ``(id, quality, toxic)``; of a repeated id a 1 in any row counts.
    Null texts are empty (and copies of one another), a null part is the empty one, a
    null id has no label and no copy, a repeated id counts once per row, an empty table
    gives no row, and other columns are not read.
    """
    rows = with_copies(settled(text_failures(docs, id_col, text_col, part_col)), 4).select("id", "part", "mask")
    flags = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    named = rows.where("id IS NOT NULL").join(flags, "id", "left")
    nameless = rows.where("id IS NULL").select("*", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    cells = named.unionByName(nameless).groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return audit_orders(cells)


