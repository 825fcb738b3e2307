"""Chat formatting with a prefix tree: conversations that begin alike share the text of their common turns.

Every distinct beginning of a conversation is a node.  Sorted by their paths the
nodes stand in depth-first order, and each node's formatted turn is written
once into one stream of characters.  A node carries its place in the stream, the position id at
which it begins (the length of its ancestors), and the stretches of the stream, its
ancestors, that it attends to besides itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselight.llm.links import settled
from caselight.shipping import ship_by_value

ship_by_value(__name__)

OPEN, CLOSE, END = "<|", "|>", "</s>"
# Strings that templates and tokenizers give a meaning to; inside a text they are broken up.
CONTROLS = (OPEN, CLOSE, END, "<s>", "[INST]", "[/INST]", "<unk>", "<pad>")
STEP = 24  # hexadecimal digits per turn in a path


def escaped(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    """Backslashes are doubled, and a backslash goes after the first character of each control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in controls:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def beginnings(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """``(conv, n, path, role, text)`` per turn; ``path`` has a digest of each turn so far, so equal beginnings have equal paths."""
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                       F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    path = F.array_join(F.collect_list("step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "")
    return rows.withColumn("step", F.substring(digest, 1, STEP)).select(
        "conv", F.row_number().over(order).alias("n"), path.alias("path"), "role", "text")


_NODE = ("path string, role string, segment string, start long, end long, position long, loss_start long, loss_end long, "
         "attends array<struct<start:long,end:long>>")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: its length, and the last node with those of its ancestors that stand in the same partition."""
    total, chain = 0, []
    for batch in batches:
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            while chain and not path.startswith(chain[-1][0]):
                chain.pop()
            chain.append((path, total, total + size))
            total += size
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total], pa.int64()),
             pa.array([[{"path": p, "start": s, "end": e} for p, s, e in chain]],
                      pa.list_(pa.struct([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["at", "total", "chain"])


def _placed(before: dict[int, tuple[int, list[tuple[str, int, int]]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chain = before.get(TaskContext.get().partitionId(), (0, []))
        chain = list(chain)
        for batch in batches:
            out = {name: [] for name in ("start", "end", "position", "loss_start", "loss_end", "attends")}
            columns = [batch.column(i).to_pylist() for i in (0, 3, 4, 5)]
            for path, size, lead, body in zip(*columns):
                while chain and not path.startswith(chain[-1][0]):
                    chain.pop()
                out["start"].append(total)
                out["end"].append(total + size)
                out["position"].append(sum(e - s for _, s, e in chain))
                out["loss_start"].append(total + lead)
                out["loss_end"].append(total + lead + body)
                out["attends"].append([{"start": s, "end": e} for _, s, e in chain])
                chain.append((path, total, total + size))
                total += size
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], *[pa.array(out[c], pa.int64()) for c in list(out)[:-1]],
                                              pa.array(out["attends"], kind)],
                                             ["path", "role", "segment", *out])
    return run


def prefix_tree(turns: DataFrame, learn_role: str = "assistant", controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """The nodes of ``beginnings`` in depth-first order:
    ``(path, role, segment, start, end, position, loss_start, loss_end, attends)``.

    ``start`` and ``end`` are places in the stream, in code points.  A node attends to
    ``attends`` and to itself up to the current place.  The loss mask is ``loss_start`` to ``loss_end``: the
    text of a ``learn_role`` turn, and nothing of others.  The stream is sorted and measured in parallel:
    only each partition's length and last branch go through the driver, so a first turn that many
    conversations share is spread like any other.
    """
    nodes = turns.select("path", "role", "text").distinct()
    lead, body = F.concat(F.lit(OPEN), escaped(F.col("role"), controls), F.lit(CLOSE)), escaped(F.col("text"), controls)
    nodes = nodes.select("path", "role", lead.alias("lead"), body.alias("body")).select(
        "path", "role", F.concat("lead", "body", F.lit(END)).alias("segment"),
        (F.length("lead") + F.length("body") + len(END)).cast("long").alias("size"), F.length("lead").cast("long").alias("lead"),
        F.when(F.col("role") == learn_role, F.length("body")).otherwise(0).cast("long").alias("body"))
    ordered = settled(nodes.orderBy("path"))
    ends = ordered.select("path", "size").mapInArrow(_ends, "at int, total long, chain array<struct<path:string,start:long,end:long>>").collect()
    before, total, chain = {}, 0, []
    for row in sorted(ends, key=lambda r: r["at"]):  # one row per partition
        before[row["at"]] = total, chain
        first = row["chain"][0]["path"]
        chain = [c for c in chain if first.startswith(c[0])] + [(c["path"], total + c["start"], total + c["end"]) for c in row["chain"]]
        total += row["total"]
    return ordered.mapInArrow(_placed(before), _NODE)


def read_back(turns: DataFrame, tree: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """``(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` of each conversation, taken from the tree.

    Distinct conversations are read once, however many conversations are equal.
    """
    last = turns.groupBy("conv").agg(F.max("n").cast("long").alias("n_turns"), F.max_by("path", "n").alias("leaf"))
    leaves = last.select("leaf").distinct()
    steps = leaves.select("leaf", F.explode(F.sequence(F.lit(1), (F.length("leaf") / STEP).cast("int"))).alias("n"))
    steps = steps.withColumn("path", F.expr(f"substring(leaf, 1, n * {STEP})"))
    lead = F.regexp_extract("segment", r"(?s)^<\|(.*?)\|>", 1)
    text = F.expr(f"substring(segment, length(lead) + {len(OPEN) + len(CLOSE) + 1}, "
                  f"length(segment) - length(lead) - {len(OPEN) + len(CLOSE) + len(END)})")
    learnt = F.expr("substring(segment, cast(loss_start - start + 1 AS int), cast(loss_end - loss_start AS int))")
    parts = (steps.join(tree.select("path", "segment", "start", "loss_start", "loss_end"), "path")
             .withColumn("lead", lead)
             .select("leaf", "n", unescaped(F.col("lead")).alias("role"), unescaped(text).alias("text"),
                     unescaped(learnt).alias("learnt"), F.length("segment").cast("long").alias("size")))
    told = (parts.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("n", "role", "text", "learnt", "size"))).alias("t"))
            .select("leaf",
                    F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("all"),
                    F.array_join(F.transform("t", lambda x: x["learnt"]), "").alias("learnt"),
                    F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("formatted_chars"))
            .select("leaf", F.sha2(F.col("all").cast("binary"), 256).alias("turns_sha256"),
                    F.length("learnt").cast("long").alias("loss_chars"),
                    F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), "formatted_chars"))
    return last.join(told, "leaf").select("conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 learn_role: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """``(turns, tree)``: the paths of all conversations, and the prefix tree that they share.

    Turns are ordered by number (a null first), then role and text; repeated rows are turns of
    their own.  Null roles and texts count as empty, rows with a null conversation id are one
    conversation, other columns are not read, and an empty table gives an empty tree.
    """
    turns = settled(beginnings(rows, conv_col, turn_col, role_col, text_col))
    return turns, prefix_tree(turns, learn_role)
