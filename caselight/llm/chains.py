"""The prefix tree of ``chat`` with rows of fixed size, for conversations of any length.

A node's id is a digest chained over the turns up to it.  The digests of a stretch of turns can be
joined to those before it, so one conversation is spread over many tasks.  A node belongs to the smallest
conversation through it; the nodes of one conversation are its chunk, a run of turns, and only chunks, not nodes, have paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.chat import CLOSE, CONTROLS, END, OPEN, escaped, unescaped
from caselight.llm.links import settled
from caselight.shipping import ship_by_value

ship_by_value(__name__)

PRIME = (1 << 127) - 1
BASE = 0x5851F42D4C957F2D14057B7EF767814F


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: its first and last conversation, and the last one's number of turns and digest so far."""
    first = last = None
    n, value, seen = 0, 0, False
    kind = pa.null()
    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not seen:
                first, last, seen = conv, conv, True
                single = True
            elif conv != last:
                last, n, value, single = conv, 0, 0, False
            n, value = n + 1, (value * BASE + int(digest, 16)) % PRIME
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], kind), pa.array([last], kind),
                                          pa.array([single]), pa.array([n], pa.int64()), pa.array([f"{value:x}"])],
                                         ["at", "first", "last", "single", "n", "value"])


def _named(n: int, value: int) -> str | None:
    return f"{n:x}:{value:032x}" if n else None


def _chained(before: dict[int, tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, value = before.get(TaskContext.get().partitionId(), (None, 0, 0))
        for batch in batches:
            out = []
            for conv, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if conv != last:
                    last, n, value = conv, 0, 0
                parent = _named(n, value)
                n, value = n + 1, (value * BASE + int(digest, 16)) % PRIME
                out.append((n, _named(n, value), parent))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()),
                 pa.array([x[2] for x in out], pa.string()), batch.column(2), batch.column(3)], ["conv", "n", "id", "parent", "role", "text"])
    return run


def chained_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, n, id, parent, role, text)`` per turn, in the order of ``chat.beginnings``; equal beginnings have equal ids."""
    kind = rows.select(conv_col).schema[0].dataType.simpleString()
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    ordered = settled(rows.orderBy("conv", "turn", "role", "text").select("conv", digest.alias("digest"), "role", "text"))
    ends = ordered.select("conv", "digest").mapInArrow(
        _steps, f"at int, first {kind}, last {kind}, single boolean, n long, value string").collect()  # one row per partition
    before, state = {}, (None, 0, 0)
    for row in sorted(ends, key=lambda r: r["at"]):
        before[row["at"]] = state
        n, value = row["n"], int(row["value"], 16)
        if row["single"] and state[1] and row["first"] == state[0]:
            n, value = state[1] + n, (state[2] * pow(BASE, n, PRIME) + value) % PRIME
        state = row["last"], n, value
    return settled(ordered.mapInArrow(_chained(before), f"conv {kind}, n long, id string, parent string, role string, text string"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition: its length, the depth of its first node, and the last node with those ancestors that stand in the same partition."""
    total, chain, first = 0, [], None
    for batch in batches:
        for n, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            first = n if first is None else first
            while chain and chain[-1][0] >= n:
                chain.pop()
            chain.append((n, total, total + size))
            total += size
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total], pa.int64()), pa.array([[c[0] for c in chain]], pa.list_(pa.int64())),
             pa.array([[c[1] for c in chain]], pa.list_(pa.int64())), pa.array([[c[2] for c in chain]], pa.list_(pa.int64()))],
            ["at", "total", "n", "start", "end"])


class _Branch:
    """The ancestors of a place in the stream, with their places merged to runs."""

    def __init__(self, chain):
        self.chain, self.runs = [], []
        for c in chain:
            self.push(*c)

    def push(self, n: int, start: int, end: int) -> None:
        self.chain.append((n, start, (self.chain[-1][2] if self.chain else 0) + end - start))
        if self.runs and self.runs[-1][1] == start:
            self.runs[-1][1] = end
        else:
            self.runs.append([start, end])

    def cut(self, n: int) -> None:
        while self.chain and self.chain[-1][0] >= n:
            start = self.chain.pop()[1]
            if self.runs[-1][0] == start:
                self.runs.pop()
            else:
                self.runs[-1][1] = start


def _placed(before: dict[int, tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chain = before.get(TaskContext.get().partitionId(), (0, []))
        branch = _Branch(chain)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for n, size, lead, body in zip(*(batch.column(i).to_pylist() for i in (4, 5, 6, 7))):
                branch.cut(n)
                out.append((total, total + size, branch.chain[-1][2] if branch.chain else 0, total + lead, total + lead + body,
                            [{"start": s, "end": e} for s, e in branch.runs]))
                branch.push(n, total, total + size)
                total += size
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], *[pa.array([x[i] for x in out], pa.int64()) for i in range(5)],
                                              pa.array([x[5] for x in out], kind)],
                                             ["id", "parent", "role", "segment", "n", "start", "end", "position", "loss_start", "loss_end", "attends"])
    return run


def chained_tree(turns: DataFrame, learn_role: str = "assistant", controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """The nodes in depth-first order: ``(id, parent, role, segment, n, start, end, position, loss_start, loss_end, attends)``.

    As ``chat.prefix_tree``, but a node names only its parent, and the ``attends`` of ancestors that
    stand side by side are one.  Chunks are placed under the chunks they branch off,
    a round for each step of branching, so no row holds more than its branchings.
    """
    owner = F.struct(F.col("conv").isNotNull().alias("named"), F.col("conv").alias("conv"))
    nodes = settled(turns.groupBy("id", "parent", "n").agg(F.min(owner).alias("owner"), F.min("role").alias("role"), F.min("text").alias("text")))
    heads = nodes.groupBy("owner").agg(F.min(F.struct("n", "parent")).alias("head")).select("owner", F.col("head.n").alias("n"), "head.parent")
    heads = settled(heads.join(nodes.select(F.col("id").alias("parent"), F.col("owner").alias("above")), "parent", "left"))
    own = F.array(F.struct((-F.col("n")).alias("n"), "owner"))
    level = settled(heads.where(F.col("above").isNull()).select("owner", own.alias("key")))
    keys, count = level, level.count()
    while count:
        level = settled(heads.join(level.withColumnRenamed("owner", "above"), "above").select("owner", F.concat("key", own).alias("key")))
        count = level.count()
        keys = keys.unionByName(level)
    lead, body = F.concat(F.lit(OPEN), escaped(F.col("role"), controls), F.lit(CLOSE)), escaped(F.col("text"), controls)
    ordered = settled(nodes.join(keys, "owner").orderBy("key", "n").select("id", "parent", "role", lead.alias("lead"), body.alias("body"), "n").select(
        "id", "parent", "role", F.concat("lead", "body", F.lit(END)).alias("segment"), "n",
        (F.length("lead") + F.length("body") + len(END)).cast("long").alias("size"), F.length("lead").cast("long").alias("lead"),
        F.when(F.col("role") == learn_role, F.length("body")).otherwise(0).cast("long").alias("body")))
    ends = ordered.select("n", "size").mapInArrow(_ends, "at int, total long, n array<long>, start array<long>, end array<long>").collect()
    before, total, chain = {}, 0, []
    for row in sorted(ends, key=lambda r: r["at"]):  # one row per partition
        before[row["at"]] = total, chain
        first = row["n"][0]
        chain = [c for c in chain if c[0] < first] + [(n, total + s, total + e) for n, s, e in zip(row["n"], row["start"], row["end"])]
        total += row["total"]
    return ordered.mapInArrow(_placed(before), "id string, parent string, role string, segment string, n long, start long, end long, position long, "
                              "loss_start long, loss_end long, attends array<struct<start:long,end:long>>")


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each leaf's turns, which come in their order; only one turn is looked at at a time."""
    names = ["leaf", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    last, every, learnt, loss, chars = None, None, None, 0, 0
    for batch in batches:
        out = []
        for leaf, role, text, part, size in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
            if leaf != last:
                if last is not None:
                    out.append((last, every.hexdigest(), loss, learnt.hexdigest(), chars))
                last, every, learnt, loss, chars = leaf, hashlib.sha256(), hashlib.sha256(), 0, 0
            every.update(f"{role}\n{text}\n".encode())
            learnt.update(part.encode())
            loss, chars = loss + len(part), chars + size
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[i]) for i in range(5)], names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((last, every.hexdigest(), loss, learnt.hexdigest(), chars), kinds)], names)


def chained_read_back(turns: DataFrame, tree: DataFrame) -> DataFrame:
    """The columns of ``chat.read_back``, taken from the tree; each distinct conversation is read once, as a sorted stream."""
    last = turns.groupBy("conv").agg(F.max("n").alias("n_turns"), F.max_by("id", "n").alias("leaf"))
    readers = last.groupBy("leaf").agg(F.min(F.struct(F.col("conv").isNotNull().alias("named"), "conv")).alias("one")).select("leaf", "one.conv")
    steps = turns.alias("t").join(readers.alias("r"), F.col("t.conv").eqNullSafe(F.col("r.conv"))).select("leaf", "n", "id")
    lead = F.regexp_extract("segment", r"(?s)^<\|(.*?)\|>", 1)
    text = F.expr(f"substring(segment, length(lead) + {len(OPEN) + len(CLOSE) + 1}, "
                  f"length(segment) - length(lead) - {len(OPEN) + len(CLOSE) + len(END)})")
    learnt = F.expr("substring(segment, cast(loss_start - start + 1 AS int), cast(loss_end - loss_start AS int))")
    parts = (steps.join(tree.select("id", "segment", "start", "loss_start", "loss_end"), "id").withColumn("lead", lead)
             .select("leaf", "n", unescaped(F.col("lead")).alias("role"), unescaped(text).alias("text"), unescaped(learnt).alias("learnt"),
                     F.length("segment").cast("long").alias("size")))
    told = parts.repartition("leaf").sortWithinPartitions("leaf", "n").mapInArrow(
        _told, "leaf string, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return last.join(told, "leaf").select("conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
