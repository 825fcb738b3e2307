"""Handling messages as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from caselight import config
from caselight.config import Policy
from caselight.functions.text import clean_text
from caselight.operators.retrieval import SparseIndex
from caselight.plans.handling import Classifier, handle
from caselight.streaming.growing import GrowingIndex


def read_arriving(spark: SparkSession, path: str, schema: StructType | str, pattern: str | None = None,
                  files_per_batch: int = 1000) -> DataFrame:
    """A file source over a folder of Parquet message files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def handle_stream(messages: DataFrame, index: SparseIndex | GrowingIndex, classify: Classifier, output: str, checkpoint: str,
                  id_col: str = "id", text_col: str = "text", k: int = config.TOP_K, policy: Policy = Policy(),
                  draft: str = "none", available_now: bool = True, reply_col: str | None = None) -> StreamingQuery:
    """``handle`` on every micro-batch.

    Each batch is written once under the checkpoint folder and read from there.  It owns the folder
    of its number there and in the output and overwrites them, so a batch that is
    replayed after a failure leaves no duplicates.

    With a ``GrowingIndex`` and ``reply_col``, messages that come with a reply become
    cases once their batch has been handled: batch n is handled against version n,
    and writes version n + 1.  A batch so finds the replies of all batches before it,
    as if their messages had been in the corpus.  Ids of messages and cases must not coincide.
    """
    grows = isinstance(index, GrowingIndex)
    if reply_col and not grows:
        raise ValueError("replies can only be added to a growing index")
    static = None if grows else index.written()

    def on_batch(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, f"{checkpoint}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(own)
        rows = spark.read.schema(batch.schema).parquet(own)
        handle(rows, index.at(number) if grows else static, classify, id_col, text_col, k, policy, draft).write.mode("overwrite").parquet(
            f"{output}/batch={number}")
        if grows:
            id_type = index.spark.read.parquet(index._folder("cases", 0)).schema[index.doc_id].dataType
            names = {index.doc_id: F.col(id_col).cast(id_type), "cust": clean_text(F.col(text_col)), "reply": F.col(reply_col) if reply_col else F.lit(None)}
            cases = rows.where(F.col(reply_col).isNotNull() if reply_col else F.lit(False)).select(*[c.alias(n) for n, c in names.items()])
            index.add(number, cases, "cust")

    writer = messages.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
