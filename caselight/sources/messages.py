"""Scans and sinks.  CSV columns are read as declared; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_MESSAGES = ("tweet_id string, author_id string, inbound string, created_at string, text string, "
                "response_tweet_id string, in_response_to_tweet_id string")
GOLDEN = ("tweet_id string, cust_text string, true_intent string, should_escalate boolean, escalate_reason string, "
          "ideal_reply_notes string, labeler_notes string, source string")
TUNING = "tuning_id string, cust_text string, true_intent string, should_escalate boolean, label_reason string"
HUMAN_RATINGS = ("tweet_id string, cust_text string, human_groundedness int, human_correctness int, "
                 "human_brand_voice int, human_actionability int, human_safety int")

_CSV = {"header": True, "quote": '"', "escape": '"'}


def scan_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Header row, quoted line breaks, doubled quotes.

    A file with quoted line breaks cannot be split, so one file is one task: bring
    a large table as many files, or, if no text holds a line break, read it with
    ``multi_line=False``, which splits large files.
    """
    return spark.read.schema(schema).options(multiLine=multi_line, **_CSV).csv(path)


def scan_messages(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The thread table, every column a nullable string."""
    return scan_csv(spark, path, RAW_MESSAGES, multi_line)


def scan_labelled(spark: SparkSession, path: str, schema: str = GOLDEN, multi_line: bool = True) -> DataFrame:
    return scan_csv(spark, path, schema, multi_line)


def scan_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_pairs(pairs: DataFrame, path: str, mode: str = "overwrite") -> None:
    pairs.write.mode(mode).parquet(path)


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Drafts, scores or messages.  An empty text comes back as null, as CSV readers commonly have it."""
    rows.write.mode(mode).options(header=True, quote='"', escape='"').csv(path)


def write_metrics_json(document: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row nested document as JSON text."""
    (document.select(F.to_json(F.struct(*document.columns), {"ignoreNullFields": "false"}).alias("value"))
     .write.mode(mode).text(path))
