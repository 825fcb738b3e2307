"""From raw documents to token ids: language, near duplicates, benchmark passages, personal data, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm import decontaminate, language, neardup, pieces, privacy
from caselight.llm.links import settled
from caselight.llm.queries import remainder
from caselight.session import scratch_dir


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any identifiable language go.

    A null or empty text and one without a letter has none.  Null ids, repeated rows and long texts are
    judged row by row like any other; an empty table gives none; further columns stay.
    """
    model = language.fit_languages(docs.where(remainder("doc_id", 4) != 2))
    return language.keep_identified(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays; see ``neardup.keep_first`` for nulls, repeats and other columns."""
    return neardup.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Rows go by id: all rows of an id of which one text holds an item.  Null and empty texts hold none; a row
    with a null id stays; long texts are searched whole; an empty table gives none; further columns stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    held = settled(decontaminate.find_contained(docs, items).select("doc_id").distinct())
    return docs.join(held, "doc_id", "left_anti").select(*docs.columns)


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the texts; every document stays.

    Null and empty texts, null ids, repeated rows and further columns stay as they are; ``n_chars``, if there,
    is counted again; an empty table gives none.
    """
    clean = privacy.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the text decoded from them.

    A null text counts as empty; null ids and repeated rows stay; other columns are not returned.
    """
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True).drop("decoded")


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("private_data", privacy_stage),
    ("piece_codec", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


ORACLE_SQL = None  # no stage can be written in SQL; tests compare with brute force
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
