"""An index of past cases that grows while a stream runs.

Every version adds one folder of cases with their terms (read once, never
rewritten), and has the document frequencies of all cases up to it.  The state of a version is
written last, so a version either is whole or does not exist; a batch that is replayed
overwrites its own version and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselight import config
from caselight.functions import tokens as K
from caselight.operators.blocks import Size
from caselight.operators.features import Vocabulary, smooth_idf, tfidf_stages, top_terms
from caselight.operators.retrieval import SparseIndex
from caselight.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class GrowingIndex:
    """Cases under ``path``, a shared folder; ``merge_every`` versions their cases are written together."""

    spark: SparkSession
    path: str
    doc_id: str
    payload: tuple[str, ...]
    max_features: int = config.MAX_FEATURES
    stop_words: tuple[str, ...] = ()
    ngrams: int = 2
    merge_every: int = 20

    @classmethod
    def start(cls, corpus: DataFrame, doc_id: str, text_col: str, path: str, payload: Sequence[str] = (), **settings) -> "GrowingIndex":
        """Version 0, from the cases known before the stream."""
        index = cls(corpus.sparkSession, path, doc_id, tuple(payload), **settings)
        index._write(0, corpus, text_col, None)
        return index

    def add(self, version: int, cases: DataFrame, text_col: str) -> None:
        """Write version ``version + 1``: the cases of ``version`` and these, with the columns of the corpus."""
        self._write(version + 1, cases, text_col, version)

    def _folder(self, kind: str, version: int) -> str:
        return f"{self.path}/{kind}/version={version}"

    def _write(self, version: int, cases: DataFrame, text_col: str, before: int | None) -> None:
        terms = K.terms(F.coalesce(F.col(text_col), F.lit("")), self.stop_words, self.ngrams)
        own = self._folder("cases", version)
        cases.select(self.doc_id, *self.payload, terms.alias("_terms")).write.mode("overwrite").parquet(own)
        new = self.spark.read.parquet(own)
        counts = new.select(F.inline(K.term_counts(F.col("_terms")))).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
        rows, folders = new.count(), [version]
        if before is not None:
            state = self.state(before)
            counts = counts.unionByName(self.spark.read.parquet(self._folder("terms", before))).groupBy("term").agg(
                F.sum("df").alias("df"), F.sum("total").alias("total"))
            rows, folders = rows + state["rows"], [*state["folders"], version]
        if len(folders) > self.merge_every:
            merged = self._folder("merged", version)
            self._cases(folders).write.mode("overwrite").parquet(merged)
            folders = [-version]  # one folder in place of all so far
        counts.write.mode("overwrite").parquet(self._folder("terms", version))
        self.spark.createDataFrame([(rows, folders)], "rows long, folders array<int>").coalesce(1).write.mode("overwrite").parquet(self._folder("state", version))

    def state(self, version: int):
        """``(rows, folders)`` of a version: how many cases, and where they lie (below zero: written together)."""
        return self.spark.read.parquet(self._folder("state", version)).first()

    def _cases(self, folders: Sequence[int]) -> DataFrame:
        return self.spark.read.parquet(*[self._folder("merged" if f < 0 else "cases", abs(f)) for f in folders])

    def at(self, version: int) -> SparseIndex:
        """The index of a version: what ``fit_index`` gives for all its cases together."""
        ensure_checkpoint_dir(self.spark)
        state = self.state(version)
        kept = top_terms(self.spark.read.parquet(self._folder("terms", version)), self.max_features)
        frame = kept.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"), "df", "total",  # at most max_features rows
                            smooth_idf(F.lit(state["rows"]), F.col("df")).alias("idf")).checkpoint()
        vocabulary = Vocabulary(frame, self.max_features, self.stop_words, self.ngrams)
        stages = tfidf_stages(vocabulary, "_terms")
        vectors = stages.transform(self._cases(state["folders"])).select(self.doc_id, "features", *self.payload)
        entries = frame.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        # the search makes query vectors from a column of another name
        return SparseIndex(vectors, vocabulary, tfidf_stages(vocabulary), Size(state["rows"], entries), self.doc_id, self.payload)
