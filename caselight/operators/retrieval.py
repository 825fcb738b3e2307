"""Similar past cases: exact top-k by TF-IDF cosine or by dense vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight import config
from caselight.operators.blocks import Limits, Size, block_top_k, text_size, usable, usual_width, vector_size
from caselight.operators.features import Vocabulary, fit_vocabulary, tfidf_stages, tfidf_vectors
from caselight.operators.impact import impact_top_k
from caselight.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class SparseIndex:
    """A corpus turned into TF-IDF vectors, with the columns to return for a hit."""

    vectors: DataFrame
    vocabulary: Vocabulary
    stages: PipelineModel
    size: Size
    doc_id: str
    payload: tuple[str, ...]

    @property
    def width(self) -> int:
        """Length of the vectors: the terms of the fitted stage."""
        return len(self.stages.stages[0].vocabulary)

    def written(self) -> "SparseIndex":
        """The same index read back from the shared checkpoint; for use over many batches."""
        ensure_checkpoint_dir(self.vectors.sparkSession)
        return replace(self, vectors=self.vectors.checkpoint())


def fit_index(corpus: DataFrame, doc_id: str, text_col: str, payload: Sequence[str] = (),
              max_features: int = config.MAX_FEATURES, stop_words: Sequence[str] = (),
              ngrams: int = 2) -> SparseIndex:
    vocabulary = fit_vocabulary(corpus, doc_id, text_col, max_features, stop_words, ngrams)
    stages = tfidf_stages(vocabulary)
    vectors = tfidf_vectors(corpus, doc_id, text_col, vocabulary, stages, payload)
    # documents per term add up to the entries of all vectors
    entries = vocabulary.frame.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    return SparseIndex(vectors, vocabulary, stages, Size(corpus.count(), entries), doc_id, tuple(payload))


def search(index: SparseIndex, queries: DataFrame, query_id: str, text_col: str, k: int = config.TOP_K,
           pad: bool = True, query_size: Size | None = None, limits: Limits | None = None) -> DataFrame:
    """``(query_id, rank, doc_id, score, *payload)``; without ``pad`` hits of score zero are left out.

    ``query_size`` spares the pass that measures the queries; ``limits`` is the size of a block.
    """
    vectors = tfidf_vectors(queries, query_id, text_col, index.vocabulary, index.stages)
    hits = block_top_k(vectors, index.vectors, k, "sparse", query_id, index.doc_id,
                       query_size or text_size(queries, text_col), index.size, index.payload, index.width, limits)
    return hits if pad else hits.where(F.col("score") > 0)


def retrieve_sparse(queries: DataFrame, corpus: DataFrame, query_id: str, query_text: str, doc_id: str,
                    doc_text: str, k: int = config.TOP_K, payload: Sequence[str] = (), pad: bool = True,
                    max_features: int = config.MAX_FEATURES, ngrams: int = 2, limits: Limits | None = None) -> DataFrame:
    return search(fit_index(corpus, doc_id, doc_text, payload, max_features, (), ngrams),
                  queries, query_id, query_text, k, pad, limits=limits)


def entries_read(index: SparseIndex, queries: DataFrame, query_id: str, text_col: str, limits: Limits,
                 k: int = config.TOP_K) -> DataFrame:
    """One row ``(held, read)``: vector entries that share a term with a query, and those the pruned search reads or probes."""
    vectors = tfidf_vectors(queries, query_id, text_col, index.vocabulary, index.stages)
    return impact_top_k(vectors, index.vectors, k, query_id, index.doc_id, text_size(queries, text_col), index.size, index.width, limits, True)


def retrieve_dense(queries: DataFrame, corpus: DataFrame, query_id: str, query_vector: str, doc_id: str,
                   doc_vector: str, k: int = config.TOP_K, payload: Sequence[str] = (), limits: Limits | None = None) -> DataFrame:
    """Inner product of L2-normalised vectors, exact flat search.

    The usual length of the corpus vectors is the width; a row of either side whose vector is
    null, of another length or holds null, NaN or infinity takes no part and has no hits.
    """
    right = corpus.select(doc_id, F.col(doc_vector).alias("features"), *payload)
    width = usual_width(right, "features")
    left = usable(queries.select(query_id, F.col(query_vector).alias("features")), "features", width)
    right = usable(right, "features", width)
    return block_top_k(left, right, k, "dense", query_id, doc_id, vector_size(left, "features"),
                       vector_size(right, "features"), payload, width, limits)


def top1_scores(queries: DataFrame, hits: DataFrame, query_id: str) -> DataFrame:
    """Every query with the score of its first hit, 0.0 when it has none."""
    best = hits.where(F.col("rank") == 1).select(query_id, F.col("score").alias("_best"))
    return (queries.select(query_id).join(best, query_id, "left")
            .select(query_id, F.coalesce("_best", F.lit(0.0)).alias("top1_score")))


def hits_as_array(hits: DataFrame, query_id: str, doc_id: str, payload: Sequence[str]) -> DataFrame:
    """``(query_id, hits array<struct<rank, doc_id, *payload, score>>)``; at most k per query."""
    entry = F.struct("rank", F.col(doc_id).alias("doc_id"), *payload, "score")
    return hits.groupBy(query_id).agg(F.sort_array(F.collect_list(entry)).alias("hits"))
