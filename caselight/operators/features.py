"""TF-IDF: vocabulary, weights in long form, vectors in array form, and the Spark ML stages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselight import config
from caselight.functions import tokens as K
from caselight.session import ensure_checkpoint_dir
from caselight.shipping import ship_by_value

ship_by_value(__name__)

_TOKENS = 2_000_000  # tokens counted at once inside a task


@dataclass(frozen=True)
class Vocabulary:
    """Fitted terms ``(term, idx, df, total, idf)`` and the settings they were fitted with."""

    frame: DataFrame
    max_features: int
    stop_words: tuple[str, ...] = ()
    ngrams: int = 2


def document_terms(docs: DataFrame, id_col: str, text_col: str, stop_words: Sequence[str] = (),
                   ngrams: int = 2) -> DataFrame:
    """``(id, term, tf)``; a document without terms keeps one row with a null term."""
    counts = K.term_counts(K.terms(F.col(text_col), stop_words, ngrams))
    return docs.select(F.col(id_col), F.inline_outer(counts))


def term_frequencies(docs: DataFrame, id_col: str, text_col: str, stop_words: Sequence[str] = (),
                     ngrams: int = 2) -> DataFrame:
    """``(term, df, total)`` over the corpus; tasks count numbered tokens, and a term is written out once per slice of rows."""
    tokens = K.kept_tokens(F.col(text_col), stop_words, ngrams).alias("tokens")
    return (docs.select(tokens).mapInArrow(_counted(ngrams), "term string, df long, total long")
            .groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")))


def _slices(lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """``(first row, tokens per row, tokens)`` of rows that hold a bounded number of tokens together, or of single ones."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, a = np.cumsum(lengths), 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _TOKENS, "right")))
        yield a, lengths[a:b], lists.slice(a, b - a).flatten()
        a = b


def _numbered_counts(owner: np.ndarray, number: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold each of ``size`` numbers, and how often all rows do."""
    held = np.unique(owner * size + number)
    return np.bincount(held % max(1, size), minlength=size), np.bincount(number, minlength=size)


def _counted(ngrams: int):
    """Terms of a slice of rows with their counts; bigrams are pairs of token numbers until each is named once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, lengths, tokens in _slices(batch.column(0)):
                coded = tokens.dictionary_encode()
                names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(lengths)), lengths)
                terms, counts = [names], [_numbered_counts(owner, code, len(names))]
                if ngrams == 2 and len(code) > 1:
                    together = owner[1:] == owner[:-1]
                    pairs, number = np.unique(code[:-1][together] * len(names) + code[1:][together], return_inverse=True)
                    left, right = (names.take(pa.array(x)) for x in np.divmod(pairs, len(names)))
                    terms.append(pc.binary_join_element_wise(left, right, " "))
                    counts.append(_numbered_counts(owner[1:][together], number, len(pairs)))
                df, total = (np.concatenate(x) for x in zip(*counts))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(terms), pa.array(df), pa.array(total)], ["term", "df", "total"])
    return run


def top_terms(frequencies: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent terms; ties go to the smaller term.

    A histogram of the counts' logarithm, a few dozen rows, first drops nearly all
    rare terms, so that the final sort does not meet ``n`` terms of every task.
    The drop is exact: terms go only when ``n`` others lie in higher buckets.
    """
    sized = frequencies.withColumn("_magnitude", F.floor(F.log2("total")))
    # df is read along, and comes first in the counts, so that histogram and filter share their shuffle
    histogram = sized.groupBy("_magnitude").agg(F.count(F.lit(1)).alias("_n"), F.sum("df").alias("_df"))
    above = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("_magnitude")).rowsBetween(Window.unboundedPreceding, -1)),
                       F.lit(0))
    cut = histogram.where("_df > 0").withColumn("_above", above).where(F.col("_above") < n).agg(F.min("_magnitude"))
    kept = sized.where(F.col("_magnitude") >= cut.scalar()).drop("_magnitude")
    return kept.orderBy(F.desc("total"), F.asc("term")).limit(n)


def smooth_idf(n: Column, df: Column) -> Column:
    return F.ln((1 + n) / (1 + df)) + 1


def fit_vocabulary(docs: DataFrame, id_col: str, text_col: str, max_features: int = config.MAX_FEATURES,
                   stop_words: Sequence[str] = (), ngrams: int = 2) -> Vocabulary:
    """Terms, document frequencies and smoothed idf; written to the shared checkpoint once, then reused."""
    ensure_checkpoint_dir(docs.sparkSession)
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    kept = top_terms(term_frequencies(docs, id_col, text_col, stop_words, ngrams), max_features)
    # the numbering window sees at most max_features rows
    frame = kept.select(
        "term", (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"), "df", "total",
        smooth_idf(n, F.col("df")).alias("idf"))
    return Vocabulary(frame.checkpoint(), max_features, tuple(stop_words), ngrams)


def tfidf_weights(docs: DataFrame, id_col: str, text_col: str, vocabulary: Vocabulary) -> DataFrame:
    """Long form ``(id, term, tf, weight)``; unknown terms are dropped.  Map-only; tasks hold the bounded vocabulary."""
    kept = [docs.schema[id_col], *T.StructType.fromDDL("term string, tf int, weight double").fields]
    known = vocabulary.frame.select("term", "idf").orderBy("idx").toArrow()
    if not known.num_rows:
        return docs.sparkSession.createDataFrame([], T.StructType(kept))
    tokens = K.kept_tokens(F.coalesce(F.col(text_col), F.lit("")), vocabulary.stop_words, vocabulary.ngrams)
    weighted = _Weighted(known.column("term").to_pylist(), known.column("idf").to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(weighted.terms, pa.string())
        for batch in batches:
            for first, lengths, found in _slices(batch.column(1)):
                owner, term, tf, weight = weighted.entries(lengths, found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner + first)), names.take(pa.array(term)), pa.array(tf.astype(np.int32)), pa.array(weight)],
                    [id_col, "term", "tf", "weight"])

    return docs.select(id_col, tokens.alias("_tokens")).mapInArrow(run, T.StructType(kept))


class _Weighted:
    """Known terms as numbers and pairs of numbers, to weigh the tokens of many rows at once."""

    def __init__(self, terms: Sequence[str], idf: np.ndarray):
        self.terms, self.idf = list(terms), np.asarray(idf)
        parts = [t.split(" ") for t in self.terms]
        self.words = sorted({w for p in parts for w in p})
        number = {w: i for i, w in enumerate(self.words)}
        self.single = np.full(len(self.words), -1)
        pairs = []
        for at, part in enumerate(parts):
            if len(part) == 1:
                self.single[number[part[0]]] = at
            else:
                pairs.append((number[part[0]] * len(self.words) + number[part[1]], at))
        self.pair_keys, self.pair_terms = np.array(sorted(pairs), np.int64).reshape(-1, 2).T

    def entries(self, lengths: np.ndarray, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(row, term, tf, weight)`` by row and term; the weights of a row have length 1."""
        code = pc.fill_null(pc.index_in(tokens, pa.array(self.words, pa.string())), -1).to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        one = np.where(code >= 0, self.single[code], -1)
        found = [owner[one >= 0] * len(self.terms) + one[one >= 0]]
        if len(self.pair_keys) and len(code) > 1:
            both = np.flatnonzero((owner[1:] == owner[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0))
            key = code[both] * len(self.words) + code[both + 1]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            known = self.pair_keys[at] == key
            found.append(owner[both[known]] * len(self.terms) + self.pair_terms[at[known]])
        entry, tf = np.unique(np.concatenate(found), return_counts=True)
        row, term = np.divmod(entry, len(self.terms))
        raw = tf * self.idf[term]
        return row, term, tf, raw / np.sqrt(np.bincount(row, weights=raw * raw, minlength=len(lengths)))[row]


def tfidf_stages(vocabulary: Vocabulary, input_col: str = "terms", output_col: str = "features") -> PipelineModel:
    """The same weights as Spark ML stages over an array-of-terms column; no shuffle.

    Spark's own IDF lacks the +1, so counts are scaled by the fitted idf.  At most
    ``max_features`` terms are read to the driver, which is what the stage holds.
    """
    idf = {r["term"]: r["idf"] for r in vocabulary.frame.select("term", "idf").collect()}
    if not idf:
        raise ValueError("the corpus has no terms")
    # fitting on one row that holds every term once keeps the list inside the JVM; the stage picks its own order
    every = vocabulary.frame.agg(F.collect_list("term").alias(input_col))
    counts = CountVectorizer(inputCol=input_col, outputCol="_counts", vocabSize=len(idf)).fit(every)
    scale = ElementwiseProduct(scalingVec=Vectors.dense([idf[t] for t in counts.vocabulary]), inputCol="_counts",
                               outputCol="_scaled")
    return PipelineModel([counts, scale, Normalizer(p=2.0, inputCol="_scaled", outputCol=output_col)])


def tfidf_vectors(docs: DataFrame, id_col: str, text_col: str, vocabulary: Vocabulary, stages: PipelineModel,
                  payload: Sequence[str] = ()) -> DataFrame:
    """``(id, features, *payload)``: one sparse unit vector per row; no known term gives the zero vector."""
    return stages.transform(with_terms(docs, text_col, vocabulary)).select(id_col, "features", *payload)


def with_terms(docs: DataFrame, text_col: str, vocabulary: Vocabulary, output_col: str = "terms") -> DataFrame:
    terms = K.terms(F.coalesce(F.col(text_col), F.lit("")), vocabulary.stop_words, vocabulary.ngrams)
    return docs.withColumn(output_col, terms)


def merged_partitions(features: DataFrame, rows: int, at_least: int = 10_000) -> DataFrame:
    """Merge near-empty partitions before an iterative fit, which runs one job over all of them per step: a task has ``at_least`` rows if there are."""
    return features.coalesce(max(1, rows // at_least))
