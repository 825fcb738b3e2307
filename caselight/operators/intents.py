"""Intent classification: majority floor, TF-IDF + logistic regression, fixed linear scoring."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, StopWordsRemover, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight import config
from caselight.operators.blocks import sparse_parts
from caselight.operators.features import Vocabulary, fit_vocabulary, merged_partitions, tfidf_stages, with_terms
from caselight.shipping import ship_by_value

ship_by_value(__name__)


# --- floor ----------------------------------------------------------------------

def majority_label(labelled: DataFrame, label: str) -> DataFrame:
    """One row: the most frequent label; ties go to the smaller label."""
    return (labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(label)).limit(1))


def predict_majority(train: DataFrame, label: str, rows: DataFrame, output: str = "predicted") -> DataFrame:
    """The majority label on every row, as a scalar subquery instead of a join."""
    return rows.withColumn(output, majority_label(train, label).select(label).scalar())


# --- TF-IDF + logistic regression -------------------------------------------------

@dataclass(frozen=True)
class IntentModel:
    """Fitted stages plus what is needed to turn a text into their input."""

    stages: PipelineModel
    stop_words: tuple[str, ...]
    ngrams: int
    text_col: str

    def predict(self, rows: DataFrame, text_col: str | None = None) -> DataFrame:
        """Rows plus ``intent`` and ``confidence`` (the largest class probability)."""
        settings = Vocabulary(None, 0, self.stop_words, self.ngrams)
        scored = self.stages.transform(with_terms(rows, text_col or self.text_col, settings, "_terms"))
        return scored.select(*rows.columns, F.col("_intent").alias("intent"),
                             F.array_max(vector_to_array("_probability")).alias("confidence"))

    def save(self, path: str, spark: SparkSession) -> None:
        self.stages.write().overwrite().save(f"{path}/stages")
        settings = (" ".join(self.stop_words), self.ngrams, self.text_col)
        spark.createDataFrame([settings], "stop_words string, ngrams int, text_col string").write.mode(
            "overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "IntentModel":
        settings = spark.read.parquet(f"{path}/settings").first()
        return cls(PipelineModel.load(f"{path}/stages"), tuple(settings["stop_words"].split()),
                   settings["ngrams"], settings["text_col"])


def english_stop_words() -> tuple[str, ...]:
    return tuple(w for w in StopWordsRemover.loadDefaultStopWords("english") if "'" not in w)


def balanced_weights(labelled: DataFrame, label: str) -> DataFrame:
    """``(label, n, weight)`` with weight = n / (number of labels * rows of the label); sums to n over the rows."""
    counts = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg((F.sum("n") / F.count(F.lit(1))).alias("share")).scalar()
    return counts.select(label, "n", (totals / F.col("n")).alias("weight"))


def fit_intent_model(train: DataFrame, id_col: str, text_col: str, label: str,
                     max_features: int = config.MAX_FEATURES, stop_words: Sequence[str] | None = None,
                     ngrams: int = 2, c: float = 1.0, max_iter: int = 1000, tol: float = 1e-9) -> IntentModel:
    """TF-IDF features and L2 logistic regression with balanced class weights.

    Spark divides the loss by the weight sum, which is n here, so the penalty is
    1 / (c n).  One label alone cannot be fitted and raises.
    """
    stop_words = english_stop_words() if stop_words is None else tuple(stop_words)
    weights = balanced_weights(train, label).collect()  # one row per label
    if len(weights) < 2:
        raise ValueError("training needs at least two labels")
    weight = F.lit(0.0)
    for row in weights:
        weight = F.when(F.col(label) == row[label], F.lit(row["weight"])).otherwise(weight)
    vocabulary = fit_vocabulary(train, id_col, text_col, max_features, stop_words, ngrams)
    features = tfidf_stages(vocabulary, "_terms", "_features")
    # the labels are known from the weights; Spark orders them by code point, as Python does
    indexer = StringIndexerModel.from_labels(sorted(str(row[label]) for row in weights), label, "_label")
    ready = features.transform(with_terms(train, text_col, vocabulary, "_terms"))
    rows = sum(row["n"] for row in weights)
    ready = merged_partitions(indexer.transform(ready).select("_features", "_label", weight.alias("_weight")),
                            rows).persist()
    try:
        regression = LogisticRegression(
            featuresCol="_features", labelCol="_label", weightCol="_weight", predictionCol="_prediction",
            probabilityCol="_probability", rawPredictionCol="_raw", regParam=1.0 / (c * rows),
            elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol).fit(ready)
    finally:
        ready.unpersist()
    naming = IndexToString(inputCol="_prediction", outputCol="_intent", labels=indexer.labels)
    return IntentModel(PipelineModel([*features.stages, regression, naming]), stop_words, ngrams, text_col)


def _slopes(width: int, classes: int):
    """Per task, the part of the gradient and of the loss that its rows make, as one row per class and term touched."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope, bias, loss, rows = np.zeros((classes, width)), np.zeros(classes), 0.0, 0
        for batch in batches:
            lengths, terms, values = sparse_parts(pa.table({"features": batch.column(0)}))
            chance = batch.column(1).flatten().to_numpy().reshape(len(batch), -1)
            weight, label = batch.column(2).to_numpy(), batch.column(3).to_numpy().astype(np.int64)
            loss -= (weight * np.log(np.maximum(chance[np.arange(len(batch)), label], 1e-300))).sum()
            off = chance.copy()
            off[np.arange(len(batch)), label] -= 1.0
            off = (off[:, -classes:] if classes > 1 else off[:, 1:]) * weight[:, None]
            bias, rows = bias + off.sum(0), rows + len(batch)
            owner = np.repeat(np.arange(len(batch)), lengths)
            for c in range(classes):
                slope[c] += np.bincount(terms, weights=off[owner, c] * values, minlength=width)
        at, term = np.nonzero(slope)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([at, np.arange(classes)]).astype(np.int32)), pa.array(np.concatenate([term, np.full(classes, -1)]).astype(np.int32)),
             pa.array(np.concatenate([slope[at, term], bias])), pa.array([0.0] * len(at) + [loss] + [0.0] * (classes - 1)),
             pa.array([0] * len(at) + [rows] + [0] * (classes - 1), pa.int64())], ["class", "term", "slope", "loss", "rows"])
    return run


def fit_certificate(model: IntentModel, train: DataFrame, label: str, c: float = 1.0, text_col: str | None = None) -> DataFrame:
    """One row ``(n, objective, gradient)``: how far the model is from the only optimum on these training rows.

    The objective is the mean of weight times loss plus the squared coefficients over
    ``2 c n``; it is strictly convex in the coefficients, so a largest slope of
    zero over all labels and terms (``gradient``) proves the fit.  One pass over the rows; tasks send
    sums per label and term of the bounded vocabulary.
    """
    regression, names = model.stages.stages[-2], model.stages.stages[-1].getLabels()
    coefficients = regression.coefficientMatrix.toArray()
    classes, width = coefficients.shape
    weights = {str(r[label]): r["weight"] for r in balanced_weights(train, label).collect()}  # one row per label
    number, weight = F.lit(None).cast("int"), F.lit(None).cast("double")
    for at, name in enumerate(names):
        number = F.when(F.col(label).cast("string") == name, F.lit(at)).otherwise(number)
        weight = F.when(F.col(label).cast("string") == name, F.lit(weights[name])).otherwise(weight)
    settings = Vocabulary(None, 0, model.stop_words, model.ngrams)
    ready = model.stages.transform(with_terms(train, text_col or model.text_col, settings, "_terms")).select(
        "_features", vector_to_array("_probability").alias("_chance"), weight.alias("_weight"), number.alias("_label"))
    parts = ready.mapInArrow(_slopes(width, classes), "class int, term int, slope double, loss double, rows long")
    sums = parts.groupBy("class", "term").agg(*[F.sum(x).alias(x) for x in ("slope", "loss", "rows")]).toArrow()  # classes * width at most
    n = sum(sums.column("rows").to_pylist())
    slope, bias = np.zeros((classes, width)), np.zeros(classes)
    at, term, value = (sums.column(x).to_numpy() for x in ("class", "term", "slope"))
    slope[at[term >= 0], term[term >= 0]] = value[term >= 0]
    bias[at[term < 0]] = value[term < 0]
    gradient = max(np.abs(slope / n + coefficients / (c * n)).max(), np.abs(bias / n).max())
    objective = sum(sums.column("loss").to_pylist()) / n + (coefficients ** 2).sum() / (2 * c * n)
    return train.sparkSession.createDataFrame([(n, float(objective), float(gradient))], "n long, objective double, gradient double")


# --- fixed coefficients ------------------------------------------------------------

def score_linear(features: DataFrame, id_col: str, coefficients: DataFrame, intercepts: dict[str, float],
                 value_col: str = "weight") -> DataFrame:
    """``(id, intent, confidence)`` from long features ``(id, term, value)`` and ``(term, label, coefficient)``.

    The coefficient table is one row per vocabulary term and label; Spark broadcasts
    it or not by its measured size.
    """
    labels = sorted(intercepts)
    wide = coefficients.groupBy("term").pivot("label", labels).agg(F.first("coefficient"))
    joined = features.join(wide, "term", "left")
    logits = joined.groupBy(id_col).agg(*[
        (F.lit(float(intercepts[l])) + F.coalesce(F.sum(F.col(value_col) * F.col(f"`{l}`")), F.lit(0.0)))
        .alias(f"_z{i}") for i, l in enumerate(labels)])
    return _softmax(logits, id_col, labels)


def _softmax(logits: DataFrame, id_col: str, labels: Sequence[str]) -> DataFrame:
    z = [F.col(f"_z{i}") for i in range(len(labels))]
    top = F.greatest(*z) if len(z) > 1 else z[0]
    total = sum((F.exp(c - F.col("_top")) for c in z[1:]), F.exp(z[0] - F.col("_top")))
    intent = F.coalesce(*[F.when(c == F.col("_top"), F.lit(l)) for c, l in zip(z, labels)])
    return (logits.withColumn("_top", top)
            .select(id_col, intent.alias("intent"), (F.lit(1.0) / total).alias("confidence")))
