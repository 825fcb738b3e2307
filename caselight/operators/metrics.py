"""Evaluation: label metrics, binary metrics, threshold sweep, judge means and rank agreement."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from caselight import config
from caselight.config import Grid, Policy
from caselight.functions import policy as P
from caselight.operators.ordering import running_totals
from caselight.session import ensure_checkpoint_dir
from caselight.shipping import ship_by_value


ship_by_value(__name__)


def ratio(top: Column, bottom: Column) -> Column:
    """0/0 counts as 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(F.try_divide(top, bottom))


def f1(hits: Column, predicted: Column, true: Column) -> Column:
    return ratio(2.0 * hits, predicted + true)


# --- label metrics ------------------------------------------------------------------

def label_pairs(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    """Counts per (true, predicted); everything below works on these few rows."""
    return rows.groupBy(F.col(true).alias("true"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def label_counts(pairs: DataFrame) -> DataFrame:
    """``(label, support, predicted, hits)`` over every label seen as true or predicted."""
    hit = F.when(F.col("true") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    roles = F.array(
        F.struct(F.col("true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 hit.alias("hits")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")))
    return (pairs.select(F.inline(roles)).groupBy("label")
            .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")]))


def accuracy_macro_f1(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    """One row: share of equal labels, and the plain mean of F1 over the labels seen."""
    return label_counts(label_pairs(rows, true, predicted)).agg(
        ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg(f1(F.col("hits"), F.col("predicted"), F.col("support"))).alias("macro_f1"))


def classification_report(rows: DataFrame, true: str, predicted: str,
                          labels: Sequence[str] = config.LABELS) -> DataFrame:
    """Per-label rows for a fixed label list, then accuracy (or micro), macro and weighted averages."""
    spark = rows.sparkSession
    fixed = spark.createDataFrame([(l,) for l in labels], "label string").withColumn("fixed", F.lit(True))
    counts = fixed.join(label_counts(label_pairs(rows, true, predicted)), "label", "full").select(
        "label", F.coalesce("fixed", F.lit(False)).alias("fixed"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "predicted", "hits")])
    scored = counts.select("*", ratio(F.col("hits"), F.col("predicted")).alias("precision"),
                           ratio(F.col("hits"), F.col("support")).alias("recall"),
                           f1(F.col("hits"), F.col("predicted"), F.col("support")).alias("f1"))
    per_label = scored.where("fixed").select("label", "precision", "recall", "f1", "support")

    listed = scored.where("fixed")
    covers = scored.agg(F.coalesce(F.min("fixed"), F.lit(True))).scalar()
    measures = ("precision", "recall", "f1")
    micro = listed.agg(
        ratio(F.sum("hits"), F.sum("predicted")).alias("precision"),
        ratio(F.sum("hits"), F.sum("support")).alias("recall"),
        f1(F.sum("hits"), F.sum("predicted"), F.sum("support")).alias("f1"), F.sum("support").alias("support"),
    ).select(F.when(covers, F.lit("accuracy")).otherwise(F.lit("micro avg")).alias("label"), *measures, "support")
    macro = listed.agg(*[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support")).select(
        F.lit("macro avg").alias("label"), *measures, "support")
    weighted = listed.agg(*[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures],
                          F.sum("support").alias("support")).select(
        F.lit("weighted avg").alias("label"), *measures, "support")
    return per_label.unionByName(micro).unionByName(macro).unionByName(weighted)


def confusion_matrix(rows: DataFrame, true: str, predicted: str, labels: Sequence[str] = config.LABELS) -> DataFrame:
    """Dense ``(true_ord, true, pred_ord, predicted, n)`` over a fixed, ordered label list."""
    spark = rows.sparkSession
    cells = [(i, a, j, b) for i, a in enumerate(labels) for j, b in enumerate(labels)]
    dense = spark.createDataFrame(cells, "true_ord int, true string, pred_ord int, predicted string")
    return dense.join(label_pairs(rows, true, predicted), ["true", "predicted"], "left").select(
        "true_ord", "true", "pred_ord", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_pivot(matrix: DataFrame, labels: Sequence[str] = config.LABELS) -> DataFrame:
    """The same matrix with one column per predicted label."""
    return matrix.groupBy("true_ord", "true").pivot("predicted", list(labels)).agg(F.sum("n"))


def source_counts(rows: DataFrame, source: str = "source") -> DataFrame:
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("n"))


# --- binary metrics -------------------------------------------------------------------

def binary_prf(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    """One row: precision, recall, F1, and how many are and are called positive."""
    t, p = F.col(true), F.col(predicted)
    return rows.agg(F.count_if(t & p).alias("_hits"), F.count_if(t).alias("n_true"),
                    F.count_if(p).alias("n_predicted")).select(
        ratio(F.col("_hits"), F.col("n_predicted")).alias("precision"),
        ratio(F.col("_hits"), F.col("n_true")).alias("recall"),
        f1(F.col("_hits"), F.col("n_predicted"), F.col("n_true")).alias("f1"), "n_true", "n_predicted")


def false_negatives(rows: DataFrame, true: str, predicted: str) -> DataFrame:
    return rows.where(F.col(true) & ~F.col(predicted))


def threshold_grid(rows: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Every row once per grid point, for use on small or already grouped rows."""
    points = F.array(*[F.struct(F.lit(c).alias("confidence_threshold"), F.lit(r).alias("retrieval_threshold"))
                       for c in grid.confidence for r in grid.retrieval])
    return rows.select("*", F.inline(points))


def _passed(score: Column, thresholds: Sequence[float]) -> Column:
    """How many thresholds the score reaches."""
    score = F.coalesce(score, F.lit(0.0))
    return reduce(lambda a, b: a + b, [(score >= F.lit(t)).cast("int") for t in thresholds])


def threshold_sweep(scored: DataFrame, true: str, text: str, intent: str, confidence: str, top1: str, negative: str,
                    grid: Grid = Grid(), policy: Policy = Policy()) -> DataFrame:
    """Precision, recall and F1 of the policy at every grid point.

    A row matters only through (truth, escalates anyway, thresholds passed on each
    axis), so rows are first counted in those cells (at most 144 for a 5 x 5
    grid) and only the cells meet the grid.
    """
    c_grid, r_grid = sorted(grid.confidence), sorted(grid.retrieval)
    cells = scored.groupBy(
        F.col(true).alias("true"),
        P.unconditional(F.col(text), F.col(intent), F.col(negative), policy).alias("always"),
        _passed(F.col(confidence), c_grid).alias("c_passed"),
        _passed(F.col(top1), r_grid).alias("r_passed")).agg(F.count(F.lit(1)).alias("n"))
    at = threshold_grid(cells, Grid(tuple(c_grid), tuple(r_grid)))
    c_needed = _passed(F.col("confidence_threshold"), c_grid)
    r_needed = _passed(F.col("retrieval_threshold"), r_grid)
    escalates = F.col("always") | (F.col("c_passed") < c_needed) | (F.col("r_passed") < r_needed)
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))
    counts = at.withColumn("called", escalates).groupBy("confidence_threshold", "retrieval_threshold").agg(
        total(F.col("true") & F.col("called")).alias("hits"), total(F.col("true")).alias("n_true"),
        total(F.col("called")).alias("n_called"))
    return counts.select(
        "confidence_threshold", "retrieval_threshold",
        F.round(ratio(F.col("hits"), F.col("n_called")), 3).alias("precision"),
        F.round(ratio(F.col("hits"), F.col("n_true")), 3).alias("recall"),
        F.round(f1(F.col("hits"), F.col("n_called"), F.col("n_true")), 3).alias("f1"))


# --- judge -------------------------------------------------------------------------------

def judge_means(scores: DataFrame, axes: Sequence[str] = config.JUDGE_AXES) -> DataFrame:
    """One row: the mean of each axis over its non-null grades, and the rows scored."""
    return scores.agg(*[F.avg(a).alias(a) for a in axes], F.count(F.lit(1)).alias("n_scored"))


def ratings_join(judge: DataFrame, human: DataFrame, key: str = "tweet_id") -> DataFrame:
    """Judge and human grades of the same item; shared columns other than the key get a suffix."""
    shared = (set(judge.columns) & set(human.columns)) - {key}
    left = judge.withColumnsRenamed({c: f"{c}_judge" for c in shared})
    right = human.withColumnsRenamed({c: f"{c}_human" for c in shared})
    return left.join(right, key)


def spearman_by_axis(merged: DataFrame, axes: Sequence[str] = config.JUDGE_AXES,
                     prefix: str = "human_") -> DataFrame:
    """``(axis, spearman_rho, p_value, n)`` for axes with more than two complete pairs; average ranks on ties.

    Grades are counted per (axis, judge, human) first, so ranking works on the
    distinct grades of the scale and not on the rows; these may be many as well, and
    are ranked range by range (``running_totals``), never an axis in one task.
    """
    both = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("j"),
                              F.col(prefix + a).cast("double").alias("h")) for a in axes])
    cells = (merged.select(F.inline(both)).where(F.col("j").isNotNull() & F.col("h").isNotNull())
             .groupBy("axis", "j", "h").agg(F.count(F.lit(1)).alias("n")))

    ensure_checkpoint_dir(merged.sparkSession)
    cells = cells.checkpoint()
    totals = cells.groupBy("axis").agg(F.sum("n").alias("_total"))  # one row per axis

    def centred_ranks(side: str) -> DataFrame:
        grades = running_totals(cells.groupBy("axis", side).agg(F.sum("n").alias("c")), ["axis"], side, "c", "_below")
        return grades.join(F.broadcast(totals), "axis").select(
            "axis", side, (F.col("_below") + (F.col("c") + 1) / 2 - (F.col("_total") + 1) / 2).alias(f"r{side}"))

    ranked = cells.join(centred_ranks("j"), ["axis", "j"]).join(centred_ranks("h"), ["axis", "h"])
    weighted = lambda c: F.sum(F.col("n") * c)
    sums = ranked.groupBy("axis").agg(
        F.sum("n").alias("n"), weighted(F.col("rj") * F.col("rh")).alias("xy"),
        weighted(F.col("rj") * F.col("rj")).alias("xx"), weighted(F.col("rh") * F.col("rh")).alias("yy"))
    # constant grades have no correlation
    rho = F.when((F.col("xx") == 0) | (F.col("yy") == 0), F.lit(float("nan"))).otherwise(
        F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))))
    return (sums.where(F.col("n") > 2).select("axis", rho.alias("spearman_rho"), "n")
            .select("axis", "spearman_rho", _two_sided_p("spearman_rho", "n").alias("p_value"), "n"))


@F.pandas_udf(DoubleType())
def _two_sided_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Student-t tail for a handful of axis rows; Spark has no such function."""
    return pd.Series([t_test_p(r, int(c)) for r, c in zip(rho, n)])


def t_test_p(rho: float, n: int) -> float:
    """Two-sided p of a rank correlation over n pairs: I_x((n - 2) / 2, 1 / 2) at x = 1 - rho^2."""
    if math.isnan(rho):
        return math.nan
    if abs(rho) >= 1.0 - 1e-15:
        return 0.0
    return min(1.0, _regularised_beta(1.0 - rho * rho, rho * rho, (n - 2) / 2, 0.5))


def _regularised_beta(x: float, y: float, a: float, b: float) -> float:
    """I_x(a, b) with y = 1 - x, by its continued fraction (DLMF 8.17.22); as many terms as it needs."""
    if x <= 0.0 or y <= 0.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _regularised_beta(y, x, b, a)
    scale = math.exp(a * math.log(x) + b * math.log(y) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    top, bottom = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1))
    value, m = bottom, 0
    while True:
        m += 1
        before = value
        for d in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                  -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            top, bottom = 1.0 + d / top, 1.0 / (1.0 + d * bottom)
            value *= top * bottom
        if abs(value - before) <= 1e-14 * abs(value):
            return scale * value
