"""Train, score and evaluate over a labelled table; results as one nested document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight import config
from caselight.config import Grid, Policy
from caselight.functions import text as T
from caselight.operators import intents, metrics
from caselight.operators import retrieval as R
from caselight.operators.requests import (attach_responses, judge_requests, labels_from_responses, reply_requests,
                                          scores_from_responses)
from caselight.plans.handling import Classifier, escalation_eval, score_messages
from caselight.sources.messages import write_metrics_json


def weakly_labelled(pairs: DataFrame, text_col: str = "cust_text_clean",
                    rules=config.KEYWORD_RULES, default: str = config.DEFAULT_LABEL) -> DataFrame:
    return pairs.withColumn("weak_label", T.weak_label(F.col(text_col), rules, default))


def train_eval_baselines(train: DataFrame, id_col: str, text_col: str, label: str, golden: DataFrame,
                         golden_text: str, truth: str, answers: DataFrame | None = None, golden_id: str | None = None,
                         labels: Sequence[str] = config.LABELS, **fit) -> tuple[intents.IntentModel, DataFrame]:
    """The fitted model, and ``(model, accuracy, macro_f1, report)`` for the majority floor and for it.

    ``report`` holds the rows of the classification report over ``labels``.  With ``answers``
    ``(golden_id, raw)`` of a language model a third row, ``llm``, follows; the same
    answers serve the policy through ``handling.answers_classifier``.
    """
    model = intents.fit_intent_model(train, id_col, text_col, label, **fit)
    fitted = _evaluated("tfidf", model.predict(golden, golden_text), truth, "intent", labels)
    return model, evaluate_unfitted(train, label, golden, truth, answers, golden_id, labels).unionByName(fitted)


def evaluate_unfitted(train: DataFrame, label: str, golden: DataFrame, truth: str, answers: DataFrame | None = None,
                      golden_id: str | None = None, labels: Sequence[str] = config.LABELS) -> DataFrame:
    """The rows that need no fitted model: the majority floor, and a language model's answers if there are any."""
    out = _evaluated("trivial", intents.predict_majority(train, label, golden), truth, "predicted", labels)
    if answers is not None:
        answered = labels_from_responses(golden, answers, golden_id, labels=labels)
        out = out.unionByName(_evaluated("llm", answered, truth, "intent", labels))
    return out


def _evaluated(name: str, rows: DataFrame, truth: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    report = _many(metrics.classification_report(rows, truth, predicted, labels), ["label"])
    return metrics.accuracy_macro_f1(rows, truth, predicted).select(F.lit(name).alias("model"), "*", report.alias("report"))


def scored_golden(golden: DataFrame, index: R.SparseIndex, classify: Classifier, id_col: str, text_col: str,
                  policy: Policy = Policy(), clean: bool = False) -> DataFrame:
    """The labelled table with everything the policy reads.  Raw text by default, as the evaluation scores it.

    Written to the shared checkpoint: every metric below reads it, and none
    repeats the search.
    """
    return score_messages(golden, index, classify, id_col, text_col, config.TOP_K, policy, clean).checkpoint()


def _one(frame: DataFrame):
    """A one-row frame as a struct-valued scalar."""
    return frame.select(F.struct(*frame.columns).alias("row")).scalar()


def _many(frame: DataFrame, order: Sequence[str]):
    """A frame of few rows as an ordered array of structs."""
    columns = [*order, *[c for c in frame.columns if c not in order]]
    return frame.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows")).scalar()


def metrics_document(scored: DataFrame, baselines: DataFrame, text_col: str, truth: str = "should_escalate",
                     source: str = "source", judge: DataFrame | None = None, agreement: DataFrame | None = None,
                     grid: Grid = Grid(), policy: Policy = Policy()) -> DataFrame:
    """All results in one nested row; of the missed escalations, which may be many, their number."""
    escalation, missed = escalation_eval(scored, text_col, truth, policy)
    sweep = metrics.threshold_sweep(scored, truth, text_col, "intent", "confidence", "top1_score", "negative", grid,
                                    policy)
    spark = scored.sparkSession
    columns = [
        scored.agg(F.count(F.lit(1)).alias("n")).scalar().alias("golden_set_size"),
        _many(metrics.source_counts(scored, source), [source]).alias("golden_set_sources"),
        _many(baselines, ["model"]).alias("intent_classification"),
        _one(escalation).alias("escalation"),
        missed.agg(F.count(F.lit(1)).alias("n")).scalar().alias("false_negatives"),
        _many(sweep, ["confidence_threshold", "retrieval_threshold"]).alias("escalation_threshold_sweep"),
        F.struct(F.lit(policy.confidence_threshold).alias("confidence_threshold_used"),
                 F.lit(policy.retrieval_threshold).alias("retrieval_threshold_used")).alias("config"),
    ]
    if judge is not None:
        columns.append(_one(metrics.judge_means(judge)).alias("reply_quality_judge"))
    if agreement is not None:
        columns.append(F.struct(
            agreement.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_examples_rated"),
            _many(metrics.spearman_by_axis(agreement), ["axis"]).alias("spearman_by_axis")).alias("judge_human_agreement"))
    return spark.range(1).select(*columns)


def write_evaluation(scored: DataFrame, baselines: DataFrame, text_col: str, path: str,
                     truth: str = "should_escalate", policy: Policy = Policy(), **rest) -> None:
    """The document under ``metrics`` and every missed escalation, with its reason, under ``false_negatives``."""
    write_metrics_json(metrics_document(scored, baselines, text_col, truth, policy=policy, **rest), f"{path}/metrics")
    missed = escalation_eval(scored, text_col, truth, policy)[1]
    missed.select(F.col(text_col).alias("text"), "reason").write.mode("overwrite").json(f"{path}/false_negatives")


# --- drafts and grades through request / response tables ----------------------------------------

def draft_requests(golden: DataFrame, label_responses: DataFrame, index: R.SparseIndex, id_col: str,
                   text_col: str) -> tuple[DataFrame, DataFrame]:
    """(cases with intent and hits, reply requests) from the label answers."""
    labelled = labels_from_responses(golden, label_responses, id_col)
    hits = R.hits_as_array(R.search(index, golden, id_col, text_col), id_col, index.doc_id, index.payload)
    cases = labelled.join(hits, id_col, "left")
    return cases, reply_requests(cases, id_col, text_col, "intent", "hits")


def score_drafts(cases: DataFrame, reply_responses: DataFrame, id_col: str, text_col: str,
                 judge_responses: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(drafts, judge requests, judge scores once the judge has answered)."""
    drafted = attach_responses(cases, reply_responses.withColumnRenamed("raw", "draft"), id_col, "draft")
    drafts = drafted.select(id_col, text_col, "draft")
    requests = judge_requests(drafted, id_col, text_col, "draft", "hits")
    scores = None
    if judge_responses is not None:
        scores = scores_from_responses(drafts.select(id_col), judge_responses, id_col)
    return drafts, requests, scores

