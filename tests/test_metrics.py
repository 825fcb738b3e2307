import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselight import config
from caselight.config import Policy
from caselight.functions import policy as P
from caselight.operators import metrics as M
from caselight.operators import ordering as O

A, B_, C_ = "battery_power", "account_access", "app_store_billing"


def decide(spark, text, intent, conf, top1, neg):
    df = spark.createDataFrame([(text, intent, conf, top1, neg)], "t string, i string, c double, r double, n boolean")
    return df.select(P.decide(*[F.col(c) for c in "ticrn"]).alias("d")).first()["d"]


@pytest.mark.parametrize("case, rule", [
    (("call my lawyer", A, 0.9, 0.9, False), "safety_term"),
    (("locked out", B_, 0.9, 0.9, False), "forced_label"),
    (("slow", A, 0.549, 0.9, False), "low_confidence"),
    (("slow", A, 0.55, 0.049, False), "no_precedent"),
    (("slow", A, 0.55, 0.05, True), "auto"),
    (("slow", C_, 0.9, 0.9, True), "negative_sensitive"),
    (("slow", C_, 0.9, 0.9, False), "auto"),
    (("slow", A, 0.9, 0.0, False), "no_precedent"),
    (("slow", A, None, 0.9, False), "low_confidence"),
    (("hacked", B_, 0.1, 0.0, True), "safety_term"),
    ((None, A, 0.9, 0.9, False), "auto"),
])
def test_policy(spark, case, rule):
    d = decide(spark, *case)
    assert d["rule"] == rule and d["escalate"] is (rule != "auto") and d["reason"]


def test_reason_shows_two_digits(spark):
    assert "0.12 is under the 0.55" in decide(spark, "x", A, 0.125, 0.9, False)["reason"]


def f1(tp, p, t):
    return 0.0 if p + t == 0 else 2 * tp / (p + t)


def label_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abcd"), rng.choice("abce")) for _ in range(200)]
    return rows, spark.createDataFrame(rows, "t string, p string")


def test_accuracy_and_macro_f1(spark):
    rows, df = label_rows(spark)
    got = M.accuracy_macro_f1(df, "t", "p").first()
    per = [f1(sum(t == p == l for t, p in rows), sum(p == l for _, p in rows), sum(t == l for t, _ in rows)) for l in "abcde"]
    assert got["accuracy"] == pytest.approx(sum(t == p for t, p in rows) / 200)
    assert got["macro_f1"] == pytest.approx(sum(per) / 5)


def test_report_names_the_total_by_coverage(spark):
    rows, df = label_rows(spark)
    part = {r["label"]: r for r in M.classification_report(df, "t", "p", ["a", "b"]).collect()}
    assert set(part) == {"a", "b", "micro avg", "macro avg", "weighted avg"}
    tp = sum(t == p and t in "ab" for t, p in rows)
    assert part["micro avg"]["precision"] == pytest.approx(tp / sum(p in "ab" for _, p in rows))
    full = {r["label"]: r for r in M.classification_report(df, "t", "p", list("abcdef")).collect()}
    assert full["accuracy"]["f1"] == pytest.approx(sum(t == p for t, p in rows) / 200)
    assert full["f"]["f1"] == 0.0 and full["f"]["support"] == 0 and full["d"]["precision"] == 0.0


def test_confusion_is_dense_and_ordered(spark):
    rows, df = label_rows(spark)
    cells = M.confusion_matrix(df, "t", "p", list("abz")).collect()
    assert len(cells) == 9
    assert all(c["n"] == sum((t, p) == (c["true"], c["predicted"]) for t, p in rows) for c in cells)
    wide = {r["true"]: r for r in M.confusion_pivot(M.confusion_matrix(df, "t", "p", list("abz")), list("abz")).collect()}
    assert wide["z"]["a"] == 0 and wide["a"]["b"] == sum(r == ("a", "b") for r in rows)


def test_binary_edges(spark):
    schema = "t boolean, p boolean"
    none = M.binary_prf(spark.createDataFrame([(False, False)], schema), "t", "p").first()
    assert (none["precision"], none["recall"], none["f1"], none["n_true"], none["n_predicted"]) == (0.0, 0.0, 0.0, 0, 0)
    some = M.binary_prf(spark.createDataFrame([(True, True), (True, False), (False, True), (False, True)], schema), "t", "p").first()
    assert (some["precision"], some["recall"]) == (pytest.approx(1 / 3), 0.5)


def test_sweep_equals_policy_on_every_grid_point(spark):
    rng = random.Random(3)
    texts = ["fine", "my lawyer", "so done"]
    rows = [(i, rng.choice(texts), rng.choice(config.LABELS), rng.choice([0.2, 0.35, 0.55, 0.6, 0.75, 0.9]),
             rng.choice([0.0, 0.05, 0.1, 0.12, 0.25, 0.5]), rng.random() < 0.5, rng.random() < 0.4) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, text string, intent string, confidence double, top1 double, negative boolean, truth boolean")
    got = {(r[0], r[1]): tuple(r)[2:] for r in M.threshold_sweep(df, "truth", "text", "intent", "confidence", "top1", "negative").collect()}
    d = P.decide(*[F.col(c) for c in ("text", "intent", "confidence", "top1", "negative")], Policy(),
                 F.col("confidence_threshold"), F.col("retrieval_threshold"))
    called = M.threshold_grid(df).withColumn("called", d["escalate"]).collect()
    assert len(got) == 25
    for point in got:
        at = [r for r in called if (r["confidence_threshold"], r["retrieval_threshold"]) == point]
        h, t, p = sum(r["truth"] and r["called"] for r in at), sum(r["truth"] for r in at), sum(r["called"] for r in at)
        assert got[point] == pytest.approx((h / p, h / t, f1(h, p, t)), abs=5.1e-4)


def ranks(x):
    x = np.asarray(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_spearman_with_ties_nulls_constants(spark):
    rng = random.Random(9)
    rows = [(i, rng.randint(1, 5), rng.choice([1, 2, 3, None]), 4, i, rng.choice([1, 2]), rng.randint(1, 5), rng.randint(1, 5), 5,
             -i, rng.choice([1, None]) if i < 2 else None) for i in range(40)]
    cols = ["tweet_id", *config.JUDGE_AXES, *[f"human_{a}" for a in config.JUDGE_AXES]]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols))
    got = {r["axis"]: r for r in M.spearman_by_axis(df).collect()}
    assert "safety" not in got and got["actionability"]["spearman_rho"] == pytest.approx(-1.0)
    assert got["actionability"]["p_value"] == 0.0 and math.isnan(got["brand_voice"]["spearman_rho"])
    for axis, at in (("groundedness", 1), ("correctness", 2)):
        pairs = [(r[at], r[at + 5]) for r in rows if r[at] is not None and r[at + 5] is not None]
        want = np.corrcoef(ranks([p[0] for p in pairs]), ranks([p[1] for p in pairs]))[0, 1]
        assert got[axis]["spearman_rho"] == pytest.approx(want) and got[axis]["n"] == len(pairs)


def test_p_values():
    assert M.t_test_p(1.7 / math.sqrt(1.7**2 + 8), 10) == pytest.approx(0.12755, abs=1e-5)
    assert M.t_test_p(1.0 / math.sqrt(2), 3) == pytest.approx(0.5)  # one degree of freedom, t = 1
    assert M.t_test_p(0.0, 17) == pytest.approx(1.0)
    rho, n = 0.004, 100_002
    assert M.t_test_p(rho, n) == pytest.approx(M.t_test_p(rho, n + 1), abs=1e-4)
    assert M.t_test_p(2.0 / math.sqrt(4.0 + 10**9), 10**9 + 2) == pytest.approx(math.erfc(2 / math.sqrt(2)), rel=1e-5)
    for rho, n in ((0.3, 4), (0.3, 12), (-0.05, 40)):  # even degrees of freedom have a finite sum
        f, c2 = n - 2, 1 - rho * rho
        term, total = 1.0, 1.0
        for j in range(1, f // 2):
            term *= (2 * j - 1) / (2 * j) * c2
            total += term
        assert M.t_test_p(rho, n) == pytest.approx(1 - abs(rho) * total, abs=1e-12)


def test_majority_and_sources(spark):
    from caselight.operators import intents as I
    df = spark.createDataFrame([("b",), ("b",), ("a",), ("a",), ("c",)], "l string")
    assert I.majority_label(df, "l").first()["l"] == "a"
    assert {r["predicted"] for r in I.predict_majority(df, "l", spark.range(4)).collect()} == {"a"}
    assert {r["l"]: r["n"] for r in M.source_counts(df, "l").collect()} == {"a": 2, "b": 2, "c": 1}


def test_judge_means_skip_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (4.0, 2.0)], "groundedness double, safety double")
    row = M.judge_means(df, ["groundedness", "safety"]).first()
    assert (row["groundedness"], row["safety"], row["n_scored"]) == (2.5, 2.0, 2)


def test_sweep_groups_before_the_grid(spark, plan):
    df = spark.range(10).selectExpr("id", "'x' text", "'a' intent", "0.5D confidence", "0.1D top1", "true negative", "true truth")
    text = plan(M.threshold_sweep(df, "truth", "text", "intent", "confidence", "top1", "negative"), "simple")
    assert text.index("Generate") < text.rindex("HashAggregate") and "NestedLoop" not in text


def test_ranks_of_many_grades_are_dealt_over_tasks(spark, plan):
    """10^5 distinct grades on one axis: no task ranks them all, and the result is that of plain ranks."""
    n = 100_000
    df = spark.range(n).select(((F.col("id") * 7919) % n / 3.0).alias("a"), ((F.col("id") * 104729) % n / 7.0 + F.col("id") % 2).alias("human_a"))
    row = M.spearman_by_axis(df, ("a",)).first()
    x, y = (np.array(c, float) for c in zip(*df.collect()))
    rank = lambda v: np.searchsorted(np.sort(v), v, "left") + (np.searchsorted(np.sort(v), v, "right") - np.searchsorted(np.sort(v), v, "left") + 1) / 2
    assert row["n"] == n and row["spearman_rho"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1], abs=1e-9)
    totals = O.running_totals(df.select(F.lit("q").alias("axis"), "a", F.lit(1).alias("c")), ["axis"], "a", "c", "below")
    sizes = totals.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert totals.where("below != round(a * 3)").count() == 0
    assert "hashpartitioning(axis" in plan(totals, "simple") and len(sizes) >= 1


def test_running_totals_of_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(o), int(v)) for g, o, v in zip(rng.integers(0, 3, 400), rng.permutation(400), rng.integers(0, 9, 400))]
    got = O.running_totals(spark.createDataFrame(rows, "g int, o double, v int").repartition(5), ["g"], "o", "v", "before").collect()
    assert len(got) == 400
    assert all(r["before"] == sum(v for g, o, v in rows if g == r["g"] and o < r["o"]) for r in got)
