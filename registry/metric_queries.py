"""Label metrics, binary metrics, the sweep, judge means and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselight import config
from caselight.functions import responses as RS
from caselight.operators import intents, metrics as M
from caselight.operators import requests as Q
from caselight.plans import handling as H
from registry import base as B
from registry.text_queries import sql_rule

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("majority_label", f"""WITH {B.GRADED}, m AS (SELECT intent FROM graded GROUP BY intent ORDER BY count(*) DESC, intent LIMIT 1)
SELECT doc_id, (SELECT intent FROM m) AS predicted FROM graded""")
def _(spark, sf):
    graded = B.graded(spark, sf)
    return intents.predict_majority(graded, "intent", graded.select("doc_id"))


COUNTS = f"""{B.GRADED}, seen AS (SELECT DISTINCT label FROM (SELECT true_intent AS label FROM graded UNION ALL SELECT intent FROM graded)),
per AS (SELECT label, (SELECT count(*) FROM graded WHERE true_intent = label AND intent = label)::DOUBLE AS tp,
  (SELECT count(*) FROM graded WHERE intent = label) AS pred, (SELECT count(*) FROM graded WHERE true_intent = label) AS sup FROM seen),
prf AS (SELECT label, sup, pred, tp, CASE WHEN pred = 0 THEN 0 ELSE tp / pred END AS p, CASE WHEN sup = 0 THEN 0 ELSE tp / sup END AS r,
  CASE WHEN pred + sup = 0 THEN 0 ELSE 2 * tp / (pred + sup) END AS f FROM per)"""


@query("accuracy_macro_f1", f"""WITH {COUNTS} SELECT round((SELECT avg((true_intent = intent)::INTEGER) FROM graded), 6) AS accuracy,
  round(avg(f), 6) AS macro_f1 FROM prf""")
def _(spark, sf):
    return rounded(M.accuracy_macro_f1(B.graded(spark, sf), "true_intent", "intent"), "accuracy", "macro_f1")


def _report_sql(labels) -> str:
    listed = ", ".join(f"({B.lit(l)})" for l in labels)
    covers = "(SELECT count(*) FROM seen WHERE label NOT IN (SELECT label FROM listed)) = 0"
    return f"""WITH {COUNTS}, listed(label) AS (VALUES {listed}),
k AS (SELECT label, coalesce(sup, 0) AS sup, coalesce(pred, 0) AS pred, coalesce(tp, 0) AS tp, coalesce(p, 0) AS p,
  coalesce(r, 0) AS r, coalesce(f, 0) AS f FROM listed LEFT JOIN prf USING (label)),
t AS (SELECT label, p, r, f, sup FROM k
 UNION ALL SELECT CASE WHEN {covers} THEN 'accuracy' ELSE 'micro avg' END, sum(tp) / sum(pred), sum(tp) / sum(sup),
   2 * sum(tp) / (sum(pred) + sum(sup)), sum(sup) FROM k
 UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(sup) FROM k
 UNION ALL SELECT 'weighted avg', sum(p * sup) / sum(sup), sum(r * sup) / sum(sup), sum(f * sup) / sum(sup), sum(sup) FROM k)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, sup::BIGINT AS support FROM t"""


@query("classification_report", _report_sql(config.LABELS))
def _(spark, sf):
    return rounded(M.classification_report(B.graded(spark, sf), "true_intent", "intent"), "precision", "recall", "f1")


@query("classification_report_part", _report_sql(config.LABELS[:4]))
def _(spark, sf):
    report = M.classification_report(B.graded(spark, sf), "true_intent", "intent", config.LABELS[:4])
    return rounded(report, "precision", "recall", "f1")


_ORD = ", ".join(f"({i}, {B.lit(l)})" for i, l in enumerate(config.LABELS))


@query("confusion_matrix", f"""WITH {B.GRADED}, l(ord, label) AS (VALUES {_ORD})
SELECT a.ord::INTEGER AS true_ord, a.label AS "true", b.ord::INTEGER AS pred_ord, b.label AS predicted, count(g.doc_id) AS n
FROM l a CROSS JOIN l b LEFT JOIN graded g ON g.true_intent = a.label AND g.intent = b.label GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    return M.confusion_matrix(B.graded(spark, sf), "true_intent", "intent")


@query("confusion_pivot", f"""WITH {B.GRADED}, l(ord, label) AS (VALUES {_ORD})
SELECT a.ord::INTEGER AS true_ord, a.label AS "true", {", ".join(f"count(*) FILTER (WHERE g.intent = {B.lit(l)}) AS {l}" for l in config.LABELS)}
FROM l a LEFT JOIN graded g ON g.true_intent = a.label GROUP BY 1, 2""")
def _(spark, sf):
    return M.confusion_pivot(M.confusion_matrix(B.graded(spark, sf), "true_intent", "intent"))


@query("source_counts", f"WITH {B.GRADED} SELECT source, count(*) AS n FROM graded GROUP BY source")
def _(spark, sf):
    return M.source_counts(B.graded(spark, sf))


DECIDED = f"""{B.GRADED}, decided AS (SELECT *, rule <> 'auto' AS predicted FROM (SELECT *, {sql_rule()} AS rule FROM graded))"""


@query("binary_prf", f"""WITH {DECIDED}, c AS (SELECT count(*) FILTER (WHERE should_escalate AND predicted) AS h,
  count(*) FILTER (WHERE should_escalate) AS t, count(*) FILTER (WHERE predicted) AS p FROM decided)
SELECT round(CASE WHEN p = 0 THEN 0 ELSE h / p END, 6) AS precision, round(CASE WHEN t = 0 THEN 0 ELSE h / t END, 6) AS recall,
  round(CASE WHEN p + t = 0 THEN 0 ELSE 2 * h / (p + t) END, 6) AS f1, t AS n_true, p AS n_predicted FROM c""")
def _(spark, sf):
    prf, _missed = H.escalation_eval(B.graded(spark, sf), "text")
    return rounded(prf, "precision", "recall", "f1")


@query("false_negatives", f"WITH {DECIDED} SELECT doc_id, text, rule FROM decided WHERE should_escalate AND NOT predicted")
def _(spark, sf):
    _prf, missed = H.escalation_eval(B.graded(spark, sf), "text")
    return missed.select("doc_id", "text", "rule")


_GRID = ", ".join(f"({c}::DOUBLE, {r}::DOUBLE)" for c in config.CONFIDENCE_GRID for r in config.RETRIEVAL_GRID)
_CALLED = f"""({B.sql_safety('text')} IS NOT NULL OR intent = 'account_access' OR (negative AND intent = 'app_store_billing'))"""


@query("threshold_sweep", f"""WITH {B.GRADED}, grid(ct, rt) AS (VALUES {_GRID}), base AS (SELECT *, {_CALLED} AS always FROM graded),
c AS (SELECT ct, rt, count(*) FILTER (WHERE should_escalate AND (always OR confidence < ct OR top1_score < rt)) AS h,
  count(*) FILTER (WHERE should_escalate) AS t, count(*) FILTER (WHERE always OR confidence < ct OR top1_score < rt) AS p
  FROM base CROSS JOIN grid GROUP BY ct, rt)
SELECT ct AS confidence_threshold, rt AS retrieval_threshold, round(h / p, 3) AS precision, round(h / t, 3) AS recall,
  round(2 * h / (p + t), 3) AS f1 FROM c""")
def _(spark, sf):
    return M.threshold_sweep(B.graded(spark, sf), "should_escalate", "text", "intent", "confidence", "top1_score", "negative")


# --- answers of a judge ------------------------------------------------------------------------------------

_G = {"groundedness": "1 + n_chars % 5", "correctness": "1 + (n_chars // 5) % 5", "brand_voice": "1 + doc_id % 5",
      "actionability": "1 + (doc_id + n_chars) % 5", "safety": "1 + (n_chars // 7) % 5"}


def _body(axes) -> str:
    return "'{' || " + " || ".join(f"'\"{a}\": ' || ({_G[a]}) || ', '" for a in axes) + " || '\"rationale\": \"read ' || n_chars || '\"}'"


ANSWERS = f"""answers AS (SELECT doc_id::VARCHAR AS tweet_id, CASE doc_id % 5
  WHEN 0 THEN '```json' || chr(10) || {_body(config.JUDGE_AXES)} || chr(10) || '```' WHEN 1 THEN
    CASE WHEN doc_id % 10 = 1 THEN regexp_replace(regexp_replace({_body(config.JUDGE_AXES)}, '"groundedness": ([0-9])', '"groundedness": "\\1"'),
      '"correctness": [0-9]', '"correctness": "n/a"') ELSE {_body(config.JUDGE_AXES)} END
  WHEN 2 THEN '{{' || {_body(config.JUDGE_AXES)} WHEN 3 THEN {_body(config.JUDGE_AXES[:4])}
  ELSE 'I would say ' || (n_chars % 5) END AS raw FROM documents)"""
_AXES = ", ".join(f"CASE WHEN ok THEN TRY_CAST(json_extract_string(body, '$.{a}') AS DOUBLE) END AS {a}" for a in config.JUDGE_AXES)
JUDGED = f"""{ANSWERS}, stripped AS (SELECT tweet_id, trim(regexp_replace(raw, '(?m)^```(?:json)?|```$', '', 'g'), chr(10) || ' ') AS body FROM answers),
checked AS (SELECT *, json_valid(body) AND body LIKE '{{%' AS ok FROM stripped),
judged AS (SELECT tweet_id, {_AXES}, CASE WHEN ok THEN json_extract_string(body, '$.rationale')
  ELSE 'JUDGE_PARSE_ERROR: ' || substr(body, 1, 200) END AS rationale FROM checked)"""
_H = {"groundedness": "n_chars % 5", "correctness": "(n_chars // 5) % 3", "brand_voice": "(doc_id + quality) % 5",
      "actionability": "(doc_id + n_chars) % 4", "safety": "toxic + (n_chars // 7) % 4"}
HUMAN = "human AS (SELECT doc_id::VARCHAR AS tweet_id, " + ", ".join(
    f"CASE WHEN doc_id % 7 <> 0 THEN (1 + {e})::INTEGER END AS human_{a}" for a, e in _H.items()) + \
    " FROM documents JOIN labels USING (doc_id))"


def _judged(spark, sf):
    answers = B.judge_answers(spark, sf)
    return Q.scores_from_responses(answers.select("tweet_id"), answers, "tweet_id")


@query("parse_judge", f"WITH {JUDGED} SELECT * FROM judged")
def _(spark, sf):
    return B.judge_answers(spark, sf).select("tweet_id", F.inline(F.array(RS.parse_judge(F.col("raw")))))


@query("judge_means", f"WITH {JUDGED} SELECT {', '.join(f'round(avg({a}), 6) AS {a}' for a in config.JUDGE_AXES)}, count(*) AS n_scored FROM judged")
def _(spark, sf):
    return rounded(M.judge_means(_judged(spark, sf)), *config.JUDGE_AXES)


@query("ratings_join", f"WITH {JUDGED}, {HUMAN} SELECT * FROM judged JOIN human USING (tweet_id)")
def _(spark, sf):
    return M.ratings_join(_judged(spark, sf), B.human_ratings(spark, sf))


_LONG = " UNION ALL ".join(f"SELECT {B.lit(a)} AS axis, {a} AS j, human_{a}::DOUBLE AS h FROM merged WHERE {a} IS NOT NULL AND human_{a} IS NOT NULL"
                           for a in config.JUDGE_AXES)


@query("spearman", f"""WITH {JUDGED}, {HUMAN}, merged AS (SELECT * FROM judged JOIN human USING (tweet_id)), long AS ({_LONG}),
ranked AS (SELECT axis, rank() OVER (PARTITION BY axis ORDER BY j) + (count(*) OVER (PARTITION BY axis, j) - 1) / 2 AS rj,
  rank() OVER (PARTITION BY axis ORDER BY h) + (count(*) OVER (PARTITION BY axis, h) - 1) / 2 AS rh FROM long)
, rho AS (SELECT axis, corr(rj, rh) AS r, count(*) AS n, count(*) - 2 AS f FROM ranked GROUP BY axis HAVING count(*) > 2),
series AS (SELECT *, 1 + coalesce(list_sum(list_transform(range(1, f // 2), lambda j: exp(j * ln(1 - r * r) + CASE WHEN f % 2 = 0
    THEN lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1) ELSE lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5) END))), 0) AS s FROM rho)
SELECT axis, round(r, 6) AS spearman_rho, round(greatest(0, 1 - CASE WHEN f % 2 = 0 THEN abs(r) * s
    ELSE 2 / pi() * (asin(abs(r)) + CASE WHEN f > 1 THEN abs(r) * sqrt(1 - r * r) * s ELSE 0 END) END), 6) AS p_value, n FROM series""")
def _(spark, sf):
    merged = M.ratings_join(_judged(spark, sf), B.human_ratings(spark, sf))
    return rounded(M.spearman_by_axis(merged), "spearman_rho", "p_value").select("axis", "spearman_rho", "p_value", "n")
