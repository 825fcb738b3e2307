"""Request tables, response parsing, batch and streaming handling, and the evaluation document."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselight import config
from caselight.functions import responses as RS
from caselight.operators import metrics as M
from caselight.operators import requests as Q
from caselight.operators import retrieval as R
from caselight.plans import evaluation as E
from caselight.plans import handling as H
from caselight.session import scratch_dir
from caselight.sources import messages as S
from caselight.streaming.arriving import handle_stream, read_arriving
from caselight.streaming.growing import GrowingIndex
from registry import base as B
from registry.metric_queries import SQL as METRIC_SQL
from registry.metric_queries import _CALLED as CALLED
from registry.metric_queries import _report_sql as report_sql
from registry.model_queries import PAIR_HITS, PAIRS, _asked, _baselines, _pairs, _train
from registry.model_queries import SQL as MODEL_SQL
from registry.text_queries import sql_rule

SQL_FLOOR = MODEL_SQL["eval_floor_and_answers"]

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


# --- prompts --------------------------------------------------------------------------------------------

LABELLED = f"""labelled AS (SELECT doc_id, text, {B.sql_weak_label('text')} AS label FROM documents),
heads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS rn FROM labelled) WHERE rn <= 3),
defs AS (SELECT string_agg('- ' || name || ': ' || n || ' messages', chr(10) ORDER BY name) AS block
  FROM (SELECT label AS name, count(*) AS n FROM labelled GROUP BY label)),
shots AS (SELECT string_agg('Message: "' || text || '"' || chr(10) || 'Label: ' || label || chr(10), chr(10) ORDER BY label, rn) AS block FROM heads)"""


def _taxonomy(spark, sf):
    from caselight.functions import text as T

    docs = B.table(spark, sf, "documents", spread=True).withColumn("label", T.weak_label(F.col("text")))
    return Q.taxonomy_from_labelled(docs, "doc_id", "text", "label")


@query("prompt_blocks", f"WITH {LABELLED} SELECT defs.block AS definitions, shots.block AS examples FROM defs CROSS JOIN shots")
def _(spark, sf):
    taxonomy = _taxonomy(spark, sf)
    return spark.range(1).select(Q.definitions_block(taxonomy, "name").alias("definitions"),
                                 Q.fewshot_block(taxonomy, "name").alias("examples"))


def _sql_text(text: str) -> str:
    return " || chr(10) || ".join(B.lit(part) for part in text.split("\n"))


_DEFS = "\n".join(f"- {t.name}: {t.definition}" for t in config.TAXONOMY)
_SHOTS = "\n".join(f'Message: "{e}"\nLabel: {t.name}\n' for t in config.TAXONOMY for e in t.examples)


@query("classify_requests", f"""WITH {B.MESSAGES} SELECT tweet_id, {_sql_text(Q.CLASSIFY_SYSTEM.replace('%s', _DEFS))} AS system,
{_sql_text(f'Examples:{chr(10)}{_SHOTS}{chr(10)}Message: "')} || text || {_sql_text('"' + chr(10) + 'Label:')} AS "user"
FROM msgs WHERE inbound = 'True'""")
def _(spark, sf):
    return Q.classify_requests(_asked(spark, sf), "tweet_id", "text", Q.taxonomy_table(spark))


def _label_answers(spark, sf):
    """A model's label answer per customer message: exact, wordy, or nothing known."""
    turn = F.substring_index("tweet_id", ":", -1).cast("int")
    conv = F.substring_index("tweet_id", ":", 1).cast("int")
    label = B.pick(config.LABELS, conv + turn)
    raw = (F.when(conv % 3 == 0, label).when(conv % 3 == 1, F.concat(F.lit("The label is "), F.upper(label), F.lit(".")))
           .otherwise(F.col("text")))
    return _asked(spark, sf).select("tweet_id", raw.alias("raw"))


_CONV, _TURN = "CAST(split_part(tweet_id, ':', 1) AS INTEGER)", "CAST(split_part(tweet_id, ':', 2) AS INTEGER)"
_PICKED = B.sql_pick(config.LABELS, f"{_CONV} + {_TURN}")
_KEPT = "regexp_replace(lower(raw), '[^a-z_]', '', 'g')"
LABEL_ANSWERS = f"""label_answers AS (SELECT tweet_id, CASE {_CONV} % 3 WHEN 0 THEN {_PICKED}
  WHEN 1 THEN 'The label is ' || upper({_PICKED}) || '.' ELSE text END AS raw FROM msgs WHERE inbound = 'True'),
parsed AS (SELECT tweet_id, CASE WHEN list_contains([{', '.join(map(B.lit, config.LABELS))}], kept) THEN kept
  {' '.join(f"WHEN contains(kept, {B.lit(l)}) THEN {B.lit(l)}" for l in config.LABELS)} ELSE 'other_uncategorised' END AS label,
  (CASE WHEN list_contains([{', '.join(map(B.lit, config.LABELS))}], kept) THEN 1.0 WHEN {B.sql_any('kept', config.LABELS)} THEN 0.5
   ELSE 0.3 END)::DOUBLE AS confidence FROM (SELECT *, {_KEPT} AS kept FROM label_answers))"""


@query("parse_label", f"WITH {B.MESSAGES}, {LABEL_ANSWERS} SELECT * FROM parsed")
def _(spark, sf):
    parsed = RS.parse_label(F.col("raw"))
    return _label_answers(spark, sf).select("tweet_id", F.inline(F.array(parsed)))


@query("attach_responses", f"""WITH {B.MESSAGES}, {LABEL_ANSWERS} SELECT a.tweet_id, text, r.raw FROM (SELECT tweet_id, text FROM msgs) a
LEFT JOIN label_answers r USING (tweet_id)""")
def _(spark, sf):
    requests = B.messages(spark, sf).select("tweet_id", "text")
    return Q.attach_responses(requests, _label_answers(spark, sf), "tweet_id")


HITS = f"""{PAIRS}, {PAIR_HITS}, {B.clean_ctes('asked', {'clean': 'text'}, 'messages_clean', config.BRAND_HANDLES)},
{B.terms_ctes('messages_clean', 'tweet_id', 'clean', 'qterm')}, {B.weights_cte('qterm', 'qw')},
{B.hits_cte('messages_clean', 'tweet_id', 'corpus', 'pair_id', 'qw', 'cw')},
cases AS (SELECT h.query_id AS tweet_id,
  string_agg(printf('- They wrote: "%s" We answered: "%s" (similarity %.2f)', c.cust, c.reply, round(h.score, 9)), chr(10) ORDER BY h.rank) AS scored,
  string_agg('- "' || c.reply || '"', chr(10) ORDER BY h.rank) AS plain,
  arg_min(c.reply, h.rank) AS first_reply, max(h.score) AS top1
  FROM hits h JOIN corpus c ON c.pair_id = h.doc_id GROUP BY h.query_id)"""


def _cases(spark, sf):
    from caselight.functions import text as T

    index = R.fit_index(_pairs(spark, sf), "pair_id", "cust", ("cust", "reply"))
    asked = _asked(spark, sf).withColumn("clean", T.clean_text(F.col("text")))
    hits = R.hits_as_array(R.search(index, asked, "tweet_id", "clean"), "tweet_id", "pair_id", ("cust", "reply"))
    return asked.withColumn("intent", T.weak_label(F.col("clean"))).join(hits, "tweet_id", "left")


@query("reply_requests", f"""WITH {HITS} SELECT tweet_id, {B.lit(Q.REPLY_SYSTEM)} AS system,
'Intent: ' || {B.sql_weak_label('clean')} || chr(10) || 'Message: "' || clean || '"' || chr(10) || 'Past cases:' || chr(10) || scored
  || chr(10) || chr(10) || 'Write the answer.' AS "user" FROM messages_clean JOIN cases USING (tweet_id)""")
def _(spark, sf):
    return Q.reply_requests(_cases(spark, sf), "tweet_id", "clean", "intent", "hits")


@query("canned_reply", f"WITH {HITS} SELECT tweet_id, first_reply AS draft FROM cases")
def _(spark, sf):
    return _cases(spark, sf).select("tweet_id", Q.canned_reply(F.col("hits")).alias("draft"))


@query("judge_requests", f"""WITH {HITS} SELECT tweet_id, {B.lit(Q.JUDGE_SYSTEM)} AS system,
'Message: "' || clean || '"' || chr(10) || 'Past replies:' || chr(10) || plain || chr(10) || 'Reply: "' || first_reply || '"' || chr(10)
  || 'Return the JSON.' AS "user" FROM messages_clean JOIN cases USING (tweet_id)""")
def _(spark, sf):
    cases = _cases(spark, sf).withColumn("draft", Q.canned_reply(F.col("hits")))
    return Q.judge_requests(cases, "tweet_id", "clean", "draft", "hits")


# --- handling ---------------------------------------------------------------------------------------------

HANDLED = f"""{HITS}, ready AS (SELECT tweet_id, m.text AS input, clean AS text, {B.sql_weak_label('clean')} AS intent,
  coalesce(top1, 0.0) AS top1_score, {B.sql_negative('clean')} AS negative, first_reply
  FROM messages_clean m LEFT JOIN cases USING (tweet_id)),
held AS (SELECT *, CASE WHEN intent = 'other_uncategorised' THEN 0.3 ELSE 1.0 END::DOUBLE AS confidence FROM ready),
handled AS (SELECT *, {sql_rule()} AS rule FROM held)"""


def _index(spark, sf):
    return R.fit_index(_pairs(spark, sf), "pair_id", "cust", ("cust", "reply"))


def _handled(spark, sf):
    return H.handle(_asked(spark, sf), _index(spark, sf), H.rule_classifier(), "tweet_id", "text", draft="canned")


def _flat(handled):
    """Scalar columns of the handled rows; the grounding as its size."""
    return handled.select(
        "tweet_id", "input", "cleaned_input", "intent", "intent_confidence",
        F.round("top1_retrieval_score", 6).alias("top1_retrieval_score"),
        F.size("grounded_on").cast("long").alias("n_grounded"), "sentiment_negative", "draft_reply", "escalate", "escalation_rule")


@query("handle_batch", f"""WITH {HANDLED} SELECT tweet_id, input, text AS cleaned_input, intent, confidence AS intent_confidence,
  round(top1_score, 6) AS top1_retrieval_score, (SELECT count(*) FROM hits h WHERE h.query_id = tweet_id) AS n_grounded,
  negative AS sentiment_negative, first_reply AS draft_reply, rule <> 'auto' AS escalate, rule AS escalation_rule FROM handled""")
def _(spark, sf):
    return _flat(_handled(spark, sf))


@query("route_counts", f"WITH {HANDLED} SELECT rule <> 'auto' AS escalate, rule AS escalation_rule, count(*) AS n FROM handled GROUP BY 1, 2")
def _(spark, sf):
    path = scratch_dir(spark, "routed")
    H.write_routed(_handled(spark, sf), path)
    return H.route_counts(H.scan_routed(spark, path))


@query("handle_stream", SQL["handle_batch"])
def _(spark, sf):
    arriving, out, marks = (scratch_dir(spark, n) for n in ("arriving", "handled", "marks"))
    asked = _asked(spark, sf)
    asked.repartition(3).write.parquet(arriving)
    stream = read_arriving(spark, arriving, asked.schema, files_per_batch=2)
    handle_stream(stream, _index(spark, sf), H.rule_classifier(), out, marks, "tweet_id", "text",
                  draft="canned").awaitTermination()
    return _flat(spark.read.parquet(out))


def _halves(asked):
    """Messages of even conversations arrive first, each with the reply it got; the others after them."""
    even = F.substring_index("tweet_id", ":", 1).cast("long") % 2 == 0
    told = asked.withColumn("reply", F.concat(F.lit("We wrote to "), "tweet_id"))
    return told.where(even), told.where(~even)


_EVEN = "split_part(tweet_id, ':', 1)::BIGINT % 2 = 0"
_GROWN = HITS.replace("corpus AS (SELECT brand_tweet_id AS pair_id, cust_text_clean AS cust, brand_text_clean AS reply FROM built)",
                      f"""asked_ AS (SELECT tweet_id, text FROM msgs WHERE inbound = 'True' AND {_EVEN}),
{B.clean_ctes('asked_', {'clean': 'text'}, 'cleaned_', config.BRAND_HANDLES)},
corpus AS (SELECT brand_tweet_id AS pair_id, cust_text_clean AS cust, brand_text_clean AS reply FROM built
  UNION ALL SELECT tweet_id, clean, 'We wrote to ' || tweet_id FROM cleaned_)""")


@query("handle_stream_growing", f"WITH {_GROWN} SELECT tweet_id, round(coalesce(top1, 0.0), 6) AS top1_retrieval_score, first_reply AS draft_reply FROM cases WHERE NOT ({_EVEN})")
def _(spark, sf):
    """The second half of the messages, answered from the corpus and from the replies that the first half got."""
    arriving, out, marks, cases = (scratch_dir(spark, n) for n in ("arriving", "handled", "marks", "cases"))
    index = GrowingIndex.start(_pairs(spark, sf), "pair_id", "cust", cases, ("cust", "reply"))
    for half in _halves(_asked(spark, sf)):
        half.coalesce(1).write.mode("append").parquet(arriving)
        handle_stream(read_arriving(spark, arriving, half.schema), index, H.rule_classifier(), out, marks, "tweet_id", "text",
                      draft="canned", reply_col="reply").awaitTermination()
    late = F.substring_index("tweet_id", ":", 1).cast("long") % 2 != 0
    return spark.read.parquet(out).where(late).select("tweet_id", F.round("top1_retrieval_score", 6).alias("top1_retrieval_score"), "draft_reply")


# --- evaluation ---------------------------------------------------------------------------------------------

def _golden(spark, sf):
    """Customer messages with a truth to be measured against."""
    from caselight.functions import text as T

    return _asked(spark, sf).withColumns({
        "should_escalate": T.negative_sentiment(F.col("text")) | F.contains("text", F.lit("order")),
        "true_intent": T.weak_label(F.col("text")),
        "source": F.concat(F.lit("turn"), F.substring_index("tweet_id", ":", -1))})


@query("escalation_eval", f"""WITH {PAIRS}, {PAIR_HITS}, {B.terms_ctes('asked', 'tweet_id', 'text', 'qterm')}, {B.weights_cte('qterm', 'qw')},
{B.hits_cte('asked', 'tweet_id', 'corpus', 'pair_id', 'qw', 'cw', k=1)},
held AS (SELECT text, {B.sql_weak_label('text')} AS intent, score AS top1_score, {B.sql_negative('text')} AS negative,
  {B.sql_negative('text')} OR contains(text, 'order') AS truth FROM asked JOIN hits ON query_id = tweet_id),
ruled AS (SELECT truth, {sql_rule()} <> 'auto' AS called FROM (SELECT *, CASE WHEN intent = 'other_uncategorised' THEN 0.3 ELSE 1.0 END::DOUBLE AS confidence FROM held)),
c AS (SELECT count(*) FILTER (WHERE truth AND called) AS h, count(*) FILTER (WHERE truth) AS t, count(*) FILTER (WHERE called) AS p FROM ruled)
SELECT round(h / p, 6) AS precision, round(h / t, 6) AS recall, round(2 * h / (p + t), 6) AS f1, t AS n_true, p AS n_predicted FROM c""")
def _(spark, sf):
    classify = H.rule_classifier()
    scored = H.score_messages(_golden(spark, sf), _index(spark, sf), classify, "tweet_id", "text", clean=False)
    prf, _missed = H.escalation_eval(scored, "text")
    return prf.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("metrics_document")
def _(spark, sf):
    golden, pairs = _golden(spark, sf), _pairs(spark, sf)
    train = E.weakly_labelled(pairs, "cust")
    model, baselines = E.train_eval_baselines(train, "pair_id", "cust", "weak_label", golden, "text", "true_intent")
    index = R.fit_index(pairs, "pair_id", "cust", ("cust", "reply"))
    scored = E.scored_golden(golden, index, H.model_classifier(model), "tweet_id", "text")
    answers = B.judge_answers(spark, sf)
    judged = Q.scores_from_responses(answers.select("tweet_id"), answers, "tweet_id")
    path = scratch_dir(spark, "metrics")
    E.write_evaluation(scored, baselines, "text", path, judge=judged,
                       agreement=M.ratings_join(judged, B.human_ratings(spark, sf)))
    return spark.read.text(f"{path}/metrics")


# the document's fields one by one, each from the SQL of the operator that fills it
_SAID = SQL_FLOOR.split("seen AS (SELECT DISTINCT model")[0].rstrip().rstrip(",")


def _sql_report(model: str) -> str:
    counted = report_sql(config.LABELS).replace(B.GRADED, f"{_SAID.removeprefix('WITH ')}, graded AS (SELECT truth AS true_intent, guess AS intent FROM said WHERE model = '{model}')", 1)
    measures = " UNION ALL ".join(f"SELECT 'intent_classification.{model}.report.' || label || '.{m}' AS field, {m}::DOUBLE AS value FROM r" for m in ("precision", "recall", "f1", "support"))
    return f"SELECT field, value FROM (WITH r AS ({counted}) {measures})"


_SWEEP_GRID = ", ".join(f"({c}::DOUBLE, {r}::DOUBLE)" for c in config.CONFIDENCE_GRID for r in config.RETRIEVAL_GRID)
_SWEPT = SQL["escalation_eval"].split("ruled AS (SELECT truth")[0] + f"""base AS (SELECT *, {CALLED} AS always, CASE WHEN intent = 'other_uncategorised' THEN 0.3 ELSE 1.0 END::DOUBLE AS confidence FROM held),
grid(ct, rt) AS (VALUES {_SWEEP_GRID}),
c AS (SELECT ct, rt, count(*) FILTER (WHERE truth AND (always OR confidence < ct OR top1_score < rt)) AS h, count(*) FILTER (WHERE truth) AS t,
  count(*) FILTER (WHERE always OR confidence < ct OR top1_score < rt) AS p FROM base CROSS JOIN grid GROUP BY ct, rt)
SELECT 'escalation_threshold_sweep.' || (ct * 100)::INTEGER || '.' || (rt * 100)::INTEGER AS place, h / p AS precision, h / t AS recall, 2 * h / (p + t) AS f1 FROM c"""


def _fields(source: str, prefix: str, *names: str) -> str:
    """``(field, value)`` of the named columns; ``prefix`` is SQL."""
    return " UNION ALL ".join(f"SELECT {prefix} || '.{n}' AS field, {n}::DOUBLE AS value FROM ({source})" for n in names)


_FIELDS = " UNION ALL ".join([
    f"SELECT 'golden_set_size' AS field, count(*)::DOUBLE AS value FROM (WITH {B.MESSAGES} SELECT * FROM msgs WHERE inbound = 'True')",
    f"SELECT 'golden_set_sources.turn' || split_part(tweet_id, ':', -1), count(*)::DOUBLE FROM (WITH {B.MESSAGES} SELECT * FROM msgs WHERE inbound = 'True') GROUP BY 1",
    _fields(SQL_FLOOR, "'intent_classification.' || model", "accuracy", "macro_f1"), _sql_report("trivial"), _sql_report("llm"),
    _fields(SQL["escalation_eval"], "'escalation'", "precision", "recall", "f1", "n_true", "n_predicted"),
    f"SELECT 'false_negatives', n_true - round(recall * n_true) FROM ({SQL['escalation_eval']})",
    _fields(_SWEPT, "place", "precision", "recall", "f1"),
    "SELECT 'config.confidence_threshold_used', 0.55::DOUBLE", "SELECT 'config.retrieval_threshold_used', 0.05::DOUBLE",
    _fields(METRIC_SQL["judge_means"], "'reply_quality_judge'", *config.JUDGE_AXES, "n_scored"),
    f"SELECT 'judge_human_agreement.n_examples_rated', count(*)::DOUBLE FROM ({METRIC_SQL['ratings_join']})",
    # grades that agree wholly have a correlation of 1 only up to rounding
    _fields(METRIC_SQL["spearman"].replace("corr(rj, rh) AS r", "greatest(-1, least(1, corr(rj, rh))) AS r").replace(
        "ln(1 - r * r)", "ln(greatest(1 - r * r, 1e-300))"), "'judge_human_agreement.' || axis", "spearman_rho", "p_value", "n")])


@query("metrics_document_fields", f"SELECT field, round(value, 3) AS value FROM ({_FIELDS})")
def _(spark, sf):
    """Every field of the document with rule labels in the model's place, written as JSON, read back and laid out one by one."""
    golden = _golden(spark, sf)
    weak, answers = _baselines(spark, sf)
    floor = E.evaluate_unfitted(_train(spark, sf), "weak_label", weak, "weak_label", answers, "tweet_id")
    scored = E.scored_golden(golden, _index(spark, sf), H.rule_classifier(), "tweet_id", "text")
    answers = B.judge_answers(spark, sf)
    judged = Q.scores_from_responses(answers.select("tweet_id"), answers, "tweet_id")
    path = scratch_dir(spark, "metrics")
    agreement = M.ratings_join(judged, B.human_ratings(spark, sf))
    written = E.metrics_document(scored, floor, "text", judge=judged, agreement=agreement)
    S.write_metrics_json(written, f"{path}/metrics")
    document = spark.read.text(f"{path}/metrics").select(F.from_json("value", written.schema).alias("d")).select("d.*")

    def told(prefix, row, names):
        return [F.struct(F.concat(prefix, F.lit(f".{n}")).alias("field"), row[n].cast("double").alias("value")) for n in names]

    def each(column, name, names):
        return F.flatten(F.transform(column, lambda r: F.array(*told(name(r), r, names))))

    percent = lambda c: F.round(c * 100).cast("int").cast("string")
    parts = [
        F.array(F.struct(F.lit("golden_set_size").alias("field"), F.col("golden_set_size").cast("double").alias("value")),
                F.struct(F.lit("false_negatives").alias("field"), F.col("false_negatives").cast("double").alias("value"))),
        F.transform("golden_set_sources", lambda r: F.struct(F.concat(F.lit("golden_set_sources."), r["source"]).alias("field"), r["n"].cast("double").alias("value"))),
        each("intent_classification", lambda r: F.concat(F.lit("intent_classification."), r["model"]), ("accuracy", "macro_f1")),
        F.flatten(F.transform("intent_classification", lambda m: F.flatten(F.transform(m["report"], lambda r: F.array(
            *told(F.concat(F.lit("intent_classification."), m["model"], F.lit(".report."), r["label"]), r, ("precision", "recall", "f1", "support"))))))),
        F.array(*told(F.lit("escalation"), F.col("escalation"), ("precision", "recall", "f1", "n_true", "n_predicted"))),
        each("escalation_threshold_sweep", lambda r: F.concat(F.lit("escalation_threshold_sweep."), percent(r["confidence_threshold"]), F.lit("."),
                                                              percent(r["retrieval_threshold"])), ("precision", "recall", "f1")),
        F.array(*told(F.lit("config"), F.col("config"), ("confidence_threshold_used", "retrieval_threshold_used"))),
        F.array(*told(F.lit("reply_quality_judge"), F.col("reply_quality_judge"), (*config.JUDGE_AXES, "n_scored"))),
        F.array(*told(F.lit("judge_human_agreement"), F.col("judge_human_agreement"), ("n_examples_rated",))),
        each("judge_human_agreement.spearman_by_axis", lambda r: F.concat(F.lit("judge_human_agreement."), r["axis"]), ("spearman_rho", "p_value", "n"))]
    return document.select(F.inline(F.concat(*parts))).select("field", F.round("value", 3).alias("value"))


@query("score_drafts", f"""WITH {B.MESSAGES}, asked AS (SELECT tweet_id, text FROM msgs WHERE inbound = 'True'),
n AS (SELECT tweet_id, length(text) AS l FROM asked)
SELECT count(*) AS n_scored, round(avg(1 + l % 5), 6) AS groundedness, round(avg(1 + l % 4), 6) AS correctness,
  round(avg(1 + l % 3), 6) AS brand_voice, round(avg(1 + l % 2), 6) AS actionability, 5.0::DOUBLE AS safety FROM n""")
def _(spark, sf):
    asked = _asked(spark, sf)
    cases, requests = E.draft_requests(asked, _label_answers(spark, sf), _index(spark, sf), "tweet_id", "text")
    drafts = requests.select("tweet_id", F.concat(F.lit("We read: "), "user").alias("raw"))
    n = F.length("text")
    grades = F.format_string('{"groundedness": %d, "correctness": %d, "brand_voice": %d, "actionability": %d, "safety": 5, '
                             '"rationale": "ok"}', 1 + n % 5, 1 + n % 4, 1 + n % 3, 1 + n % 2)
    _drafts, _requests, scores = E.score_drafts(cases, drafts, "tweet_id", "text", asked.select("tweet_id", grades.alias("raw")))
    means = M.judge_means(scores)
    return means.withColumns({a: F.round(a, 6) for a in config.JUDGE_AXES})
