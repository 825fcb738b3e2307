import json

import pytest
from pyspark.sql import functions as F

from caselight import config
from caselight.functions.responses import parse_judge, parse_label
from caselight.operators import metrics as M
from caselight.operators import requests as Q
from caselight.operators import retrieval as R
from caselight.plans import evaluation as E
from caselight.plans import handling as H
from caselight.streaming.arriving import handle_stream, read_arriving
from caselight.streaming.growing import GrowingIndex

PAIRS = [("p1", "battery drains so fast", "Try low power mode"), ("p2", "charged twice for one app", "DM your order"),
         ("p3", "screen has a crack", "Book a repair"), ("p4", "update made it crash", "Reinstall please"),
         ("p5", "thank you all", "You are welcome")]
ASKED = [("1", "@AppleSupport my battery drains so fast"), ("2", "I was charged twice, this sucks"), ("3", "charged twice please refund"),
         ("4", "my lawyer will call"), ("5", "locked out of icloud"), ("6", "qqq"), ("7", None)]


def index(spark):
    return R.fit_index(spark.createDataFrame(PAIRS, "pair_id string, cust string, reply string"), "pair_id", "cust", ("cust", "reply"))


def asked(spark):
    return spark.createDataFrame(ASKED, "id string, text string")


def test_handle(spark):
    got = {r["id"]: r for r in H.handle(asked(spark), index(spark), H.rule_classifier()).collect()}
    assert len(got) == 7
    assert {k: r["escalation_rule"] for k, r in got.items()} == {
        "1": "auto", "2": "negative_sensitive", "3": "auto", "4": "safety_term", "5": "forced_label", "6": "low_confidence", "7": "low_confidence"}
    assert got["1"]["cleaned_input"] == "my battery drains so fast" and got["1"]["grounded_on"][0]["doc_id"] == "p1"
    assert len(got["6"]["grounded_on"]) == 3 and got["6"]["top1_retrieval_score"] == 0.0
    assert got["1"]["draft_reply"] is None and got["7"]["cleaned_input"] == ""


def test_drafts_go_with_both_routes(spark, tmp_path):
    handled = H.handle(asked(spark), index(spark), H.rule_classifier(), draft="canned")
    auto, person = H.route(handled)
    assert {r["id"] for r in auto.collect()} == {"1", "3"}
    assert person.where("draft_reply IS NULL").count() == 0
    H.write_routed(handled, str(tmp_path / "r"))
    assert H.route_counts(H.scan_routed(spark, str(tmp_path / "r"))).where("escalate").agg(F.sum("n")).first()[0] == 5
    with pytest.raises(ValueError):
        H.handle(asked(spark), index(spark), H.rule_classifier(), draft="other")


def test_stream_equals_batch(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    asked(spark).where("id < '4'").repartition(2).write.parquet(source)
    ix = index(spark)

    def run():
        stream = read_arriving(spark, source, "id string, text string", files_per_batch=1)
        handle_stream(stream, ix, H.rule_classifier(), out, marks).awaitTermination()

    run()
    asked(spark).where("id >= '4'").write.mode("append").parquet(source)
    run()  # carries on from the marks
    batch = H.handle(asked(spark), ix, H.rule_classifier())
    columns = batch.columns
    assert sorted(map(repr, spark.read.parquet(out).select(*columns).collect())) == sorted(map(repr, batch.collect()))


@pytest.mark.parametrize("merge_every", [20, 1])
def test_a_growing_index_finds_the_replies_of_earlier_batches(spark, tmp_path, merge_every):
    source, out, marks, cases = (str(tmp_path / n) for n in ("in", "out", "marks", "cases"))
    first = [("n1", "my toaster explodes daily", "Unplug it"), ("n2", "no reply came to this", None)]
    second = [("n3", "the toaster explodes daily again", "As before"), ("n4", "charged twice for one app", None)]
    third = [("n5", "toaster explodes daily again", None)]
    schema, classify = "id string, text string, reply string", H.rule_classifier()
    corpus = spark.createDataFrame(PAIRS, "pair_id string, cust string, reply string")
    ix = GrowingIndex.start(corpus, "pair_id", "cust", cases, ("cust", "reply"), merge_every=merge_every)
    for batch in (first, second, third):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        handle_stream(read_arriving(spark, source, schema), ix, classify, out, marks, reply_col="reply").awaitTermination()
    got = {r["id"]: r for r in spark.read.parquet(out).collect()}
    assert got["n3"]["grounded_on"][0]["reply"] == "Unplug it" and got["n5"]["grounded_on"][0]["reply"] == "As before"
    known = list(PAIRS)
    for number, batch in enumerate((first, second, third)):
        union = R.fit_index(spark.createDataFrame(known, "pair_id string, cust string, reply string"), "pair_id", "cust", ("cust", "reply"))
        want = H.handle(spark.createDataFrame(batch, schema), union, classify)
        have = spark.read.parquet(f"{out}/batch={number}").select(*want.columns)
        assert sorted(map(repr, have.collect())) == sorted(map(repr, want.collect()))
        known += [x for x in batch if x[2]]
    # a batch that comes again overwrites its own version
    before = ix.state(2)
    ix.add(1, spark.createDataFrame([(a, b, c) for a, b, c in second if c], "pair_id string, cust string, reply string"), "cust")
    assert ix.state(2) == before and ix.state(1)["rows"] == len(PAIRS) + 1 and ix.state(2)["rows"] == len(PAIRS) + 2


def test_replies_need_a_growing_index(spark, tmp_path):
    with pytest.raises(ValueError, match="growing"):
        handle_stream(asked(spark), index(spark), H.rule_classifier(), "o", "c", reply_col="reply")


def parsed(spark, fn, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_parse_label(spark):
    got = parsed(spark, parse_label, ["battery_power", " Battery_Power. ", "It is account_access I think", "no idea", None,
                                      "order_shipping or battery_power"])
    assert [tuple(r) for r in got] == [("battery_power", 1.0), ("battery_power", 1.0), ("account_access", 0.5),
                                       ("other_uncategorised", 0.3), ("other_uncategorised", 0.3), ("battery_power", 0.5)]


def test_judge_grades_are_read_one_by_one(spark):
    got = parsed(spark, parse_judge, ['{"groundedness": "4", "correctness": "n/a", "safety": 5, "rationale": "r"}'])[0]
    assert (got["groundedness"], got["correctness"], got["brand_voice"], got["safety"], got["rationale"]) == (4.0, None, None, 5.0, "r")


def test_parse_judge(spark):
    good = {a: i + 1 for i, a in enumerate(config.JUDGE_AXES)} | {"rationale": "fine"}
    part = {k: v for k, v in good.items() if k != "safety"}
    texts = [json.dumps(good), f"```json\n{json.dumps(good)}\n```", f"```\n{json.dumps(part)}\n```", '{"groundedness": 3', "x" * 300, "", None, "[1]",
             '{"groundedness": null}']
    got = parsed(spark, parse_judge, texts)
    assert [r["groundedness"] for r in got] == [1, 1, 1, None, None, None, None, None, None]
    assert [r["safety"] for r in got[:3]] == [5, 5, None] and got[0]["rationale"] == "fine"
    assert got[4]["rationale"] == "JUDGE_PARSE_ERROR: " + "x" * 200 and got[3]["rationale"].startswith("JUDGE_PARSE_ERROR: {")
    assert got[8]["rationale"] is None


def test_prompts(spark):
    row = Q.classify_requests(asked(spark), "id", "text", Q.taxonomy_table(spark)).where("id = '6'").first()
    assert row["system"].index("- battery_power:") < row["system"].index("- other_uncategorised:")
    assert row["user"].count("Label: ") == sum(len(t.examples) for t in config.TAXONOMY) and row["user"].endswith('Message: "qqq"\nLabel:')


def test_references(spark):
    ix = index(spark)
    hits = R.hits_as_array(R.search(ix, asked(spark), "id", "text", k=1), "id", "pair_id", ix.payload)
    cases = asked(spark).join(hits, "id").withColumn("intent", F.lit("x")).withColumn("draft", Q.canned_reply(F.col("hits")))
    user = Q.reply_requests(cases, "id", "text", "intent", "hits").where("id = '3'").first()["user"]
    assert 'They wrote: "charged twice for one app" We answered: "DM your order" (similarity 0.' in user
    assert '- "DM your order"\nReply: "DM your order"' in Q.judge_requests(cases, "id", "text", "draft", "hits").where("id = '3'").first()["user"]
    none = cases.withColumn("hits", F.expr("filter(hits, h -> false)"))
    assert Q.NO_REFERENCES in Q.reply_requests(none, "id", "text", "intent", "hits").first()["user"]
    assert none.select(Q.canned_reply(F.col("hits"))).first()[0] == Q.FALLBACK_REPLY


def test_missing_responses_keep_their_rows(spark):
    answers = spark.createDataFrame([("1", "battery_power")], "id string, raw string")
    got = {r["id"]: (r["intent"], r["confidence"]) for r in Q.labels_from_responses(asked(spark), answers, "id").collect()}
    assert len(got) == 7 and got["1"] == ("battery_power", 1.0) and got["2"] == ("other_uncategorised", 0.3)


def test_document(spark, tmp_path):
    golden = asked(spark).where("id < '7'").withColumns({"true_intent": F.lit("battery_power"), "should_escalate": F.col("id") > "2",
                                                         "source": F.lit("own")})
    train = E.weakly_labelled(spark.createDataFrame(PAIRS, "pair_id string, cust string, reply string"), "cust")
    answers = golden.select("id", F.when(F.col("id") != "1", F.lit("battery_power")).otherwise(F.lit("no idea")).alias("raw"))
    model, baselines = E.train_eval_baselines(train, "pair_id", "cust", "weak_label", golden, "text", "true_intent", answers, "id")
    assert {r["intent"] for r in H.answers_classifier(answers, "id")(golden).collect()} == {"battery_power", "other_uncategorised"}
    scored = E.scored_golden(golden, index(spark), H.rule_classifier(), "id", "text")
    grades = spark.createDataFrame([(str(i), *[float(1 + (i + j) % 5) for j in range(5)]) for i in range(6)],
                                   "tweet_id string, " + ", ".join(f"{a} double" for a in config.JUDGE_AXES))
    human = spark.createDataFrame([(str(i), *[1 + i % 3] * 5) for i in range(6)],
                                  "tweet_id string, " + ", ".join(f"human_{a} int" for a in config.JUDGE_AXES))
    E.write_evaluation(scored, baselines, "text", str(tmp_path), judge=grades, agreement=M.ratings_join(grades, human))
    out = json.loads(spark.read.text(str(tmp_path / "metrics")).first()[0])
    assert out["golden_set_size"] == 6 and len(out["escalation_threshold_sweep"]) == 25 and len(out["judge_human_agreement"]["spearman_by_axis"]) == 5
    assert out["judge_human_agreement"]["n_examples_rated"] == 6
    told = {b["model"]: b for b in out["intent_classification"]}
    assert set(told) == {"tfidf", "trivial", "llm"} and told["llm"]["accuracy"] == pytest.approx(5 / 6)
    assert {r["label"] for r in told["llm"]["report"]} >= {*config.LABELS, "macro avg", "weighted avg"}
    assert out["escalation"]["n_true"] == 4 and out["false_negatives"] == 1
    assert spark.read.json(str(tmp_path / "false_negatives")).first()["text"] == "charged twice please refund"
    assert out["reply_quality_judge"]["n_scored"] == 6


def test_score_drafts(spark):
    cases, requests = E.draft_requests(asked(spark), spark.createDataFrame([("1", "battery_power")], "id string, raw string"),
                                       index(spark), "id", "text")
    assert requests.count() == 7
    replies = requests.select("id", F.lit("We can help.").alias("raw"))
    judge = requests.select("id", F.lit('{"groundedness": 4, "rationale": "r"}').alias("raw"))
    drafts, judge_requests, scores = E.score_drafts(cases, replies, "id", "text", judge)
    assert drafts.where("draft = 'We can help.'").count() == 7 and judge_requests.count() == 7
    assert M.judge_means(scores).first()["groundedness"] == 4.0
