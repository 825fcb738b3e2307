from pyspark.sql import functions as F

from caselight.operators import pairs as O
from caselight.operators.ordering import head_per_group, sample_n
from caselight.sources import messages as S

COLUMNS = "tweet_id string, author_id string, inbound string, created_at string, text string, response_tweet_id string, in_response_to_tweet_id string"
ROWS = [
    ("1", "u1", "True", "t", "hello there", "2,3", None),
    ("2", "Desk", "False", "t", "DM us", None, "1"),
    ("10", "Desk", "False", "t", "and again", None, "1"),
    ("4", "u2", "True", "t", "hello there", None, "2"),     # answers a reply
    ("5", "Desk", "False", "t", "DM us", None, "4"),          # same clean pair as 2
    ("6", "Desk", "False", "t", "lost", None, "99"),          # parent missing
    ("7", "Desk", "False", "t", "to ourselves", None, "2"),   # brand to brand
    ("8", "Other", "False", "t", "not us", None, "1"),
    ("9", "Desk", "False", "t", "no parent", None, None),
    ("11", "u3", "True", "t", None, None, None),
    ("12", "Desk", "False", "t", "https://x.example/y", None, "11"),
]


def messages(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def ids(df):
    return sorted((r["cust_tweet_id"], r["brand_tweet_id"]) for r in df.collect())


def test_all_replies(spark):
    assert ids(O.reply_pairs(messages(spark), "Desk")) == [("1", "10"), ("1", "2"), ("11", "12"), ("4", "5")]


def test_first_reply_by_number_not_text(spark):
    assert ids(O.reply_pairs(messages(spark), "Desk", first_only=True)) == [("1", "2"), ("11", "12"), ("4", "5")]


def test_dedupe_keeps_first_and_drops_links(spark):
    enriched = O.enrich(O.reply_pairs(messages(spark), "Desk"))
    assert ids(O.dedupe_pairs(enriched)) == [("1", "10"), ("1", "2"), ("11", "12")]
    assert ids(O.build_pairs(messages(spark), "Desk", None)) == [("1", "10"), ("1", "2")]
    assert O.drop_report(enriched).first().asDict() == {"rows_before": 4, "rows_after": 2, "rows_dropped": 2}


def test_sample_is_exact_and_stable(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"))
    first = {r["a"] for r in sample_n(df, 700, ["a", "b"]).collect()}
    again = {r["a"] for r in sample_n(df.repartition(7), 700, ["a", "b"]).collect()}
    import hashlib
    want = sorted((hashlib.md5(f"42:{i}:x".encode()).hexdigest(), str(i)) for i in range(5000))[:700]
    assert first == again == {i for _, i in want}
    assert sample_n(df, 9000, ["a", "b"]).count() == 5000
    assert sample_n(df, None, ["a", "b"]) is df and sample_n(df, 0, ["a", "b"]) is df


def test_group_heads(spark):
    hot = spark.range(3000).withColumn("g", F.when(F.col("id") < 2000, 0).otherwise(F.col("id")))
    assert head_per_group(hot, ["g"], [F.asc("id")], 2).count() == 1002


def test_hot_group_is_cut_before_the_shuffle(spark, plan):
    text = plan(head_per_group(spark.range(100).withColumn("g", F.col("id") % 3), ["g"], [F.asc("id")], 1), "simple")
    assert "WindowGroupLimit" in text
    assert text.rindex("WindowGroupLimit") > text.rindex("Exchange hashpartitioning")  # nearer the scan


def test_filters_reach_the_scan(spark, plan, tmp_path):
    path = str(tmp_path / "m")
    messages(spark).write.parquet(path)
    text = plan(O.reply_pairs(spark.read.parquet(path), "Desk"))
    assert "EqualTo(author_id,Desk)" in text and "IsNotNull(in_response_to_tweet_id)" in text
    assert "response_tweet_id:string>" not in text.replace("in_response_to_tweet_id:string>", "")


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", "a", "True", "t", 'say "hi",\nthen go', "2,3", None), ("2", "b", "False", "t", "", None, "1")]
    df = spark.createDataFrame(rows, COLUMNS)
    S.write_csv(df, str(tmp_path / "c"))
    got = sorted(map(tuple, S.scan_messages(spark, str(tmp_path / "c")).collect()))
    assert got == [rows[0], ("2", "b", "False", "t", None, None, "1")]


def test_golden_schema(spark, tmp_path):
    (tmp_path / "g.csv").write_text('tweet_id,cust_text,true_intent,should_escalate,escalate_reason,ideal_reply_notes,labeler_notes,source\n'
                                    '7,"two\nlines",battery_power,True,,,,own\n')
    row = S.scan_labelled(spark, str(tmp_path / "g.csv")).first()
    assert row["cust_text"] == "two\nlines" and row["should_escalate"] is True and row["escalate_reason"] is None


def test_pairs_parquet(spark, tmp_path):
    built = O.build_pairs(messages(spark), "Desk", None)
    S.write_pairs(built, str(tmp_path / "p"))
    assert ids(S.scan_pairs(spark, str(tmp_path / "p"))) == ids(built)


def test_sample_stays_spread(spark, plan):
    sample = sample_n(spark.range(5000).select(F.col("id").cast("string").alias("a")), 4000, ["a"])
    assert sample.rdd.getNumPartitions() > 1 and sample.count() == 4000
