import re
import unicodedata

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caselight import config
from caselight.functions import text as T


def apply(spark, fn, values):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


# Inputs with the outputs that the cleaning rules call for, written by hand.
CLEANED = {
    "@AppleSupport my phone": "my phone", "@applesupport_fan hi": "@USER hi", "@@x": "@@USER", "mail a@b.com. now": "mail <EMAIL> now",
    "see https://t.co/a@b ok": "see <URL> ok", "12345 123456 a123456 123456b 123456, (7654321)": "12345 <ID> a123456 123456b <ID>, (<ID>)",
    "٣٤٥٦٧٨ @张伟 é123456": "<ID> @USER é123456", "a\xa0b c\nd": "a b c d", "x": "x", "": "", None: "", "  lead and trail\t": "lead and trail",
    "@105835 call 5551234": "@USER call <ID>", "https://": "https://", "http://x": "<URL>", "a" * 5000 + " b@c.de": "a" * 5000 + " <EMAIL>",
}


def test_clean_table(spark):
    assert apply(spark, lambda c: T.clean_text(c, repair=False), list(CLEANED)) == list(CLEANED.values())


alphabet = st.sampled_from(list("ab1290 @.+-_:/é\n\xa0") + ["@AppleSupport", "https://", "123456", "@", ".com"])


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(alphabet, max_size=14).map("".join), min_size=20, max_size=60))
def test_clean_property(spark, texts):
    for clean in apply(spark, lambda c: T.clean_text(c, repair=False), texts):
        assert all(name == "USER" for name in re.findall(r"@(\w+)", clean))
        assert not re.search(r"\b\d{6}\d*\b", clean)
        assert clean == " ".join(clean.split())


def test_scrub_is_optional(spark):
    assert apply(spark, lambda c: T.clean_text(c, scrub_pii=False), ["id 1234567"]) == ["id 1234567"]


def test_fix_encoding(spark):
    got = apply(spark, T.fix_encoding, ["donâ€™t", "cafÃ©", "café", "Ã", "&amp;lt; &lt;b&gt;", "<b>&amp;</b>", "“a” ‘b’", "a\r\nb\x07",
                                        "ﬁne ＡＢ", "snow ☃ Ã©", None])
    assert got == ["don't", "café", "café", "Ã", "&lt; <b>", "<b>&amp;</b>", "\"a\" 'b'", "a\nb", "fine AB", "snow ☃ é", None]


def test_broken_stretches_are_mended_beside_sound_ones(spark):
    texts = ["naïve cafÃ© ☃", "éÃ©Ã", "SÃO PAULO", "donâ€™t 日本 naïve", "ÐŸÑ€Ð¸Ð²ÐµÑ‚ привет", "Ã©" * 3000 + " ï", "Ã\xa0 la", "ï¿½Ã¼"]
    assert apply(spark, T.repair_mojibake, texts) == ["naïve café ☃", "ééÃ", "SÃO PAULO", "don’t 日本 naïve", "Привет привет", "é" * 3000 + " ï", "à la", "\ufffdü"]


def test_composition_equals_the_library(spark):
    random = np.random.default_rng(4)
    letters = list("aeiouAEncCoOsSẹệêâ각가x9 \n") + ["\u1100", "\u1161", "\u11a8", "\u0915", "\u0bc6", "\u212b", "\u2126", "\u0958", "\U0001d15e", "\uf900"]
    marks = [chr(c) for c in (0x300, 0x301, 0x302, 0x303, 0x308, 0x323, 0x327, 0x328, 0x331, 0x344, 0x345, 0x93c, 0x9be, 0xbbe, 0x3099, 0x5bc)]
    texts = ["".join(random.choice(letters if random.random() < 0.5 else marks) for _ in range(random.integers(0, 14))) for _ in range(1500)]
    texts += [unicodedata.normalize("NFD", chr(c)) + "x" for c in range(0x80, 0x2000)] + ["plain", "", "e" + "\u0301" * 150]
    assert apply(spark, T.compose, texts) == [unicodedata.normalize("NFC", t) for t in texts]
    assert apply(spark, T.compose, [None]) == [None]


def test_references_equal_the_standard(spark):
    import html
    texts = ["caf&eacute; &#8217;s &copy; &#233;", "&#x1F600;&#128;&#0;&#xD800;&#x110000;&#1;x", "&AMP; &notin; &NotEqualTilde;", "a & b &; &&amp;", "&#x41;&#65;"]
    assert apply(spark, T.decode_entities, texts) == [html.unescape(t) for t in texts]
    assert apply(spark, T.decode_entities, ["&noname;", "&#x;", "&amp;lt;", "x < &amp;"]) == ["&noname;", "&#x;", "&lt;", "x < &amp;"]


def test_emoji(spark):
    assert apply(spark, T.has_positive_emoji, ["❤️", "❤", "👍!", None, ""]) == [True, False, True, False, False]
    assert apply(spark, T.has_negative_emoji, ["😡😡", "ok", None]) == [True, False, False]


def test_substring_traps_and_whole_words(spark):
    texts = ["the issue", "sue them", "abandoned", "all done", "Admin", "DM us", None]
    assert apply(spark, T.safety_term, texts) == ["sue", "sue", None, None, None, None, None]
    assert apply(spark, lambda c: T.safety_term(c, whole_word=True), texts)[:2] == [None, "sue"]
    assert apply(spark, T.negative_sentiment, texts) == [False, False, True, True, False, False, False]
    assert apply(spark, lambda c: T.negative_sentiment(c, whole_word=True), texts)[2:4] == [False, True]
    assert apply(spark, T.mentions_handoff, texts) == [False] * 4 + [True, True, False]


def test_first_listed_safety_term_wins(spark):
    assert apply(spark, T.safety_term, ["hacked, call a lawyer", "SUICIDE", "legal action"]) == ["lawyer", "suicide", "legal action"]


def test_every_rule_and_their_order(spark):
    texts = [words[0] for _, words in config.KEYWORD_RULES] + ["battery refund", "crack in the update", "hello", "THANKS", None]
    want = [label for label, _ in config.KEYWORD_RULES] + ["app_store_billing", "device_damage_repair",
                                                           "other_uncategorised", "general_praise_or_vent", "other_uncategorised"]
    assert apply(spark, T.weak_label, texts) == want


def test_boilerplate(spark):
    assert apply(spark, T.not_boilerplate, ["<URL>", " <URL>  <URL>", "see <URL>", ""]) == [False, False, True, False]


def test_cleaning_stays_in_the_jvm(spark, plan):
    df = spark.createDataFrame([("x",)], "t string")
    text = plan(df.select(T.clean_text(F.col("t")), T.negative_sentiment(F.col("t")), T.weak_label(F.col("t"))))
    assert "EvalPython" not in text and "Exchange" not in text


def test_composition_reads_no_long_map():
    """A map is read from end to end: the tables are dealt to buckets of a few entries."""
    import json
    for name in ("apart", "pairs", "ranks"):
        buckets = json.loads(T._composition()[name])
        assert isinstance(buckets, list) and max(map(len, buckets)) <= 16


def test_a_letter_with_one_mark(spark):
    texts = [a + chr(c) + "z" for a in "aeqZ-" for c in range(0x300, 0x370)]
    assert apply(spark, T.compose, texts) == [unicodedata.normalize("NFC", t) for t in texts]
