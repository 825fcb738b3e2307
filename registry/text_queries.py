"""Scans, cleaning, flags, rules and pairs."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from caselight import config
from caselight.functions import policy as P
from caselight.functions import text as T
from caselight.functions import tokens as K
from caselight.operators import pairs as O
from caselight.operators.ordering import sample_n
from caselight.session import scratch_dir
from caselight.sources import messages as S
from registry import base as B

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


# --- scans and sinks -------------------------------------------------------------------------

@query("scan_messages", f"WITH {B.MESSAGES} SELECT * FROM msgs")
def _(spark, sf):
    path = scratch_dir(spark, "messages-csv")
    S.write_csv(B.messages(spark, sf), path)
    return S.scan_messages(spark, path)


@query("scan_pairs", f"""WITH {B.BUILT} SELECT cust_tweet_id, brand_tweet_id, cust_text_clean, brand_text_clean,
  has_negative_emoji, has_positive_emoji, has_dm_handoff FROM built""")
def _(spark, sf):
    path = scratch_dir(spark, "pairs")
    S.write_pairs(O.build_pairs(B.messages(spark, sf), B.BRAND, None, brands=B.BRANDS), path)
    return S.scan_pairs(spark, path).select(
        "cust_tweet_id", "brand_tweet_id", "cust_text_clean", "brand_text_clean", "has_negative_emoji",
        "has_positive_emoji", "has_dm_handoff")


@query("scan_labelled", f"""WITH {B.GRADED} SELECT doc_id::VARCHAR AS tweet_id, text AS cust_text, true_intent,
  should_escalate, NULL::VARCHAR AS escalate_reason, NULL::VARCHAR AS ideal_reply_notes,
  NULL::VARCHAR AS labeler_notes, source FROM graded""")
def _(spark, sf):
    path = scratch_dir(spark, "golden-csv")
    nothing = F.lit(None).cast("string")
    S.write_csv(B.graded(spark, sf).select(
        F.col("doc_id").cast("string").alias("tweet_id"), F.col("text").alias("cust_text"), "true_intent",
        "should_escalate", nothing.alias("escalate_reason"), nothing.alias("ideal_reply_notes"),
        nothing.alias("labeler_notes"), "source"), path)
    return S.scan_labelled(spark, path)


# --- cleaning ----------------------------------------------------------------------------------

def _docs(spark, sf):
    return B.documents(spark, sf)


REFERENCES = (("caf&eacute; &#8217;s", "café 's"), ("&copy; &#233; &#x1F600;", "© é 😀"), ("a &amp;lt; b &hellip;", "a &lt; b …"),
              ("&noname; &#x; & &#55555555555;", "&noname; &#x; & &#55555555555;"), ("&AMP;&nbsp;x &frac12;", "&\u00a0x ½"),
              ("5 &#128; &#0; &Sigma;&sigma;", "5 € \ufffd Σσ"))
MOJIBAKE = (("cafÃ© nÂº", "café nº"), ("itâ€™s", "it's"), ("naÃ¯ve â€œquoteâ€\x9d", 'naïve "quote"'), ("plain", "plain"),
            ("schon gut: é", "schon gut: é"), ("StraÃŸe", "Straße"))


def _side(phrases, at: int, number: str) -> str:
    return B.sql_pick(tuple(p[at] for p in phrases), number)


_READ_WRONG = {c: c.encode().decode("cp1252") for c in "éèêëçñöüäßáíóúâôîûœ"}


@query("repair_stretches", "SELECT doc_id, 'naïve ☃ ' || coalesce(text, '') AS text FROM documents")
def _(spark, sf):
    """Whole documents whose accented letters were read in the wrong encoding, behind a sound word and another script: only the broken parts change."""
    broken = F.coalesce("text", F.lit(""))
    for sound, wrong in _READ_WRONG.items():
        broken = F.replace(broken, F.lit(sound), F.lit(wrong))
    return B.table(spark, sf, "documents", spread=True).select("doc_id", T.repair_mojibake(F.concat(F.lit("naïve ☃ "), broken)).alias("text"))


_APART = {c: unicodedata.normalize("NFD", c) for c in "éèêëçñöüäáíóúâôîû"}


def _sql_apart(text: str) -> str:
    for whole, parts in _APART.items():
        text = f"replace({text}, '{whole}', '{parts}')"
    return text


@query("compose_text", f"""SELECT doc_id, nfc_normalize({_sql_apart("coalesce(text, '')")} || 'Å' || chr(803) || chr(8491) || 'q' || chr(775) || chr(803)) AS text
FROM documents""")
def _(spark, sf):
    """Whole documents with their accents apart, and marks out of order behind them."""
    apart = F.coalesce("text", F.lit(""))
    for whole, parts in _APART.items():
        apart = F.replace(apart, F.lit(whole), F.lit(parts))
    tail = F.lit("Å" + chr(803) + chr(8491) + "q" + chr(775) + chr(803))
    return B.table(spark, sf, "documents", spread=True).select("doc_id", T.compose(F.concat(apart, tail)).alias("text"))


@query("fix_encoding", rf"""WITH t AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, html FROM pages),
a AS (SELECT page_id, {B.sql_entities('title')} AS title, html FROM t)
SELECT 'title' AS kind, page_id AS id, {B.sql_straight('title')} AS text FROM a
UNION ALL SELECT 'page', page_id, {B.sql_straight('html')} FROM a
UNION ALL SELECT 'document', doc_id, CASE WHEN contains(text, '<') THEN {B.sql_straight(f"text || ' ' || {_side(REFERENCES, 0, 'doc_id')}")}
  ELSE {B.sql_straight(B.sql_entities('text'))} || ' ' || {_side(REFERENCES, 1, 'doc_id')} END FROM documents
UNION ALL SELECT 'phrase', doc_id, {_side(MOJIBAKE, 1, 'doc_id')} || ' ' || doc_id FROM documents""")
def _(spark, sf):
    """Page titles, whole pages, whole documents with references behind them, and phrases that were read in the wrong encoding."""
    pages, docs = B.table(spark, sf, "pages", spread=True), B.table(spark, sf, "documents", spread=True)
    part = lambda df, kind, key, text: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), text.alias("text"))
    phrase = lambda phrases: B.pick(tuple(p[0] for p in phrases), F.col("doc_id"))
    given = (part(pages, "title", "page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1))
             .unionByName(part(pages, "page", "page_id", F.col("html")))
             .unionByName(part(docs, "document", "doc_id", F.concat_ws(" ", "text", phrase(REFERENCES))))
             .unionByName(part(docs, "phrase", "doc_id", F.concat_ws(" ", phrase(MOJIBAKE), F.col("doc_id").cast("string")))))
    return given.select("kind", "id", T.fix_encoding(F.col("text")).alias("text"))


@query("normalise_mentions", f"WITH {B.DOCUMENTS} SELECT doc_id, {B.sql_mentions('text')} AS text FROM docs")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", T.normalise_mentions(F.col("text"), B.BRANDS).alias("text"))


@query("normalise_urls", f"WITH {B.DOCUMENTS} SELECT doc_id, {B.sql_urls('text')} AS text FROM docs")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", T.normalise_urls(F.col("text")).alias("text"))


@query("redact_pii", f"WITH {B.DOCUMENTS} SELECT doc_id, {B.sql_pii('text')} AS text FROM docs")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", T.redact_pii(F.col("text")).alias("text"))


@query("collapse_whitespace", f"SELECT doc_id, {B.sql_collapse('text')} AS text FROM documents")
def _(spark, sf):
    return B.table(spark, sf, "documents", spread=True).select(
        "doc_id", T.collapse_whitespace(F.col("text")).alias("text"))


@query("clean_text", f"""WITH {B.DOCUMENTS},
{B.clean_ctes('docs', {'clean': 'text'}, 'cleaned')} SELECT doc_id, clean FROM cleaned""")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_text(F.col("text"), brands=B.BRANDS).alias("clean"))


# --- flags ---------------------------------------------------------------------------------------

@query("emoji_flags", f"""WITH {B.MESSAGES} SELECT tweet_id, {B.sql_any('text', config.NEGATIVE_EMOJI)} AS negative,
  {B.sql_any('text', config.POSITIVE_EMOJI)} AS positive FROM msgs""")
def _(spark, sf):
    return B.messages(spark, sf).select("tweet_id", T.has_negative_emoji(F.col("text")).alias("negative"),
                                        T.has_positive_emoji(F.col("text")).alias("positive"))


@query("handoff_rate", f"""WITH {B.ENRICHED} SELECT {B.sql_weak_label('cust_text_clean')} AS label,
  count(*) AS n, round(avg(has_dm_handoff::INTEGER), 6) AS handoff_rate FROM enriched GROUP BY 1""")
def _(spark, sf):
    pairs = O.enrich(O.reply_pairs(B.messages(spark, sf), B.BRAND), B.BRANDS)
    return pairs.groupBy(T.weak_label(F.col("cust_text_clean")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("has_dm_handoff").cast("int")), 6).alias("handoff_rate"))


@query("negative_sentiment", f"WITH {B.DOCUMENTS} SELECT doc_id, {B.sql_negative('text')} AS negative FROM docs")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", T.negative_sentiment(F.col("text")).alias("negative"))


@query("safety_term", f"WITH {B.DOCUMENTS} SELECT doc_id, {B.sql_safety('text')} AS term FROM docs")
def _(spark, sf):
    return _docs(spark, sf).select("doc_id", T.safety_term(F.col("text")).alias("term"))


@query("weak_label_default", f"""WITH {B.MESSAGES} SELECT tweet_id, {B.sql_weak_label('text')} AS label FROM msgs
WHERE inbound = 'True'""")
def _(spark, sf):
    return O.customer_messages(B.messages(spark, sf)).select("tweet_id", T.weak_label(F.col("text")).alias("label"))


PROSE_RULES = (("rare", ("thhe", "üch")), ("french", ("elle", "eau")), ("german", ("ung", "lich")),
               ("english", ("tion", "the")))


@query("weak_label_docs", f"""SELECT doc_id, {B.sql_weak_label('text', PROSE_RULES, 'none')} AS label FROM documents""")
def _(spark, sf):
    return B.table(spark, sf, "documents", spread=True).select(
        "doc_id", T.weak_label(F.col("text"), PROSE_RULES, "none").alias("label"))


# --- pairs -----------------------------------------------------------------------------------------

RAW_PAIRS = f"""WITH {B.MESSAGES}, p AS (SELECT c.tweet_id AS cust_tweet_id, c.text AS cust_text,
    c.created_at AS cust_created_at, b.tweet_id AS brand_tweet_id, b.text AS brand_text, b.created_at AS brand_created_at
  FROM msgs b JOIN msgs c ON b.in_response_to_tweet_id = c.tweet_id
  WHERE b.inbound = 'False' AND b.author_id = {B.lit(B.BRAND)} AND c.inbound = 'True')"""


@query("reply_pairs", f"{RAW_PAIRS} SELECT * FROM p")
def _(spark, sf):
    return O.reply_pairs(B.messages(spark, sf), B.BRAND)


def _opening(messages):
    """Every message answers the opening one of its conversation, so that messages have several replies."""
    opening = F.concat(F.substring_index("tweet_id", ":", 1), F.lit(":0"))
    return messages.withColumn("in_response_to_tweet_id", F.when(F.col("tweet_id") != opening, opening))


@query("reply_pairs_first", f"""WITH {B.MESSAGES}, m2 AS (SELECT * REPLACE (CASE WHEN tweet_id <> split_part(tweet_id, ':', 1) || ':0'
    THEN split_part(tweet_id, ':', 1) || ':0' END AS in_response_to_tweet_id) FROM msgs)
SELECT cust_tweet_id, brand_tweet_id, brand_text FROM (
  SELECT c.tweet_id AS cust_tweet_id, b.tweet_id AS brand_tweet_id, b.text AS brand_text,
         row_number() OVER (PARTITION BY c.tweet_id ORDER BY length(b.tweet_id), b.tweet_id) AS rn
  FROM m2 b JOIN m2 c ON b.in_response_to_tweet_id = c.tweet_id
  WHERE b.inbound = 'False' AND b.author_id = {B.lit(B.BRAND)} AND c.inbound = 'True') WHERE rn = 1""")
def _(spark, sf):
    return O.reply_pairs(_opening(B.messages(spark, sf)), B.BRAND, first_only=True).select(
        "cust_tweet_id", "brand_tweet_id", "brand_text")


@query("enrich_pairs", f"WITH {B.ENRICHED} SELECT * FROM enriched")
def _(spark, sf):
    return O.enrich(O.reply_pairs(B.messages(spark, sf), B.BRAND), B.BRANDS)


@query("dedupe_pairs", f"""WITH {B.ENRICHED} SELECT cust_tweet_id, brand_tweet_id, cust_text_clean, brand_text_clean
FROM (SELECT *, row_number() OVER (PARTITION BY cust_text_clean, brand_text_clean ORDER BY {B.ID_ORDER}) AS rn
      FROM enriched) WHERE rn = 1""")
def _(spark, sf):
    pairs = O.enrich(O.reply_pairs(B.messages(spark, sf), B.BRAND), B.BRANDS)
    return O.dedupe_pairs(pairs).select("cust_tweet_id", "brand_tweet_id", "cust_text_clean", "brand_text_clean")


@query("drop_boilerplate", f"WITH {B.ENRICHED} SELECT cust_tweet_id, brand_tweet_id, brand_text_clean FROM enriched WHERE {B.KEPT}")
def _(spark, sf):
    pairs = O.enrich(O.reply_pairs(B.messages(spark, sf), B.BRAND), B.BRANDS)
    return O.drop_boilerplate(pairs).select("cust_tweet_id", "brand_tweet_id", "brand_text_clean")


@query("drop_report", f"""WITH {B.BUILT} SELECT (SELECT count(*) FROM enriched) AS rows_before,
  (SELECT count(*) FROM built) AS rows_after, (SELECT count(*) FROM enriched) - (SELECT count(*) FROM built) AS rows_dropped""")
def _(spark, sf):
    return O.drop_report(O.enrich(O.reply_pairs(B.messages(spark, sf), B.BRAND), B.BRANDS))


@query("build_pairs", f"""WITH {B.BUILT} SELECT {B.sql_weak_label('cust_text_clean')} AS label, count(*) AS n,
  CAST(sum(has_dm_handoff::INTEGER) AS BIGINT) AS handoffs, CAST(sum(has_negative_emoji::INTEGER) AS BIGINT) AS negative
FROM built GROUP BY 1""")
def _(spark, sf):
    built = O.build_pairs(B.messages(spark, sf), B.BRAND, None, brands=B.BRANDS)
    return built.groupBy(T.weak_label(F.col("cust_text_clean")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("has_dm_handoff").alias("handoffs"),
        F.count_if("has_negative_emoji").alias("negative"))


SAMPLE = 150


@query("sample_n", f"""{RAW_PAIRS} SELECT cust_tweet_id, brand_tweet_id FROM p
ORDER BY md5('42' || ':' || cust_tweet_id || ':' || brand_tweet_id), cust_tweet_id, brand_tweet_id LIMIT {SAMPLE}""")
def _(spark, sf):
    pairs = O.reply_pairs(B.messages(spark, sf), B.BRAND)
    return sample_n(pairs, SAMPLE, ["cust_tweet_id", "brand_tweet_id"]).select("cust_tweet_id", "brand_tweet_id")


# --- tokens ---------------------------------------------------------------------------------------

STOP = ("the", "and", "of", "to", "in", "my", "is", "der", "die", "und", "la", "le", "les", "des", "et")


@query("tokenize", rf"""SELECT doc_id, len(t) AS n_tokens, list_distinct(t).len() AS n_distinct, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[{B.W}]{{2,}}') AS t FROM documents)""")
def _(spark, sf):
    tokens = B.table(spark, sf, "documents", spread=True).select("doc_id", K.tokenize(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"),
                         F.size(F.array_distinct("t")).cast("long").alias("n_distinct"),
                         F.array_join("t", " ").alias("tokens"))


@query("stop_words", rf"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[{B.W}]{{2,}}'),
  lambda x: NOT list_contains([{', '.join(map(B.lit, STOP))}], x)), ' ') AS kept FROM documents""")
def _(spark, sf):
    kept = K.drop_stop_words(K.tokenize(F.col("text")), STOP)
    return B.table(spark, sf, "documents", spread=True).select("doc_id", F.array_join(kept, " ").alias("kept"))


@query("ngrams", f"""WITH {B.terms_ctes('documents', 'doc_id', 'text', 'x', STOP)} SELECT id AS doc_id, count(*) AS n_terms,
  CAST(sum(tf) AS BIGINT) AS n_total, CAST(max(tf) AS BIGINT) AS max_tf, min(term) AS first_term FROM x GROUP BY id""")
def _(spark, sf):
    counts = K.term_counts(K.terms(F.col("text"), STOP))
    summed = T.bind(counts, lambda c: F.when(F.size(c) > 0, F.struct(  # in the row, so that no term is shuffled; the terms are in order
        F.size(c).cast("long").alias("n"), F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["tf"]).alias("total"),
        F.array_max(F.transform(c, lambda x: x["tf"])).cast("long").alias("most"), F.get(c, F.lit(0))["term"].alias("first"))))
    rows = B.table(spark, sf, "documents", spread=True).select("doc_id", summed.alias("s"))
    return rows.groupBy("doc_id").agg(
        F.sum("s.n").alias("n_terms"), F.sum("s.total").alias("n_total"), F.max("s.most").alias("max_tf"),
        F.min("s.first").alias("first_term")).where(F.col("n_terms").isNotNull())


# --- policy --------------------------------------------------------------------------------------------

def sql_rule(conf: str = str(config.CONFIDENCE_THRESHOLD), retr: str = str(config.RETRIEVAL_THRESHOLD)) -> str:
    return f"""CASE WHEN {B.sql_safety('text')} IS NOT NULL THEN 'safety_term'
  WHEN intent = 'account_access' THEN 'forced_label' WHEN confidence < {conf}::DOUBLE THEN 'low_confidence'
  WHEN top1_score < {retr}::DOUBLE THEN 'no_precedent'
  WHEN negative AND intent = 'app_store_billing' THEN 'negative_sensitive' ELSE 'auto' END"""


def _decision():
    return P.decide(F.col("text"), F.col("intent"), F.col("confidence"), F.col("top1_score"), F.col("negative"))


@query("escalate", f"""WITH {B.GRADED}, r AS (SELECT *, {sql_rule()} AS rule FROM graded)
SELECT doc_id, rule <> 'auto' AS escalate, rule FROM r""")
def _(spark, sf):
    rows = B.graded(spark, sf).withColumn("d", _decision())
    return rows.select("doc_id", F.col("d.escalate").alias("escalate"), F.col("d.rule").alias("rule"))


@query("escalation_reason", f"""WITH {B.GRADED}, r AS (SELECT *, {sql_rule()} AS rule FROM graded)
SELECT doc_id, CASE rule
  WHEN 'safety_term' THEN 'The message uses safety, security or legal wording; a person always takes these.'
  WHEN 'forced_label' THEN 'Intent ' || intent || ' touches account security; it is never answered automatically.'
  WHEN 'low_confidence' THEN printf('Intent confidence %.2f is under the %.2f threshold.', confidence, 0.55::DOUBLE)
  WHEN 'no_precedent' THEN printf('No close precedent: best similarity %.2f is under %.2f.', top1_score, 0.05::DOUBLE)
  WHEN 'negative_sensitive' THEN 'A billing matter told in strongly negative words; a person should answer.'
  ELSE 'Intent ' || intent || printf(' at confidence %.2f with precedent similarity %.2f; fit for an automatic reply.',
                                     confidence, top1_score) END AS reason FROM r""")
def _(spark, sf):
    return B.graded(spark, sf).select("doc_id", _decision()["reason"].alias("reason"))
