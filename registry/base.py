"""Frames derived from the given tables, once for Spark and once as SQL.

The given texts are invented prose on which few default keywords fire, so a short
support phrase, picked by row number, is added to each text.  In every third
conversation the phrase is the whole text, which makes many exact copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight import config

BRAND = "HelpDesk"
BRANDS = ("helpdesk",)

PHRASES = (
    "@HelpDesk my battery drains by noon",
    "@helpdesk @user_77 I was charged twice, refund me, this is ridiculous",
    "locked out of my account, mail me at jo.doe+x@mail.example.org",
    "the screen has a crack after a fall 😡",
    "since the update it will freeze &amp; crash https://t.example/a1b2",
    "order 12345678 was never shipped",
    "thank you, great job 🙂❤️",
    "does the old cable fit?",
    "I will call my lawyer about invoice 0048812345",
    "someone hacked it, ref AB123456 and 1234567",
    "“cancel” my subscription, I hate waiting 😤",
    "is this done ? ask @HelpDeskFans",
    "charging port is loose\n\n call 555123 or 5551234",
    "ok",
    "warranty question for id 777888999, screen fine",
    "sign in fails &lt;again&gt; and the 2fa code never comes, a nightmare",
)
REPLIES = (
    "Please DM us your details",
    "https://help.example/faq",
    "Have you tried to restart? @user_9 https://help.example/r",
    "Send a direct message with order 99887766",
    "Our admin team will look",
    "Sorry about that 😢 we are on it",
    "Write to care@helpdesk.example please",
    "Thanks! Glad it works",
)


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A given table.  With ``spread``, a scan with fewer tasks than cores is dealt out to them first; a large one never is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def pick(options: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), F.pmod(number, F.lit(len(options))).cast("int"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` in the layout of a raw thread table."""
    c = table(spark, sf_dir, "conversations", spread=True)
    ident = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    phrase = F.when(F.col("role") == "assistant", pick(REPLIES, F.col("conv_id"))).otherwise(
        pick(PHRASES, F.col("conv_id") + F.col("turn")))
    text = (F.when(F.col("role") == "system", F.col("text"))
            .when(F.col("conv_id") % 3 == 0, phrase)
            .otherwise(F.concat_ws(" ", "text", phrase)))
    return c.select(
        ident(F.col("turn")).alias("tweet_id"),
        F.when(F.col("role") == "assistant", F.lit(BRAND)).otherwise(
            F.concat("role", F.col("conv_id").cast("string"))).alias("author_id"),
        F.when(F.col("role") == "user", F.lit("True")).otherwise(F.lit("False")).alias("inbound"),
        F.concat(F.lit("t"), F.col("turn").cast("string")).alias("created_at"),
        text.alias("text"),
        ident(F.col("turn") + 1).alias("response_tweet_id"),
        F.when(F.col("turn") > 0, ident(F.col("turn") - 1)).alias("in_response_to_tweet_id"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with a phrase in front of each text."""
    d = table(spark, sf_dir, "documents", spread=True)
    return d.withColumn("text", F.concat_ws(" ", pick(PHRASES, F.col("doc_id")), "text"))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents in the layout of a scored golden table."""
    from caselight.functions import text as T

    d = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    truth = pick(config.LABELS, F.col("doc_id") + F.col("quality") + 3 * F.col("toxic"))
    return d.select(
        "doc_id", "text", "source", truth.alias("true_intent"),
        T.weak_label(F.col("text")).alias("intent"),
        ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("should_escalate"),
        (F.pmod("n_chars", F.lit(97)) / F.lit(96.0)).alias("confidence"),
        (F.pmod("n_chars", F.lit(41)) / F.lit(100.0)).alias("top1_score"),
        T.negative_sentiment(F.col("text")).alias("negative"))


def judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language-model judge's raw answer per document: fenced, bare, badly typed, broken, partial or prose."""
    d = table(spark, sf_dir, "documents")
    n, i = F.col("n_chars"), F.col("doc_id")
    grades = {"groundedness": 1 + n % 5, "correctness": 1 + F.floor(n / 5) % 5, "brand_voice": 1 + i % 5,
              "actionability": 1 + (i + n) % 5, "safety": 1 + F.floor(n / 7) % 5}

    def body(axes) -> Column:
        parts = [c for a in axes for c in (F.lit(f'"{a}": '), grades[a].cast("string"), F.lit(", "))]
        return F.concat(F.lit("{"), *parts, F.lit('"rationale": "read '), n.cast("string"), F.lit('"}'))

    full = body(config.JUDGE_AXES)
    odd = F.regexp_replace(F.regexp_replace(full, r'"groundedness": (\d)', r'"groundedness": "$1"'), r'"correctness": \d', '"correctness": "n/a"')
    raw = (F.when(i % 5 == 0, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
           .when(i % 10 == 1, odd)
           .when(i % 5 == 1, full)
           .when(i % 5 == 2, F.concat(F.lit("{"), full))
           .when(i % 5 == 3, body(config.JUDGE_AXES[:4]))
           .otherwise(F.concat(F.lit("I would say "), (n % 5).cast("string"))))
    return d.select(F.col("doc_id").cast("string").alias("tweet_id"), raw.alias("raw"))


def human_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nullable whole grades per labelled document."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n, i = F.col("n_chars"), F.col("doc_id")
    shift = {"groundedness": n % 5, "correctness": F.floor(n / 5) % 3, "brand_voice": (i + F.col("quality")) % 5,
             "actionability": (i + n) % 4, "safety": F.col("toxic") + F.floor(n / 7) % 4}
    return d.select(
        i.cast("string").alias("tweet_id"),
        *[F.when(i % 7 != 0, 1 + e).cast("int").alias(f"human_{a}") for a, e in shift.items()])


# --- the same in SQL --------------------------------------------------------------------------------

W = r"\p{L}\p{N}_"
S = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_pick(options: tuple[str, ...], number: str) -> str:
    return f"list_extract([{', '.join(map(lit, options))}], 1 + CAST(({number}) % {len(options)} AS INTEGER))"


MESSAGES = f"""msgs AS (
  SELECT conv_id || ':' || turn AS tweet_id,
         CASE WHEN role = 'assistant' THEN {lit(BRAND)} ELSE role || conv_id END AS author_id,
         CASE WHEN role = 'user' THEN 'True' ELSE 'False' END AS inbound,
         't' || turn AS created_at,
         CASE WHEN role = 'system' THEN text WHEN conv_id % 3 = 0 THEN phrase ELSE text || ' ' || phrase END AS text,
         conv_id || ':' || (turn + 1) AS response_tweet_id,
         CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS in_response_to_tweet_id
  FROM (SELECT *, CASE WHEN role = 'assistant' THEN {sql_pick(REPLIES, 'conv_id')}
                       ELSE {sql_pick(PHRASES, 'conv_id + turn')} END AS phrase FROM conversations))"""

DOCUMENTS = f"""docs AS (SELECT doc_id, {sql_pick(PHRASES, 'doc_id')} || ' ' || text AS text, source, n_chars
  FROM documents)"""


def sql_any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(t)})" for t in terms) + ")"


def sql_weak_label(text: str, rules=config.KEYWORD_RULES, default: str = config.DEFAULT_LABEL) -> str:
    whens = " ".join(f"WHEN {sql_any(f'lower({text})', words)} THEN {lit(label)}" for label, words in rules)
    return f"CASE {whens} ELSE {lit(default)} END"


def sql_negative(text: str) -> str:
    return f"({sql_any(text, config.NEGATIVE_EMOJI)} OR {sql_any(f'lower({text})', config.NEGATIVE_LEXICON)})"


def sql_safety(text: str) -> str:
    return "coalesce(" + ", ".join(
        f"CASE WHEN contains(lower({text}), {lit(t)}) THEN {lit(t)} END" for t in config.SAFETY_TERMS) + ")"


GRADED = f"""{DOCUMENTS},
graded AS (SELECT d.doc_id, d.text, d.source, {sql_pick(config.LABELS, 'd.doc_id + l.quality + 3 * l.toxic')} AS true_intent,
  {sql_weak_label('d.text')} AS intent, (l.quality = 0 OR l.toxic = 1) AS should_escalate,
  (d.n_chars % 97) / 96.0::DOUBLE AS confidence, (d.n_chars % 41) / 100.0::DOUBLE AS top1_score,
  {sql_negative('d.text')} AS negative
  FROM docs d JOIN labels l USING (doc_id))"""


def sql_entities(x: str) -> str:
    pairs = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"),
             ("&nbsp;", " "), ("&amp;", "&"))
    out = x
    for a, b in pairs:
        out = f"replace({out}, {lit(a)}, {lit(b)})"
    return f"CASE WHEN contains({x}, '<') THEN {x} ELSE {out} END"


def sql_straight(x: str) -> str:
    out = f"translate({x}, 'ʼ‘’‚‛“”„‟', '''''''''''\"\"\"\"')"
    out = rf"regexp_replace({out}, '\r\n|[\r\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g')"
    return (rf"regexp_replace({out}, '[\x00-\x08\x0b\x0e-\x1f\x7f\x{{206a}}-\x{{206f}}\x{{feff}}"
            rf"\x{{fff9}}-\x{{fffc}}]', '', 'g')")


def sql_mentions(x: str, brands=BRANDS) -> str:
    marked = rf"regexp_replace({x}, '@([{W}]+)', '⟦\1⟧', 'g')"
    own = rf"regexp_replace({marked}, '(?i)⟦({'|'.join(brands)})⟧', '', 'g')"
    return rf"regexp_replace({own}, '⟦[{W}]+⟧', '@USER', 'g')"


def sql_urls(x: str) -> str:
    return rf"regexp_replace({x}, 'https?://[^{S}]+', '<URL>', 'g')"


def sql_pii(x: str) -> str:
    out = rf"regexp_replace({x}, '[{W}.+\-]+@[{W}\-]+\.[{W}.\-]+', '<EMAIL>', 'g')"
    for _ in range(2):  # no look-around here: a neighbour is captured and put back, so every other match per pass
        out = rf"regexp_replace({out}, '(^|[^{W}])\p{{Nd}}{{6,}}($|[^{W}])', '\1<ID>\2', 'g')"
    return out


def sql_collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[{S}]+', ' ', 'g'), ' ')"


def clean_ctes(source: str, columns: dict[str, str], name: str, brands=BRANDS) -> str:
    """CTEs adding cleaned copies of columns, one step per CTE to keep the SQL short."""
    steps = (sql_entities, sql_straight, lambda x: sql_mentions(x, brands), sql_urls, sql_pii, sql_collapse)
    out, last = [], source
    for at, step in enumerate(steps):
        this = name if at == len(steps) - 1 else f"{name}_{at}"
        if at == 0:
            cols = ", ".join(f"{step(f'coalesce({raw}, \'\')')} AS {new}" for new, raw in columns.items())
            out.append(f"{this} AS (SELECT *, {cols} FROM {last})")
        else:
            cols = ", ".join(f"{step(new)} AS {new}" for new in columns)
            out.append(f"{this} AS (SELECT * REPLACE ({cols}) FROM {last})")
        last = this
    return ",\n".join(out)


ENRICHED = f"""{MESSAGES},
pairs AS (SELECT c.tweet_id AS cust_tweet_id, c.text AS cust_text, c.created_at AS cust_created_at,
    b.tweet_id AS brand_tweet_id, b.text AS brand_text, b.created_at AS brand_created_at
  FROM msgs b JOIN msgs c ON b.in_response_to_tweet_id = c.tweet_id
  WHERE b.inbound = 'False' AND b.author_id = {lit(BRAND)} AND c.inbound = 'True'),
{clean_ctes('pairs', {'cust_text_clean': 'cust_text', 'brand_text_clean': 'brand_text'}, 'cleaned')},
enriched AS (SELECT *, {sql_any('cust_text', config.NEGATIVE_EMOJI)} AS has_negative_emoji,
    {sql_any('cust_text', config.POSITIVE_EMOJI)} AS has_positive_emoji,
    {sql_any('lower(brand_text)', config.HANDOFF_TERMS)} AS has_dm_handoff FROM cleaned)"""

ID_ORDER = "length(cust_tweet_id), cust_tweet_id, length(brand_tweet_id), brand_tweet_id"
KEPT = rf"length(trim(regexp_replace(replace(brand_text_clean, '<URL>', ''), '[{S}]+', ' ', 'g'), ' ')) > 0"

BUILT = f"""{ENRICHED},
built AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
    PARTITION BY cust_text_clean, brand_text_clean ORDER BY {ID_ORDER}) AS rn FROM enriched) WHERE rn = 1 AND {KEPT})"""


def terms_ctes(source: str, ident: str, text: str, name: str, stop_words=(), ngrams: int = 2) -> str:
    """``{name}(id, term, tf)`` by plain grouping."""
    tokens = rf"regexp_extract_all(lower({text}), '[{W}]{{2,}}')"
    if stop_words:
        tokens = f"list_filter({tokens}, lambda x: NOT list_contains([{', '.join(map(lit, stop_words))}], x))"
    two = (f" UNION ALL SELECT id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) "
           f"FROM {name}_tok WHERE len(t) > 1") if ngrams == 2 else ""
    return f"""{name}_tok AS (SELECT {ident} AS id, {tokens} AS t FROM {source}),
{name} AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM {name}_tok{two}) GROUP BY id, term)"""


def vocabulary_cte(terms: str, source: str, name: str = "voc", max_features: int = config.MAX_FEATURES) -> str:
    return f"""{name} AS (SELECT term, df, total, ln((1 + (SELECT count(*) FROM {source})) / (1 + df)) + 1 AS idf
  FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM {terms} GROUP BY term
        ORDER BY total DESC, term LIMIT {max_features}))"""


def weights_cte(terms: str, name: str, voc: str = "voc") -> str:
    return f"""{name} AS (SELECT id, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight
  FROM (SELECT x.id, x.term, x.tf, x.tf * v.idf AS raw FROM {terms} x JOIN {voc} v USING (term)))"""


def hits_cte(queries: str, query_id: str, corpus: str, doc_id: str, wq: str, wd: str, name: str = "hits",
             k: int = config.TOP_K) -> str:
    """Exact top k of every query, padded with zero scores."""
    return f"""{name} AS (SELECT query_id, doc_id, score, CAST(rn AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rn FROM (
    SELECT q.{query_id} AS query_id, d.{doc_id} AS doc_id, coalesce(s.score, 0.0) AS score
    FROM {queries} q CROSS JOIN {corpus} d LEFT JOIN (
      SELECT a.id AS qid, b.id AS did, sum(a.weight * b.weight) AS score FROM {wq} a JOIN {wd} b USING (term)
      GROUP BY a.id, b.id) s ON s.qid = q.{query_id} AND s.did = d.{doc_id})) WHERE rn <= {k})"""
