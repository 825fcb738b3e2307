"""The registered queries of this subpackage: each applies its operator to the whole given table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm import (chains, chat, decontaminate, filters, language, licenses, mixing, neardup, neighbours, pieces, privacy, runs,
                           tokens, toxicity)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, by: int):
    """crc32 of an id as text, modulo ``by``: the contracts' split into learning and held-out rows."""
    return F.crc32(F.col(column).cast("string")) % by


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_languages(docs.where(remainder("doc_id", 4) != 2))
    return language.predict_languages(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op2_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.find_private(table(spark, sf_dir, "documents"))


@query
def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where(F.col("vec_id") % 50 == 0), factor=0.9)


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    turns = chains.chained_turns(rows)
    return chains.chained_read_back(turns, chains.chained_tree(turns)).withColumnRenamed("conv", "conv_id")


def _sql_escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


SQL["op3_chat_format"] = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length({_sql_escaped("role")}) + length({_sql_escaped("text")}) + {len(chat.OPEN + chat.CLOSE + chat.END)}) AS BIGINT)
    AS formatted_chars
FROM rows_ GROUP BY conv_id"""


def with_repeated_tail(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)``; where crc32 of the id ends in 0, the words from one place on are replaced by a stretch of them over and over."""
    h = F.crc32(F.col(id_col).cast("string"))
    # let words, a and p be known inside the lambda without being evaluated per word
    tail = F.expr(r"""transform(array(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)), w -> IF(size(w) = 0, text,
        transform(array(CAST(g % size(w) AS INT)), a -> transform(array(1 + CAST((size(w) - a) div (3 + g % 8) AS INT)), p ->
        concat_ws(' ', transform(sequence(0, size(w) - 1), i -> get(w, IF(i < a, i, a + (i - a) % p)))))[0])[0]))[0]""")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), h.alias("h"),
                       F.floor(h / 10).alias("g"))
    return rows.select(F.col("id").alias(id_col), F.when(F.col("h") % 10 == 0, tail).otherwise(F.col("text")).alias(text_col))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_repeated_tail(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"], )), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op12_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size,
    md5(concat_ws(':', '12', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS key FROM documents),
sources AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
weighed AS (SELECT *, [3, 1, 2][1 + CAST((place - 1) % 3 AS INTEGER)]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM sources),
levels AS (  -- every source if those of smaller cap per weight have stopped
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
plan AS (
  SELECT source, source_size, place, least(cap, weight * coalesce((SELECT arg_min(level, (cap / weight, place)) FROM levels WHERE cap > weight * level), 1e300)) AS target,
    CAST(ceil(2.0 * source_size / 64) AS BIGINT) AS most, greatest(1, CAST(ceil(source_size / 65536.0) AS BIGINT)) AS shards FROM levels),
source_quotients AS (
  SELECT place, target / (2 * k + 1) AS quotient FROM (SELECT place, target, unnest(range(most)) AS k FROM plan)),
blocks AS (
  SELECT place, count(*) AS blocks FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, place) AS n FROM source_quotients WHERE quotient > 0)
  WHERE n <= (SELECT floor(sum(target) / 64 + 0.5) FROM plan) GROUP BY place),
laid AS (
  SELECT * REPLACE (tail::BIGINT AS tail), (tail - size)::BIGINT AS head FROM (
    SELECT s.*, p.source_size, p.target, p.place, ('0x' || s.key[1:8])::BIGINT % p.shards AS shard,
      sum(s.size) OVER (PARTITION BY p.place, ('0x' || s.key[1:8])::BIGINT % p.shards ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS tail
    FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source WHERE s.size > 0)),
shards AS (SELECT place, shard, CAST(sum(size) AS BIGINT) AS words, CAST((sum(size) + 63) // 64 AS BIGINT) AS n FROM laid GROUP BY place, shard),
shard_quotients AS (
  SELECT place, shard, words::DOUBLE / (2 * k + 1) AS quotient FROM (SELECT place, shard, words, unnest(range(2 * n)) AS k FROM shards)),
quotas AS (
  SELECT place, shard, count(*) AS quota FROM (
    SELECT *, row_number() OVER (PARTITION BY place ORDER BY quotient DESC, shard) AS r FROM shard_quotients) JOIN blocks USING (place)
  WHERE r <= blocks GROUP BY place, shard),
block_times AS (
  SELECT place, shard, j, quota // n + CASE WHEN row_number() OVER (PARTITION BY place, shard ORDER BY md5(concat_ws(':', '12', place, shard, j))) <= quota % n
    THEN 1 ELSE 0 END AS times
  FROM (SELECT s.*, coalesce(q.quota, 0) AS quota, unnest(range(s.n)) AS j FROM shards s LEFT JOIN quotas q USING (place, shard))),
cut AS (SELECT *, unnest(range(head // 64, (tail - 1) // 64 + 1)) AS j FROM laid)
SELECT doc_id, size, source_size, target, CAST(sum((least(tail, (j + 1) * 64) - greatest(head, j * 64)) * times) AS BIGINT) AS taken
FROM cut JOIN block_times USING (place, shard, j) GROUP BY doc_id, size, source_size, target, key
UNION ALL SELECT s.doc_id, s.size, p.source_size, p.target, 0 FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source WHERE s.size = 0"""

SQL["op13_filter_audit"] = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS w FROM texts),
flags AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
    'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w),
    'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS f
  FROM words LEFT JOIN flags USING (doc_id)),
long AS (
  SELECT row_number() OVER () AS r, part, good, toxic, f FROM fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
masked AS (
  SELECT part, f['A'] AS a, f['B'] AS b, f['C'] AS c, f['D'] AS d, f['E'] AS e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM long GROUP BY ALL),
stepped AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
seen AS (
  SELECT m.*, s.filter_order, s.step, list_transform(range(1, 6), lambda i: CASE filter_order[i] WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS v
  FROM masked m, stepped s),
counted AS (
  SELECT part, filter_order, step, sum(n) FILTER (WHERE NOT list_bool_or(v[1:step])) AS kept,
    sum(n) FILTER (WHERE v[step] AND NOT coalesce(list_bool_or(v[1:step - 1]), false)) AS removed,
    sum(n) FILTER (WHERE v[step] AND coalesce(list_bool_or(v[1:step - 1]), false)) AS redundant,
    sum(n) FILTER (WHERE v[step] AND len(list_filter(v, lambda x: x)) = 1) AS unique_fails,
    sum(good) FILTER (WHERE v[step] AND NOT coalesce(list_bool_or(v[1:step - 1]), false)) AS good_lost,
    sum(toxic) FILTER (WHERE v[step] AND NOT coalesce(list_bool_or(v[1:step - 1]), false)) AS toxic_lost
  FROM seen GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley
FROM counted"""
