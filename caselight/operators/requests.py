"""Tables of language-model requests, and answers joined back to them.

The remote call is outside this package: a request table goes out, a response
table with the same id comes back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight import config
from caselight.config import Intent
from caselight.functions.responses import parse_judge, parse_label
from caselight.operators.clusters import cluster_examples

NO_REFERENCES = "(nothing similar on record)"
FALLBACK_REPLY = "Thank you for writing to us. Please send us a direct message and we will look into it."

# Defaults; every request function takes another text.  They ask for what the parsers in functions/responses.py can read.
CLASSIFY_SYSTEM = "Labels:\n%s\n\nGive the one label that describes the message, spelled as above. Unsure: other_uncategorised."
REPLY_SYSTEM = "You answer for a support desk. Output: the text to be sent, and nothing around it. Earlier cases follow as background."
JUDGE_SYSTEM = ("Grade the answer below. Output: a JSON object with the number keys groundedness, correctness, brand_voice, "
                "actionability, safety (1 worst, 5 best) and a text key rationale.")


def taxonomy_table(spark, taxonomy: Sequence[Intent] = config.TAXONOMY) -> DataFrame:
    rows = [(i, t.name, t.definition, list(t.examples)) for i, t in enumerate(taxonomy)]
    return spark.createDataFrame(rows, "ord int, name string, definition string, examples array<string>")


def taxonomy_from_labelled(rows: DataFrame, id_col: str, text_col: str, label: str, n: int = 3) -> DataFrame:
    """A taxonomy read off labelled rows: labels in order, their size, and the first ``n`` texts of each."""
    examples = cluster_examples(rows, id_col, text_col, label, n)
    folded = examples.groupBy(label).agg(
        F.sort_array(F.collect_list(F.struct("rank", text_col))).alias("_ranked"))
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return folded.join(sizes, label).select(
        F.col(label).alias("name"), F.format_string("%d messages", F.col("_n")).alias("definition"),
        F.transform("_ranked", lambda r: r[text_col]).alias("examples"))


def _folded(lines: DataFrame, order: Sequence[str], line: str) -> Column:
    """A few ordered lines as one text, usable as a scalar in any select."""
    ordered = lines.agg(F.sort_array(F.collect_list(F.struct(*order, line))).alias("lines"))
    return ordered.select(F.array_join(F.transform("lines", lambda l: l[line]), "\n").alias("block")).scalar()


def definitions_block(taxonomy: DataFrame, order: str = "ord") -> Column:
    lines = taxonomy.select(order, F.concat(F.lit("- "), "name", F.lit(": "), "definition").alias("line"))
    return _folded(lines, [order], "line")


def fewshot_block(taxonomy: DataFrame, order: str = "ord") -> Column:
    lines = taxonomy.select(order, "name", F.posexplode("examples").alias("at", "example")).select(
        order, "at", F.concat(F.lit('Message: "'), "example", F.lit('"\nLabel: '), "name", F.lit("\n")).alias("line"))
    return _folded(lines, [order, "at"], "line")


def classify_requests(messages: DataFrame, id_col: str, text_col: str, taxonomy: DataFrame,
                      order: str = "ord",
                      system: str = CLASSIFY_SYSTEM) -> DataFrame:
    """``(id, system, user)``; the two blocks are computed once and reused as scalars on every row."""
    before, after = system.split("%s")
    return messages.select(
        id_col,
        F.concat(F.lit(before), definitions_block(taxonomy, order), F.lit(after)).alias("system"),
        F.concat(F.lit("Examples:\n"), fewshot_block(taxonomy, order), F.lit('\nMessage: "'), text_col,
                 F.lit('"\nLabel:')).alias("user"))


def reference_lines(hits: Column, with_scores: bool = True) -> Column:
    """Hits ``array<struct<cust, reply, score>>`` as lines, or the marker when there are none."""
    def line(h: Column) -> Column:
        if with_scores:
            return F.format_string('- They wrote: "%s" We answered: "%s" (similarity %.2f)',
                                   h["cust"], h["reply"], F.bround(h["score"], 2))
        return F.concat(F.lit('- "'), h["reply"], F.lit('"'))

    lines = F.array_join(F.transform(hits, line), "\n")
    return F.when(hits.isNull() | (F.size(hits) == 0), F.lit(NO_REFERENCES)).otherwise(lines)


def reply_requests(cases: DataFrame, id_col: str, text_col: str, intent: str, hits: str,
                   system: str = REPLY_SYSTEM) -> DataFrame:
    """``(id, system, user)`` for drafting a reply; hits carry cust, reply and score."""
    return cases.select(
        id_col, F.lit(system).alias("system"),
        F.concat(F.lit("Intent: "), intent, F.lit('\nMessage: "'), text_col, F.lit('"\nPast cases:\n'),
                 reference_lines(F.col(hits)), F.lit("\n\nWrite the answer.")).alias("user"))


def judge_requests(cases: DataFrame, id_col: str, text_col: str, draft: str, hits: str,
                   system: str = JUDGE_SYSTEM) -> DataFrame:
    return cases.select(
        id_col, F.lit(system).alias("system"),
        F.concat(F.lit('Message: "'), text_col, F.lit('"\nPast replies:\n'), reference_lines(F.col(hits), False),
                 F.lit('\nReply: "'), draft, F.lit('"\nReturn the JSON.')).alias("user"))


def canned_reply(hits: Column) -> Column:
    """The most similar case's reply word for word, or a fixed sentence."""
    return F.coalesce(F.get(hits, F.lit(0))["reply"], F.lit(FALLBACK_REPLY))


def attach_responses(requests: DataFrame, responses: DataFrame, id_col: str, raw: str = "raw") -> DataFrame:
    """Every request with its answer, null when none came."""
    return requests.join(responses.select(id_col, raw), id_col, "left")


def labels_from_responses(rows: DataFrame, responses: DataFrame, id_col: str, raw: str = "raw",
                          labels: Sequence[str] = config.LABELS) -> DataFrame:
    """Rows plus ``intent`` and ``confidence`` read from a model's answers."""
    parsed = attach_responses(rows, responses, id_col, raw).withColumn("_parsed", parse_label(F.col(raw), labels))
    return parsed.select(*rows.columns, F.col("_parsed.label").alias("intent"),
                         F.col("_parsed.confidence").alias("confidence"))


def scores_from_responses(rows: DataFrame, responses: DataFrame, id_col: str, raw: str = "raw",
                          axes: Sequence[str] = config.JUDGE_AXES) -> DataFrame:
    """Rows plus one column per judge axis and the rationale."""
    parsed = attach_responses(rows, responses, id_col, raw).withColumn("_parsed", parse_judge(F.col(raw), axes))
    return parsed.select(*rows.columns, F.col("_parsed.*"))
