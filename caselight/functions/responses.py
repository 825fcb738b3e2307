"""Reading language-model answers back into columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselight import config


def parse_label(raw: Column, labels: Sequence[str] = config.LABELS,
                default: str = config.DEFAULT_LABEL) -> Column:
    """``struct<label, confidence>``: exact name 1.0, a name inside the answer 0.5, else the default at 0.3."""
    kept = F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), "[^a-z_]", "")

    def outcome(label: str | Column, confidence: float) -> Column:
        label = F.lit(label) if isinstance(label, str) else label
        return F.struct(label.alias("label"), F.lit(confidence).alias("confidence"))

    parsed = F.when(kept.isin(*labels), outcome(kept, 1.0))
    for name in labels:
        parsed = parsed.when(F.contains(kept, F.lit(name)), outcome(name, 0.5))
    return parsed.otherwise(outcome(default, 0.3))


def parse_judge(raw: Column, axes: Sequence[str] = config.JUDGE_AXES) -> Column:
    """``struct<axes…, rationale>``: each grade is read by itself, quoted or not, and is null if it is no
    number; an answer that is no JSON object gives null axes and its first 200 characters."""
    body = F.trim(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"(?m)^```(?:json)?|```$", ""), F.lit(" \n\r\t"))
    schema = ", ".join(f"`{a}` STRING" for a in axes) + ", rationale STRING, _corrupt_record STRING"
    # permissive mode turns broken JSON into a struct of nulls, so the corrupt field tells the two apart
    doc = F.from_json(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    broken = ~body.rlike(r"(?s)^\{.*\}$") | doc["_corrupt_record"].isNotNull()
    return F.struct(
        *[F.when(~broken, doc[a].try_cast("double")).alias(a) for a in axes],
        F.when(broken, F.concat(F.lit("JUDGE_PARSE_ERROR: "), F.substring(body, 1, 200)))
        .otherwise(doc["rationale"]).alias("rationale"))
