"""Language identification in two steps: the family first, then the language within it.

Every decision is a vote of one-versus-one linear support vector machines over
hashed byte trigrams of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselight.shipping import ship_by_value

ship_by_value(__name__)

UNKNOWN = "und"
DIMENSIONS = 4096
PIECE = 1 << 19  # bytes of text looked at together
ROWS = 128  # rows looked at together: their dense features are 4 MB, however short the texts

# Families of common language codes; a code not listed is a family of its own.
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb"), "germanic"),
    **dict.fromkeys(("fr", "es", "pt", "it", "ro", "ca", "gl", "oc", "la"), "romance"),
    **dict.fromkeys(("ru", "uk", "be", "bg", "mk", "sr", "pl", "cs", "sk", "sl", "hr", "bs"), "slavic"),
    **dict.fromkeys(("hi", "ur", "bn", "mr", "gu", "pa", "ne"), "indic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
    **dict.fromkeys(("tr", "az", "kk", "uz", "ky"), "turkic"),
}


def _classes() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def trigram_features(texts: pa.Array, dimensions: int = DIMENSIONS) -> Iterator[np.ndarray]:
    """Rows of unit length, a slice of the column at a time: square roots of hashed trigram shares of each whole text."""
    letters = _classes()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    row = 0
    while row < len(texts):
        stop, size = row + 1, sizes[row]
        while stop < min(len(texts), row + ROWS) and size + sizes[stop] <= PIECE:
            size += sizes[stop]
            stop += 1
        low = pa.concat_arrays([pc.utf8_lower(texts.slice(row, stop - row))])
        at = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1)
        data = np.frombuffer(low.buffers()[2], np.uint8)[at[0]:at[-1]] if low.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        counts = np.zeros((stop - row) * dimensions)
        for start in range(0, len(data), PIECE):
            b = letters[data[start:start + PIECE + 2]].astype(np.uint32)
            if len(b) < 3:
                continue
            code = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
            code = ((code * np.uint32(0x27D4EB2F)) >> np.uint32(15)) % np.uint32(dimensions)
            place = np.arange(start, start + len(code))
            text = np.searchsorted(at, place, "right") - 1
            inside = (place + 2 < at[text + 1]) & ((b[:-2] != 32) | (b[1:-1] != 32))
            counts += np.bincount(text[inside] * dimensions + code[inside], minlength=len(counts))
        counts = counts.reshape(stop - row, dimensions)
        counts /= np.maximum(counts.sum(1, keepdims=True), 1)
        yield np.sqrt(counts, out=counts)
        row = stop


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """At most ``per_language`` rows per label, by a digest of the id and text: first a share of each label, then the exact cut."""
    sizes = {r[0]: r[1] for r in docs.groupBy(lang_col).count().collect()}
    if not sizes:
        return docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.3 * per_language / n + 20 / n))])
    digest = F.xxhash64(F.col(id_col), F.lit(5))
    some = (docs.withColumn("_digest", digest)
            .where(F.pmod("_digest", F.lit(1 << 20)) < F.element_at(share, F.col(lang_col)) * (1 << 20)))
    order = Window.partitionBy(lang_col).orderBy("_digest", text_col)
    return (some.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language)
            .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))


class LanguageModel:
    """Weights of the machines: ``machines[(a, b)]`` is positive for ``a``."""

    def __init__(self, families: dict[str, list[str]], machines: dict[tuple[str, str], tuple[np.ndarray, float]]):
        self.families, self.machines = families, machines

    def _vote(self, names: list[str], features: np.ndarray, prefix: str) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner per row, and the chance that it beats its nearest rival."""
        n = len(features)
        if len(names) == 1:
            return np.zeros(n, int), np.ones(n)
        chance = np.full((n, len(names), len(names)), 0.5)
        for i, j in combinations(range(len(names)), 2):
            weights, bias = self.machines[prefix + names[i], prefix + names[j]]
            p = 1 / (1 + np.exp(-np.clip(3 * (features @ weights + bias), -30, 30)))
            chance[:, i, j], chance[:, j, i] = p, 1 - p
        votes = (chance > 0.5).sum(2) + chance.sum(2) / (2 * len(names))  # the margins decide equal votes
        best = votes.argmax(1)
        rivals = chance[np.arange(n), best]
        rivals[np.arange(n), best] = 1
        return best, rivals.min(1)

    def predict(self, features: np.ndarray) -> tuple[list[str], np.ndarray]:
        names = sorted(self.families)
        family, sure = self._vote(names, features, "family ")
        out, score = [""] * len(features), np.zeros(len(features))
        for at, name in enumerate(names):
            rows = np.flatnonzero(family == at)
            if len(rows):
                best, inner = self._vote(self.families[name], features[rows], "")
                for r, b in zip(rows, best):
                    out[r] = self.families[name][b]
                score[rows] = sure[rows] * inner
        return out, score


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  families: dict[str, str] = FAMILIES, per_language: int = 400, iterations: int = 25) -> LanguageModel | None:
    """Fit the machines on at most ``per_language`` rows of each label (a bounded, documented sample; whole texts).

    Rows with a null label or text are left out.  Returns None when no row is left.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for rows in trigram_features(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(rows)),
                                                  pa.array(list(rows), pa.list_(pa.float64()))], ["lang", "features"])
                start += len(rows)

    sample = labelled_sample(labelled, "id", "text", "lang", per_language).repartition(8)
    rows = (sample.mapInArrow(run, "lang string, features array<double>")
            .select("lang", array_to_vector("features").alias("features")).persist())
    try:
        present = sorted(r[0] for r in rows.select("lang").distinct().collect())
        if not present:
            return None
        groups: dict[str, list[str]] = {}
        for lang in present:
            groups.setdefault(families.get(lang, lang), []).append(lang)
        machines = {}

        def fit(key: tuple[str, str], one: list[str], other: list[str]) -> None:
            pair = rows.where(F.col("lang").isin(one + other)).withColumn("label", F.col("lang").isin(one).cast("double"))
            model = LinearSVC(maxIter=iterations, regParam=1e-3, standardization=False, tol=1e-3).fit(pair)
            machines[key] = (np.array(model.coefficients.toArray()), float(model.intercept))

        for a, b in combinations(sorted(groups), 2):
            fit(("family " + a, "family " + b), groups[a], groups[b])
        for group in groups.values():
            for a, b in combinations(group, 2):
                fit((a, b), [a], [b])
        return LanguageModel(groups, machines)
    finally:
        rows.unpersist()


def predict_languages(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` per row: a learned label and how sure the closest decisions were (0 to 1).

    A null text or one without a letter, and any text when nothing was learned,
    gives ``und`` with score 0.  Map-only; repeated rows give one row each, a null
    id stays null, and other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for rows in trigram_features(batch.column(1)):
                known = batch.column(2).slice(start, len(rows)).to_pylist()
                langs, scores = model.predict(rows) if model else ([UNKNOWN] * len(rows), np.zeros(len(rows)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(rows)), pa.array([x if k else UNKNOWN for x, k in zip(langs, known)]),
                     pa.array([float(s) if k else 0.0 for s, k in zip(scores, known)])], [id_col, "lang_pred", "score"])
                start += len(rows)

    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), letter.alias("letter")).mapInArrow(
        run, f"`{id_col}` {id_type}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is given a language; those predicted ``und`` go.  Map-only."""
    from pyspark.sql.types import StructField, StructType

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for rows in trigram_features(pc.struct_field(batch.column(0), [names.index(text_col)]).cast(pa.large_string())):
                known = batch.column(1).slice(start, len(rows)).to_pylist()
                langs = model.predict(rows)[0] if model else [UNKNOWN] * len(rows)
                part = batch.slice(start, len(rows)).filter(pa.array([k and x != UNKNOWN for x, k in zip(langs, known)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([part.column(0)], ["row"])
                start += len(rows)

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), letter.alias("letter")).mapInArrow(
        run, StructType([StructField("row", docs.schema)])).select("row.*")
