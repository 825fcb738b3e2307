"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary texts, over a shared backoff.

The symbols are the bytes of the lower-cased text, so that parts of words count
as well as words.  Each class interpolates its own six-byte sequences with its
continuation counts of five bytes, and both hand what is taken off rare
sequences to one backoff: the continuation counts of four bytes in the whole
corpus, labelled or not.  A text's figure is the difference of the two
log-likelihoods per byte, put on a 0 to 1 scale by a logistic curve fitted on
labelled rows that the counts have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.links import settled
from caselight.llm.words import worker_state
from caselight.operators.ordering import sample_n
from caselight.session import scratch_dir
from caselight.shipping import ship_by_value

ship_by_value(__name__)

ROWS_PER_CLASS = 4_000
ORDINARY = 0.95  # share of a class's texts that count by their full length
DISCOUNTS = (0.75, 1.5, 3.0, 6.0, 12.0)  # above 1, rare sequences count through the shared backoff alone
ORDER = 6
SLICE = 1 << 19  # bytes of text looked at together
BUCKETS = 256  # that the sequences are dealt to
_CORPUS, _HELD = 2, 3  # kinds of counts beside the two classes
_FIVE, _FOUR, _THREE = (1 << 40) - 1, (1 << 32) - 1, (1 << 24) - 1


def _symbols() -> np.ndarray:
    """Letters and bytes above ASCII stay; digits are one symbol, all the rest is a space."""
    table = np.full(256, 32, np.uint8)
    table[48:58] = 48
    table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def sequences(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a text column: ``(first row, end row, keys, offsets)``.

    There is one key per byte: the last ORDER bytes up to it as an integer, with
    spaces in front of the text.  A text longer than SLICE comes in several pieces.
    """
    table = worker_state("toxicity symbols", _symbols)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    row = 0
    while row < len(texts):
        stop, size = row + 1, sizes[row]
        while stop < len(texts) and size + sizes[stop] <= SLICE:
            size += sizes[stop]
            stop += 1
        low = pa.concat_arrays([pc.utf8_lower(texts.slice(row, stop - row))])
        at = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1)
        data = np.frombuffer(low.buffers()[2], np.uint8)[at[0]:at[-1]] if low.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = at - at[0]
        for start in range(0, max(len(data), 1), SLICE) if len(low) == 1 else (0,):
            end = min(start + SLICE, len(data)) if len(low) == 1 else len(data)
            lead = data[max(start - ORDER + 1, 0):start]
            piece = table[np.concatenate([np.full(ORDER - 1 - len(lead), 32, np.uint8), lead, data[start:end]])].astype(np.int64)
            bounds = np.array([0, end - start]) if len(low) == 1 else at
            keys = np.zeros(end - start, np.int64)
            into = np.arange(end - start) - np.repeat(bounds[:-1], np.diff(bounds))  # bytes since the start of the text
            for back in range(ORDER - 1, -1, -1):
                symbol = piece[ORDER - 1 - back:len(piece) - back]
                if len(low) > 1:
                    symbol = np.where(into < back, 32, symbol)
                keys = (keys << 8) | symbol
            yield row, stop, keys, bounds
        row = stop


def look_up(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def found(table: np.ndarray, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of keys in a sorted table, 0 where absent, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys)), np.zeros(len(keys), bool)
    at = look_up(table, keys)
    return np.where(at >= 0, values[at], 0.0), at >= 0


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class ToxicityModel:
    """Log-likelihood differences of seen sequences of six and five bytes, and those of backing off from each context."""

    def __init__(self, six, of_six, from_five, of_from_five, five, of_five, from_four, of_from_four):
        self.six, self.of_six, self.from_five, self.of_from_five = six, of_six, from_five, of_from_five
        self.five, self.of_five, self.from_four, self.of_from_four = five, of_five, from_four, of_from_four
        self.slope, self.offset = 1.0, 0.0

    def differences(self, keys: np.ndarray) -> np.ndarray:
        """Log-likelihood difference at each byte."""
        unique, place = np.unique(keys, return_inverse=True)
        value, seen = found(self.six, self.of_six, unique)
        rest = np.flatnonzero(~seen)
        low = unique[rest]
        back, _ = found(self.from_five, self.of_from_five, low >> 8)
        five, seen = found(self.five, self.of_five, low & _FIVE)
        four, _ = found(self.from_four, self.of_from_four, (low & _FIVE) >> 8)
        value[rest] = back + np.where(seen, five, four)
        return value[place]

    def score(self, difference: np.ndarray) -> np.ndarray:
        return _logistic(self.slope * difference + self.offset)


def _distinct_five(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences of five bytes that a task has met, each at most once per 8 MB of text."""
    held, size = np.zeros(0, np.int64), 0
    for batch in batches:
        for _, _, keys, _ in sequences(batch.column(0)):
            held = np.union1d(held, keys & _FIVE)
            size += len(keys)
            if size > 16 * SLICE:
                yield pa.RecordBatch.from_arrays([pa.array(held)], ["key"])
                held, size = np.zeros(0, np.int64), 0
    yield pa.RecordBatch.from_arrays([pa.array(held)], ["key"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, weights = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for start, stop, keys, offsets in sequences(batch.column(0)):
            label, weight = (np.repeat(x[start:stop], np.diff(offsets)) for x in (labels, weights))
            for c in (0, 1):
                unique, place = np.unique(keys[label == c], return_inverse=True)
                n = np.bincount(place, weight[label == c], len(unique))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unique), c, np.int32)), pa.array(unique), pa.array(n, pa.float64())],
                                                 ["label", "key", "n"])


def _counted_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences counted per text, with its size in bytes; a text without any has one row that counts nothing."""
    for batch in batches:
        ids, labels = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for start, stop, keys, offsets in sequences(batch.column(1)):
            for row in range(start, stop):
                low, high = offsets[row - start], offsets[row - start + 1]
                unique, n = np.unique(keys[low:high], return_counts=True) if high > low else (np.zeros(1, np.int64), np.zeros(1, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(unique), ids[row])), pa.array(np.full(len(unique), labels[row], np.int32)), pa.array(unique), pa.array(n, pa.int32())],
                    ["row", "label", "key", "n"])


def bounded_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """``(id, label, fold, weight)`` of at most ``rows`` labelled documents of each class, by a digest of the id, however long they are.

    A document marked both ways counts as toxic, a label other than 0 and 1 is left out, and of exact copies one is taken.
    A text longer than ORDINARY of its class weighs as much as one of that length, so that no single text outweighs the rest.
    """
    marked = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
              .withColumn("digest", F.xxhash64("id", F.lit(10))))
    sizes = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, 1.2 * rows / n + 20 / n))).otherwise(share)
    some = marked.where(F.pmod("digest", F.lit(1 << 20)) < share * (1 << 20))
    # the exact cut of each class without a class in one task
    some = reduce(DataFrame.unionByName, [sample_n(some.where(F.col("label") == label), rows, ["id"], seed=10) for label in (0, 1)])
    # at most 2 x rows ids: small by construction
    one = settled(docs.select(F.col(id_col).alias("id"), F.coalesce(F.length(text_col), F.lit(0)).alias("size"),
                              F.md5(F.col(text_col).cast("binary")).alias("copy"))
                  .join(F.broadcast(some), "id").groupBy("label", "copy").agg(F.min(F.struct("digest", "id", "size")).alias("one"))
                  .select("label", "one.*"))
    usual = one.groupBy("label").agg(F.expr(f"percentile_disc({ORDINARY}) WITHIN GROUP (ORDER BY size)").alias("usual"))  # two rows
    return settled(one.join(F.broadcast(usual), "label")
                   .select("id", "label", F.pmod(F.shiftright("digest", 20), F.lit(4)).cast("int").alias("fold"),
                           F.least(F.lit(1.0), F.greatest("usual", F.lit(1)) / F.greatest("size", F.lit(1))).alias("weight")))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 rows: int = ROWS_PER_CLASS) -> ToxicityModel | None:
    """Learn from labelled rows (a sample of ``rows`` per class, each with its whole text) and from the texts of all documents.

    A quarter of the sample is kept for the discount and the logistic curve.  Texts and counts stay in
    the tasks: all that is asked of a sequence lies in the bucket of its three bytes before the last, so buckets are
    weighed apart.  The driver gets two figures per text kept, and of the model what differs from backing off.
    Returns None when a class has no text.  Rows with a null id are not labelled;
    null and empty texts add nothing.
    """
    sample = bounded_sample(docs, labels, id_col, text_col, label_col, rows)
    texts = settled(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
                    .join(F.broadcast(sample), "id").select("text", "label", "fold", "weight"))
    grams = _written(texts.where("fold > 0").select("text", "label", "weight").mapInArrow(_counted, "label int, key long, n double")
                     .groupBy("label", "key").agg(F.sum("n").alias("n")))  # distinct sequences of the sample
    if grams.select("label").distinct().count() < 2:
        return None
    kept = _written(texts.where("fold = 0").select(F.monotonically_increasing_id().alias("row"), "text", "label")
                    .mapInArrow(_counted_each, "row long, label int, key long, n int"))
    none = F.lit(None).cast("long").alias("row")
    counts = (grams.select(F.col("label").alias("kind"), none, "key", "n")
              .unionByName(_follows(docs.select(F.col(text_col).cast("string"))).select(F.lit(_CORPUS).alias("kind"), none, F.col("four").alias("key"), F.col("n").cast("double").alias("n"))))
    held = kept.where("n > 0").select(F.lit(_HELD).alias("kind"), "row", "key", F.col("n").cast("double").alias("n"))
    sums = (_by_bucket(counts.unionByName(held)).applyInArrow(_tried, "row long, sums array<double>")
            .groupBy("row").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(len(DISCOUNTS))]).alias("sums")))
    tried = (kept.groupBy("row", "label").agg(F.sum("n").alias("size")).join(sums, "row", "left").orderBy("row")
             .select("label", "size", *[F.coalesce(F.col("sums")[i], F.lit(0.0)).alias(f"x{i}") for i in range(len(DISCOUNTS))])).toArrow()  # texts kept
    truth, size = (tried.column(c).to_numpy().astype(float) for c in ("label", "size"))
    best = None
    for i, discount in enumerate(DISCOUNTS):
        x = tried.column(f"x{i}").to_numpy() / np.maximum(size, 1)
        slope, offset = _curve(x, truth)
        p = np.clip(_logistic(slope * x + offset), 1e-9, 1 - 1e-9)
        loss = -np.log(p[truth == 1]).mean() - np.log(1 - p[truth == 0]).mean() if 0 < truth.sum() < len(truth) else 0.0
        if best is None or loss < best[0]:
            best = loss, discount, slope, offset
    _, discount, slope, offset = best
    told = _written(_by_bucket(counts).applyInArrow(_telling(discount), "part int, key long, value double"))
    arrays = []
    for part in range(4):
        table = told.where(F.col("part") == part).select("key", "value").toArrow()
        key, value = table.column("key").to_numpy(), table.column("value").to_numpy()
        del table
        order = np.argsort(key)
        arrays += [key[order], value[order]]
    model = ToxicityModel(*arrays)
    model.slope, model.offset = slope, offset
    return model


def _written(df: DataFrame) -> DataFrame:
    """The frame as files of the shared folder: columns of small numbers take far less there than in a checkpoint."""
    path = scratch_dir(df.sparkSession, "toxicity")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _follows(texts: DataFrame) -> DataFrame:
    """``(four, n)``: how many different bytes stand before each sequence of four bytes of the whole corpus."""
    return _written(texts.mapInArrow(_distinct_five, "key long").distinct()
                    .groupBy(F.expr(f"key & {_FOUR}").alias("four")).agg(F.count("*").alias("n")))


def _by_bucket(counts: DataFrame):
    three = F.expr(f"shiftright(key, 8) & {_THREE}")
    return counts.withColumn("bucket", F.pmod(F.xxhash64(three), F.lit(BUCKETS)).cast("int")).groupBy("bucket")


def _bucket_counts(table: pa.Table):
    """The sample's counts of a bucket, arranged, and its rows of held-out texts."""
    kind, key, n = (table.column(c).to_numpy() for c in ("kind", "key", "n"))
    mine, corpus, held = kind < 2, kind == _CORPUS, kind == _HELD
    five = np.unique(key[mine] & _FIVE)
    counted = _arranged(kind[mine], key[mine], n[mine], five, _shared(five, key[corpus], n[corpus]))
    return counted, table.column("row").filter(pa.array(held)).to_numpy(), key[held], n[held]


def _tried(table: pa.Table) -> pa.Table:
    """What the held-out texts' sequences of a bucket add to each text's difference, for every discount."""
    counted, row, key, n = _bucket_counts(table)
    rows, at = np.unique(row, return_inverse=True)
    sums = [np.bincount(at, n * _model(*counted, discount).differences(key), len(rows)) for discount in DISCOUNTS]
    flat = pa.array(np.stack(sums, 1).ravel(), pa.float64())  # without rows, bincount tells whole numbers
    return pa.table({"row": pa.array(rows, pa.int64()), "sums": pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(DISCOUNTS), pa.int32()), flat)})


def _telling(discount: float):
    """A bucket's part of the model, without what gives the same by backing off: sequences that no class counts above
    the discount, and contexts that both classes discount alike."""
    def run(table: pa.Table) -> pa.Table:
        counted = _bucket_counts(table)[0]
        model, (six, *_, classes, _) = _model(*counted, discount), counted
        often_six, often_five = np.zeros(len(six), bool), np.zeros(len(model.five), bool)
        for mine, n, follows in classes:
            often_six[mine[n > discount]] = True
            often_five |= follows > discount
        parts = [(six[often_six], model.of_six[often_six])]
        parts.append((model.from_five[model.of_from_five != 0], model.of_from_five[model.of_from_five != 0]))
        parts.append((model.five[often_five], model.of_five[often_five]))
        parts.append((model.from_four[model.of_from_four != 0], model.of_from_four[model.of_from_four != 0]))
        return pa.table({"part": pa.array(np.repeat(np.arange(4, dtype=np.int32), [len(k) for k, _ in parts])),
                         "key": pa.array(np.concatenate([k for k, _ in parts])), "value": pa.array(np.concatenate([v for _, v in parts]), pa.float64())})
    return run


def _shared(five: np.ndarray, four: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The corpus-wide chance of the last byte of each sequence after the three before it, by continuation counts."""
    order = np.argsort(four)
    four, n = four[order], n[order]
    three, at = np.unique(four >> 8, return_inverse=True)
    total, kinds = np.append(np.bincount(at, n, len(three)), 1.0), np.append(np.bincount(at, minlength=len(three)), 1)
    count = np.append(n, 0.0)[look_up(four, five & _FOUR)]
    context = look_up(three, (five & _FOUR) >> 8)
    return (np.maximum(count - 0.75, 0) + 0.75 * kinds[context] / 256) / total[context]


def _arranged(label, key, n, five, shared) -> tuple:
    """The sorted sequences with their contexts, and each class's counts: the same for every discount."""
    six, six_at = np.unique(key, return_inverse=True)
    from_five, five_context = np.unique(six >> 8, return_inverse=True)
    from_four, four_context = np.unique(five >> 8, return_inverse=True)
    lower = np.searchsorted(five, six & _FIVE).astype(np.int32)
    classes = []
    for c in (1, 0):
        mine = six_at[label == c].astype(np.int32)
        classes.append((mine, n[label == c], np.bincount(lower[mine], minlength=len(five)).astype(np.int32)))
    return six, from_five, five_context.astype(np.int32), five, from_four, four_context.astype(np.int32), lower, classes, shared


def _model(six, from_five, five_context, five, from_four, four_context, lower, classes, shared, discount: float) -> ToxicityModel:
    of_six, of_five, of_from_five, of_from_four = [], [], [], []
    for mine, n, follows in classes:
        count = np.bincount(mine, n, len(six))
        total = np.bincount(four_context, follows, len(from_four))
        held = np.where(total > 0, np.bincount(four_context, np.minimum(follows, discount), len(from_four)) / np.maximum(total, 1), 1.0)
        low = np.maximum(follows - discount, 0) / np.maximum(total, 1)[four_context] + held[four_context] * shared
        of_five.append(np.log(low))
        of_from_four.append(np.log(held))
        total = np.bincount(five_context, count, len(from_five))
        # counts of long texts are fractions: a context seen less than once keeps what it has
        held = np.where(total > 0, np.bincount(five_context, np.minimum(count, discount), len(from_five)) / np.where(total > 0, total, 1), 1.0)
        of_six.append(np.log(np.maximum(count - discount, 0) / np.where(total > 0, total, 1)[five_context] + held[five_context] * low[lower]))
        of_from_five.append(np.log(held))
    return ToxicityModel(six, of_six[0] - of_six[1], from_five, of_from_five[0] - of_from_five[1],
                         five, of_five[0] - of_five[1], from_four, of_from_four[0] - of_from_four[1])


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, both classes weighing alike, with a small ridge on the standardised slope."""
    if not 0 < y.sum() < len(y):
        return 1.0, 0.0
    centre, spread = x.mean(), max(x.std(), 1e-9)
    z = np.stack([(x - centre) / spread, np.ones(len(x))], 1)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -35, 35)))
        slope = z.T @ (weight * (y - p)) - np.array([1.0, 0.0]) * beta
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1.0, 1e-6])
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / spread), float(beta[1] - beta[0] * centre / spread)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, difference, score)`` per row: mean log-likelihood difference per byte of the whole text, and its place from 0 to 1.

    A null or empty text has difference 0; without a model every score is 0.
    Map-only; the model, bounded by the sample it was fitted on, goes along as a
    broadcast variable.  Repeated rows give one row each, a null id stays null, and
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sums = np.zeros(len(texts))
            size = np.zeros(len(texts))
            for start, stop, keys, offsets in sequences(texts):
                if known and len(keys):
                    value = np.append(known.differences(keys), 0.0)
                    sums[start:stop] += np.add.reduceat(value, offsets[:-1]) * (np.diff(offsets) > 0)
                size[start:stop] += np.diff(offsets)
            difference = sums / np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(difference), pa.array(known.score(difference) if known else sums)],
                                             [id_col, "difference", "score"])

    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {id_type}, difference double, score double")
