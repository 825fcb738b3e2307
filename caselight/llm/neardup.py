"""Near-duplicate documents by DartMinHash signatures and banded joins, confirmed on the shingles themselves.

A text is the multiset of its five-word shingles.  Each unit of weight of a
shingle is a region into which hashed darts are thrown along a rank axis; for
each coordinate the earliest dart over all regions is kept, so two texts agree
in a coordinate with a probability equal to their weighted Jaccard similarity.
A text needs about k ln k darts, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from caselight.llm.links import components, packed, settled
from caselight.llm.words import as_long, mix, shingles, word_hashes
from caselight.shipping import ship_by_value

ship_by_value(__name__)

BANDS, ROWS = 25, 5  # a pair of similarity 0.8 shares a band with probability 0.99995
BLOCK = 256  # texts on either side of a block
PAIRS_PER_BUCKET = 2_000  # a bucket with more pairs across classes is compared in blocks
ROUNDS = 2  # comparisons of every bucket with one of its texts
_U = np.uint64


def weighted_elements(shingle: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One element per unit of weight: the n-th copy of a shingle in its text is an element of its own."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((shingle, text))
    s, t = shingle[order], text[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0))
    return mix(s + (np.arange(len(s)) - begin).astype(_U) * _U(0x9E3779B97F4A7C15)), t


def dart_signatures(elements: np.ndarray, text: np.ndarray, texts: int, k: int) -> np.ndarray:
    """``texts x k`` identities of the earliest dart per coordinate; rows of texts without elements are zero."""
    out = np.zeros((texts, k), _U)
    weight = np.bincount(text, minlength=texts)
    limit = np.where(weight > 0, (k * np.log(k) + 2 * k) / np.maximum(weight, 1), 0.0)
    todo = weight > 0
    while todo.any():
        use = todo[text]
        e, t = elements[use], text[use]
        rank, throw = np.zeros(len(e)), 0
        found_rank, found_key, found_id = [], [], []
        while len(e):  # the next dart of every region that has not passed its text's limit
            throw += 1
            dart = mix(e + _U(throw * 0xA24BAED4963EE407 % (1 << 64)))
            rank = rank - np.log(((dart >> _U(11)).astype(np.float64) + 0.5) / (1 << 53))
            near = rank <= limit[t]
            e, t, rank, dart = e[near], t[near], rank[near], mix(dart[near] ^ _U(0x5851F42D4C957F2D))
            found_rank.append(rank)
            found_key.append(t * k + (dart % _U(k)).astype(np.int64))
            found_id.append(dart)
        r, key, dart = np.concatenate(found_rank), np.concatenate(found_key), np.concatenate(found_id)
        order = np.lexsort((dart, r, key))
        key = key[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        flat = np.zeros(texts * k, _U)
        flat[key[first]] = dart[order][first] | _U(1)
        flat = flat.reshape(texts, k)
        full = todo & (flat != 0).all(1)
        out[full] = flat[full]
        todo &= ~full
        limit = np.where(todo, limit * 2, limit)  # a coordinate was not hit: throw further
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), _U)
    for band in range(bands):
        total = np.full(len(signature), _U(band + 1))
        for row in range(rows):
            total = mix(total * _U(0x9E3779B97F4A7C15) + signature[:, band * rows + row])
        keys[:, band] = total
    return keys


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted arrays of weighted elements without repeats."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return both / (len(a) + len(b) - both)


def _signed(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, hashes, offsets in word_hashes(batch.column(1)):
                elements, text = weighted_elements(*shingles(hashes, offsets, n))
                keys = band_keys(dart_signatures(elements, text, stop - start, bands * rows), bands, rows)
                some = np.bincount(text, minlength=stop - start) > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), batch.column(2).slice(start, stop - start),
                     pa.array([k.view(np.int64) if s else [] for k, s in zip(keys, some)], pa.list_(pa.int64()))],
                    ["id", "copy", "keys"])
    return run


def _similar(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [weighted_jaccard(x, y) >= threshold for x, y in zip(_elements(batch.column(2), n), _elements(batch.column(3), n))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5,
                    threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(id, class_id)`` per row: the smallest id among documents linked by weighted shingle similarity of at least ``threshold``.

    Exact copies meet by a digest of the text and only the smallest id goes on.
    In each band bucket all texts are compared with one of them, in ROUNDS rounds
    with another one each time, leaving out those already in its class.  Texts
    still outside the largest class of a bucket are then compared with all members of
    other classes, in bounded blocks where that is many, so no link between texts
    that share a band is lost.  Links are confirmed on the whole texts.

    Null and empty texts: equal ones are one class (a null counts as empty).  A
    text of fewer than ``n`` words is one shingle; one without words is linked to
    exact copies only.  An id that repeats is one document; a null id takes no part and
    gets a null class.  Other columns are not read.  An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    signed = settled(base.where("id IS NOT NULL").select("id", "text", F.md5(F.col("text").cast("binary")).alias("copy"))
                     .mapInArrow(_signed(n, bands, rows), f"id {id_type}, copy string, keys array<long>"))
    kept = settled(signed.groupBy("copy").agg(F.min(F.struct("id", "keys")).alias("least")).select("copy", "least.*"))
    # copies to their smallest id: the groups may be large, the joined rows are small
    copies = signed.select("id", "copy").join(kept.select("copy", F.col("id").alias("first")), "copy").where("id <> first")

    dealt = kept.select("id", F.explode("keys").alias("key"))
    buckets = dealt.groupBy("key").agg(F.min("id").alias("_first"), F.max("id").alias("_last")).where("_first < _last").select("key")
    members = settled(dealt.join(buckets, "key"))  # only buckets in which at least two texts meet
    texts = settled(base.join(members.select("id").distinct(), "id", "left_semi"))
    edges = settled(copies.select(F.col("id").alias("a"), F.col("first").alias("b")).distinct().limit(0))
    tested = edges
    label = edges.select(F.col("a").alias("id"), F.col("b").alias("label"))
    for turn in range(ROUNDS + 1):
        named = settled(members.join(label, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label")))
        if turn < ROUNDS:  # one text of each bucket stands against those outside its class: another one each time
            pick = F.min(F.struct(F.xxhash64("id", F.lit(turn)) if turn else F.lit(0), "id", "label")).alias("pick")
            heads = (named.groupBy("key").agg(pick, F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high")
                     .select("key", F.col("pick.id").alias("b"), F.col("pick.label").alias("b_label")))
            met = named.withColumnRenamed("id", "a").join(heads, "key").where("label <> b_label")
        else:  # what is left: texts outside their bucket's largest class stand against all of other classes
            sizes = named.groupBy("key", "label").agg(F.count("*").alias("n"))
            main = (sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("classes"), F.sum("n").alias("all"))
                    .where("classes > 1").select("key", F.col("top.label").alias("main"), "all", (F.col("all") - F.col("top.n")).alias("out")))
            mixed = settled(named.join(main, "key"))
            small = mixed.where(F.col("all") * F.col("out") <= PAIRS_PER_BUCKET)
            met = (small.where("label <> main").select("key", F.col("id").alias("a"), "label")
                   .join(small.select("key", F.col("id").alias("b"), F.col("label").alias("b_label")), "key").where("label <> b_label"))
            large = mixed.where(F.col("all") * F.col("out") > PAIRS_PER_BUCKET)
            edges = settled(edges.unionByName(_in_blocks(large, texts, n, threshold, id_type)))
            label = components(edges)
        pairs = settled(met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
                        .join(tested, ["a", "b"], "left_anti"))
        new = pairs.count()
        if not new:
            continue
        pairs = packed(pairs, new)
        tested = tested.unionByName(pairs)
        edges = settled(edges.unionByName(_confirmed(pairs, texts, n, threshold, id_type)))
        label = components(edges)
    # an id with several texts is linked to each of their groups
    every = label.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(
        copies.select(F.col("id").alias("a"), F.col("first").alias("b")).distinct())
    classes = components(every)
    ids = base.select("id")
    return (ids.join(classes.groupBy("id").agg(F.min("label").alias("label")), "id", "left")
            .select(F.col("id").alias(id_col), F.coalesce("label", "id").alias("class_id")))


def _elements(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted weighted elements of each text."""
    for _, _, hashes, offsets in word_hashes(texts):
        e, t = weighted_elements(*shingles(hashes, offsets, n))
        at = np.searchsorted(t, np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            yield np.sort(e[at[i]:at[i + 1]])


def _block(n: int, threshold: float, id_type: pa.DataType):
    def shares(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(columns)), np.float32)
        for row, own in enumerate(sets):
            at = np.searchsorted(columns, own)
            at = np.minimum(at, len(columns) - 1)
            out[row, at[columns[at] == own]] = 1
        return out

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"a": pa.array([], id_type), "b": pa.array([], id_type)})
        if not len(left) or not len(right):
            return empty
        mine, theirs = (list(_elements(t.column("text").combine_chunks(), n)) for t in (left, right))
        columns = np.intersect1d(np.concatenate(mine), np.concatenate(theirs))
        both = np.zeros((len(mine), len(theirs)), np.float32)
        for start in range(0, len(columns), 8192):
            part = columns[start:start + 8192]
            both += shares(mine, part) @ shares(theirs, part).T
        size = np.add.outer([len(x) for x in mine], [len(x) for x in theirs]) - both
        # classes are numbered, as ids may be of any type
        numbers = pa.concat_arrays(left.column("label").chunks + right.column("label").chunks).dictionary_encode().indices.to_numpy()
        la, lb = numbers[:len(mine)], numbers[len(mine):]
        i, j = np.nonzero((both >= threshold * size - 1e-9) & (size > 0) & (la[:, None] != lb[None, :]))
        # one link to each class is enough: the first
        _, first = np.unique(np.stack([i, lb[j]], 1), axis=0, return_index=True) if len(i) else (None, [])
        i, j = i[first], j[first]
        return pa.table({"a": left.column("id").take(pa.array(i)), "b": right.column("id").take(pa.array(j))}) if len(i) else empty
    return run


def _in_blocks(mixed: DataFrame, texts: DataFrame, n: int, threshold: float, id_type: str) -> DataFrame:
    """Links found in buckets with many texts outside the main class, BLOCK texts against BLOCK texts at a time; no pair is written."""
    side = lambda who: F.greatest(F.ceil(F.col(who) / BLOCK).cast("int"), F.lit(1))
    deal = lambda salt, who: F.pmod(F.xxhash64("id", F.lit(salt)), side(who)).cast("int")
    every = lambda who: F.explode(F.sequence(F.lit(0), side(who) - 1))
    mixed = mixed.join(texts, "id")
    left = mixed.where("label <> main").select("id", "label", "text", "key", deal(1, "out").alias("l"), every("all").alias("r")).toDF("id", "label", "text", "key", "l", "r")
    right = mixed.select("id", "label", "text", "key", deal(2, "all").alias("r"), every("out").alias("l")).toDF(
        "id", "label", "text", "key", "r", "l")
    arrow = to_arrow_type(mixed.schema["id"].dataType)
    return (left.groupBy("key", "l", "r").cogroup(right.groupBy("key", "l", "r"))
            .applyInArrow(_block(n, threshold, arrow), f"a {id_type}, b {id_type}").distinct())


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int, threshold: float, id_type: str) -> DataFrame:
    """The pairs ``(a, b)`` whose texts reach the threshold."""
    return (pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b").mapInArrow(_similar(n, threshold), f"a {id_type}, b {id_type}"))


def _sortable(column: str, kind: T.DataType):
    """Text that sorts as the ids do."""
    c = F.col(column)
    if isinstance(kind, T.StringType):
        return F.concat(c, F.lit("\0"))
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    if isinstance(kind, T.DecimalType):
        digits = F.lpad(F.abs(c).cast("string"), 42, "0")
        return F.when(c < 0, F.concat(F.lit("0"), F.translate(digits, "0123456789", "9876543210"))).otherwise(F.concat(F.lit("1"), digits))
    return F.concat(c.cast("string"), F.lit("\0"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each class of near duplicates the row with the smallest id, with all its columns; rows with a null id stay.

    An id on rows with different texts names as many documents, ordered by id, then digest of
    the text.  Of rows with the same id and text one stays, the first by its other columns.  Null and empty
    texts are copies of one another.  Columns may have any name and type; an empty table gives no row.
    """
    key = "_key"
    while key in docs.columns:
        key += "_"
    digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    named = docs.where(F.col(id_col).isNotNull())
    several = named.groupBy(id_col).agg(F.min(digest).alias("_low"), F.max(digest).alias("_high")).where("_low < _high")
    own = F.col(id_col) if several.isEmpty() else F.concat(_sortable(id_col, docs.schema[id_col].dataType), digest)
    keyed = named.withColumn(key, own)
    first = near_duplicates(keyed.select(F.col(key).alias("_own"), F.col(text_col).alias("_text")), "_own", "_text").where("_own = class_id").select(
        F.col("_own").alias(key)).distinct()
    kept = keyed.join(first, key, "left_semi")
    repeated = settled(keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key))
    once = kept.join(repeated, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    whole, others = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)])
    order = F.to_json(others) if len(docs.columns) > 2 else F.lit("")
    one = kept.join(repeated, key, "left_semi").groupBy(key).agg(F.min_by(whole, order).alias("_row")).select("_row.*")
    return once.unionByName(one).unionByName(docs.where(F.col(id_col).isNull()))
