"""Personal data: base patterns, keys, and terms that give a protected entity away.

Every e-mail address, network address, card and phone number found is a
protected entity, and so is every key: a long word of letters and digits whose signs carry
too much information for a word of any language.  The words of all documents that name an entity
show how strongly a term reveals it: a term discloses an entity when their pointwise mutual
information comes near the information content of the entity itself.  The same is
asked of each kind of entity, which recurs where single values hardly do.  Such
terms are replaced wherever they stand, in any document, by their kind, or
removed where even the kind tells too much.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.bits import bit_field, holds
from caselight.llm.links import settled
from caselight.llm.words import SLICE, as_long, mix, word_hashes
from caselight.shipping import ship_by_value

ship_by_value(__name__)

# The kinds in their order and the patterns of the base detection.
KINDS = ("email", "ip", "card", "phone")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Whatever holds an ip, card or phone match lies within one such run: shorter ones are too short for any of them.
NUMBERS = re.compile(r"[+0-9][0-9 ().\-]{6,}")
TERM = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
KEY = re.compile(r"(?<![0-9A-Za-z_-])[0-9A-Za-z_-]{20,}(?![0-9A-Za-z_-])")
KEY_BITS = 3.0  # information per sign of a key, by the frequencies within it
TERM_PLACE, KEY_PLACE = 4, 5  # places of the method's kinds behind the base ones
WINDOW = 6  # words on each side of an entity that are its surroundings
REACH = 400  # characters on each side in which they are looked for


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if at % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        found = EMAIL_DOMAIN.match(text, at) if start < at else None
        if found:
            last = found.end()
            yield start, last
        else:
            last = at + 1  # nothing before this sign can belong to a later address
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, kind's place, end)`` of all base matches, per kind leftmost and without overlap, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for run in NUMBERS.finditer(text):
        at, part = run.start(), run.group()
        for m in IP.finditer(part):
            if all(len(n.lstrip("0")) <= 3 and int(n) <= 255 for n in m.group().split(".")):
                out.append((at + m.start(), 1, at + m.end()))
        for m in CARD.finditer(part):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((at + m.start(), 2, at + m.end()))
        for m in PHONE.finditer(part):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((at + m.start(), 3, at + m.end()))
    return sorted(out)


def key_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """``(start, end)`` of words that can only be keys, apart from base spans."""
    out = []
    for m in KEY.finditer(text):
        word = m.group()
        digits, letters = sum(c.isdigit() for c in word), sum(c.isalpha() for c in word)
        if digits < 4 or letters < 2 or any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        if -sum(n / len(word) * math.log2(n / len(word)) for n in Counter(word).values()) >= KEY_BITS:
            out.append(m.span())
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


KIND_ENTITIES = {kind: _signed(xxhash.xxh64_intdigest(f"every {kind}")) for kind in (*KINDS, "key")}


def marks(text: str, spans: list[tuple[int, int, str]]) -> list[dict]:
    """Per base span or key: its entity and the entity of its kind, each with a digest of the words around it, and those words with their places."""
    out = []
    for start, kind, end in spans:
        name = "key" if kind == KEY_PLACE else KINDS[kind]
        value = text[start:end].lower() if kind in (0, KEY_PLACE) else re.sub("[^0-9.]" if kind == 1 else "[^0-9]", "", text[start:end])
        low = max(start - REACH, 0)
        before = [(low + m.start(), low + m.end()) for m in TERM.finditer(text[low:start])]
        if before and low and before[0][0] == low:
            before = before[1:]  # it may be the end of a longer word
        after = [(end + m.start(), end + m.end()) for m in TERM.finditer(text[end:end + REACH])]
        if after and after[-1][1] == end + REACH:
            after = after[:-1]
        near = [(s, e) for s, e in before[-WINDOW:] + after[:WINDOW] if not any(s < y and x < e for x, _, y in spans)]
        words = [text[s:e] for s, e in near]
        for entity in (_signed(xxhash.xxh64_intdigest(f"{name}:{value}")), KIND_ENTITIES[name]):
            out.append({"entity": entity, "context": _signed(xxhash.xxh64_intdigest(" ".join(words).lower())), "words": words, "places": near})
    return out


_FOUND = ("copy string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
          "base array<struct<start:int,place:int,end:int>>, keys array<struct<start:int,place:int,end:int>>, "
          "marks array<struct<entity:long,context:long,terms:array<struct<term:long,start:int,end:int,number:boolean>>>>")


_EXTRA = "array<struct<start:int,place:int,end:int,number:boolean,remove:boolean>>"


def _detect(id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                counts, digests, base, keys, held, copies, words = [], [], [], [], [], [], []
                for text in part.column(1):
                    text = text.as_py() or ""
                    spans = base_spans(text)
                    counts.append([sum(k == kind for _, k, _ in spans) for kind in range(4)])
                    digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest())
                    base.append([{"start": s, "place": k, "end": e} for s, k, e in spans])
                    keys.append([{"start": s, "place": KEY_PLACE, "end": e} for s, e in key_spans(text, spans)])
                    spans = sorted(spans + [(k["start"], KEY_PLACE, k["end"]) for k in keys[-1]])
                    copies.append(hashlib.md5(text.encode()).hexdigest() if text else None)
                    held.append(marks(text, spans) if spans else [])
                    words += [w for m in held[-1] for w in m["words"]]
                hashes = np.concatenate([h for _, _, h, _ in word_hashes(pa.array(words, pa.string()))]) if words else np.zeros(0, np.uint64)
                if len(hashes) != len(words):
                    raise ValueError("a term is not one word")
                at, hashes = 0, hashes.view(np.int64).tolist()
                rows = []
                for found in held:
                    row = []
                    for m in found:
                        terms = [{"term": hashes[at + i], "start": s, "end": e, "number": w[0].isdigit()}
                                 for i, ((s, e), w) in enumerate(zip(m["places"], m["words"]))]
                        at += len(terms)
                        row.append({"entity": m["entity"], "context": m["context"], "terms": terms})
                    rows.append(row)
                term = pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("number", pa.bool_())])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(copies, pa.string()), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(4)],
                     pa.array(digests),
                     *[pa.array(x, pa.list_(pa.struct([("start", pa.int32()), ("place", pa.int32()), ("end", pa.int32())]))) for x in (base, keys)],
                     pa.array(rows, pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("terms", pa.list_(term))])))],
                    [id_col, "copy", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "keys", "marks"])
    return run


def _documents_with(field):
    """Documents per preselected term, added up within the task; it is written out each time a million terms have gathered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, hashes, offsets in word_hashes(batch.column(0)):
                hit = np.flatnonzero(holds(field, mix(hashes)))
                text = np.searchsorted(offsets, hit, "right") - 1
                pairs = np.unique(np.stack([hashes[hit].view(np.int64), text], 1), axis=0)
                term, n = np.unique(pairs[:, 0], return_counts=True)
                terms, place = np.unique(np.concatenate([terms, term]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, n]), len(terms)).astype(np.int64)
            if len(terms) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts)], ["term", "n"])
                terms, counts = terms[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts)], ["term", "n"])
    return run


def _free_words(text: str, hashes: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(start, end, hash)`` of the chosen ones of a text's words, without those that a base span or a key touches."""
    spans = base_spans(text)
    spans = sorted(spans + [(s, KEY_PLACE, e) for s, e in key_spans(text, spans)])
    places = [(m.start(), m.end()) for m in TERM.finditer(text)]
    if len(places) != len(hashes):  # a run without any divider was hashed in pieces
        wanted = hashes[chosen]
        places = [(s, e) for s, e in places if e - s < SLICE // 16]
        hashes = np.concatenate([h for _, _, h, _ in word_hashes(pa.array([text[s:e] for s, e in places], pa.string()))] or [hashes[:0]])
        chosen = np.isin(hashes, wanted)
    ends, high = [s for s, _, _ in spans], []
    for _, _, e in spans:
        high.append(max(e, high[-1]) if high else e)
    for i in np.flatnonzero(chosen).tolist():
        start, end = places[i]
        at = bisect.bisect_left(ends, end)  # spans that begin before the word's end
        if not at or high[at - 1] <= start:
            yield start, end, _signed(int(hashes[i]))


def _chosen_words(column: pa.Array, field) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Per text with words in the bit field (all words without one): its row and those words."""
    for start, stop, hashes, offsets in word_hashes(column):
        chosen = np.ones(len(hashes), bool) if field is None else holds(field, mix(hashes))
        for row in np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(chosen)])[offsets])).tolist():
            part = slice(offsets[row], offsets[row + 1])
            yield start + row, list(_free_words(column[start + row].as_py(), hashes[part], chosen[part]))


def _free_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, words in _chosen_words(batch.column(0), None):
            yield pa.RecordBatch.from_arrays([pa.array(sorted({t for _, _, t in words}), pa.int64())], ["term"])


def _named_with(field):
    """Each entity of a text beside each preselected word of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in _chosen_words(batch.column(0), field):
                terms = np.array(sorted({t for _, _, t in words}), np.int64)
                n = batch.column(1)[row]
                for m in batch.column(2)[row].as_py() if len(terms) else ():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(terms), m["entity"])), pa.array(terms), pa.array(np.full(len(terms), m["context"])),
                         pa.array(np.full(len(terms), n.as_py()))], ["entity", "term", "context", "n"])
    return run


def _standing(field):
    """Every place of a preselected word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in _chosen_words(batch.column(1), field):
                text = batch.column(1)[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[row].as_py()] * len(words), pa.string()), pa.array([t for _, _, t in words], pa.int64()),
                     pa.array([s for s, _, _ in words], pa.int32()), pa.array([e for _, e, _ in words], pa.int32()),
                     pa.array([text[s].isdigit() for s, _, _ in words], pa.bool_())], ["copy", "term", "start", "end", "number"])
    return run


def _of_copies(field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(holds(field, batch.column(2).to_numpy().view(np.uint64))))
    return run


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([as_long(mix(batch.column(0).to_numpy().view(np.uint64)))], ["key"])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans per row with the words around them; map-only, written to the shared folder."""
    id_type = docs.select(id_col).schema[0].dataType.simpleString()
    return settled(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(_detect(id_col), f"`{id_col}` {id_type}, {_FOUND}"))


def disclosing_terms(found: DataFrame, texts: DataFrame, strength: float = 0.75, support: int = 3, broadcast_rows: int = 100_000) -> DataFrame:
    """``(copy, extra)``: per text the places of all terms that disclose some entity, whether the text names that entity or not.

    ``log2 p(e,t) / (p(e) p(t)) >= strength * -log2 p(e)`` over whole documents, for terms
    that stand in texts with at least ``support`` different surroundings of the entity, or in that many surroundings
    themselves, so that copies of one text prove nothing.  For a kind of entity, which many texts name, documents
    with both count less two standard errors, so that chance among many rare words proves nothing either.
    Exact over the whole corpus; only the fields of bits that preselect terms and texts are bounded.
    """
    rows = max(texts.count(), 1)
    named = found.where(F.size("marks") > 0).groupBy("copy").agg(F.count("*").alias("n"), F.min("marks").alias("marks"))
    near = settled(named.select("copy", "n", F.explode("marks").alias("m")).select("copy", "n", "m.*"))
    often = (near.select("entity", "context").distinct().groupBy("entity").agg(F.count("*").alias("surroundings"))
             .where(F.col("surroundings") >= support))
    entity = settled(near.join(often, "entity", "left_semi").select("entity", "copy", "n").distinct()
                     .groupBy("entity").agg(F.sum("n").alias("n_entity")))
    most = entity.agg(F.max("n_entity")).first()[0]
    if most is None:
        return entity.select(F.lit("").alias("copy"), F.expr(f"cast(null AS {_EXTRA})").alias("extra")).limit(0)
    terms = settled(near.join(entity, "entity").select("entity", "context", F.explode("terms").alias("t")).select("entity", "context", "t.*"))
    backed = settled(terms.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("s"))
                     .where(F.col("s") >= support).select("entity", "term", F.lit(True).alias("near")))
    wanted = settled(near.join(entity, "entity", "left_semi").groupBy("copy", "n", "entity").agg(F.min("context").alias("context"))
                     .groupBy("copy", "n").agg(F.collect_list(F.struct("entity", "context")).alias("named")))
    copies = bit_field(wanted.select(F.xxhash64("copy").alias("key")))
    copy = F.md5(F.col("text").cast("binary"))
    naming = settled(texts.select(copy.alias("copy"), "text").select("copy", "text", F.xxhash64("copy").alias("key"))
                     .mapInArrow(_of_copies(copies), "copy string, text string, key long").dropDuplicates(["copy"])
                     .join(wanted, "copy").select("text", "n", "named"))
    several = naming.select("text").mapInArrow(_free_terms, "term long").groupBy("term").agg(F.count("*").alias("s")).where(F.col("s") >= support)
    candidates = settled(several.select("term").unionByName(backed.select("term")).distinct())
    counted = (texts.mapInArrow(_documents_with(bit_field(candidates.mapInArrow(_mixed, "key long"))), "term long, n long")
               .groupBy("term").agg(F.sum("n").alias("n_term")))
    # a term of more documents than this cannot be strong, since no more hold both than name the entity
    counts = settled(counted.join(candidates, "term", "left_semi")
                     .where(F.log2("n_term") <= strength * math.log2(most) + (1 - strength) * math.log2(rows) + 1e-6))
    pairs = (naming.mapInArrow(_named_with(bit_field(counts.select("term").mapInArrow(_mixed, "key long"))),
                               "entity long, term long, context long, n long")
             .groupBy("entity", "term", "context").agg(F.sum("n").alias("n"))
             .groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("s")))
    information = F.log2(F.lit(float(rows)) / F.col("n_entity"))
    certain = F.when(F.col("entity").isin(list(KIND_ENTITIES.values())), F.greatest(F.col("n_both") - 2 * F.sqrt("n_both"), F.lit(1e-9))).otherwise(F.col("n_both"))
    mutual = F.log2(certain * float(rows) / (F.col("n_entity") * F.col("n_term")))
    strong = (pairs.join(backed, ["entity", "term"], "left").where((F.col("s") >= support) | F.col("near"))
              .join(counts, "term").join(entity, "entity").where((information > 0) & (mutual >= strength * information - 1e-9)))
    # the more general term is the kind of word: it is judged by the same measure among all surroundings
    kinds = terms.groupBy("entity", "number").agg(F.countDistinct("context").alias("c"))
    per_entity = terms.groupBy("entity").agg(F.countDistinct("context").alias("c_entity"))
    per_kind = {r["number"]: r["c"] for r in terms.groupBy("number").agg(F.countDistinct("context").alias("c")).collect()}  # two rows
    c_all = max(terms.select(F.countDistinct("context")).first()[0], 1)
    c_kind = F.when(F.col("number"), F.lit(per_kind.get(True, 1))).otherwise(F.lit(per_kind.get(False, 1)))
    told = (kinds.join(per_entity, "entity")
            .withColumn("remove", F.log2(F.col("c") * c_all / (F.col("c_entity") * c_kind))
                        > strength * F.greatest(F.log2(c_all / F.col("c_entity")), F.lit(1.0)))
            .select("entity", "number", "remove"))
    disclosing = settled(strong.select("entity", "term").join(told, "entity", "left").groupBy("term")
                         .agg(F.coalesce(F.bool_or(F.col("remove") & F.col("number")), F.lit(False)).alias("remove_number"),
                              F.coalesce(F.bool_or(F.col("remove") & ~F.col("number")), F.lit(False)).alias("remove_word")))
    field = bit_field(disclosing.select("term").mapInArrow(_mixed, "key long"))
    places = texts.select(copy.alias("copy"), "text").mapInArrow(_standing(field), "copy string, term long, start int, end int, number boolean")
    return (places.join(F.broadcast(disclosing) if disclosing.count() <= broadcast_rows else disclosing, "term")
            .groupBy("copy", "start", "end", "number")
            .agg(F.bool_or(F.when(F.col("number"), F.col("remove_number")).otherwise(F.col("remove_word"))).alias("remove"))
            .groupBy("copy").agg(F.collect_list(F.struct("start", F.lit(TERM_PLACE).alias("place"), "end", "number", "remove")).alias("extra")))


def _extra(found: DataFrame, docs: DataFrame, text_col: str, strength: float, support: int, broadcast_rows: int) -> DataFrame:
    """The disclosing terms by text, written out and counted: broadcast only up to ``broadcast_rows`` texts, so that a text with many copies isn't dealt by its digest."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    extra = settled(disclosing_terms(found, texts, strength, support, broadcast_rows))
    return F.broadcast(extra) if extra.count() <= broadcast_rows else extra


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strength: float = 0.75, support: int = 3,
                 broadcast_rows: int = 100_000) -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms, n_keys, n_spans)`` per row.

    ``spans`` lists ``kind:start:end`` of base matches, of disclosing terms
    (kind ``term``, wherever they stand) and of keys (kind ``key``) by start, then kind; places are code points, the end is not
    included.  A null or empty text has no spans; repeated rows give one row each, a null id
    stays null, other columns are not read, and an empty table gives no rows.  Beyond
    ``broadcast_rows`` texts with terms these are joined by a shuffle.
    """
    found = detect(docs, id_col, text_col)
    extra = _extra(found, docs, text_col, strength, support, broadcast_rows)
    names = F.create_map(*[F.lit(x) for at, kind in enumerate((*KINDS, "term", "key")) for x in (at, kind)])
    plain = F.transform("extra", lambda x: F.struct(x["start"].alias("start"), x["place"].alias("place"), x["end"].alias("end")))
    joined = F.array_sort(F.concat("base", "keys", F.coalesce(plain, F.expr("array()").cast("array<struct<start:int,place:int,end:int>>"))))
    written = F.transform(joined, lambda x: F.concat_ws(":", names[x["place"]], x["start"].cast("string"), x["end"].cast("string")))
    return (found.join(extra, "copy", "left")
            .select(id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(written, ",").alias("spans"),
                    F.coalesce(F.size("extra").cast("long"), F.lit(0).cast("long")).alias("n_terms"), F.size("keys").cast("long").alias("n_keys"),
                    F.size(joined).cast("long").alias("n_spans")))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strength: float = 0.75, support: int = 3,
             broadcast_rows: int = 100_000) -> DataFrame:
    """The same rows and columns with every span of the text replaced.

    Base spans become ``<EMAIL>``, ``<IP>``, ``<CARD>`` or ``<PHONE>``, keys ``<KEY>``; a disclosing
    term becomes ``<WORD>`` or ``<NUMBER>``, or goes where that kind discloses too.
    Overlapping spans are replaced together by the mark of the first.  A null text
    stays null.  The table of term spans is broadcast only if counted to hold at most
    ``broadcast_rows`` texts; beyond that it is joined by a shuffle.
    """
    found = detect(docs, id_col, text_col)
    extra = _extra(found, docs, text_col, strength, support, broadcast_rows)
    names = docs.columns
    at = names.index(text_col)
    key = F.md5(F.col(text_col).cast("binary"))
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), key.alias("copy")).join(extra, "copy", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column(0).flatten()
            columns[at] = pa.array([None if t.as_py() is None else rewritten(t.as_py(), e.as_py() or [])
                                    for t, e in zip(columns[at], batch.column(1))], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return both.select("row", "extra").mapInArrow(run, docs.schema)


def rewritten(text: str, extra: list[dict]) -> str:
    base = base_spans(text)
    spans = [(s, e, f"<{KINDS[k].upper()}>") for s, k, e in base] + [(s, e, "<KEY>") for s, e in key_spans(text, base)]
    spans += [(x["start"], x["end"], "" if x["remove"] else "<NUMBER>" if x["number"] else "<WORD>") for x in extra]
    out, last = [], 0
    for start, end, mark in sorted(spans):
        if start >= last:
            out += [text[last:start], mark]
        last = max(last, end)
    return "".join(out) + text[last:]
