"""Text cleaning and lexicon flags as built-in column expressions (no Python UDF).

Java's ``\\w \\d \\s \\b`` are ASCII by default, so the classes are spelled out.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache, reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselight import config

WORD = r"\p{L}\p{N}_"
SPACE = (r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
         r"\x{202f}\x{205f}\x{3000}")

# The local part is matched possessively and only from the start of its run (or where the
# previous match ended), so a long run without an "@" costs one pass instead of one per character.
EMAIL = (rf"(?:\G|(?<![{WORD}.+\-]))[{WORD}.+\-]++@[{WORD}\-]++\.[{WORD}.\-]++")
LONG_NUMBER = rf"(?<![{WORD}])\p{{Nd}}{{6,}}(?![{WORD}])"

# Windows-1252 characters that stand for bytes 0x80-0x9F.
_CP1252 = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0)
           if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_EXTRA = "".join(_CP1252.values())
_TAIL = rf"[\x{{80}}-\x{{bf}}{_EXTRA}]"
_SUSPECT = rf"[\x{{c2}}-\x{{f4}}]{_TAIL}"  # a cheap look that settles most texts
# lead bytes with their followers, as many side by side as a pattern may hold without deep recursion
_MOJIBAKE = rf"(?:[\x{{c2}}-\x{{df}}]{_TAIL}|[\x{{e0}}-\x{{ef}}]{_TAIL}{{2}}|[\x{{f0}}-\x{{f4}}]{_TAIL}{{3}}){{1,200}}"
_CONTROL = r"\x00-\x08\x0b\x0e-\x1f\x7f\x{206a}-\x{206f}\x{feff}\x{fff9}-\x{fffc}"
# plain ranges that hold all that is straightened; cheap looks that settle most texts
_HIGH_ANY = r"[\x{300}-\x{10ffff}]"
_HIGH, _LOW = r"[\x{2bc}-\x{ffff}]", r"[\x00-\x08\x0b-\x1f\x7f-\x{85}]"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_ODD = "ʼ‘’‚‛“”„‟　" + _WIDE
_PLAIN = "'" * 5 + '"' * 4 + " " + "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)
_CROOKED = (rf"[ʼ\x{{2018}}-\x{{201f}}\x{{3000}}\x{{ff01}}-\x{{ff5e}}\x{{fb00}}-\x{{fb06}}\r\x{{85}}\x{{2028}}\x{{2029}}"
            rf"{_CONTROL}]")
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st"}
# The public HTML standard's names, as Python's library lists them; the usual ones are tried first.
_NAMED = json.dumps({name[:-1]: text for name, text in html5.items() if name.endswith(";")}, ensure_ascii=False)
_USUAL = ("amp", "lt", "gt", "quot", "apos", "nbsp")
_REFERENCE = r"^(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbered(n: Column) -> Column:
    """The character of a numeric reference, by the HTML standard's rules for numbers that name none."""
    def between(*ends: tuple[int, int]) -> Column:
        return reduce(lambda a, b: a | b, [n.between(*e) for e in ends])

    windows = F.array(*[F.lit(_CP1252.get(b, chr(b))) for b in range(0x80, 0xA0)])
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (F.when((n == 0) | (n > 0x10FFFF) | between((0xD800, 0xDFFF)), F.lit("\ufffd"))
            .when(between((0x80, 0x9F)), F.get(windows, (n - 0x80).cast("int")))
            .when(between((1, 8), (0xB, 0xB), (0xE, 0x1F), (0x7F, 0x7F), (0xFDD0, 0xFDEF)) | (n.bitwiseAND(0xFFFE) == 0xFFFE), F.lit(""))
            .otherwise(plain))


def decode_entities(text: Column) -> Column:
    """Named and numeric HTML references that end in a semicolon, each decoded once.

    What is no reference stays; text that holds a literal ``<`` is left alone (it is markup).
    """
    def after_sign(part: Column) -> Column:
        def named(name: Column) -> Column:
            known = reduce(lambda c, u: c.when(name == u, F.lit(html5[u + ";"])), _USUAL[1:], F.when(name == _USUAL[0], F.lit("&")))
            number = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2)))
            known = known.when(name.startswith("#"), bind(number.try_cast("bigint"), _numbered))
            found = known.otherwise(F.try_element_at(F.from_json(F.lit(_NAMED), "map<string,string>"), name))
            return F.coalesce(F.concat(found, F.substr(part, F.length(name) + 2)), F.concat(F.lit("&"), part))
        return F.when(part.rlike(_REFERENCE), bind(F.regexp_extract(part, _REFERENCE, 1), named)).otherwise(F.concat(F.lit("&"), part))

    def decoded(t: Column) -> Column:
        parts = F.split(t, "&")
        out = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), after_sign), ""))
        return F.when(F.contains(t, F.lit("&")) & ~F.contains(t, F.lit("<")), out).otherwise(t)

    return bind(text, decoded)


def repair_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Windows-1252 or Latin-1, stretch by stretch.

    A stretch is a run of characters that spell lead bytes with their followers; each is
    judged alone, so sound words, other scripts and emojis beside it neither hinder the repair nor change.
    """
    def mended(part: Column) -> Column:
        as_bytes = F.translate(part, _EXTRA, "".join(map(chr, _CP1252)))
        return F.coalesce(F.try_validate_utf8(F.encode(as_bytes, "ISO-8859-1").cast("string")), part)

    def repaired(t: Column) -> Column:
        eligible = t.rlike(_SUSPECT)
        # blanked inside the branch as well: a branch may be evaluated ahead of its condition
        safe = F.when(eligible, t).otherwise(F.lit(""))
        around = F.split(safe, _MOJIBAKE, -1)
        between = F.transform(F.regexp_extract_all(safe, F.lit(_MOJIBAKE), F.lit(0)), mended)
        out = F.array_join(F.zip_with(around, between, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(eligible, out).otherwise(t)

    return bind(text, repaired)


# --- canonical composition --------------------------------------------------------------------

_BUCKETS = 1021  # a map is read from end to end, so tables are dealt to maps of a few entries each


def _dealt(table: dict[str, str | int]) -> str:
    """A table of one or two characters as JSON: a map per bucket, the bucket told by the characters' numbers."""
    buckets: list[dict] = [{} for _ in range(_BUCKETS)]
    for key, value in table.items():
        buckets[(31 * ord(key[0]) + ord(key[-1])) % _BUCKETS][key] = value
    return json.dumps(buckets, ensure_ascii=False)


def _found(dealt: str, first: Column, last: Column, key: Column, kind: str = "string") -> Column:
    buckets = F.from_json(F.lit(dealt), f"array<map<string,{kind}>>")
    return F.try_element_at(F.get(buckets, F.pmod(31 * F.ascii(first) + F.ascii(last), F.lit(_BUCKETS))), key)


@cache
def _composition() -> dict[str, str]:
    """Tables of canonical composition, made from the Unicode data that Python carries, as JSON or as pattern classes."""
    code = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and not 0xAC00 <= c <= 0xD7A3]
    apart = {c: d for c in code if (d := unicodedata.normalize("NFD", c)) != c}
    pairs = {}
    for c in apart:
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and unicodedata.normalize("NFC", c) == c:
            pairs["".join(chr(int(p, 16)) for p in parts)] = c
    ranks = {c: unicodedata.combining(c) for c in code if unicodedata.combining(c)}
    alone = {c: n for c in code if (n := unicodedata.normalize("NFC", c)) != c}
    return {"apart": _dealt(apart), "pairs": _dealt(pairs), "ranks": _dealt(ranks),
            "from": "".join(c for c, n in alone.items() if len(n) == 1), "to": "".join(n for n in alone.values() if len(n) == 1),
            "longer": json.dumps({c: n for c, n in alone.items() if len(n) > 1}, ensure_ascii=False)}


# wide classes that hold all there is to compose or replace
_LOOSE = (r"[\p{M}\x{374}\x{37e}\x{387}\x{958}-\x{95f}\x{9dc}-\x{9df}\x{a33}-\x{a5e}\x{b5c}\x{b5d}\x{f43}-\x{fb9}\x{2adc}\x{1100}-\x{11ff}\x{1f00}-\x{1fff}\x{2000}\x{2001}\x{2126}\x{212a}\x{212b}\x{2329}\x{232a}\x{f900}-\x{faff}"
          r"\x{fb1d}-\x{fb4e}\x{1d15e}-\x{1d1c0}\x{2f800}-\x{2fa1d}]")
_CLUSTER = r"(?s)(?:[^\p{M}]|^)\p{M}{1,200}"
_PLAIN_PAIR = r"^[\x00-\x7f][\x{300}-\x{33f}\x{346}-\x{36f}]$"  # neither part comes apart, and nothing is to be ordered
_JAMO = r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11a8}-\x{11c2}]?|[\x{ac00}-\x{d7a3}][\x{11a8}-\x{11c2}]"


def compose(text: Column) -> Column:
    """Canonical composition (NFC): letters and the marks behind them become one character where there is one.

    Built-in expressions over tables of Unicode's own data; texts without a mark or
    another character that could change are left after one look.  At most 200 marks
    in a row are ordered.
    """
    tables = _composition()

    def single(name: str, c: Column, kind: str = "string") -> Column:
        return _found(tables[name], c, c, c, kind)

    def pair(letter: Column, mark: Column) -> Column:
        return _found(tables["pairs"], letter, mark, F.concat(letter, mark))

    def characters(t: Column) -> Column:
        return F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))

    def apart(t: Column) -> Column:
        return F.array_join(F.transform(characters(t), lambda c: F.coalesce(single("apart", c), c)), "")

    def cluster(t: Column) -> Column:
        def joined(chars: Column) -> Column:
            ranked = F.transform(chars, lambda c: F.coalesce(single("ranks", c, "int"), F.lit(0)))
            return bind(ranked, lambda ranks: fold(chars, ranks))

        def fold(chars: Column, ranks: Column) -> Column:
            # marks are ordered by rank between characters of rank 0
            places = F.transform(chars, lambda c, i: F.struct(
                F.size(F.filter(F.slice(ranks, F.lit(1), i + 1), lambda r: r == 0)).alias("group"), F.get(ranks, i).alias("rank"), i.alias("at"), c.alias("c")))
            start = F.struct(F.lit("").alias("done"), F.lit("").alias("letter"), F.lit(-1).alias("last"), F.lit("").alias("rest"))

            def step(s: Column, m: Column) -> Column:
                open_ = (s["rest"] == "") | ((s["last"] < m["rank"]) & (m["rank"] > 0))
                made = F.when(open_ & (s["letter"] != ""), pair(s["letter"], m["c"]))
                return (F.when(made.isNotNull(), F.struct(s["done"].alias("done"), made.alias("letter"), s["last"].alias("last"), s["rest"].alias("rest")))
                        .when(m["rank"] == 0, F.struct(F.concat(s["done"], s["letter"], s["rest"]).alias("done"), m["c"].alias("letter"),
                                                       F.lit(-1).alias("last"), F.lit("").alias("rest")))
                        .otherwise(F.struct(s["done"].alias("done"), s["letter"].alias("letter"), m["rank"].alias("last"),
                                            F.concat(s["rest"], m["c"]).alias("rest"))))

            return F.aggregate(F.array_sort(places), start, step, lambda s: F.concat(s["done"], s["letter"], s["rest"]))

        plain = F.coalesce(pair(F.substr(t, F.lit(1), F.lit(1)), F.substr(t, F.lit(2), F.lit(1))), t)
        return F.when(t.rlike(_PLAIN_PAIR), plain).otherwise(bind(characters(apart(t)), joined))

    def syllable(t: Column) -> Column:
        def number(at: int) -> Column:
            return F.conv(F.hex(F.encode(F.substr(t, F.lit(at), F.lit(1)), "UTF-32")), 16, 10).cast("int")

        def last(at: int) -> Column:
            return F.when(F.length(t) >= at, number(at) - 0x11A7).otherwise(F.lit(0))

        whole = F.when(number(1) >= 0xAC00, F.when((number(1) - 0xAC00) % 28 == 0, number(1) + last(2))).otherwise(
            0xAC00 + ((number(1) - 0x1100) * 21 + number(2) - 0x1161) * 28 + last(3))
        return F.coalesce(F.decode(F.unhex(F.lpad(F.hex(whole), 8, "0")), "UTF-32"), t)

    def each(t: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), change)
        return F.array_join(F.zip_with(F.split(t, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    def composed(t: Column) -> Column:
        loose = t.rlike(_HIGH_ANY) & t.rlike(_LOOSE)
        out = F.translate(F.when(loose, t).otherwise(F.lit("")), tables["from"], tables["to"])
        steps = ((f"[{''.join(json.loads(tables['longer']))}]", lambda c: F.try_element_at(F.from_json(F.lit(tables["longer"]), "map<string,string>"), c)), (_CLUSTER, cluster), (_JAMO, syllable))
        return F.when(loose, reduce(lambda c, s: bind(c, lambda o: each(o, *s)), steps, out)).otherwise(t)

    return bind(text, composed)


def straighten(text: Column) -> Column:
    """Curly quotes, ligatures, full-width ASCII, line ends and control characters."""
    def straight(t: Column) -> Column:
        out = F.translate(t, _ODD, _PLAIN)
        out = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), _LIGATURES.items(), out)
        out = F.regexp_replace(out, r"\r\n|[\r\x{85}\x{2028}\x{2029}]", "\n")
        out = F.regexp_replace(out, f"[{_CONTROL}]", "")
        return F.when((t.rlike(_HIGH) | t.rlike(_LOW)) & t.rlike(_CROOKED), out).otherwise(t)

    return bind(text, straight)


def fix_encoding(text: Column) -> Column:
    """References, wrongly read stretches, plain signs, and composed characters, in this order."""
    return compose(straighten(repair_mojibake(decode_entities(text))))


def normalise_mentions(text: Column, brands: Sequence[str] = config.BRAND_HANDLES) -> Column:
    """Brand handles vanish, every other handle becomes ``@USER``."""
    if brands:
        own = "|".join(rf"\Q{b}\E" for b in brands)
        text = F.regexp_replace(text, rf"@(?iu:{own})(?![{WORD}])", "")
    return F.regexp_replace(text, rf"@[{WORD}]+", "@USER")


def normalise_urls(text: Column) -> Column:
    return F.regexp_replace(text, rf"https?://[^{SPACE}]+", "<URL>")


def redact_pii(text: Column) -> Column:
    text = F.regexp_replace(text, EMAIL, "<EMAIL>")
    return F.regexp_replace(text, LONG_NUMBER, "<ID>")


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def clean_text(text: Column, scrub_pii: bool = True, brands: Sequence[str] = config.BRAND_HANDLES,
               repair: bool = True) -> Column:
    """Null becomes the empty text; the order of the steps decides the result."""
    out = F.coalesce(text, F.lit(""))
    if repair:
        out = fix_encoding(out)
    out = normalise_urls(normalise_mentions(out, brands))
    if scrub_pii:
        out = redact_pii(out)
    return collapse_whitespace(out)


def contains_any(text: Column, terms: Sequence[str], whole_word: bool = False) -> Column:
    """True when any term occurs; false for null text and for an empty list."""
    if not terms:
        return F.lit(False)
    hits = [_occurs(text, t, whole_word) for t in terms]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def _occurs(text: Column, term: str, whole_word: bool) -> Column:
    if whole_word:
        return text.rlike(rf"(?<![{WORD}])\Q{term}\E(?![{WORD}])")
    return F.contains(text, F.lit(term))


def has_negative_emoji(raw: Column, emoji: Sequence[str] = config.NEGATIVE_EMOJI) -> Column:
    return contains_any(raw, emoji)


def has_positive_emoji(raw: Column, emoji: Sequence[str] = config.POSITIVE_EMOJI) -> Column:
    return contains_any(raw, emoji)


def mentions_handoff(reply: Column, terms: Sequence[str] = config.HANDOFF_TERMS,
                     whole_word: bool = False) -> Column:
    return contains_any(F.lower(reply), terms, whole_word)


def negative_sentiment(text: Column, terms: Sequence[str] = config.NEGATIVE_LEXICON,
                       emoji: Sequence[str] = config.NEGATIVE_EMOJI, whole_word: bool = False) -> Column:
    return contains_any(text, emoji) | contains_any(F.lower(text), terms, whole_word)


def safety_term(text: Column, terms: Sequence[str] = config.SAFETY_TERMS, whole_word: bool = False) -> Column:
    """The first listed term that occurs, else null."""
    low = F.lower(text)
    return F.coalesce(*[F.when(_occurs(low, t, whole_word), F.lit(t)) for t in terms], F.lit(None).cast("string"))


def not_boilerplate(clean_reply: Column) -> Column:
    """The reply says something besides links."""
    return F.length(collapse_whitespace(F.replace(clean_reply, F.lit("<URL>"), F.lit("")))) > 0


def weak_label(text: Column, rules: Sequence[tuple[str, Sequence[str]]] = config.KEYWORD_RULES,
               default: str = config.DEFAULT_LABEL) -> Column:
    """First rule with a keyword in the text wins."""
    low = F.lower(text)
    label = None
    for name, keywords in rules:
        hit = contains_any(low, keywords)
        label = F.when(hit, F.lit(name)) if label is None else label.when(hit, F.lit(name))
    return F.lit(default) if label is None else label.otherwise(F.lit(default))
