"""Tokens, n-grams and per-text term counts; all inside the row, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselight.functions.text import WORD, bind

TOKEN = rf"[{WORD}]{{2,}}"


def tokenize(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def drop_stop_words(tokens: Column, stop_words: Sequence[str]) -> Column:
    if not stop_words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(*stop_words))


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by one blank."""
    rest = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), rest), F.slice(tokens, F.lit(2), rest),
                      lambda a, b: F.concat(a, F.lit(" "), b))


def kept_tokens(text: Column, stop_words: Sequence[str] = (), ngrams: int = 2) -> Column:
    """The tokens of which ``terms`` are made."""
    if ngrams not in (1, 2):
        raise ValueError("ngrams must be 1 or 2")
    return drop_stop_words(tokenize(text), stop_words)


def terms(text: Column, stop_words: Sequence[str] = (), ngrams: int = 2) -> Column:
    """Unigrams, and bigrams when ``ngrams`` is 2; stop words go before bigrams are formed."""
    tokens = kept_tokens(text, stop_words, ngrams)
    return tokens if ngrams == 1 else bind(tokens, lambda t: F.concat(t, bigrams(t)))


def term_counts(term_array: Column) -> Column:
    """``array<struct<term,tf>>`` from an array of terms.

    Sorting the array and reading off the run lengths counts inside the row, so a
    corpus-wide (document, term) grouping never has to be shuffled.
    """
    def counted(ordered: Column) -> Column:
        size = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(1), F.greatest(size, F.lit(1))),
            lambda i: (size > 0) & ((i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2))))
        return bind(starts, lambda at: F.transform(at, lambda p, i: F.struct(
            F.get(ordered, p - 1).alias("term"),
            (F.coalesce(F.get(at, i + 1), size + 1) - p).alias("tf"))))

    return bind(F.sort_array(term_array), counted)
