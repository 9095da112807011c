"""Analysis chains as Column expressions: everything stays in the JVM, row by row, without a shuffle."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}]+"
#: The usual short list of English stop words.
STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def tokens(text: Column) -> Column:
    """Lower-case words of a text; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def without_stop_words(words: Column, stop: list[str] | None = None) -> Column:
    listed = F.array(*[F.lit(w) for w in (STOP if stop is None else stop)])
    return F.filter(words, lambda w: ~F.array_contains(listed, w))


def shingles(words: Column, n: int = 2) -> Column:
    """Successive n words joined by a space; empty for fewer than n words."""
    at = F.sequence(F.lit(1), F.size(words) - (n - 1))
    joined = F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))


def edge_ngrams(words: Column, least: int = 1, most: int = 3) -> Column:
    """Beginnings of each word with ``least`` to ``most`` characters; shorter words give what they have."""
    lengths = F.array(*[F.lit(i) for i in range(least, most + 1)])
    return F.flatten(F.transform(words, lambda w: F.transform(F.filter(lengths, lambda n: n <= F.length(w)), lambda n: F.substring(w, F.lit(1), n))))


def word_parts(text: Column) -> Column:
    """Word-delimiter analysis: splits at case changes and between letters and digits."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\p{Lu}?\p{Ll}+|\p{Lu}+(?!\p{Ll})|\p{N}+|\p{Lo}+"), F.lit(0)), F.lower)


def positions(words: Column, term: str | list[str]) -> Column:
    """0-based positions of a term, or of any of several."""
    hit = (lambda w: w.isin(*term)) if isinstance(term, (list, tuple)) else (lambda w: w == term)
    return F.filter(F.transform(words, lambda w, i: F.when(hit(w), i)), lambda p: p.isNotNull())


def frequency(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def base36(n: Column, width: int = 6) -> Column:
    """Zero-padded lower-case base 36."""
    return F.lpad(F.lower(F.conv(n.cast("string"), 10, 36)), width, "0")


def from_base36(text: Column) -> Column:
    return F.conv(text, 36, 10).cast("long")


def unescape(text: Column) -> Column:
    """All named and numbered character entities; a text without an ampersand is not looked at."""

    @F.pandas_udf("string")
    def read(column: pd.Series) -> pd.Series:
        return column.map(html.unescape, na_action="ignore")

    return F.when(F.contains(text, F.lit("&")), read(F.when(F.contains(text, F.lit("&")), text))).otherwise(text)


def plain_text(page: Column) -> Column:
    """Text of a page: scripts, styles and comments dropped, tags to spaces, entities read, space squeezed."""
    text = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.btrim(F.regexp_replace(unescape(F.regexp_replace(text, r"(?s)<[^>]*>", " ")), "[\\s\u00a0]+", " "))


def wiki_text(markup: Column, depth: int = 4) -> Column:
    """Text of wiki markup: templates and tables dropped from the inside out (to ``depth``), links by their label."""
    text = F.regexp_replace(markup, r"(?s)<!--.*?-->|<ref\b[^>]*/>|<ref\b.*?</ref>", "")
    for _ in range(depth):
        text = F.regexp_replace(text, r"(?s)\{\{[^{}]*\}\}|\{\|[^{}]*\|\}", "")
    text = F.regexp_replace(text, r"\[\[(?:File|Image|Category):[^\[\]]*\]\]", "")
    text = F.regexp_replace(text, r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1")
    text = F.regexp_replace(text, r"\[https?://\S+ ?([^\]]*)\]", "$1")
    text = F.regexp_replace(text, r"'{2,}|(?m)^=+\s*|\s*=+$", "")
    return plain_text(text)
