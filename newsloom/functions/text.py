"""Text expressions: the Unicode tokenizer, the searchable text of an article, word counts and markup stripping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def tokenize(c: Column) -> Column:
    """Lower-case Unicode words, in order; null gives null, no word an empty array."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def article_text(title: Column, abstract: Column) -> Column:
    """Title and abstract with a space between; a null part is empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit("")))


def word_count(c: Column) -> Column:
    """Words by white space; 0 for null and blank."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+")))


def plain_words(c: Column, stopwords: list[str]) -> Column:
    """Lower-case words without markup, entities, digits and punctuation, of at least two letters and no stop word."""
    t = F.lower(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"&#?\w+;", " ")
    words = F.split(F.trim(F.regexp_replace(t, r"[^\p{L}]+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(stopwords) if stopwords else F.length(w) > 1)
