"""Similarity by sets of three-letter grams, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(c: Column) -> Column:
    """Distinct grams of the words of a text, each word with two blanks before and one behind it."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    grams = F.transform(
        words,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Common grams over all grams; 0 without grams."""
    x, y = trigrams(a), trigrams(b)
    common = F.size(F.array_intersect(x, y))
    every = F.size(x) + F.size(y) - common
    return F.when(every > 0, common / every).otherwise(0.0)


def word_similarity(word: Column, text: Column) -> Column:
    """The share of a word's grams found in one word of the text, at best."""
    x = trigrams(word)
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    best = F.array_max(F.transform(words, lambda w: F.size(F.array_intersect(x, trigrams(w))) / F.greatest(F.size(x), F.lit(1))))
    return F.coalesce(best, F.lit(0.0))
