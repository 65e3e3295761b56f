"""Text and name normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language names to codes, words that are no keywords, topic words, connectors of phrases, punctuation at the edges of queries.
LANGUAGES = {"english": "en", "chinese": "zh", "中文": "zh", "英文": "en"}
GENERIC_KEYWORDS = ["study", "analysis", "result", "results", "paper", "research", "method", "methods", "data", "approach"]
TOPIC_WORDS = [
    "learning", "model", "models", "gene", "protein", "cell", "cells", "disease", "cancer", "algorithm", "algorithms",
    "analysis", "using", "with", "for", "in", "therapy", "genomics",
]
CONNECTORS = ["and", "or", "for", "with", "in", "using", "via", "by", "of", "on", "to", "from"]
EDGE = "[\\s\"'`“”‘’!?;:()\\[\\]{}<>]"


def collapse(c: Column) -> Column:
    """Blanks of any kind become one blank; outer ones fall away."""
    return F.trim(F.regexp_replace(c, r"[\s\x{00A0}\x{3000}]+", " "))


def filled(c: Column) -> Column:
    """The value, or null where it is blank."""
    return F.when(F.trim(c) != "", c)


def language(c: Column, default: str = "en") -> Column:
    """The code of a language's name, other values in lower case; the default for a missing or empty one."""
    low = F.lower(F.trim(c))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(F.coalesce(F.try_element_at(known, low), low))


def term(c: Column) -> Column:
    """Lower-case letters, digits, plus, underscore and dash; all else parts words."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9+_\-]+", " "))


def author_key(c: Column) -> Column:
    """Lower-case name with commas and full stops as blanks."""
    return collapse(F.translate(F.lower(c), ",.", "  "))


def query_text(c: Column) -> Column:
    """A query without punctuation at its edges."""
    return collapse(F.regexp_replace(c, f"^{EDGE}+|{EDGE}+$", ""))


def correctable(c: Column) -> Column:
    """Whether a query is long enough to correct and has a letter."""
    t = term(c)
    return (F.length(t) >= 4) & t.rlike("[a-z]")


def author_like(c: Column) -> Column:
    """Two to four capitalised words of letters, none of them a topic word."""
    words = F.split(collapse(c), " ")
    plain = F.forall(words, lambda w: w.rlike(r"^[A-Z][A-Za-z'.\-]*$") & ~F.lower(w).isin(TOPIC_WORDS))
    return F.size(words).between(2, 4) & plain


def usable_keyword(c: Column) -> Column:
    t = F.lower(collapse(c))
    return F.length(t).between(2, 200) & ~t.isin(GENERIC_KEYWORDS)


def parts(c: Column, pattern: str) -> Column:
    """Non-empty trimmed parts of a separated list; an empty array for null."""
    return F.coalesce(F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def renumber(authors: Column) -> Column:
    """Authors in their order, numbered from one, with collapsed names and without blank affiliations."""
    kept = F.filter(authors, lambda a: F.coalesce(collapse(a["name"]), F.lit("")) != "")
    return F.transform(
        kept,
        lambda a, i: F.struct(
            (i + 1).alias("sequence"),
            collapse(a["name"]).alias("name"),
            F.coalesce(F.filter(F.transform(a["affiliations"], collapse), lambda x: x != ""), F.array().cast("array<string>")).alias("affiliations"),
        ),
    )
