"""What to mark in the results of a query, and the marking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions.fuzzy import ratio
from litmill.functions.text import CONNECTORS, query_text, term

# Most terms that are marked, letters that a word of a term has at least, how like the query a keyword must be.
MOST_TERMS, LEAST_LETTERS, ALIKE = 12, 3, 0.90
STOPPED = [*CONNECTORS, "a", "an", "the", "this", "that", "these", "those"]


def words_of(c: Column) -> Column:
    """The words of a term that may be marked by themselves."""
    return F.filter(F.split(term(query_text(c)), " "), lambda w: (F.length(w) >= LEAST_LETTERS) & ~w.isin(STOPPED))


def highlight_plan(routed: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, mode, fields, terms) of routed queries (operators.understand.route).

    A sure author is marked among the authors. Other queries mark, in title and abstract, their correction and the
    keywords (query_id, keyword) like them, each whole and by its words; without either, the query's own words. Terms that differ only
    by case or marks count once; the longest come first, MOST_TERMS at most. Blank queries mark nothing.
    """
    close = candidates.join(routed.select("query_id", "query"), "query_id")
    close = close.where(ratio(term(F.col("query")), term(F.col("keyword"))) >= ALIKE).groupBy("query_id").agg(F.array_sort(F.collect_set("keyword")).alias("near"))
    none = F.array().cast("array<string>")
    spread = lambda xs: F.flatten(F.transform(xs, lambda x: F.concat(F.array(x), words_of(x))))
    fixed = F.when(F.col("corrected_query").isNotNull(), F.array("corrected_query")).when(F.col("suggestion").isNotNull(), F.array("suggestion")).otherwise(none)
    found = spread(F.concat(fixed, F.coalesce("near", none)))
    own = F.when(F.size(found) > 0, found).otherwise(words_of(F.coalesce("corrected_query", "query")))
    # One of those that are the same term: the first in the list.
    tagged = F.filter(F.transform(own, lambda x: F.struct(term(x).alias("key"), query_text(x).alias("text"))), lambda x: (x["key"] != "") & (x["text"] != ""))
    once = F.filter(tagged, lambda x, i: F.array_position(F.transform(tagged, lambda y: y["key"]), x["key"]) == i + 1)
    ordered = F.transform(F.array_sort(F.transform(once, lambda x: F.struct((-F.length(x["text"])).alias("n"), F.lower(x["text"]).alias("low"), x["text"].alias("text")))), lambda x: x["text"])
    author = F.col("route") == "metadata_author"
    terms = F.when(author, F.array(query_text(F.col("author")))).when(F.col("route") == "vector", F.slice(ordered, 1, MOST_TERMS)).otherwise(none)
    j = routed.join(close, "query_id", "left").withColumn("terms", terms)
    mode = F.when(author, "author_name").when((F.col("route") == "vector") & (F.size("terms") > 0), "keyword").otherwise("none")
    fields = F.when(author, F.array(F.lit("authors"))).when(F.col("route") == "vector", F.array(F.lit("title"), F.lit("abstract"))).otherwise(none)
    return j.select("query_id", mode.alias("mode"), fields.alias("fields"), "terms")


def marked(text: Column, terms: Column) -> Column:
    """The text with its terms between mark tags, whatever their case; the longest term wins where several start."""
    escaped = F.transform(terms, lambda t: F.concat(F.lit("\\Q"), F.regexp_replace(t, r"\\E", ""), F.lit("\\E")))
    pattern = F.concat(F.lit("(?i)("), F.array_join(escaped, "|"), F.lit(")"))
    return F.when(F.size(terms) > 0, F.regexp_replace(text, pattern, F.lit("<mark>$1</mark>"))).otherwise(text)
