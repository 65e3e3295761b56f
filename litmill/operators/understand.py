"""Routing of queries: authors, corrected terms, or vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.functions.fuzzy import ratio
from litmill.functions.text import CONNECTORS, TOPIC_WORDS, author_key, author_like, correctable, query_text
from litmill.operators.latest import best_per_key
from litmill.operators.suggest import author_pool, distinct_keywords, search_authors, suggest_terms
from litmill.session import settle

# Thresholds of author matches and of corrections.
AUTHOR_SURE, AUTHOR_LIKELY, AUTHOR_GAP = 0.92, 0.80, 0.03
CORRECT, SUGGEST, SUGGEST_PHRASE = 0.88, 0.75, 0.82
# A query of so many words is corrected phrase by phrase; what falls off the ends of a phrase.
LONG = 5
EDGES = " \t\r\n\"'`“”‘’!?;:()[]{}<>,./"
STOPPED = {*CONNECTORS, "a", "an", "the", "this", "that", "these", "those"}


def author_routes(authors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, author, score, ambiguous) of the best author of each query."""
    top = search_authors(author_pool(authors), queries, 2)
    per = top.groupBy("query_id").agg(F.max_by("name", F.struct("score", "papers")).alias("author"), F.max("score").alias("score"), F.min("score").alias("next"), F.count("*").alias("n"))
    words = F.size(F.split(query_text(F.col("query")), " "))
    out = per.join(queries, "query_id")
    # A name that is not equal counts less in a long query and in one with a topic word.
    topic = F.exists(F.split(author_key(F.col("query")), " "), lambda w: w.isin(TOPIC_WORDS))
    less = F.when(words > 4, 0.7).otherwise(1.0) * F.when(topic, 0.7).otherwise(1.0)
    score = F.when(F.col("score") < 1, F.col("score") * less).otherwise(F.col("score"))
    equal = (F.col("score") == 1) & (words <= 4)
    ambiguous = ~equal & (F.col("n") > 1) & ((words == 1) | (F.col("score") - F.col("next") < AUTHOR_GAP))
    return out.select("query_id", "author", F.round(score, 4).alias("score"), ambiguous.alias("ambiguous"))


def corrections(keywords: DataFrame, queries: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(query_id, suggestion, confidence, applied): the keyword most like the query; an equal one is no correction."""
    asked = queries.where(correctable(F.col("query")))
    close = suggest_terms(keywords, asked.select("query_id", "query"), vocabulary=vocabulary).select("query_id", "display", "keyword_key", "docs").join(asked, "query_id")
    scored = close.withColumn("confidence", F.when(F.lower("query") == F.col("keyword_key"), 1.0).otherwise(F.round(ratio(F.lower("query"), F.col("keyword_key")), 4)))
    best = best_per_key(scored.where(F.col("confidence") >= SUGGEST), ["query_id"], F.struct("confidence", "docs", "keyword_key"), ["display", "confidence"])
    casing = F.lower("query") == F.col("query")
    return best.join(asked, "query_id").select(
        "query_id", F.when(casing, F.lower("display")).otherwise(F.col("display")).alias("suggestion"), "confidence",
        ((F.col("confidence") >= CORRECT) & (F.col("confidence") < 1)).alias("applied"),
    )


def _term(text: str) -> str:
    return " ".join(re.findall(r"[a-z0-9+_-]+", text.lower()))


def spans(query: str, most: int = 5) -> list[tuple[int, int]]:
    """(start, end) of the phrases of a query, in order and without overlap.

    The query is parted at connectors, commas, semicolons and slashes. Where a part has more than ``most``
    words, runs of its words stand for it: from the left, the longer text in place of those that it overlaps.
    """
    found: dict[tuple[int, int], tuple[int, int]] = {}

    def add(start: int, end: int, rank: int) -> None:
        while start < end and query[start] in EDGES:
            start += 1
        while end > start and query[end - 1] in EDGES:
            end -= 1
        term = _term(query[start:end])
        words = term.split()
        if len(term) >= 4 and len(words) <= most and not all(w in STOPPED for w in words):
            found[(start, end)] = min(found.get((start, end), (9, 0)), (rank, start - end))

    at = 0
    for m in re.finditer(r"\s+(?:" + "|".join(sorted(CONNECTORS, key=len, reverse=True)) + r")\s+|[,;/]+", query, re.IGNORECASE):
        add(at, m.start(), 0)
        at = m.end()
    add(at, len(query), 0)
    words = [m.span() for m in re.finditer(r"[A-Za-z0-9][A-Za-z0-9+_/-]*", query)]
    for i in range(len(words)):
        for k in range(i, min(len(words), i + most)):
            add(words[i][0], words[k][1], 1)
    chosen: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda x: (x[0], x[0] - x[1])):
        over = [x for x in chosen if x[0] < b and a < x[1]]
        if not any(found[x] <= found[a, b] for x in over):
            chosen = [x for x in chosen if x not in over] + [(a, b)]
    return sorted(chosen)


def phrases(queries: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, position, phrase, start, end): the phrases of each query, as they are written, and where they stand."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(q, i, t[a:b], a, b) for q, t in zip(df["query_id"], df["query"], strict=True) for i, (a, b) in enumerate(spans(t, most))]
            yield pd.DataFrame(rows, columns=["query_id", "position", "phrase", "start", "end"])

    kind = dict(queries.dtypes)["query_id"]
    return queries.where("query is not null").select("query_id", "query").mapInPandas(run, f"query_id {kind}, position int, phrase string, start int, end int")


def phrase_corrections(keywords: DataFrame, queries: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(query_id, suggestion, confidence, applied) of long queries, and of those with connectors or marks, by their phrases.

    Sure corrections of phrases are put in their places; where there are none, a likely one gives the confidence alone.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower("query"), r"[^a-z0-9+_-]+", " ")), " ")
    long = (F.size(words) >= LONG) | F.col("query").rlike("[,;/]") | F.exists(words, lambda w: w.isin(*CONNECTORS))
    asked = queries.where(long)
    each = phrases(asked).where(~author_like(F.col("phrase")))
    distinct = each.select(F.col("phrase").alias("query")).distinct().withColumn("query_id", F.col("query"))
    fixed = corrections(keywords, settle(distinct), vocabulary).where((F.col("confidence") >= SUGGEST_PHRASE) & (F.col("confidence") < 1))
    hits = each.join(fixed.withColumnRenamed("query_id", "phrase"), "phrase")
    per = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "suggestion", "confidence", "applied"))).alias("hits")).join(asked.select("query_id", "query"), "query_id")
    # The phrases do not overlap, so all sure ones are spliced in, from the left.
    sure = F.filter("hits", lambda h: h["applied"])
    begun = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    spliced = F.aggregate(
        sure, begun,
        lambda x, h: F.struct(F.concat(x["text"], F.substring(F.col("query"), x["at"] + 1, h["start"] - x["at"]), h["suggestion"]).alias("text"), h["end"].alias("at")),
        lambda x: F.concat(x["text"], F.substring(F.col("query"), x["at"] + 1, F.length("query"))),
    )
    some = F.size(sure) > 0
    confidence = F.when(some, F.array_min(F.transform(sure, lambda h: h["confidence"]))).otherwise(F.array_max(F.transform("hits", lambda h: h["confidence"])))
    return per.select("query_id", F.when(some, spliced).alias("suggestion"), confidence.alias("confidence"), some.alias("applied"))


def route(queries: DataFrame, authors: DataFrame, keywords: DataFrame) -> DataFrame:
    """One row per query: its route, author, correction and confidence.

    A sure author by metadata, a likely one as a suggestion, else by vector with the corrected text.
    Blank queries have the route none.
    """
    # Read by every step below, so written once: the queries and the distinct keywords.
    asked = settle(queries.select("query_id", query_text(F.col("query")).alias("query")))
    vocabulary = settle(distinct_keywords(keywords))
    a = author_routes(authors, asked.where(author_like(F.col("query"))))
    by_phrase = settle(phrase_corrections(keywords, asked, vocabulary))
    c = by_phrase.unionByName(corrections(keywords, asked.join(by_phrase, "query_id", "left_anti"), vocabulary))
    j = asked.join(a, "query_id", "left").join(c, "query_id", "left")
    clear = ~F.coalesce("ambiguous", F.lit(False))
    way = (
        F.when(F.coalesce("query", F.lit("")) == "", "none")
        .when((F.col("score") >= AUTHOR_SURE) & clear, "metadata_author")
        .when((F.col("score") >= AUTHOR_LIKELY) & (F.col("score") < AUTHOR_SURE), "author_suggestion")
        .otherwise("vector")
    )
    return j.select(
        "query_id", "query", way.alias("route"), "author", F.col("score").alias("author_score"), "suggestion", F.col("confidence").alias("correction_score"),
        F.when(F.col("applied"), F.col("suggestion")).alias("corrected_query"),
    )


def smart_search(queries: DataFrame, papers: DataFrame, authors: DataFrame, keywords: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, route, paper_id, score): the papers of the author that a query names, newest first, else those nearest to its text, corrected where that is sure.

    ``vectors`` has (id, embedding) of the papers, made as payloads.embed does. Blank queries find nothing.
    """
    from litmill.operators.latest import top_per_key
    from litmill.operators.nearest import nearest
    from litmill.operators.payloads import embed

    routed = settle(route(queries, authors, keywords))
    named = routed.where("route = 'metadata_author'").select("query_id", "route", author_key(F.col("author")).alias("key"))
    written = authors.select("paper_id", F.explode("authors.name").alias("name")).select("paper_id", author_key(F.col("name")).alias("key")).distinct()
    dated = named.join(written, "key").join(papers.select("paper_id", "online_at"), "paper_id")
    by_author = top_per_key(dated, ["query_id"], [F.desc_nulls_last("online_at"), F.desc("paper_id")], k).select("query_id", "route", "paper_id", F.lit(1.0).alias("score"))
    asked = routed.where("route in ('vector', 'author_suggestion')").select(F.col("query_id").cast("long").alias("query_id"), "route", F.coalesce("corrected_query", "query").alias("text"))
    hits = nearest(vectors, embed(asked, "query_id", "text").withColumnRenamed("id", "query_id"), k)
    by_vector = hits.join(asked.select("query_id", "route"), "query_id").select("query_id", "route", F.col("id").alias("paper_id"), "score")
    return by_author.unionByName(by_vector)
