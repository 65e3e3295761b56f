"""Searches over papers by conditions and by weighted words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.operators.ranking import BLOCK, best_by_words, hashed

# Words that no text search looks for, and the weights of title and abstract.
STOPPED = [
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "between", "both", "but", "by", "can", "did", "do", "during", "each", "for", "from", "had", "has", "have",
    "how", "if", "in", "into", "is", "it", "its", "may", "more", "most", "no", "not", "of", "on", "only", "or", "other", "our", "over", "such", "than", "that", "the", "their", "them", "then", "there",
    "these", "they", "this", "those", "through", "to", "under", "up", "was", "we", "were", "what", "when", "where", "which", "while", "who", "why", "will", "with", "would",
]
TITLE_WEIGHT, ABSTRACT_WEIGHT = 0.7, 0.3
#: Units of one in which ranks and scores are added up.
RANK_UNITS, SCORE_UNITS = 10.0, 1_000_000.0


def by_condition(
    papers: DataFrame, authors: DataFrame, keywords: DataFrame, title: str | None = None, year: int | None = None, author: str | None = None, category: str | None = None, keyword_type: str | None = None,
    limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Papers that meet all given conditions, undated ones first, then the newest, then by id.

    ``title`` and ``author`` are parts of a title or a name whatever their case; ``category`` is the whole name of one. Conditions on
    the paper reach the scan, the others are semi-joins. A limit counts after the offset.
    """
    p = papers
    if title is not None:
        p = p.where(F.contains(F.lower("canonical_title"), F.lit(title.lower())))
    if year is not None:
        p = p.where(F.year("online_at") == year)
    if author is not None:
        held = F.exists("authors", lambda x: F.coalesce(F.contains(F.lower(x["name"]), F.lit(author.lower())), F.lit(False)))
        p = p.join(authors.where(held).select("paper_id"), "paper_id", "left_semi")
    if category is not None:
        p = p.join(keywords.where((F.lower("keyword_type") == "category") & (F.lower(F.trim("keyword")) == category.lower())).select("paper_id"), "paper_id", "left_semi")
    if keyword_type is not None:
        p = p.join(keywords.where(F.lower("keyword_type") == keyword_type.lower()).select("paper_id"), "paper_id", "left_semi")
    if limit is not None or offset:
        p = p.orderBy(F.desc_nulls_first("online_at"), F.desc("paper_id")).offset(offset)
        p = p if limit is None else p.limit(limit)
    return p


def search_words(c: Column) -> Column:
    """The words of three letters or more that a search looks for."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 3) & ~w.isin(STOPPED))


def weighted_rank(papers: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, paper_id, rank): the ``k`` best papers by how often they hold a query's words, the title's counting 0.7 and the abstract's 0.3.

    Only papers with a common word meet a query. Ties go to the smallest id.
    """
    texts = papers.select(F.col("paper_id").alias("id"), hashed(search_words(F.col("canonical_title"))).alias("title"), hashed(search_words(F.col("canonical_abstract"))).alias("abstract"))
    words = F.array_distinct(hashed(search_words(F.col("query"))))
    asked = queries.select("query_id", words.alias("words"), F.transform(words, lambda w: F.lit(1.0)).alias("weights"))
    title, abstract = round(TITLE_WEIGHT * RANK_UNITS), round(ABSTRACT_WEIGHT * RANK_UNITS)
    found = best_by_words(texts, asked, k, {"title": title, "abstract": abstract})
    return found.select("query_id", F.col("id").alias("paper_id"), (F.col("units") / RANK_UNITS).alias("rank"))


def okapi_rank(texts: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, paper_id, score): the ``k`` best texts (id, words array<string>) for the words of each query (query_id, words array<string>) by Okapi weights.

    Texts without words do not count. Scores are rounded to six digits, ties go to the smallest id.
    """
    texts = texts.select("id", hashed(F.col("words")).alias("words")).where("size(words) > 0")
    total = texts.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    n, mean = total[0], total[1] or 1.0
    # Texts that have each word; the words of one query come in a fixed order.
    df = texts.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = queries.select("query_id", F.explode(F.array_distinct(hashed(F.col("words")))).alias("word")).join(df, "word")
    asked = asked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("word", (idf * 2.2 * SCORE_UNITS).alias("weight")))).alias("x"))
    asked = asked.select("query_id", F.col("x.word").alias("words"), F.col("x.weight").alias("weights"))
    found = best_by_words(texts, asked, k, {"words": 1}, lambda tf, words: tf / (tf + 1.2 * (0.25 + 0.75 * words / mean)), block)
    return found.select("query_id", F.col("id").alias("paper_id"), (F.col("units") / SCORE_UNITS).alias("score"))
