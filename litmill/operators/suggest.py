"""Keyword and author suggestions for queries, for whole batches of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions.text import author_key
from litmill.functions.trigram import trigrams

# Scores of the ways in which a keyword is found.
TOKEN, PREFIX = 4.0, 2.0


def distinct_keywords(keywords: DataFrame) -> DataFrame:
    """(keyword_key, keyword_type, source, display, docs, avg_weight, max_weight): two levels of aggregation.

    First per paper, so that a paper that repeats a keyword counts once, then per keyword.
    """
    k = keywords.where("trim(keyword) <> ''").withColumn("keyword_key", F.lower(F.trim("keyword"))).withColumn("w", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)))
    per_paper = k.groupBy("keyword_key", "keyword_type", "source", "paper_id").agg(F.min("keyword").alias("display"), F.max("w").alias("w"))
    return per_paper.groupBy("keyword_key", "keyword_type", "source").agg(
        F.min("display").alias("display"), F.count("*").alias("docs"), F.avg("w").alias("avg_weight"), F.max("w").alias("max_weight")
    )


def query_tokens(q: Column) -> Column:
    """The three longest words of three letters or more; earlier ones first among equals."""
    words = F.filter(F.regexp_extract_all(F.lower(q), F.lit("[a-z0-9][a-z0-9+_\\-]*"), F.lit(0)), lambda w: F.length(w) >= 3)
    tagged = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(tagged), 1, 3), lambda t: t["w"])


def by_token(vocabulary: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, keyword_key, score): keywords that hold a token, or its first four letters, of a query.

    Both sides go through the four-letter pieces they hold, so a join key replaces the scan of all
    keywords per query; tokens of three letters go through three-letter pieces.
    """
    pieces = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))
    words = vocabulary.select("keyword_key").distinct()
    held = words.select("keyword_key", F.explode(F.array_union(pieces(F.col("keyword_key"), 3), pieces(F.col("keyword_key"), 4))).alias("piece"))
    token = queries.select("query_id", F.explode(query_tokens(F.col("query"))).alias("token"))
    token = token.withColumn("piece", F.substring("token", 1, 4))
    hit = token.join(held, "piece")
    score = F.when(F.contains("keyword_key", "token"), TOKEN).when(F.length("token") >= 5, PREFIX)
    return hit.withColumn("score", score).where("score is not null").groupBy("query_id", "keyword_key").agg(F.max("score").alias("score"))


def _rarest_first(sets: DataFrame, key: str, frequency: DataFrame) -> DataFrame:
    """(key, g): each set's grams, rarest in the vocabulary first, then by spelling."""
    each = sets.select(key, F.explode("g").alias("gram")).join(frequency, "gram", "left")
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))), lambda x: x["gram"]).alias("g"))


def by_trigram(vocabulary: DataFrame, queries: DataFrame, least: float = 0.35) -> DataFrame:
    """(query_id, keyword_key, score): keywords that share ``least`` of all grams with a query.

    Two sets that are that alike share a gram among the rarest of each, all but ``least`` of them and one more, so
    only these are joined and the pairs compared whole: common grams, which most sets have, join nothing.
    """
    words = vocabulary.select("keyword_key").distinct().withColumn("g", trigrams(F.col("keyword_key"))).where("size(g) > 0")
    asked = queries.select("query_id", trigrams(F.col("query")).alias("g")).where("size(g) > 0")
    frequency = words.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    first = lambda c: F.explode(F.slice(c, 1, F.size(c) - F.ceil(F.size(c) * least - 1e-9).cast("int") + 1)).alias("gram")
    w = _rarest_first(words, "keyword_key", frequency).withColumnRenamed("g", "h")
    a = _rarest_first(asked, "query_id", frequency)
    near = a.select("query_id", "g", first("g")).join(w.select("keyword_key", "h", first("h")), "gram").dropDuplicates(["query_id", "keyword_key"])
    common = F.size(F.array_intersect("g", "h"))
    score = common / (F.size("g") + F.size("h") - common)
    return near.select("query_id", "keyword_key", score.alias("score")).where(F.col("score") >= least)


def suggest_terms(keywords: DataFrame, queries: DataFrame, limit: int = 20, vocabulary: DataFrame | None = None) -> DataFrame:
    """The best keywords of each query: by score, then papers, average weight and spelling. ``vocabulary`` is that of distinct_keywords, if it is at hand."""
    from litmill.operators.latest import top_per_key

    vocabulary = distinct_keywords(keywords) if vocabulary is None else vocabulary
    found = by_token(vocabulary, queries).unionByName(by_trigram(vocabulary, queries)).groupBy("query_id", "keyword_key").agg(F.max("score").alias("score"))
    per_key = vocabulary.groupBy("keyword_key").agg(
        F.min("display").alias("display"), F.sum("docs").alias("docs"), F.round(F.sum(F.col("avg_weight") * F.col("docs")) / F.sum("docs"), 6).alias("avg_weight")
    )
    ranked = found.join(per_key, "keyword_key").withColumn("score", F.round("score", 6))
    return top_per_key(ranked, ["query_id"], [F.desc("score"), F.desc("docs"), F.desc("avg_weight"), F.asc("keyword_key")], limit)


def author_pool(authors: DataFrame) -> DataFrame:
    """(author_key, name, papers): papers per name, names that differ by case, commas or full stops being one."""
    each = authors.select("paper_id", F.explode("authors.name").alias("name")).where("trim(name) <> ''").withColumn("author_key", author_key(F.col("name")))
    return each.groupBy("author_key").agg(F.min("name").alias("name"), F.count_distinct("paper_id").alias("papers"))


def search_authors(pool: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """The best authors of each query by how alike the names are; only names that share a word with the query are scored."""
    from litmill.functions.fuzzy import author_score
    from litmill.operators.latest import top_per_key

    words = lambda c: F.filter(F.split(author_key(c), " "), lambda w: F.length(w) >= 2)
    asked = queries.select("query_id", "query", F.explode(F.array_distinct(words(F.col("query")))).alias("word"))
    known = pool.select("author_key", "name", "papers", F.explode(F.array_distinct(words(F.col("name")))).alias("word"))
    pairs = asked.join(known, "word").select("query_id", "query", "author_key", "name", "papers").distinct()
    scored = pairs.withColumn("score", F.round(author_score(F.col("query"), F.col("name")), 4))
    return top_per_key(scored, ["query_id"], [F.desc("score"), F.desc("papers"), F.asc("name")], limit)
