"""Searches, suggestions, hydration and recommendations. Query sets are the rows whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions.text import filled
from litmill.functions.trigram import similarity
from litmill.operators import nearest as nn
from litmill.operators.latest import top_per_key
from litmill.operators.search import STOPPED, by_condition, weighted_rank
from litmill.operators.suggest import by_token, by_trigram, distinct_keywords, suggest_terms
from litmill.operators.highlight import highlight_plan, marked
from litmill.operators.understand import corrections, phrases, route
from litmill.session import settle, table


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), "label", "embedding")
    return e, e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")


_SCORES = """
e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.id AS query_id, e.id, e.label, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e q, e WHERE q.id % 50 = 0)"""


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    return nn.nearest(v, q, 10)


DENSE_SQL = f"""WITH {_SCORES} SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s) WHERE k <= 10"""


def dense_topk_per_source(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    return nn.nearest(v, q, 3, group="label")


PER_SOURCE_SQL = f"""WITH {_SCORES} SELECT query_id, id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS k FROM s) WHERE k <= 3"""


def prioritised_search(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    hits = nn.nearest(v, q, 10, group="label")
    return nn.prioritised(hits, {3: 0, 7: 1}, 20).select("query_id", "id", "label", "score", F.col("priority").cast("int").alias("priority"))


PRIORITY_SQL = f"""
WITH {_SCORES}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS k FROM s) WHERE k <= 10),
  p AS (SELECT *, CASE label WHEN 3 THEN 0 WHEN 7 THEN 1 ELSE 2 END AS priority FROM h)
SELECT query_id, id, label, score, CAST(priority AS INTEGER) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority, score DESC, id) AS r FROM p) WHERE r <= 20"""


def recommend_similar(spark: SparkSession, d: str) -> DataFrame:
    """Five neighbours of each query row, itself left out."""
    v, q = _vectors(spark, d)
    return top_per_key(nn.nearest(v, q, 6).where("query_id <> id"), ["query_id"], [F.desc("score"), F.asc("id")], 5)


RECOMMEND_SQL = f"""
WITH {_SCORES} SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s WHERE query_id <> id) WHERE k <= 5"""


def min_score_search(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    return nn.nearest(v, q, 50).where("score >= 0.2").select("query_id", "id", F.round("score", 4).alias("score"))


MIN_SCORE_SQL = f"""
WITH {_SCORES} SELECT query_id, id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s) WHERE k <= 50 AND score >= 0.2"""


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Vector hits joined with rows of the query's own label as keyword hits.

    Rows that only the label finds score alike and rank by id, so of each label's rows the smallest ids that vector
    hits could crowd out suffice for the exact result; they are taken once per label, not per query.
    """
    v, q = _vectors(spark, d)
    k = 10
    labels = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("l"))
    low = top_per_key(v.select("id", F.col("label").alias("l")), ["l"], [F.asc("id")], 2 * k)
    hits = settle(nn.nearest(v, q, k))
    named = hits.join(v.select("id", F.col("label").alias("l")), "id").join(labels, ["query_id", "l"], "left_semi").select("query_id", "id")
    return nn.hybrid(hits, labels.join(low, "l").select("query_id", "id").unionByName(named), k).select("query_id", "id", "vector_score", "keyword_score", "score")


HYBRID_SQL = f"""
WITH {_SCORES}, v AS (SELECT query_id, id, score AS vector_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s) WHERE k <= 10),
  w AS (SELECT query_id, id FROM (SELECT q.id AS query_id, e.id, row_number() OVER (PARTITION BY q.id ORDER BY e.id) AS k FROM e q JOIN e ON q.label = e.label WHERE q.id % 50 = 0)),
  j AS (SELECT coalesce(v.query_id, w.query_id) AS query_id, coalesce(v.id, w.id) AS id, coalesce(vector_score, 0.0) AS vector_score, CASE WHEN w.id IS NULL THEN CAST(0.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS keyword_score
    FROM v FULL OUTER JOIN w ON v.query_id = w.query_id AND v.id = w.id),
  f AS (SELECT *, round(0.5 * vector_score + 0.5 * keyword_score, 6) AS score FROM j)
SELECT query_id, id, CAST(vector_score AS DOUBLE) AS vector_score, keyword_score, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM f) WHERE k <= 10"""


def search_by_condition(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty papers of a year with a word in the title, an author's name and a keyword of a type (the limit is the search's)."""
    p = by_condition(table(spark, d, "papers"), table(spark, d, "paper_author_affiliation"), table(spark, d, "paper_keywords"), title="switch", author="a", keyword_type="concept", limit=50)
    return p.select("paper_id", "canonical_title", F.date_format("online_at", "yyyy-MM-dd").alias("day"))


CONDITION_SQL = """
SELECT paper_id, canonical_title, strftime(online_at, '%Y-%m-%d') AS day FROM papers p WHERE contains(lower(canonical_title), 'switch')
  AND EXISTS (SELECT 1 FROM paper_author_affiliation a WHERE a.paper_id = p.paper_id AND len(list_filter(a.authors, lambda x: coalesce(contains(lower(x.name), 'a'), false))) > 0)
  AND EXISTS (SELECT 1 FROM paper_keywords k WHERE k.paper_id = p.paper_id AND lower(k.keyword_type) = 'concept') ORDER BY online_at DESC NULLS FIRST, paper_id DESC LIMIT 50"""


def search_category_year(spark: SparkSession, d: str) -> DataFrame:
    """All papers of a category and a year."""
    p = by_condition(table(spark, d, "papers"), table(spark, d, "paper_author_affiliation"), table(spark, d, "paper_keywords"), year=2020, category="neuroscience")
    return p.select("paper_id", F.date_format("online_at", "yyyy-MM-dd").alias("day"))


CATEGORY_YEAR_SQL = """
SELECT paper_id, strftime(online_at, '%Y-%m-%d') AS day FROM papers p WHERE year(online_at) = 2020
  AND EXISTS (SELECT 1 FROM paper_keywords k WHERE k.paper_id = p.paper_id AND lower(k.keyword_type) = 'category' AND lower(trim(k.keyword)) = 'neuroscience')"""


def search_by_author(spark: SparkSession, d: str) -> DataFrame:
    """Papers with an author whose name holds a text, newest first (the limit is the search's)."""
    a = table(spark, d, "paper_author_affiliation").where(F.exists("authors", lambda x: F.coalesce(x["name"].ilike("%maria%"), F.lit(False)))).select("paper_id")
    s = table(spark, d, "paper_sources").groupBy("paper_id").agg(F.max("online_at").alias("seen"))
    p = table(spark, d, "papers").join(a, "paper_id", "left_semi").join(s, "paper_id")
    out = p.select("paper_id", "canonical_title", F.coalesce("online_at", "seen").alias("seen_at"))
    return out.orderBy(F.desc_nulls_last("seen_at"), F.desc("paper_id")).limit(50)


AUTHOR_SQL = """
WITH s AS (SELECT paper_id, max(online_at) AS seen FROM paper_sources GROUP BY 1)
SELECT p.paper_id, p.canonical_title, coalesce(p.online_at, s.seen) AS seen_at FROM papers p JOIN s ON p.paper_id = s.paper_id
WHERE p.paper_id IN (SELECT paper_id FROM paper_author_affiliation WHERE len(list_filter(authors, lambda x: coalesce(x.name ILIKE '%maria%', false))) > 0)
ORDER BY seen_at DESC NULLS LAST, p.paper_id DESC LIMIT 50"""


def _titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of every fiftieth paper as queries."""
    p = table(spark, d, "papers").where("paper_id % 50 = 0 and trim(canonical_title) <> ''")
    return p.select(F.col("paper_id").alias("query_id"), F.trim("canonical_title").alias("query"))


_Q_SQL = "q AS (SELECT paper_id AS query_id, trim(canonical_title) AS query FROM papers WHERE paper_id % 50 = 0 AND trim(canonical_title) <> '')"
_V_SQL = "v AS (SELECT DISTINCT lower(trim(keyword)) AS keyword_key FROM paper_keywords WHERE trim(keyword) <> '')"


def suggest_by_token(spark: SparkSession, d: str) -> DataFrame:
    return by_token(distinct_keywords(table(spark, d, "paper_keywords")), _titles(spark, d))


TOKEN_SQL = f"""
WITH {_Q_SQL}, {_V_SQL}, w AS (SELECT query_id, regexp_extract_all(lower(query), '[a-z0-9][a-z0-9+_\\-]*') AS xs FROM q),
  u AS (SELECT query_id, unnest(xs) AS token, unnest(range(0, len(xs))) AS i FROM w),
  t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(token) DESC, i) AS k FROM u WHERE length(token) >= 3) WHERE k <= 3)
SELECT query_id, keyword_key, CAST(max(CASE WHEN contains(keyword_key, token) THEN 4.0 ELSE 2.0 END) AS DOUBLE) AS score FROM t JOIN v
  ON contains(keyword_key, token) OR (length(token) >= 5 AND contains(keyword_key, token[1:4])) GROUP BY 1, 2"""

_GRAMS = lambda c: f"list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def suggest_by_trigram(spark: SparkSession, d: str) -> DataFrame:
    out = by_trigram(distinct_keywords(table(spark, d, "paper_keywords")), _titles(spark, d), 0.2)
    return out.withColumn("score", F.round("score", 6))


TRIGRAM_SQL = f"""
WITH {_Q_SQL}, {_V_SQL}, a AS (SELECT query_id, {_GRAMS("query")} AS g FROM q), b AS (SELECT keyword_key, {_GRAMS("keyword_key")} AS h FROM v),
  c AS (SELECT query_id, keyword_key, len(list_intersect(g, h)) AS n, len(g) AS x, len(h) AS y FROM a, b)
SELECT query_id, keyword_key, round(n / (x + y - n), 6) AS score FROM c WHERE n > 0 AND n / (x + y - n) >= 0.2"""


def suggest_terms_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The best keywords of each title by both ways: score, papers, average weight, spelling."""
    out = suggest_terms(table(spark, d, "paper_keywords"), _titles(spark, d))
    return out.select("query_id", "keyword_key", "score", "docs")


RANKED_SQL = f"""
WITH {_Q_SQL}, k AS (SELECT lower(trim(keyword)) AS keyword_key, keyword_type, source, paper_id, max(coalesce(CAST(weight AS DOUBLE), 1.0)) AS w FROM paper_keywords WHERE trim(keyword) <> '' GROUP BY 1, 2, 3, 4),
  v AS (SELECT keyword_key, count(*) AS docs, round(avg(w), 6) AS avg_weight FROM k GROUP BY 1), w AS (SELECT query_id, regexp_extract_all(lower(query), '[a-z0-9][a-z0-9+_\\-]*') AS xs FROM q),
  u AS (SELECT query_id, unnest(xs) AS token, unnest(range(0, len(xs))) AS i FROM w),
  t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(token) DESC, i) AS k FROM u WHERE length(token) >= 3) WHERE k <= 3),
  a AS (SELECT query_id, {_GRAMS("query")} AS g FROM q), b AS (SELECT keyword_key, {_GRAMS("keyword_key")} AS h FROM v),
  c AS (SELECT query_id, keyword_key, len(list_intersect(g, h)) AS n, len(g) AS x, len(h) AS y FROM a, b),
  f AS (SELECT query_id, keyword_key, CASE WHEN contains(keyword_key, token) THEN 4.0 ELSE 2.0 END AS score FROM t JOIN v ON contains(keyword_key, token) OR (length(token) >= 5 AND contains(keyword_key, token[1:4]))
    UNION ALL SELECT query_id, keyword_key, n / (x + y - n) FROM c WHERE n > 0 AND n / (x + y - n) >= 0.35),
  s AS (SELECT query_id, keyword_key, CAST(round(max(score), 6) AS DOUBLE) AS score FROM f GROUP BY 1, 2)
SELECT query_id, keyword_key, score, docs FROM (SELECT s.*, docs, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, docs DESC, avg_weight DESC, keyword_key) AS k FROM s JOIN v USING (keyword_key)) WHERE k <= 20"""


def trigram_similarity(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").where("canonical_title is not null and canonical_publisher is not null")
    return p.select("paper_id", F.round(similarity(F.col("canonical_title"), F.col("canonical_publisher")), 6).alias("score"))


SIMILARITY_SQL = f"""
WITH a AS (SELECT paper_id, {_GRAMS("canonical_title")} AS g, {_GRAMS("canonical_publisher")} AS h FROM papers WHERE canonical_title IS NOT NULL AND canonical_publisher IS NOT NULL),
  c AS (SELECT paper_id, len(list_intersect(g, h)) AS n, len(g) AS x, len(h) AS y FROM a)
SELECT paper_id, CASE WHEN x + y - n > 0 THEN round(n / (x + y - n), 6) ELSE 0.0 END AS score FROM c"""


def asked_queries(spark: SparkSession, d: str) -> DataFrame:
    """Author names and titles of every fiftieth paper as queries."""
    names = table(spark, d, "paper_author_affiliation").where("paper_id % 50 = 0").select((F.col("paper_id") + 1_000_000_000).cast("int").alias("query_id"), F.get("authors", F.lit(0))["name"].alias("query"))
    return _titles(spark, d).unionByName(names.where("query is not null"))


def understand_queries(spark: SparkSession, d: str) -> DataFrame:
    """Author names and titles of every fiftieth paper, routed."""
    return route(asked_queries(spark, d), table(spark, d, "paper_author_affiliation"), table(spark, d, "paper_keywords"))


def query_phrases(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").where("paper_id % 50 = 0 and trim(canonical_title) <> ''").select(F.col("paper_id").alias("query_id"), F.col("canonical_title").alias("query"))
    return phrases(p).select("query_id", F.col("position").cast("int").alias("position"), "phrase")


def highlight_terms(spark: SparkSession, d: str) -> DataFrame:
    """What to mark in the hits of each title query, and the query's own title and abstract with it marked."""
    asked, keywords = _titles(spark, d), table(spark, d, "paper_keywords")
    routed = route(asked, table(spark, d, "paper_author_affiliation"), keywords)
    plan = highlight_plan(routed, suggest_terms(keywords, asked).select("query_id", F.col("display").alias("keyword")))
    p = table(spark, d, "papers").select(F.col("paper_id").alias("query_id"), "canonical_title", "canonical_abstract")
    mark = lambda c: F.when(F.array_contains("fields", c[10:]), marked(F.col(c), F.col("terms"))).otherwise(F.col(c))
    return plan.join(p, "query_id").select("query_id", "mode", F.array_join("terms", "|").alias("terms"), mark("canonical_title").alias("title"), mark("canonical_abstract").alias("abstract"))


def hydrate_papers(spark: SparkSession, d: str) -> DataFrame:
    """One row per paper with its children, each reduced to one row before the join; lists are flattened to texts."""
    s = table(spark, d, "paper_sources").groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paper_source_id", "source_name"))), lambda x: x["source_name"]), "|").alias("sources"))
    k = table(spark, d, "paper_keywords").where("trim(keyword) <> ''").groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("keyword")))), "|").alias("keywords"))
    a = table(spark, d, "paper_author_affiliation").select("paper_id", F.array_join(F.transform("authors", lambda x: x["name"]), "|").alias("authors"))
    p = table(spark, d, "papers").select("paper_id", filled(F.col("canonical_title")).alias("title"))
    return p.join(s, "paper_id", "left").join(k, "paper_id", "left").join(a, "paper_id", "left")


HYDRATE_SQL = """
WITH s AS (SELECT paper_id, string_agg(source_name, '|' ORDER BY paper_source_id) AS sources FROM paper_sources GROUP BY 1),
  k AS (SELECT paper_id, string_agg(DISTINCT lower(trim(keyword)), '|' ORDER BY lower(trim(keyword))) AS keywords FROM paper_keywords WHERE trim(keyword) <> '' GROUP BY 1),
  a AS (SELECT paper_id, array_to_string(list_filter(list_transform(authors, lambda x: x.name), lambda x: x IS NOT NULL), '|') AS authors FROM paper_author_affiliation)
SELECT p.paper_id, CASE WHEN trim(canonical_title) <> '' THEN canonical_title END AS title, sources, keywords, authors
FROM papers p LEFT JOIN s ON p.paper_id = s.paper_id LEFT JOIN k ON p.paper_id = k.paper_id LEFT JOIN a ON p.paper_id = a.paper_id"""


def text_rank(spark: SparkSession, d: str) -> DataFrame:
    """The ten papers with the best weighted count of each title query's words."""
    return weighted_rank(table(spark, d, "papers"), _titles(spark, d), 10)


_STOPPED_SQL = ", ".join(f"'{w}'" for w in STOPPED)
_SEARCHED = lambda c: rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOPPED_SQL}))"
RANK_SQL = f"""
WITH {_Q_SQL}, e AS (SELECT paper_id, unnest({_SEARCHED("canonical_title")}) AS word, 0.7 AS w FROM papers WHERE canonical_title IS NOT NULL
    UNION ALL SELECT paper_id, unnest({_SEARCHED("canonical_abstract")}), 0.3 FROM papers WHERE canonical_abstract IS NOT NULL),
  i AS (SELECT word, paper_id, sum(w) AS w FROM e GROUP BY 1, 2), a AS (SELECT DISTINCT query_id, word FROM (SELECT query_id, unnest({_SEARCHED("query")}) AS word FROM q)),
  h AS (SELECT query_id, paper_id, CAST(round(sum(w), 4) AS DOUBLE) AS rank FROM a JOIN i ON a.word = i.word GROUP BY 1, 2)
SELECT query_id, paper_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, paper_id) AS k FROM h) WHERE k <= 10"""

QUERIES = {
    "dense_topk": dense_topk, "dense_topk_per_source": dense_topk_per_source, "prioritised_search": prioritised_search, "recommend_similar": recommend_similar,
    "min_score_search": min_score_search, "hybrid_search": hybrid_search, "search_by_condition": search_by_condition, "search_category_year": search_category_year, "search_by_author": search_by_author,
    "suggest_by_token": suggest_by_token, "suggest_by_trigram": suggest_by_trigram, "suggest_terms_ranked": suggest_terms_ranked, "trigram_similarity": trigram_similarity,
    "understand_queries": understand_queries, "query_phrases": query_phrases, "highlight_terms": highlight_terms, "hydrate_papers": hydrate_papers, "text_rank": text_rank,
}
SQL = {
    "dense_topk": DENSE_SQL, "dense_topk_per_source": PER_SOURCE_SQL, "prioritised_search": PRIORITY_SQL, "recommend_similar": RECOMMEND_SQL, "min_score_search": MIN_SCORE_SQL,
    "hybrid_search": HYBRID_SQL, "search_by_condition": CONDITION_SQL, "search_category_year": CATEGORY_YEAR_SQL, "search_by_author": AUTHOR_SQL, "suggest_by_token": TOKEN_SQL, "suggest_by_trigram": TRIGRAM_SQL,
    "suggest_terms_ranked": RANKED_SQL, "trigram_similarity": SIMILARITY_SQL, "hydrate_papers": HYDRATE_SQL, "text_rank": RANK_SQL,
}
