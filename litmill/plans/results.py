"""Payloads, display rows, embedding from text, ranked text search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.operators.latest import top_per_key
from litmill.operators.nearest import nearest
from litmill.operators.payloads import embed, fan_out, notice, result_rows
from litmill.operators.search import okapi_rank, search_words
from litmill.plans.records import _many_sql
from litmill.plans.retrieval import _SEARCHED, understand_queries
from litmill.session import table
from litmill.sources import adapters


def payload_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table that the raw records of both kinds give."""
    out = None
    for kind, records in (("citation", adapters.from_citations(table(spark, d, "citation_records"))), ("preprint", adapters.from_preprints(table(spark, d, "preprint_records")))):
        for name, df in fan_out(records).items():
            part = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("table_name"), "n")
            out = part if out is None else out.unionByName(part)
    return out


_LISTED = lambda k, comma: _many_sql(k, comma)
PAYLOAD_SQL = f"""
WITH c AS (SELECT CAST(len(list_filter({_LISTED("citation_keywords", True)}, lambda x: trim(x) <> '')) AS BIGINT) AS k, CAST(len(list_filter({_LISTED("citation_reference", False)}, lambda x: trim(x) <> '')) AS BIGINT) AS r
    FROM citation_records WHERE trim(coalesce(meta['citation_title'][1], '')) <> ''),
  p AS (SELECT CASE WHEN coalesce(trim(category), '') <> '' THEN 1 ELSE 0 END AS k FROM preprint_records WHERE coalesce(trim(title), '') <> ''),
  n AS (SELECT 'citation' AS kind, (SELECT count(*) FROM c) AS n UNION ALL SELECT 'preprint', (SELECT count(*) FROM p))
SELECT kind, t AS table_name, n FROM n, (VALUES ('papers'), ('paper_sources'), ('paper_source_metadata'), ('paper_author_affiliation')) x(t)
UNION ALL SELECT 'citation', 'paper_keywords', CAST(coalesce(sum(k), 0) AS BIGINT) FROM c UNION ALL SELECT 'citation', 'paper_references', CAST(coalesce(sum(r), 0) AS BIGINT) FROM c
UNION ALL SELECT 'preprint', 'paper_keywords', CAST(coalesce(sum(k), 0) AS BIGINT) FROM p UNION ALL SELECT 'preprint', 'paper_references', CAST(0 AS BIGINT)"""


def payload_references(spark: SparkSession, d: str) -> DataFrame:
    r = fan_out(adapters.from_citations(table(spark, d, "citation_records")))["paper_references"]
    return r.select("record_id", F.col("reference_order").cast("long").alias("reference_order"), "reference_raw")


REFERENCES_SQL = r"""
WITH m AS (SELECT record_id, meta['citation_reference'] AS xs FROM citation_records WHERE trim(coalesce(meta['citation_title'][1], '')) <> ''),
  s AS (SELECT record_id, CASE WHEN len(xs) = 1 AND xs[1] LIKE '%;%' THEN list_filter(list_transform(string_split(xs[1], ';'), lambda x: trim(x)), lambda x: x <> '')
    ELSE list_filter(list_transform(xs, lambda x: trim(x)), lambda x: x <> '') END AS xs FROM m),
  e AS (SELECT record_id, unnest(range(1, len(xs) + 1)) AS reference_order, unnest(xs) AS r FROM s)
SELECT record_id, CAST(reference_order AS BIGINT) AS reference_order, trim(regexp_replace(r, '[\s\x{00A0}\x{3000}]+', ' ', 'g')) AS reference_raw FROM e"""


def display_rows(spark: SparkSession, d: str) -> DataFrame:
    """The vector hits of query rows as papers of the same number."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), "embedding")
    hits = nearest(e, e.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 10).select("query_id", F.col("id").cast("int").alias("paper_id"), "score")
    return result_rows(hits, table(spark, d, "papers"), table(spark, d, "paper_sources"), table(spark, d, "paper_author_affiliation"))


DISPLAY_SQL = """
WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
  s AS (SELECT q.id AS query_id, e.id, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM e q, e WHERE q.id % 50 = 0),
  h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s) WHERE k <= 10),
  f AS (SELECT paper_id, arg_min(struct_pack(source_name := source_name, link := coalesce(source_url, abstract_url, pdf_url)), paper_source_id) AS first_source,
    arg_min(doi, paper_source_id) FILTER (doi IS NOT NULL) AS first_doi FROM paper_sources GROUP BY 1),
  a AS (SELECT paper_id, array_to_string(list_filter(list_transform(authors, lambda x: x.name), lambda x: x IS NOT NULL), ', ') AS authors FROM paper_author_affiliation)
SELECT query_id, p.paper_id, CASE WHEN trim(canonical_title) <> '' THEN canonical_title END AS title, authors,
  CASE WHEN c.paper_source_id IS NOT NULL THEN c.source_name ELSE first_source.source_name END AS source_name,
  CASE WHEN c.paper_source_id IS NOT NULL THEN coalesce(c.source_url, c.abstract_url, c.pdf_url) ELSE first_source.link END AS link,
  coalesce(c.doi, first_doi) AS doi, strftime(p.online_at, '%Y-%m-%d') AS day, round(score, 4) AS similarity
FROM h JOIN papers p ON p.paper_id = h.id LEFT JOIN paper_sources c ON p.canonical_source_id = c.paper_source_id LEFT JOIN f ON p.paper_id = f.paper_id LEFT JOIN a ON p.paper_id = a.paper_id"""


def text_vector_search(spark: SparkSession, d: str) -> DataFrame:
    """Papers like every fiftieth paper, by hashed vectors of title and abstract; itself left out."""
    text = F.concat_ws("\n", "canonical_title", "canonical_abstract")
    v = embed(table(spark, d, "papers").select("paper_id", text.alias("text")), "paper_id", "text")
    q = v.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    return top_per_key(nearest(v, q, 6).where("query_id <> id"), ["query_id"], [F.desc("score"), F.asc("id")], 5)


def query_notices(spark: SparkSession, d: str) -> DataFrame:
    return notice(understand_queries(spark, d)).select("query_id", "route", "action", "message")


def ranked_text_search(spark: SparkSession, d: str) -> DataFrame:
    """Okapi ranking of titles for the words of every fiftieth paper's title, stop words left out, so only papers with a common word meet a query."""
    p = table(spark, d, "papers").select(F.col("paper_id").alias("id"), search_words(F.col("canonical_title")).alias("words"))
    return okapi_rank(p, p.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 10)


_WORDS = _SEARCHED("canonical_title")
OKAPI_SQL = f"""
WITH p AS (SELECT paper_id, {_WORDS} AS w FROM papers WHERE canonical_title IS NOT NULL AND len({_WORDS}) > 0),
  x AS (SELECT paper_id, len(w) AS l, unnest(w) AS word FROM p), tf AS (SELECT paper_id, word, count(*) AS tf, any_value(l) AS l FROM x GROUP BY 1, 2),
  d AS (SELECT word, count(*) AS df FROM tf GROUP BY 1), t AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM p),
  q AS (SELECT DISTINCT paper_id AS query_id, word FROM x WHERE paper_id % 50 = 0),
  h AS (SELECT query_id, tf.paper_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score
    FROM q JOIN d ON q.word = d.word JOIN tf ON q.word = tf.word, t GROUP BY 1, 2)
SELECT query_id, paper_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS k FROM h) WHERE k <= 10"""

QUERIES = {
    "payload_counts": payload_counts, "payload_references": payload_references, "display_rows": display_rows, "text_vector_search": text_vector_search,
    "query_notices": query_notices, "ranked_text_search": ranked_text_search,
}
SQL = {"payload_counts": PAYLOAD_SQL, "payload_references": REFERENCES_SQL, "display_rows": DISPLAY_SQL, "ranked_text_search": OKAPI_SQL}
