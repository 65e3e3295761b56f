"""Daily operation: intake, generated keywords, queues, feeds, statistics of stock and index, whole papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.operators import queue
from litmill.operators.keywords import upsert_generated
from litmill.operators.latest import top_per_key
from litmill.operators.nearest import nearest
from litmill.operators.payloads import embed, full_papers
from litmill.operators.pipeline import route, transform, transform_stats
from litmill.operators.understand import smart_search
from litmill.plans.retrieval import asked_queries
from litmill.session import table


def _raw(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    p = table(spark, d, "preprint_records")
    return {"preprint_history": p, "citation": table(spark, d, "citation_records"), "arxiv": p.select("record_id")}


def intake_stats(spark: SparkSession, d: str) -> DataFrame:
    """Raw records of all sources turned into normalised ones: how many could be read. One source has no adapter."""
    return transform_stats(transform(_raw(spark, d)))


INTAKE_SQL = """
WITH r AS (SELECT 'preprint_history' AS source_name, coalesce(trim(title), '') <> '' AS ok FROM preprint_records
  UNION ALL SELECT 'citation', coalesce(trim(meta['citation_title'][1]), '') <> '' FROM citation_records UNION ALL SELECT 'arxiv', false FROM preprint_records)
SELECT source_name, count(*) AS total, CAST(count(*) FILTER (ok) AS BIGINT) AS successful, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS failed, round(100.0 * count(*) FILTER (ok) / count(*), 2) AS success_rate FROM r GROUP BY 1"""


def route_sources(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "paper_sources").select("source_name")
    return route(s, known=["harbour_history", "harbour_daily", "tidepool"]).groupBy("adapter", "error").agg(F.count("*").alias("n"))


ROUTE_SQL = """
SELECT CASE WHEN source_name IN ('harbour_history', 'harbour_daily', 'tidepool') THEN source_name END AS adapter,
  CASE WHEN source_name NOT IN ('harbour_history', 'harbour_daily', 'tidepool') OR source_name IS NULL THEN 'unsupported source: ' || coalesce(source_name, 'none') END AS error, count(*) AS n FROM paper_sources GROUP BY 1, 2"""


def _generated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = table(spark, d, "paper_keywords")
    place = F.struct(F.col("created_at").isNull().alias("late"), "created_at", "keyword", "keyword_type", F.col("weight").cast("double").alias("weight"))
    new = k.where("source = 'keyword_match'").select("paper_id", place.alias("position"), "keyword_type", "keyword", "weight")
    stored = k.where("source <> 'keyword_match'").select("paper_id", "keyword_type", "keyword", "weight", "source")
    return upsert_generated(stored, new, table(spark, d, "papers"), "entity_model", ["concept", "gene", "method", "task"])


def generated_keyword_counts(spark: SparkSession, d: str) -> DataFrame:
    """The keywords of one model stored as those of another: what became of them, paper by paper."""
    return _generated(spark, d)[1]


GENERATED_SQL = r"""
WITH g AS (SELECT k.paper_id, coalesce(trim(keyword_type), '') AS t, coalesce(trim(regexp_replace(keyword, '[\s\x{00A0}\x{3000}]+', ' ', 'g')), '') AS w, p.paper_id IS NOT NULL AS there
    FROM paper_keywords k LEFT JOIN (SELECT DISTINCT paper_id FROM papers) p ON k.paper_id = p.paper_id WHERE source = 'keyword_match'),
  o AS (SELECT DISTINCT paper_id, lower(t) AS t, lower(w) AS w FROM g WHERE there AND t <> '' AND w <> '' AND t IN ('concept', 'gene', 'method', 'task')),
  s AS (SELECT DISTINCT paper_id, lower(keyword_type) AS t, lower(keyword) AS w FROM paper_keywords WHERE lower(source) = 'entity_model'),
  m AS (SELECT o.paper_id, count(*) FILTER (s.paper_id IS NULL) AS inserted, count(*) FILTER (s.paper_id IS NOT NULL) AS updated FROM o LEFT JOIN s ON o.paper_id = s.paper_id AND o.t = s.t AND o.w = s.w GROUP BY 1)
SELECT g.paper_id, CAST(coalesce(any_value(inserted), 0) AS BIGINT) AS inserted, CAST(coalesce(any_value(updated), 0) AS BIGINT) AS updated, CAST(count(*) - coalesce(any_value(inserted), 0) - coalesce(any_value(updated), 0) AS BIGINT) AS skipped,
  CAST(count(*) FILTER (there AND t <> '' AND w <> '' AND t NOT IN ('concept', 'gene', 'method', 'task')) AS BIGINT) AS unknown_types, max(CASE WHEN NOT there THEN 'paper does not exist' END) AS error
FROM g LEFT JOIN m ON g.paper_id = m.paper_id GROUP BY 1"""


def generated_keywords(spark: SparkSession, d: str) -> DataFrame:
    """All keywords after that, by type and source."""
    return _generated(spark, d)[0].groupBy(F.lower("keyword_type").alias("keyword_type"), "source").agg(F.count("*").alias("n"))


def backfill_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Papers without keywords of a model, each with its newest source record: the latest date, then the largest id."""
    from litmill.operators.latest import best_per_key

    p = queue.missing_sources(table(spark, d, "papers").where("canonical_title is not null"), table(spark, d, "paper_keywords"), ["entity_model"]).select("paper_id")
    date = F.coalesce("online_at", "submitted_at", "published_at")
    best = best_per_key(table(spark, d, "paper_sources").join(p, "paper_id", "left_semi"), ["paper_id"], F.struct(date.isNotNull(), date, "paper_source_id"), ["source_name", "paper_source_id"])
    return best


CANDIDATES_SQL = """
SELECT paper_id, source_name, paper_source_id FROM (SELECT s.*, row_number() OVER (PARTITION BY s.paper_id ORDER BY coalesce(s.online_at, s.submitted_at, s.published_at) DESC NULLS LAST, paper_source_id DESC) AS k
  FROM paper_sources s JOIN papers p ON s.paper_id = p.paper_id WHERE p.canonical_title IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM paper_keywords w WHERE w.paper_id = p.paper_id AND w.source = 'entity_model')) WHERE k = 1"""


def backfill_targets(spark: SparkSession, d: str) -> DataFrame:
    """Source and year of every run of a backfill, in their order: sources by name, years from the newest."""
    s = table(spark, d, "paper_sources").where("online_at is not null").groupBy("source_name", F.year("online_at").alias("year")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return s.withColumn("run", F.row_number().over(Window.partitionBy("source_name").orderBy(F.desc("year"))))


TARGETS_SQL = """
SELECT source_name, CAST(year AS INTEGER) AS year, n, CAST(row_number() OVER (PARTITION BY source_name ORDER BY year DESC) AS INTEGER) AS run
FROM (SELECT source_name, year(online_at) AS year, count(*) AS n FROM paper_sources WHERE online_at IS NOT NULL GROUP BY 1, 2)"""


def _status(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "paper_sources")
    state = F.when(F.col("sync_status") == "active", "succeeded").when(F.col("sync_status") == "error", "failed").otherwise("pending")
    return s.select("paper_source_id", "source_name", state.alias("status"), F.lit(1).alias("attempt_count"), F.col("updated_at"))


def queue_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of twenty of what may be tried again of some sources, the longest untouched first (page and size are the feature)."""
    return queue.candidates(_status(spark, d), sources=["harbour_history", "medindex"], page=1, size=20, key="paper_source_id").select("paper_source_id", "status")


PAGE_SQL = """
SELECT paper_source_id, CASE WHEN sync_status = 'error' THEN 'failed' ELSE 'pending' END AS status FROM paper_sources
WHERE (sync_status IS NULL OR sync_status <> 'active') AND source_name IN ('harbour_history', 'medindex') ORDER BY updated_at NULLS FIRST, paper_source_id LIMIT 20 OFFSET 20"""


def failure_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Failed events by type and the first 120 letters of what they say."""
    e = table(spark, d, "events").where("event_type not in ('click', 'view')")
    return e.groupBy("event_type", F.substring("props", 1, 120).alias("bucket")).agg(F.count("*").alias("n"))


BUCKETS_SQL = "SELECT event_type, substring(props, 1, 120) AS bucket, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1, 2"


def pending_range(spark: SparkSession, d: str) -> DataFrame:
    """The smallest and largest number and the count of papers without a vector."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("paper_id"))
    left = table(spark, d, "papers").select(F.col("paper_id").cast("long").alias("paper_id")).join(v, "paper_id", "left_anti")
    return left.agg(F.min("paper_id").alias("low"), F.max("paper_id").alias("high"), F.count("*").alias("n"))


PENDING_SQL = "SELECT CAST(min(paper_id) AS BIGINT) AS low, CAST(max(paper_id) AS BIGINT) AS high, count(*) AS n FROM papers WHERE paper_id NOT IN (SELECT vec_id FROM embeddings)"


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers")
    return p.agg(F.count("*").alias("papers"), F.count_distinct(F.when(F.trim("work_id") != "", F.col("work_id"))).alias("works"), F.sum(F.col("canonical_source_id").isNotNull().cast("long")).alias("with_canonical"))


CORPUS_SQL = "SELECT count(*) AS papers, count(DISTINCT work_id) FILTER (trim(work_id) <> '') AS works, CAST(count(*) FILTER (canonical_source_id IS NOT NULL) AS BIGINT) AS with_canonical FROM papers"


def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    """Documents and indexed vectors of every collection (label), with each one's share of all."""
    e = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("documents"), F.sum((F.coalesce(F.size("embedding"), F.lit(0)) > 0).cast("long")).alias("indexed"))
    all_ = e.agg(F.sum("documents").alias("total"))
    n = all_.first()[0] or 0  # one number
    return e.withColumn("percent", F.round(F.try_divide(100.0 * F.col("documents"), F.lit(n)), 2))


COLLECTION_SQL = "SELECT label, count(*) AS documents, CAST(count(*) FILTER (len(embedding) > 0) AS BIGINT) AS indexed, round(100.0 * count(*) / (SELECT count(*) FROM embeddings), 2) AS percent FROM embeddings GROUP BY 1"


def daily_window(spark: SparkSession, d: str) -> DataFrame:
    """Papers that came online in a window of days, some sources only: both filters reach the scan."""
    s = table(spark, d, "paper_sources").where(F.col("source_name").isin("harbour_history", "tidepool")).select("paper_id")
    p = table(spark, d, "papers").where((F.col("online_at") >= F.lit("2020-01-01").cast("timestamp_ntz")) & (F.col("online_at") < F.lit("2020-07-01").cast("timestamp_ntz")))
    return p.join(s, "paper_id", "left_semi").select("paper_id", F.date_format("online_at", "yyyy-MM-dd").alias("day"))


WINDOW_SQL = """
SELECT paper_id, strftime(online_at, '%Y-%m-%d') AS day FROM papers p WHERE online_at >= TIMESTAMP '2020-01-01' AND online_at < TIMESTAMP '2020-07-01'
  AND EXISTS (SELECT 1 FROM paper_sources s WHERE s.paper_id = p.paper_id AND s.source_name IN ('harbour_history', 'tidepool'))"""


def export_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Active source records by the ranges of a thousand papers in which they are exported."""
    s = table(spark, d, "paper_sources").where("sync_status = 'active'")
    return s.groupBy(F.floor(F.col("paper_id") / 1000).alias("part")).agg(F.count("*").alias("n"), F.min("paper_id").alias("low"), F.max("paper_id").alias("high"))


RANGES_SQL = "SELECT CAST(floor(paper_id / 1000) AS BIGINT) AS part, count(*) AS n, min(paper_id) AS low, max(paper_id) AS high FROM paper_sources WHERE sync_status = 'active' GROUP BY 1"


def published_years(spark: SparkSession, d: str) -> DataFrame:
    """Papers by the year that published_at begins with, in the order in which facets are shown: newest first, unknown last."""
    year = F.nullif(F.regexp_extract(F.trim("published_at"), r"^\d{4}", 0), F.lit(""))
    per = table(spark, d, "papers").groupBy(F.coalesce(year, F.lit("Unknown")).alias("year")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    # One row a year.
    return per.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("year").try_cast("int").desc_nulls_last())))


YEARS_SQL = r"""
WITH y AS (SELECT coalesce(nullif(regexp_extract(trim(published_at), '^\d{4}'), ''), 'Unknown') AS year, count(*) AS n FROM papers GROUP BY 1)
SELECT year, n, CAST(row_number() OVER (ORDER BY try_cast(year AS INTEGER) DESC NULLS LAST) AS INTEGER) AS place FROM y"""


def author_pool_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Names that hold a word of a query, by how many of the query's words they hold and whether they start with them."""
    a = table(spark, d, "paper_author_affiliation").select("paper_id", F.explode("authors.name").alias("name")).where("trim(name) <> ''")
    low = F.lower("name")
    matched = F.contains(low, F.lit("maria")).cast("int") + F.contains(low, F.lit("lene")).cast("int")
    priority = F.when(F.startswith(low, F.lit("maria")), 2).when(F.contains(low, F.lit("maria")), 1).otherwise(0)
    per = a.select("paper_id", "name", matched.alias("tokens"), priority.alias("priority")).where("tokens > 0").groupBy("name").agg(F.count_distinct("paper_id").alias("papers"), F.max("tokens").alias("tokens"), F.max("priority").alias("priority"))
    return per.select("name", "papers", "tokens", "priority")


TOKENS_SQL = """
WITH a AS (SELECT paper_id, unnest(list_transform(authors, lambda x: x.name)) AS name FROM paper_author_affiliation),
  m AS (SELECT paper_id, name, CAST(contains(lower(name), 'maria') AS INTEGER) + CAST(contains(lower(name), 'lene') AS INTEGER) AS tokens,
    CASE WHEN starts_with(lower(name), 'maria') THEN 2 WHEN contains(lower(name), 'maria') THEN 1 ELSE 0 END AS priority FROM a WHERE trim(name) <> '')
SELECT name, count(DISTINCT paper_id) AS papers, max(tokens) AS tokens, max(priority) AS priority FROM m WHERE tokens > 0 GROUP BY 1"""


def whole_papers(spark: SparkSession, d: str) -> DataFrame:
    """Every paper with its sources, authors and keywords as nested lists, told by what they begin and end with."""
    f = full_papers(table(spark, d, "papers"), table(spark, d, "paper_sources"), table(spark, d, "paper_author_affiliation"), table(spark, d, "paper_keywords"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return f.select(
        "paper_id", n("sources").alias("n_sources"), F.get("sources", F.lit(0))["paper_source_id"].alias("first_source"), n("authors").alias("n_authors"),
        n("keywords").alias("n_keywords"), F.get("keywords", F.lit(0))["keyword"].alias("first_keyword"), F.element_at("keywords", F.when(F.size("keywords") > 0, -1))["keyword"].alias("last_keyword"),
    )


WHOLE_SQL = """
WITH s AS (SELECT paper_id, count(*) AS n, arg_min(paper_source_id, struct_pack(a := online_at IS NOT NULL, b := -epoch_us(coalesce(online_at, TIMESTAMP '1970-01-01')), c := paper_source_id)) AS first_source FROM paper_sources GROUP BY 1),
  k AS (SELECT paper_id, count(*) AS n, arg_min(keyword, struct_pack(a := keyword_type, b := keyword)) AS first_keyword, arg_max(keyword, struct_pack(a := keyword_type, b := keyword)) AS last_keyword FROM paper_keywords GROUP BY 1)
SELECT p.paper_id, coalesce(s.n, 0) AS n_sources, first_source, CAST(coalesce(len(a.authors), 0) AS BIGINT) AS n_authors, coalesce(k.n, 0) AS n_keywords, first_keyword, last_keyword
FROM papers p LEFT JOIN s ON p.paper_id = s.paper_id LEFT JOIN paper_author_affiliation a ON p.paper_id = a.paper_id LEFT JOIN k ON p.paper_id = k.paper_id"""


def smart_searches(spark: SparkSession, d: str) -> DataFrame:
    """Titles and names asked as queries: by author where they name one, else by vector with the corrected text."""
    papers, authors = table(spark, d, "papers"), table(spark, d, "paper_author_affiliation")
    vectors = embed(papers.select("paper_id", F.concat_ws("\n", "canonical_title", "canonical_abstract").alias("text")), "paper_id", "text")
    return smart_search(asked_queries(spark, d), papers, authors, table(spark, d, "paper_keywords"), vectors, 10)


QUERIES = {
    "intake_stats": intake_stats, "route_sources": route_sources, "generated_keyword_counts": generated_keyword_counts, "generated_keywords": generated_keywords, "backfill_candidates": backfill_candidates,
    "backfill_targets": backfill_targets, "queue_page": queue_page, "failure_buckets": failure_buckets, "pending_range": pending_range, "corpus_stats": corpus_stats, "collection_stats": collection_stats,
    "daily_window": daily_window, "export_ranges": export_ranges, "published_years": published_years, "author_pool_tokens": author_pool_tokens, "whole_papers": whole_papers, "smart_searches": smart_searches,
}
SQL = {
    "intake_stats": INTAKE_SQL, "route_sources": ROUTE_SQL, "generated_keyword_counts": GENERATED_SQL, "backfill_candidates": CANDIDATES_SQL, "backfill_targets": TARGETS_SQL, "queue_page": PAGE_SQL,
    "failure_buckets": BUCKETS_SQL, "pending_range": PENDING_SQL, "corpus_stats": CORPUS_SQL, "collection_stats": COLLECTION_SQL, "daily_window": WINDOW_SQL, "export_ranges": RANGES_SQL,
    "published_years": YEARS_SQL, "author_pool_tokens": TOKENS_SQL, "whole_papers": WHOLE_SQL,
}
