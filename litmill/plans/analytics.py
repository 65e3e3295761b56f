"""Operational statistics, choices of one row per key, keyword aggregation, facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.operators.keywords import count_entities
from litmill.operators.latest import best_per_key, canonical_sources, merge_keywords, top_per_key
from litmill.session import table

_HAS = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""


def completeness(spark: SparkSession, d: str) -> DataFrame:
    """One pass over papers; sources are reduced to one row per paper first."""
    s = table(spark, d, "paper_sources").groupBy("paper_id").agg(F.max(_HAS("pdf_url").cast("int")).alias("pdf"), F.count("*").alias("n"))
    a = table(spark, d, "paper_author_affiliation").select("paper_id", F.lit(1).alias("authored"))
    p = table(spark, d, "papers").join(s, "paper_id", "left").join(a, "paper_id", "left")
    n = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    out = p.agg(
        F.count("*").alias("papers"), n(_HAS("canonical_title")).alias("with_title"), n(_HAS("canonical_abstract")).alias("with_abstract"),
        n(F.col("n").isNotNull()).alias("with_source"), n(F.col("pdf") == 1).alias("with_pdf"), n(F.col("authored").isNotNull()).alias("with_authors"), F.sum("n").alias("source_rows"),
    )
    share = lambda c: F.round(100.0 * F.try_divide(F.col(c), F.col("papers")), 2)
    return out.select(
        "papers", "with_title", "with_abstract", "with_source", "with_pdf", "with_authors", share("with_title").alias("title_percent"),
        share("with_abstract").alias("abstract_percent"), F.round(F.try_divide(F.col("source_rows"), F.col("with_source")), 4).alias("sources_per_paper"),
    )


COMPLETENESS_SQL = """
WITH s AS (SELECT paper_id, max(CASE WHEN coalesce(trim(pdf_url), '') <> '' THEN 1 ELSE 0 END) AS pdf, count(*) AS n FROM paper_sources GROUP BY 1),
  o AS (SELECT count(*) AS papers, count(*) FILTER (coalesce(trim(canonical_title), '') <> '') AS with_title, count(*) FILTER (coalesce(trim(canonical_abstract), '') <> '') AS with_abstract,
    count(s.n) AS with_source, count(*) FILTER (s.pdf = 1) AS with_pdf, count(a.paper_id) AS with_authors, sum(s.n) AS source_rows
    FROM papers p LEFT JOIN s ON p.paper_id = s.paper_id LEFT JOIN paper_author_affiliation a ON p.paper_id = a.paper_id)
SELECT papers, with_title, with_abstract, with_source, with_pdf, with_authors, round(100.0 * with_title / papers, 2) AS title_percent,
  round(100.0 * with_abstract / papers, 2) AS abstract_percent, round(source_rows / with_source, 4) AS sources_per_paper FROM o"""


def sources_by_name(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "paper_sources").groupBy("source_name").agg(
        F.count("*").alias("n"), F.count_distinct("paper_id").alias("papers"), F.sum(_HAS("pdf_url").cast("long")).alias("with_pdf"), F.max("online_at").alias("latest")
    )
    return s


BY_NAME_SQL = """
SELECT source_name, count(*) AS n, count(DISTINCT paper_id) AS papers, CAST(count(*) FILTER (coalesce(trim(pdf_url), '') <> '') AS BIGINT) AS with_pdf, max(online_at) AS latest
FROM paper_sources GROUP BY 1"""


def papers_by_year(spark: SparkSession, d: str) -> DataFrame:
    """The ten newest years (the limit is the report's)."""
    y = table(spark, d, "papers").where("online_at is not null").groupBy(F.year("online_at").cast("long").alias("year")).agg(F.count("*").alias("n"))
    return y.orderBy(F.desc("year")).limit(10)


BY_YEAR_SQL = "SELECT CAST(year(online_at) AS BIGINT) AS year, count(*) AS n FROM papers WHERE online_at IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 10"


def facets(spark: SparkSession, d: str) -> DataFrame:
    """Counts by source, and by year within source, in one pass; unknown years are a value of their own."""
    s = table(spark, d, "paper_sources").select(F.coalesce("source_name", F.lit("unknown")).alias("source"), F.coalesce(F.year("online_at").cast("string"), F.lit("Unknown")).alias("year"))
    return s.groupingSets([["source", "year"], ["source"]], "source", "year").agg(F.count("*").alias("n"), F.grouping("year").cast("long").alias("all_years"))


FACETS_SQL = """
WITH s AS (SELECT coalesce(source_name, 'unknown') AS source, coalesce(CAST(year(online_at) AS VARCHAR), 'Unknown') AS year FROM paper_sources)
SELECT source, year, count(*) AS n, CAST(grouping(year) AS BIGINT) AS all_years FROM s GROUP BY GROUPING SETS ((source, year), (source))"""


def canonical_by_online_at(spark: SparkSession, d: str) -> DataFrame:
    return canonical_sources(table(spark, d, "paper_sources"))


CANONICAL_SQL = """
SELECT paper_id, paper_source_id AS canonical_source_id FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY online_at DESC, paper_source_id DESC) AS k
  FROM paper_sources WHERE online_at IS NOT NULL) WHERE k = 1"""


def canonical_join(spark: SparkSession, d: str) -> DataFrame:
    p, s = table(spark, d, "papers"), table(spark, d, "paper_sources")
    j = p.join(s, p.canonical_source_id == s.paper_source_id).select(
        p.paper_id, s.source_name, s.version, (p.canonical_publisher == s.publisher).alias("same_publisher"), F.coalesce(s.source_url, s.abstract_url, s.pdf_url).alias("link")
    )
    return j


CANONICAL_JOIN_SQL = """
SELECT p.paper_id, s.source_name, s.version, p.canonical_publisher = s.publisher AS same_publisher, coalesce(s.source_url, s.abstract_url, s.pdf_url) AS link
FROM papers p JOIN paper_sources s ON p.canonical_source_id = s.paper_source_id"""


def daily_feed(spark: SparkSession, d: str, limit: int = 20) -> DataFrame:
    """The papers that came online last, with their newest source and authors; the feed has one to twenty of them."""
    limit = max(1, min(20, limit))
    s = table(spark, d, "paper_sources").withColumn("undated", F.col("online_at").isNull())
    newest = best_per_key(s, ["paper_id"], F.struct(~F.col("undated"), "online_at", "paper_source_id"), ["source_name", "paper_source_id"])
    p = table(spark, d, "papers").select("paper_id", "canonical_title", "online_at")
    # Only the feed's papers meet their sources.
    top = p.orderBy(F.desc_nulls_last("online_at"), F.desc("paper_id")).limit(limit)
    a = table(spark, d, "paper_author_affiliation").select("paper_id", F.array_join(F.transform("authors", lambda x: x["name"]), ", ").alias("authors"))
    return top.join(newest, "paper_id", "left").join(a, "paper_id", "left").select("authors", "paper_id", "canonical_title", F.date_format("online_at", "yyyy-MM-dd").alias("day"), "source_name", "paper_source_id")


FEED_SQL = """
WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY online_at DESC NULLS LAST, paper_source_id DESC) AS k FROM paper_sources) WHERE k = 1),
  t AS (SELECT paper_id, canonical_title, online_at FROM papers ORDER BY online_at DESC NULLS LAST, paper_id DESC LIMIT 20)
SELECT t.paper_id, t.canonical_title, strftime(t.online_at, '%Y-%m-%d') AS day, n.source_name, n.paper_source_id,
  array_to_string(list_filter(list_transform(a.authors, lambda x: x.name), lambda x: x IS NOT NULL), ', ') AS authors FROM t LEFT JOIN n ON t.paper_id = n.paper_id LEFT JOIN paper_author_affiliation a ON t.paper_id = a.paper_id"""


def category_counts(spark: SparkSession, d: str) -> DataFrame:
    """Papers by category: the categories are numbered first, papers are linked with their numbers, and the names joined back."""
    k = table(spark, d, "paper_keywords").where("lower(keyword_type) = 'category' and trim(keyword) <> ''").select("paper_id", F.lower(F.trim("keyword")).alias("name"))
    categories = k.select("name").distinct().withColumn("cat_id", F.xxhash64("name"))
    links = k.select("paper_id", F.xxhash64("name").alias("cat_id")).distinct()
    return links.join(categories, "cat_id").groupBy("name").agg(F.count("*").alias("papers"))


CATEGORY_SQL = "SELECT lower(trim(keyword)) AS name, count(DISTINCT paper_id) AS papers FROM paper_keywords WHERE lower(keyword_type) = 'category' AND trim(keyword) <> '' GROUP BY 1"


def papers_by_zone(spark: SparkSession, d: str) -> DataFrame:
    """Papers by their publisher's time zone; the ten publishers are a table of fixed size."""
    p = table(spark, d, "papers").join(F.broadcast(table(spark, d, "publishers")), F.col("canonical_publisher") == F.col("publisher"), "left")
    return p.groupBy("time_zone").agg(F.count("*").alias("n"))


ZONE_SQL = "SELECT time_zone, count(*) AS n FROM papers LEFT JOIN publishers ON canonical_publisher = publisher GROUP BY 1"


def facet_filter(spark: SparkSession, d: str) -> DataFrame:
    """Papers that pass the chosen facets: some sources, and some years or none known."""
    s = table(spark, d, "paper_sources").where(F.col("source_name").isin("harbour_history", "medindex")).select("paper_id")
    year = F.year("online_at")
    p = table(spark, d, "papers").where(year.isin(2019, 2021) | year.isNull())
    return p.join(s, "paper_id", "left_semi").groupBy(F.coalesce(year.cast("string"), F.lit("Unknown")).alias("year")).agg(F.count("*").alias("n"))


FACET_FILTER_SQL = """
SELECT coalesce(CAST(year(online_at) AS VARCHAR), 'Unknown') AS year, count(*) AS n FROM papers p WHERE (year(online_at) IN (2019, 2021) OR online_at IS NULL)
  AND EXISTS (SELECT 1 FROM paper_sources s WHERE s.paper_id = p.paper_id AND s.source_name IN ('harbour_history', 'medindex')) GROUP BY 1"""


def keyword_case_dedupe(spark: SparkSession, d: str) -> DataFrame:
    k = merge_keywords(table(spark, d, "paper_keywords"))
    return k.select("paper_id", "type_key", "keyword_key", "source", "keyword", "created_at", F.round(F.col("weight").cast("double"), 5).alias("weight"), "merged_rows")


DEDUPE_SQL = """
WITH k AS (SELECT *, lower(trim(keyword_type)) AS type_key, lower(trim(keyword)) AS keyword_key FROM paper_keywords WHERE trim(keyword) <> ''),
  w AS (SELECT *, row_number() OVER g AS r, min(created_at) OVER p AS first_at, max(coalesce(weight, 1.0::FLOAT)) OVER p AS top, count(*) OVER p AS merged_rows FROM k
    WINDOW p AS (PARTITION BY paper_id, type_key, keyword_key, source), g AS (PARTITION BY paper_id, type_key, keyword_key, source ORDER BY created_at ASC NULLS LAST, weight DESC NULLS LAST, keyword))
SELECT paper_id, type_key, keyword_key, source, keyword, first_at AS created_at, round(CAST(top AS DOUBLE), 5) AS weight, merged_rows FROM w WHERE r = 1"""


def keyword_two_level(spark: SparkSession, d: str) -> DataFrame:
    from litmill.operators.suggest import distinct_keywords

    k = distinct_keywords(table(spark, d, "paper_keywords"))
    return k.select("keyword_key", "keyword_type", "source", "display", "docs", F.round("avg_weight", 6).alias("avg_weight"), F.round("max_weight", 6).alias("max_weight"))


TWO_LEVEL_SQL = """
WITH p AS (SELECT lower(trim(keyword)) AS keyword_key, keyword_type, source, paper_id, min(keyword) AS display, max(coalesce(CAST(weight AS DOUBLE), 1.0)) AS w
  FROM paper_keywords WHERE trim(keyword) <> '' GROUP BY 1, 2, 3, 4)
SELECT keyword_key, keyword_type, source, min(display) AS display, count(*) AS docs, round(avg(w), 6) AS avg_weight, round(max(w), 6) AS max_weight FROM p GROUP BY 1, 2, 3"""


def author_pool_counts(spark: SparkSession, d: str) -> DataFrame:
    from litmill.operators.suggest import author_pool

    return author_pool(table(spark, d, "paper_author_affiliation"))


POOL_SQL = """
WITH e AS (SELECT paper_id, unnest(authors).name AS name FROM paper_author_affiliation)
SELECT trim(regexp_replace(translate(lower(name), ',.', '  '), '[\\s\\x{00A0}\\x{3000}]+', ' ', 'g')) AS author_key, min(name) AS name, count(DISTINCT paper_id) AS papers
FROM e WHERE trim(name) <> '' GROUP BY 1"""


def duplicate_work_ids(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").where("work_id is not null").groupBy("work_id").agg(F.count("*").alias("n"), F.min("paper_id").alias("first_paper"))
    return p.where("n > 1")


DUPLICATES_SQL = "SELECT work_id, count(*) AS n, min(paper_id) AS first_paper FROM papers WHERE work_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1"


def source_merge_status(spark: SparkSession, d: str) -> DataFrame:
    """What merge_status should say: whether a paper has several sources."""
    n = table(spark, d, "paper_sources").groupBy("paper_id").agg(F.count_distinct("source_name").alias("sources"))
    p = table(spark, d, "papers").join(n, "paper_id", "left")
    return p.groupBy(F.when(F.col("sources") > 1, "merged").otherwise("single_source").alias("derived"), F.lower(F.trim("merge_status")).alias("stored")).agg(F.count("*").alias("n"))


MERGE_SQL = """
WITH n AS (SELECT paper_id, count(DISTINCT source_name) AS sources FROM paper_sources GROUP BY 1)
SELECT CASE WHEN sources > 1 THEN 'merged' ELSE 'single_source' END AS derived, lower(trim(merge_status)) AS stored, count(*) AS n FROM papers p LEFT JOIN n ON p.paper_id = n.paper_id GROUP BY 1, 2"""


def latest_event_per_user(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return best_per_key(e, ["user_id", "event_type"], F.struct("ts", "event_id"), ["event_id", "value"]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


EVENT_SQL = """
SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"""


def timing_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sum, mean, least and most of a measure per status; and the share of each."""
    e = table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")
    )
    return e


TIMING_SQL = """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1"""


def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"), "value")
    return e.groupBy("k").agg(F.count("*").alias("n"))


PROPS_SQL = "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1"


#: Stand-ins for an entity model: what the names of genes and of species look like.
ENTITY_PATTERNS = {"GENE": r"(?:[A-Z][a-z]{2,4}|[A-Z]{3,4})[0-9]+", "ORGANISM": r"[A-Z][a-z]{3,}(?:a|us|um|is) [a-z]{3,}(?:a|us|um|is)"}


def entity_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Genes and species named in each document as typed keywords, weighted by frequency; twelve at most (the feature's limit)."""
    docs = table(spark, d, "documents")
    found = None
    for i, (label, pattern) in enumerate(ENTITY_PATTERNS.items()):
        part = docs.select(F.col("doc_id").alias("paper_id"), F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "text"))
        part = part.select("paper_id", (F.col("pos").cast("long") + i * 10**9).alias("position"), F.lit(label).alias("label"), "text")
        found = part if found is None else found.unionByName(part)
    return count_entities(found).select(F.col("paper_id").alias("doc_id"), "keyword_type", "keyword", "weight")


_FOUND_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS keyword_type, unnest(xs) AS name, unnest(range(0, len(xs))) + {i}000000000 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS xs FROM documents)"
    for i, (kind, pattern) in enumerate([("gene", ENTITY_PATTERNS["GENE"]), ("organism", ENTITY_PATTERNS["ORGANISM"])])
)
ENTITY_SQL = f"""
WITH e AS ({_FOUND_SQL}),
  p AS (SELECT doc_id, keyword_type, lower(name) AS key, count(*) AS n, min(pos) AS pos, arg_min(name, pos) AS keyword FROM e GROUP BY 1, 2, 3),
  r AS (SELECT *, max(n) OVER (PARTITION BY doc_id) AS top, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos, keyword_type) AS k FROM p)
SELECT doc_id, keyword_type, keyword, round(n / top, 3) AS weight FROM r WHERE k <= 12"""


def country_revenue(spark: SparkSession, d: str) -> DataFrame:
    """A star join with pre-aggregation: line revenue per order before the order meets its customer."""
    line = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    per = o.groupBy("o_custkey").agg(F.sum("revenue").alias("revenue"), F.count("*").alias("orders"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(per, F.col("c_custkey") == F.col("o_custkey"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    out = c.groupBy("c_nationkey").agg(F.sum("revenue").alias("revenue"), F.sum("orders").alias("orders"))
    return out.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", F.round("revenue", 2).alias("revenue"), "orders")


REVENUE_SQL = """
WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY 1)
SELECT n_name, round(sum(revenue), 2) AS revenue, count(*) AS orders FROM l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""

QUERIES = {
    "category_counts": category_counts, "papers_by_zone": papers_by_zone, "facet_filter": facet_filter,
    "completeness": completeness, "sources_by_name": sources_by_name, "papers_by_year": papers_by_year, "facets": facets, "canonical_by_online_at": canonical_by_online_at,
    "canonical_join": canonical_join, "daily_feed": daily_feed, "keyword_case_dedupe": keyword_case_dedupe, "keyword_two_level": keyword_two_level,
    "author_pool_counts": author_pool_counts, "duplicate_work_ids": duplicate_work_ids, "source_merge_status": source_merge_status,
    "latest_event_per_user": latest_event_per_user, "timing_stats": timing_stats, "json_props": json_props, "entity_keywords": entity_keywords, "country_revenue": country_revenue,
}
SQL = {
    "category_counts": CATEGORY_SQL, "papers_by_zone": ZONE_SQL, "facet_filter": FACET_FILTER_SQL,
    "completeness": COMPLETENESS_SQL, "sources_by_name": BY_NAME_SQL, "papers_by_year": BY_YEAR_SQL, "facets": FACETS_SQL, "canonical_by_online_at": CANONICAL_SQL,
    "canonical_join": CANONICAL_JOIN_SQL, "daily_feed": FEED_SQL, "keyword_case_dedupe": DEDUPE_SQL, "keyword_two_level": TWO_LEVEL_SQL, "author_pool_counts": POOL_SQL,
    "duplicate_work_ids": DUPLICATES_SQL, "source_merge_status": MERGE_SQL, "latest_event_per_user": EVENT_SQL, "timing_stats": TIMING_SQL, "json_props": PROPS_SQL,
    "entity_keywords": ENTITY_SQL, "country_revenue": REVENUE_SQL,
}
