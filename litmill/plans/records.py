"""Queries over raw records: adapters, normalisation, validation, identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions import ids, text
from litmill.functions.versions import version_key
from litmill.operators.identity import first_seen, identifier_rows, match_identity
from litmill.operators.payloads import source_label
from litmill.session import table
from litmill.sources import adapters

_WS = r"[\s\x{00A0}\x{3000}]+"
_COLLAPSE = lambda c: f"trim(regexp_replace({c}, '{_WS}', ' ', 'g'))"
_DOI = lambda c: f"nullif(regexp_replace(regexp_replace(trim(lower({c})), '^(?:https?://(?:dx\\.)?doi\\.org/|doi\\.org/|doi:)', ''), '\\s+', '', 'g'), '')"
_NONE = "CAST([] AS VARCHAR[])"


def preprint_adapter(spark: SparkSession, d: str) -> DataFrame:
    out = adapters.from_preprints(table(spark, d, "preprint_records"))
    return out.select(
        "record_id", "source_name", "doi", "title", "abstract", "publisher", "version", "is_published", "is_preprint", "keyword", "abstract_url", "pdf_url", "error",
        F.array_join(F.transform("authors", lambda a: a["name"]), "|").alias("authors"), F.array_join("institutions", "|").alias("institutions"),
    )


_LIST = lambda c, sep: f"list_filter(list_transform(string_split({c}, '{sep}'), lambda x: trim(x)), lambda x: x <> '')"
PREPRINT_SQL = f"""
SELECT record_id, 'preprint_history' AS source_name, {_DOI("doi")} AS doi,
  nullif({_COLLAPSE("title")}, '') AS title, nullif({_COLLAPSE("abstract")}, '') AS abstract, server AS publisher,
  nullif(trim(version), '') AS version, coalesce(upper(trim(published)) <> 'NA', false) AS is_published,
  NOT coalesce(upper(trim(published)) <> 'NA', false) AS is_preprint, nullif({_COLLAPSE("category")}, '') AS keyword,
  'https://www.biorxiv.org/content/' || trim(doi) AS abstract_url, 'https://www.biorxiv.org/content/' || trim(doi) || '.full.pdf' AS pdf_url,
  CASE WHEN coalesce({_COLLAPSE("title")}, '') = '' THEN 'title is missing' END AS error,
  array_to_string(list_transform(coalesce({_LIST("authors", ";")}, {_NONE}), lambda x: {_COLLAPSE("x")}), '|') AS authors,
  array_to_string(coalesce(CASE WHEN author_corresponding_institution LIKE '% & %' THEN {_LIST("author_corresponding_institution", " & ")}
    WHEN author_corresponding_institution LIKE '%;%' THEN {_LIST("author_corresponding_institution", ";")}
    ELSE list_filter([trim(author_corresponding_institution)], lambda x: x <> '') END, {_NONE}), '|') AS institutions
FROM preprint_records"""


def citation_adapter(spark: SparkSession, d: str) -> DataFrame:
    out = adapters.from_citations(table(spark, d, "citation_records"))
    return out.select(
        "record_id", "doi", "title", "language", "publisher", "source_record_id", "source_url", "error",
        F.size("authors").cast("long").alias("n_authors"), F.array_join("keywords", "|").alias("keywords"), F.size("references").cast("long").alias("n_references"),
        F.array_join("institutions", "|").alias("institutions"),
    )


def _many_sql(key: str, comma: bool) -> str:
    x, one = f"meta['{key}']", f"meta['{key}'][1]"
    by_comma = f"WHEN {one} LIKE '%,%' AND {one} NOT LIKE '%, %' THEN {_LIST(one, ',')}" if comma else f"WHEN contains({one}, chr(10)) THEN list_filter(list_transform(string_split({one}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    return f"""coalesce(CASE WHEN len({x}) = 1 THEN CASE WHEN {one} LIKE '%;%' THEN {_LIST(one, ";")} {by_comma}
      ELSE list_filter([trim({one})], lambda x: x <> '') END
      ELSE list_filter(list_transform({x}, lambda x: trim(x)), lambda x: x <> '') END, {_NONE})"""


CITATION_SQL = f"""
SELECT record_id, {_DOI("meta['citation_doi'][1]")} AS doi, nullif({_COLLAPSE("meta['citation_title'][1]")}, '') AS title,
  CASE WHEN coalesce(meta['citation_language'][1], '') = '' THEN 'en'
    ELSE CASE lower(trim(meta['citation_language'][1])) WHEN 'english' THEN 'en' WHEN 'chinese' THEN 'zh' WHEN '中文' THEN 'zh' WHEN '英文' THEN 'en'
      ELSE lower(trim(meta['citation_language'][1])) END END AS language,
  coalesce(nullif(meta['citation_publisher'][1], ''), 'Citation source') AS publisher,
  coalesce(nullif(regexp_extract(meta['citation_abstract_html_url'][1], '/(?:view|download)/(\\d+)', 1), ''), nullif(regexp_extract(url, '/(?:view|download)/(\\d+)', 1), '')) AS source_record_id,
  url AS source_url, CASE WHEN coalesce({_COLLAPSE("meta['citation_title'][1]")}, '') = '' THEN 'title is missing' END AS error,
  CAST(len({_many_sql("citation_author", True)}) AS BIGINT) AS n_authors, array_to_string({_many_sql("citation_keywords", True)}, '|') AS keywords,
  CAST(len({_many_sql("citation_reference", False)}) AS BIGINT) AS n_references, array_to_string({_many_sql("citation_author_institution", True)}, '|') AS institutions
FROM citation_records"""


def explode_authors(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "paper_author_affiliation").select("paper_id", F.explode(text.renumber(F.col("authors"))).alias("a"))
    return a.select("paper_id", F.col("a.sequence").cast("long").alias("sequence"), F.col("a.name").alias("name"), F.array_join("a.affiliations", "|").alias("affiliations"))


AUTHORS_SQL = f"""
WITH kept AS (SELECT paper_id, list_filter(authors, lambda a: coalesce({_COLLAPSE("a.name")}, '') <> '') AS xs FROM paper_author_affiliation),
  each AS (SELECT paper_id, unnest(xs) AS a, unnest(range(1, len(xs) + 1)) AS sequence FROM kept)
SELECT paper_id, CAST(sequence AS BIGINT) AS sequence, {_COLLAPSE("a.name")} AS name,
  array_to_string(coalesce(list_filter(list_transform(a.affiliations, lambda x: {_COLLAPSE("x")}), lambda x: x <> ''), {_NONE}), '|') AS affiliations
FROM each"""


def normalise_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paper_sources").select(
        "paper_source_id", ids.doi(F.col("doi")).alias("doi"), ids.arxiv(F.col("arxiv_id")).alias("arxiv"), ids.pubmed(F.col("pubmed_id")).alias("pubmed"),
        ids.semantic_scholar(F.col("semantic_scholar_id")).alias("semantic_scholar"), ids.record_of_url(F.col("source_url")).alias("url_record"),
    )


IDENTIFIERS_SQL = f"""
SELECT paper_source_id, {_DOI("doi")} AS doi, nullif(regexp_replace(trim(arxiv_id), '[vV]\\d+$', ''), '') AS arxiv,
  nullif(regexp_extract(pubmed_id, '\\d+'), '') AS pubmed, nullif(lower(trim(semantic_scholar_id)), '') AS semantic_scholar,
  nullif(regexp_extract(source_url, '/(?:view|download)/(\\d+)', 1), '') AS url_record
FROM paper_sources"""


def normalise_languages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").select(text.language(F.col("canonical_language")).alias("language"))
    return p.groupBy("language").agg(F.count("*").alias("n"))


LANGUAGES_SQL = """
SELECT CASE WHEN coalesce(canonical_language, '') = '' THEN 'en' ELSE CASE lower(trim(canonical_language)) WHEN 'english' THEN 'en'
  WHEN 'chinese' THEN 'zh' WHEN '中文' THEN 'zh' WHEN '英文' THEN 'en' ELSE lower(trim(canonical_language)) END END AS language, count(*) AS n
FROM papers GROUP BY 1"""


def normalise_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("canonical_title")
    return table(spark, d, "papers").select(
        "paper_id", text.collapse(t).alias("collapsed"), text.term(t).alias("term"), text.correctable(t).alias("correctable"), text.usable_keyword(t).alias("usable")
    )


TEXTS_SQL = f"""
SELECT paper_id, {_COLLAPSE("canonical_title")} AS collapsed, trim(regexp_replace(lower(canonical_title), '[^a-z0-9+_\\-]+', ' ', 'g')) AS term,
  length(trim(regexp_replace(lower(canonical_title), '[^a-z0-9+_\\-]+', ' ', 'g'))) >= 4
    AND regexp_matches(trim(regexp_replace(lower(canonical_title), '[^a-z0-9+_\\-]+', ' ', 'g')), '[a-z]') AS correctable,
  length(lower({_COLLAPSE("canonical_title")})) BETWEEN 2 AND 200
    AND lower({_COLLAPSE("canonical_title")}) NOT IN ('study','analysis','result','results','paper','research','method','methods','data','approach') AS usable
FROM papers"""


def parse_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of all texts that a paper was submitted at; null where the text has none of the plain forms."""
    return table(spark, d, "papers").select("paper_id", adapters.iso_day(F.col("submitted_at")).alias("day"))


DAYS_SQL = r"""
SELECT paper_id, CASE WHEN regexp_full_match(trim(submitted_at), '\d{4}-\d\d-\d\d(T([01]\d|2[0-3]):[0-5]\d:([0-5]\d|6[01])(\.\d{1,6})?Z?)?|\d{4}/\d\d/\d\d|\d{8}')
  THEN strftime(try_strptime(substring(regexp_replace(trim(submitted_at), '[-/]', '', 'g'), 1, 8), '%Y%m%d'), '%Y-%m-%d') END AS day
FROM papers"""


def read_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of all texts that a paper was submitted at, in any form that is read (months by name, day first, Chinese, with times); null where none can be read."""
    return table(spark, d, "papers").where("submitted_at is not null").select("paper_id", adapters.day(F.col("submitted_at")).alias("day"))


def build_index_text(spark: SparkSession, d: str) -> DataFrame:
    """Title and abstract for indexing, the title alone, or nothing."""
    t, a = (text.filled(text.collapse(F.col(c))) for c in ("canonical_title", "canonical_abstract"))
    p = table(spark, d, "papers").select("paper_id", t.alias("t"), a.alias("a")).where("t is not null")
    return p.select(
        "paper_id", F.when(F.col("a").isNotNull(), "abstract").otherwise("title").alias("text_type"), F.concat_ws("\n", "t", "a").alias("index_text")
    )


INDEX_SQL = f"""
WITH p AS (SELECT paper_id, nullif({_COLLAPSE("canonical_title")}, '') AS t, nullif({_COLLAPSE("canonical_abstract")}, '') AS a FROM papers)
SELECT paper_id, CASE WHEN a IS NOT NULL THEN 'abstract' ELSE 'title' END AS text_type, concat_ws(chr(10), t, a) AS index_text FROM p WHERE t IS NOT NULL"""


def validate_records(spark: SparkSession, d: str) -> DataFrame:
    """What the raw records of both kinds lack that must be there, the first lack counting."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    check = lambda *pairs: F.coalesce(*[F.when(test, name) for name, test in pairs], F.lit("ok"))
    p = table(spark, d, "preprint_records").select(
        F.lit("preprint").alias("kind"), check(("title", blank(F.col("title"))), ("doi", blank(F.col("doi"))), ("server", blank(F.col("server"))), ("authors", blank(F.col("authors")))).alias("reason")
    )
    one = lambda k: F.get(F.col("meta").getItem(k), F.lit(0))
    c = table(spark, d, "citation_records").select(
        F.lit("citation").alias("kind"), check(("meta", F.size("meta") <= 0), ("title", blank(one("citation_title"))), ("authors", F.coalesce(F.size(F.col("meta").getItem("citation_author")), F.lit(0)) <= 0), ("date", blank(F.coalesce(one("citation_online_date"), one("citation_publication_date"))))).alias("reason")
    )
    return p.unionByName(c).groupBy("kind", "reason").agg(F.count("*").alias("n"))


VALIDATE_SQL = """
SELECT 'preprint' AS kind, CASE WHEN coalesce(trim(title), '') = '' THEN 'title' WHEN coalesce(trim(doi), '') = '' THEN 'doi' WHEN coalesce(trim(server), '') = '' THEN 'server'
  WHEN coalesce(trim(authors), '') = '' THEN 'authors' ELSE 'ok' END AS reason, count(*) AS n FROM preprint_records GROUP BY 1, 2
UNION ALL
SELECT 'citation', CASE WHEN coalesce(cardinality(meta), 0) = 0 THEN 'meta' WHEN coalesce(trim(meta['citation_title'][1]), '') = '' THEN 'title' WHEN coalesce(len(meta['citation_author']), 0) = 0 THEN 'authors'
  WHEN coalesce(trim(coalesce(meta['citation_online_date'][1], meta['citation_publication_date'][1])), '') = '' THEN 'date' ELSE 'ok' END, count(*) FROM citation_records GROUP BY 1, 2"""


def funder_rows(spark: SparkSession, d: str) -> DataFrame:
    return adapters.funders(table(spark, d, "preprint_records")).select("record_id", F.col("position").cast("long").alias("position"), "name")


FUNDER_SQL = """
WITH f AS (SELECT record_id, CAST(try_cast(funder AS JSON) AS JSON[]) AS xs FROM preprint_records WHERE funder LIKE '[%'),
  each AS (SELECT record_id, unnest(xs) AS x, unnest(range(0, len(xs))) AS position FROM f)
SELECT record_id, CAST(position AS BIGINT) AS position, x->>'name' AS name FROM each"""


#: What the sources of the data are shown as, by the beginning of their names.
LABELS = {"harbour": "Harbour", "tidepool": "Tidepool"}


def source_labels(spark: SparkSession, d: str) -> DataFrame:
    """Source records by what their source is shown as, and by its key."""
    s = table(spark, d, "paper_sources").select(source_label(F.col("source_name"), LABELS).alias("label"), source_label(F.col("source_name"), LABELS, key=True).alias("key"))
    return s.groupBy("label", "key").agg(F.count("*").alias("n"))


LABELS_SQL = """
SELECT CASE WHEN coalesce(source_name, '') = '' THEN '-' WHEN starts_with(source_name, 'harbour') THEN 'Harbour' WHEN starts_with(source_name, 'tidepool') THEN 'Tidepool' ELSE source_name END AS label,
  CASE WHEN coalesce(source_name, '') = '' THEN 'unknown' WHEN starts_with(source_name, 'harbour') THEN 'harbour' WHEN starts_with(source_name, 'tidepool') THEN 'tidepool' ELSE lower(source_name) END AS key, count(*) AS n
FROM paper_sources GROUP BY 1, 2"""

_KINDS = {"doi": "doi", "arxiv": "arxiv_id", "pubmed": "pubmed_id", "record": "source_record_id"}


def _existing(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "paper_sources").withColumn("doi", ids.doi(F.col("doi")))
    return identifier_rows(s, ["paper_source_id", "paper_id"], _KINDS)


def identity_match(spark: SparkSession, d: str) -> DataFrame:
    """Raw records of both kinds against the stored sources, by DOI and, within their source, by record number; -1 where there is none."""
    p = table(spark, d, "preprint_records").select(F.concat(F.lit("preprint-"), "record_id").alias("record_id"), F.lit("harbour_history").alias("source_name"), ids.doi(F.col("doi")).alias("doi"), F.lit(None).cast("string").alias("number"))
    c = adapters.from_citations(table(spark, d, "citation_records")).select(F.concat(F.lit("citation-"), "record_id").alias("record_id"), F.lit("tidepool").alias("source_name"), "doi", F.concat(F.lit("tid-"), "source_record_id").alias("number"))
    incoming = identifier_rows(p.unionByName(c), ["record_id"], {"doi": "doi", "record": "number"})
    return match_identity(incoming, _existing(spark, d)).fillna(-1, ["paper_id", "paper_source_id"])


IDENTITY_SQL = f"""
WITH r AS (SELECT 'preprint-' || record_id AS record_id, 'harbour_history' AS source_name, {_DOI("doi")} AS doi, NULL AS number FROM preprint_records
  UNION ALL SELECT 'citation-' || record_id, 'tidepool', {_DOI("meta['citation_doi'][1]")},
    'tid-' || coalesce(nullif(regexp_extract(meta['citation_abstract_html_url'][1], '/(?:view|download)/(\\d+)', 1), ''), nullif(regexp_extract(url, '/(?:view|download)/(\\d+)', 1), '')) FROM citation_records),
  s AS (SELECT paper_source_id, paper_id, source_name, {_DOI("doi")} AS doi, source_record_id FROM paper_sources),
  h AS (SELECT r.record_id, s.paper_id, s.paper_source_id, s.source_name = r.source_name AS same FROM r JOIN s ON r.doi = s.doi
    UNION ALL SELECT r.record_id, s.paper_id, s.paper_source_id, true FROM r JOIN s ON r.number = s.source_record_id AND r.source_name = s.source_name),
  b AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY same DESC, paper_source_id) AS k FROM h)
SELECT r.record_id, CASE WHEN b.same THEN 'same_source' WHEN b.same IS NOT NULL THEN 'cross_source' ELSE 'none' END AS match, coalesce(b.paper_id, -1) AS paper_id, coalesce(b.paper_source_id, -1) AS paper_source_id
FROM r LEFT JOIN b ON r.record_id = b.record_id AND b.k = 1 WHERE r.doi IS NOT NULL OR r.number IS NOT NULL"""


def earlier_matches(spark: SparkSession, d: str) -> DataFrame:
    """The earlier source record, by any identifier, that each source record would have been matched with on arrival; -1 where there is none."""
    s = table(spark, d, "paper_sources").select(
        "paper_source_id", "source_name", ids.doi(F.col("doi")).alias("doi"), ids.arxiv(F.col("arxiv_id")).alias("arxiv"), ids.pubmed(F.col("pubmed_id")).alias("pubmed"),
        ids.semantic_scholar(F.col("semantic_scholar_id")).alias("scholar"), F.col("source_record_id").alias("record"),
    )
    return first_seen(identifier_rows(s, ["paper_source_id"], {"doi": "doi", "arxiv": "arxiv", "pubmed": "pubmed", "scholar": "scholar", "record": "record"}), "paper_source_id")


EARLIER_SQL = f"""
WITH s AS (SELECT paper_source_id, source_name, {_DOI("doi")} AS doi, nullif(regexp_replace(trim(arxiv_id), '[vV]\\d+$', ''), '') AS arxiv, nullif(regexp_extract(pubmed_id, '\\d+'), '') AS pubmed,
    nullif(lower(trim(semantic_scholar_id)), '') AS scholar, nullif(source_record_id, '') AS record FROM paper_sources),
  i AS (UNPIVOT s ON doi, arxiv, pubmed, scholar, record INTO NAME kind VALUE v),
  h AS (SELECT a.paper_source_id, min(b.paper_source_id) FILTER (a.source_name = b.source_name) AS same, min(b.paper_source_id) FILTER (a.source_name <> b.source_name) AS other
    FROM i a JOIN i b ON a.kind = b.kind AND a.v = b.v AND b.paper_source_id < a.paper_source_id AND (a.kind <> 'record' OR a.source_name = b.source_name) GROUP BY 1)
SELECT DISTINCT i.paper_source_id, CASE WHEN same IS NOT NULL THEN 'same_source' WHEN other IS NOT NULL THEN 'cross_source' ELSE 'none' END AS match, coalesce(same, other, -1) AS earlier
FROM i LEFT JOIN h ON i.paper_source_id = h.paper_source_id"""


def latest_version_per_doi(spark: SparkSession, d: str) -> DataFrame:
    """The newest record of every preprint: versions by number, redeliveries by the later id."""
    r = table(spark, d, "preprint_records").select("record_id", ids.doi(F.col("doi")).alias("doi"), F.trim("version").alias("version"), version_key(F.col("version")).alias("v"))
    return r.where("doi is not null and v is not null").groupBy("doi").agg(
        F.max_by("record_id", F.struct("v", "record_id")).alias("record_id"), F.max_by("version", F.struct("v", "record_id")).alias("version"), F.count("*").alias("deliveries")
    )


LATEST_SQL = f"""
WITH r AS (SELECT record_id, {_DOI("doi")} AS doi, trim(version) AS version, try_cast(trim(version) AS BIGINT) AS v FROM preprint_records),
  w AS (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY v DESC, record_id DESC) AS k, count(*) OVER (PARTITION BY doi) AS deliveries FROM r WHERE doi IS NOT NULL AND v IS NOT NULL)
SELECT doi, record_id, version, deliveries FROM w WHERE k = 1"""


QUERIES = {
    "preprint_adapter": preprint_adapter, "citation_adapter": citation_adapter, "explode_authors": explode_authors, "normalise_identifiers": normalise_identifiers,
    "normalise_languages": normalise_languages, "normalise_texts": normalise_texts, "parse_days": parse_days, "read_days": read_days, "build_index_text": build_index_text,
    "validate_records": validate_records, "funder_rows": funder_rows, "source_labels": source_labels, "identity_match": identity_match, "earlier_matches": earlier_matches,
    "latest_version_per_doi": latest_version_per_doi,
}
SQL = {
    "preprint_adapter": PREPRINT_SQL, "citation_adapter": CITATION_SQL, "explode_authors": AUTHORS_SQL, "normalise_identifiers": IDENTIFIERS_SQL,
    "normalise_languages": LANGUAGES_SQL, "normalise_texts": TEXTS_SQL, "parse_days": DAYS_SQL, "build_index_text": INDEX_SQL, "validate_records": VALIDATE_SQL,
    "funder_rows": FUNDER_SQL, "source_labels": LABELS_SQL, "identity_match": IDENTITY_SQL, "earlier_matches": EARLIER_SQL, "latest_version_per_doi": LATEST_SQL,
}
