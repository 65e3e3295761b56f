"""Writes and states: replayed upserts, queues, deletions, shards, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions import ids
from litmill.functions.versions import newer
from litmill.operators import queue
from litmill.operators.upsert import choose_canonical, identity_groups, replay_records, source_errors, triggers
from litmill.session import ensure_checkpoint_dir, table
from litmill.sources.store import SnapshotTable, cascade_delete
from litmill.streaming.ingest import stream_preprints, windowed_counts


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    """Source records as they would have arrived: in the order of their ids."""
    s = table(spark, d, "paper_sources")
    return s.select(
        F.col("paper_source_id").alias("seq"), F.col("paper_source_id").alias("record_id"), "source_name", "version", F.col("online_at"), ids.doi(F.col("doi")).alias("doi"),
        ids.arxiv(F.col("arxiv_id")).alias("arxiv_id"), "source_record_id",
    )


def upsert_replay(spark: SparkSession, d: str) -> DataFrame:
    r = replay_records(_incoming(spark, d), {"doi": "doi", "arxiv": "arxiv_id", "record": "source_record_id"})
    return r.select("record_id", "status", "paper_key", "canonical_source", "canonical_changed")


def upsert_status_counts(spark: SparkSession, d: str) -> DataFrame:
    r = replay_records(_incoming(spark, d), {"doi": "doi", "arxiv": "arxiv_id", "record": "source_record_id"})
    named = r.join(table(spark, d, "paper_sources").select(F.col("paper_source_id").alias("record_id"), "source_name"), "record_id")
    return triggers(named).groupBy("status", "needs_vector", "needs_keywords").agg(F.count("*").alias("n"))


#: Deliveries of three papers in their order, what each must come out as, and with which canonical source.
GOLDEN = [
    ("A", 1, "history", "1", "2026-04-01", "INSERT_NEW_PAPER", True, "history"), ("A", 2, "history", "2", "2026-04-03", "INSERT_UPDATE_SAME_SOURCE", False, "history"), ("A", 3, "citation", None, "2026-04-10", "INSERT_APPEND_SOURCE", True, "citation"),
    ("B", 1, "history", "1", "2026-04-02", "INSERT_NEW_PAPER", True, "history"), ("B", 2, "history", "1", "2026-04-08", "INSERT_UPDATE_SAME_SOURCE", False, "history"), ("B", 3, "citation", None, "2026-04-05", "INSERT_APPEND_SOURCE", False, "history"),
    ("C", 1, "citation", None, "2026-04-01", "INSERT_NEW_PAPER", True, "citation"), ("C", 2, "history", "1", "2026-04-08", "INSERT_APPEND_SOURCE", True, "history"), ("C", 3, "history", "2", "2026-04-09", "INSERT_UPDATE_SAME_SOURCE", False, "history"),
    ("C", 4, "citation", None, "2026-03-30", "INSERT_SKIP_SAME_SOURCE", False, "history"),
]


def upsert_golden(spark: SparkSession, d: str) -> DataFrame:
    """Known sequences of deliveries, replayed."""
    rows = [(10 * i + k, "ABC".index(doi) * 10 + k, s, v, o, doi) for i, (doi, k, s, v, o, *_) in enumerate(GOLDEN)]
    r = spark.createDataFrame(rows, "seq bigint, record_id bigint, source_name string, version string, online_at string, doi string").withColumn("online_at", F.col("online_at").cast("timestamp_ntz"))
    return replay_records(r, {"doi": "doi"}).select("record_id", "status", "canonical_source", "canonical_changed")


GOLDEN_SQL = "SELECT CAST(record_id AS BIGINT) AS record_id, status, canonical_source, canonical_changed FROM (VALUES " + ", ".join(
    f"({'ABC'.index(doi) * 10 + k}, '{status}', '{source}', {str(changed).lower()})" for doi, k, _, _, _, status, changed, source in GOLDEN
) + ") g(record_id, status, canonical_source, canonical_changed)"


def upsert_forced(spark: SparkSession, d: str) -> DataFrame:
    """Source records replayed in the mode upsert, where a record of the same source always replaces the one before."""
    r = replay_records(_incoming(spark, d), {"doi": "doi", "arxiv": "arxiv_id", "record": "source_record_id"}, mode="upsert")
    return r.groupBy("status").agg(F.count("*").alias("n"))


def update_only(spark: SparkSession, d: str) -> DataFrame:
    """Every source record as an update of an empty store: none is allowed."""
    r = replay_records(_incoming(spark, d), {"doi": "doi", "arxiv": "arxiv_id", "record": "source_record_id"}, mode="update")
    return r.groupBy("status").agg(F.count("*").alias("n"))


UPDATE_SQL = "SELECT 'UPDATE_NOT_ALLOWED_NON_SAME_SOURCE' AS status, count(*) AS n FROM paper_sources"


def identity_components(spark: SparkSession, d: str) -> DataFrame:
    """The group of source records that share a DOI or arXiv number, directly or through others."""
    s = _incoming(spark, d)
    values = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(c), F.lit(":"), c)) for c in ("doi", "arxiv_id")]))
    return identity_groups(s.select("record_id", F.explode(values).alias("value")))


COMPONENTS_SQL = r"""
WITH RECURSIVE s AS (SELECT paper_source_id AS id, nullif(regexp_replace(regexp_replace(trim(lower(doi)), '^(?:https?://(?:dx\.)?doi\.org/|doi\.org/|doi:)', ''), '\s+', '', 'g'), '') AS doi,
    nullif(regexp_replace(trim(arxiv_id), '[vV]\d+$', ''), '') AS arxiv FROM paper_sources),
  l AS (SELECT id, 'doi:' || doi AS v FROM s WHERE doi IS NOT NULL UNION SELECT id, 'arxiv:' || arxiv FROM s WHERE arxiv IS NOT NULL),
  e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM l a JOIN l b ON a.v = b.v),
  r AS (SELECT DISTINCT id, id AS reach FROM l UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a)
SELECT id AS record_id, min(reach) AS grp FROM r GROUP BY 1"""


def canonical_by_hand(spark: SparkSession, d: str) -> DataFrame:
    """The first source of every paper, and now and then another paper's, chosen as canonical."""
    s = table(spark, d, "paper_sources").select("paper_id", "paper_source_id")
    first = s.groupBy("paper_id").agg(F.min("paper_source_id").alias("canonical_source_id"))
    wrong = F.when(F.col("paper_id") % 7 == 0, F.col("canonical_source_id") + 1_000_000).otherwise(F.col("canonical_source_id"))
    return choose_canonical(table(spark, d, "papers"), s, first.withColumn("canonical_source_id", wrong)).fillna(-1, ["canonical_source_id"])


BY_HAND_SQL = """
WITH f AS (SELECT paper_id, min(paper_source_id) AS first FROM paper_sources GROUP BY 1)
SELECT f.paper_id, coalesce(CASE WHEN f.paper_id % 7 <> 0 THEN first ELSE p.canonical_source_id END, -1) AS canonical_source_id,
  CASE WHEN p.paper_id IS NULL THEN 'no such paper' WHEN f.paper_id % 7 = 0 THEN 'no source of the paper' END AS error FROM f LEFT JOIN papers p ON p.paper_id = f.paper_id"""


def source_checks(spark: SparkSession, d: str) -> DataFrame:
    """Source records checked against the sources that may be stored, with the platform's name as the key's source now and then."""
    s = table(spark, d, "paper_sources").select("source_name", F.when(F.col("paper_source_id") % 10 == 0, F.col("platform")).otherwise(F.col("source_name")).alias("key"))
    return source_errors(s, "source_name", "key", ["harbour_history", "harbour_daily", "medindex"]).groupBy("error").agg(F.count("*").alias("n"))


CHECKS_SQL = """
WITH s AS (SELECT source_name AS p, CASE WHEN paper_source_id % 10 = 0 THEN platform ELSE source_name END AS k FROM paper_sources)
SELECT CASE WHEN coalesce(k, '') = '' THEN 'key without source' WHEN coalesce(p, '') = '' THEN 'payload without source' WHEN k <> p THEN 'sources differ: ' || k || ', ' || p
  WHEN k NOT IN ('harbour_history', 'harbour_daily', 'medindex') THEN 'unknown source: ' || k END AS error, count(*) AS n FROM s GROUP BY 1"""


def _decisions(sources: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("paper_id", "source_name").orderBy("paper_source_id")
    s = sources.select("paper_source_id", "version", "online_at", F.lag("version").over(w).alias("old"), F.lag("online_at").over(w).alias("old_at"), F.row_number().over(w).alias("k")).where("k > 1")
    return s.select("paper_source_id", newer(F.col("version"), F.col("old"), F.col("online_at"), F.col("old_at")).alias("replaces"))


def version_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source record would replace the one before it of the same paper and source."""
    return _decisions(table(spark, d, "paper_sources"))


VERSIONS_SQL = r"""
WITH p AS (SELECT paper_source_id, paper_id, source_name, online_at, CASE WHEN regexp_full_match(lower(trim(version)), 'v?\d+(\.\d+)*')
    THEN list_transform(string_split(regexp_replace(ltrim(lower(trim(version)), 'v'), '(\.0+)+$', ''), '.'), lambda x: CAST(x AS BIGINT)) END AS v FROM paper_sources),
  s AS (SELECT paper_source_id, v, online_at, lag(v) OVER w AS o, lag(online_at) OVER w AS old_at, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY paper_id, source_name ORDER BY paper_source_id))
SELECT paper_source_id, CASE WHEN v IS NOT NULL AND o IS NOT NULL AND v <> o THEN v > o ELSE coalesce(coalesce(online_at > old_at, online_at IS NOT NULL AND old_at IS NULL), false) END AS replaces FROM s WHERE k > 1"""


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Events as outcomes of embedding attempts of the paper with the user's number."""
    e = table(spark, d, "events")
    outcome = F.when(F.col("event_type") == "click", "succeeded").when(F.col("event_type") == "view", "pending").otherwise("failed")
    return e.select(F.col("user_id").alias("paper_id"), outcome.alias("outcome"), F.col("event_type").alias("error"), F.struct("ts", "event_id").alias("at"))


def embedding_queue(spark: SparkSession, d: str) -> DataFrame:
    status = spark.createDataFrame([], "paper_id bigint, status string, attempt_count bigint, error string, updated_at struct<ts:timestamp_ntz,event_id:bigint>")
    return queue.advance(status, _outcomes(spark, d)).select("paper_id", "status", "attempt_count", "error")


QUEUE_SQL = """
WITH o AS (SELECT user_id AS paper_id, CASE event_type WHEN 'click' THEN 'succeeded' WHEN 'view' THEN 'pending' ELSE 'failed' END AS outcome, event_type AS error,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
  n AS (SELECT paper_id, CAST(count(*) FILTER (outcome <> 'pending') AS BIGINT) AS attempt_count FROM o GROUP BY 1)
SELECT o.paper_id, outcome AS status, attempt_count, CASE WHEN outcome = 'failed' THEN error END AS error FROM o JOIN n ON o.paper_id = n.paper_id WHERE k = 1"""


def missing_keyword_sources(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "paper_keywords")
    return queue.missing_sources(table(spark, d, "papers"), k, ["entity_model", "keyword_match"])


MISSING_SQL = """
SELECT p.paper_id, w.source FROM papers p, (VALUES ('entity_model'), ('keyword_match')) w(source)
WHERE NOT EXISTS (SELECT 1 FROM paper_keywords k WHERE k.paper_id = p.paper_id AND k.source = w.source)"""


def cascade_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows left in every table once the papers without title are deleted."""
    p = table(spark, d, "papers")
    gone = p.where("canonical_title is null or trim(canonical_title) = ''")
    names = ["papers", "paper_sources", "paper_keywords", "paper_author_affiliation"]
    left = cascade_delete({n: table(spark, d, n).select("paper_id") for n in names}, gone)
    out = None
    for n, df in left.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


CASCADE_SQL = """WITH g AS (SELECT paper_id FROM papers WHERE canonical_title IS NULL OR trim(canonical_title) = '')
""" + " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n} WHERE paper_id NOT IN (SELECT paper_id FROM g)" for n in ["papers", "paper_sources", "paper_keywords", "paper_author_affiliation"])


def shard_stats(spark: SparkSession, d: str) -> DataFrame:
    s = queue.id_shards(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", 250)
    return s.groupBy("shard").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum("n_chars").alias("chars"))


SHARD_SQL = """
WITH m AS (SELECT min(doc_id) AS low FROM documents)
SELECT CAST(floor((doc_id - low) / 250) AS BIGINT) AS shard, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents, m GROUP BY 1"""


def work_ids(spark: SparkSession, d: str) -> DataFrame:
    """Repeatable time-ordered work ids, and whether they have the right form."""
    p = table(spark, d, "papers").select("paper_id", ids.work_id(F.unix_millis(F.col("created_at").cast("timestamp")), F.col("paper_id")).alias("work_id"))
    return p.withColumn("valid", F.col("work_id").rlike("^W[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"))


def work_id_checks(spark: SparkSession, d: str) -> DataFrame:
    """How many work ids there are, how many differ, how many have the right form, and how many begin with their paper's time."""
    w = work_ids(spark, d).join(table(spark, d, "papers").select("paper_id", F.unix_millis(F.col("created_at").cast("timestamp")).alias("ms")), "paper_id")
    time = F.conv(F.concat(F.substring("work_id", 2, 8), F.substring("work_id", 11, 4)), 16, 10).cast("long")
    return w.agg(F.count("*").alias("n"), F.count_distinct("work_id").alias("different"), F.sum(F.col("valid").cast("long")).alias("valid"), F.sum((time == F.col("ms")).cast("long")).alias("timed"))


WORK_IDS_SQL = "SELECT count(*) AS n, count(*) AS different, count(created_at) AS valid, count(created_at) AS timed FROM papers"


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    out = windowed_counts(table(spark, d, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


WINDOWS_SQL = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Preprint records through the stream into a snapshot table: the last delivery of each DOI and version."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    raw = table(spark, d, "preprint_records")
    raw.write.parquet(f"{root}/in")
    store = SnapshotTable(spark, root, "preprints", ["key"])
    stream_preprints(spark, f"{root}/in", raw.schema, store, f"{root}/checkpoint").awaitTermination()
    return store.read().select("key", "record_id", "doi", "version")


STREAM_SQL = r"""
WITH r AS (SELECT record_id, nullif(regexp_replace(regexp_replace(trim(lower(doi)), '^(?:https?://(?:dx\.)?doi\.org/|doi\.org/|doi:)', ''), '\s+', '', 'g'), '') AS doi, nullif(trim(version), '') AS version
    FROM preprint_records WHERE coalesce(trim(title), '') <> ''),
  w AS (SELECT *, doi || '|' || coalesce(version, '0') AS key FROM r WHERE doi IS NOT NULL)
SELECT key, max(record_id) AS record_id, arg_max(doi, record_id) AS doi, arg_max(version, record_id) AS version FROM w GROUP BY 1"""

QUERIES = {
    "upsert_replay": upsert_replay, "upsert_status_counts": upsert_status_counts, "version_decisions": version_decisions, "embedding_queue": embedding_queue,
    "missing_keyword_sources": missing_keyword_sources, "cascade_counts": cascade_counts, "shard_stats": shard_stats, "work_ids": work_ids, "work_id_checks": work_id_checks, "event_windows": event_windows,
    "stream_ingest": stream_ingest, "upsert_golden": upsert_golden, "upsert_forced": upsert_forced, "update_only": update_only, "identity_components": identity_components,
    "canonical_by_hand": canonical_by_hand, "source_checks": source_checks,
}
SQL = {
    "version_decisions": VERSIONS_SQL, "embedding_queue": QUEUE_SQL, "missing_keyword_sources": MISSING_SQL, "cascade_counts": CASCADE_SQL, "shard_stats": SHARD_SQL,
    "event_windows": WINDOWS_SQL, "stream_ingest": STREAM_SQL, "upsert_golden": GOLDEN_SQL, "work_id_checks": WORK_IDS_SQL, "update_only": UPDATE_SQL, "identity_components": COMPONENTS_SQL, "canonical_by_hand": BY_HAND_SQL, "source_checks": CHECKS_SQL,
}
