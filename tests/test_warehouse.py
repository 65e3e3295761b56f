"""Setting up and changing the warehouse, backfilling, identity bundles, shards, labels."""

import pytest
from pyspark.sql import functions as F

from litmill.functions.trigram import word_similarity
from litmill.operators import backfill
from litmill.operators.identity import identity_bundle
from litmill.operators.payloads import fan_out, keyword_rows, notice, read_normalised, route_shards, source_label
from litmill.operators.upsert import triggers
from litmill.sources import files
from litmill.sources.store import SnapshotTable
from litmill.sources.warehouse import TABLES, Warehouse, byte_size


def test_warehouse(spark, tmp_path):
    forms = {"a": (["id"], "id int, v string"), "b": (["id"], "id int, xs array<struct<x:int,y:string>>")}
    w = Warehouse(spark, str(tmp_path), forms)
    assert w.check() == {"a": ["id", "v"], "b": ["id", "xs"]} and w.setup() == ["a", "b"] and w.setup() == [] and w.check() == {}
    steps = {"002 more": lambda x: x.add_column("a", "w", "bigint"), "001 first": lambda x: x.table("a").merge(spark.createDataFrame([(1, "v")], "id int, v string"))}
    assert w.migrate(steps) == ["001 first", "002 more"] and w.migrate(steps) == [] and w.migrate({**steps, "003": lambda x: x.add_column("a", "w", "int")}) == ["003"]
    assert [(r.id, r.v, r.w) for r in w.table("a").read().collect()] == [(1, "v", None)]
    assert {(r.table_name, r.column_name, r.column_type) for r in w.columns().collect()} >= {("a", "w", "bigint"), ("b", "xs", "array<struct<x:int,y:string>>")}
    sizes = {r.table_name: (r.rows, r.size.split(" ")[1]) for r in w.sizes().collect()}
    assert sizes["a"] == (1, "KB") and sizes["b"][0] == 0 and w.clean() == 2 and w.columns().count() == 0
    got = [r.s for r in spark.createDataFrame([(0,), (1023,), (1536,), (3 * 1024**3,)], "n bigint").select(byte_size(F.col("n")).alias("s")).collect()]
    assert got == ["0 B", "1,023 B", "1.50 KB", "3.00 GB"] and len(TABLES) == 10


def test_lookup(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path), "t", ["id"])
    t.write(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    keys = spark.createDataFrame([(2,), (7,), (2,)], "id int")
    assert [(r.id, r.v) for r in t.get(keys).collect()] == [(2, "b")] and {(r.id, r.stored) for r in t.has(keys).collect()} == {(2, True), (7, False)}


def test_backfill(spark):
    r = spark.createDataFrame([(1, 1, "s", "1", "2020-01-01", "x"), (2, 2, "s", "1", "2020-01-01", "y"), (3, 3, "s", "0", "2020-01-01", "x")], "seq bigint, record_id bigint, source_name string, version string, online_at string, doi string")
    r = r.withColumn("online_at", F.col("online_at").cast("timestamp"))
    empty = spark.createDataFrame([], "paper_id string, status string, attempt_count bigint, error string, updated_at timestamp")
    statuses, queued = backfill.insert_and_queue(r, {"doi": "doi"}, empty, "2020-02-01")
    assert [x.status for x in statuses.orderBy("seq").collect()] == ["INSERT_NEW_PAPER", "INSERT_NEW_PAPER", "INSERT_SKIP_SAME_SOURCE"]
    assert {(x.paper_id, x.status, x.attempt_count) for x in queued.collect()} == {("P1", "pending", 0), ("P2", "pending", 0)}
    tries = []

    def attempt(due):
        tries.append(sorted(x.paper_id for x in due.collect()))
        bad = (F.col("paper_id") == "P2") & F.lit(len(tries) < 3)
        return due.select("paper_id", F.when(bad, "failed").otherwise("succeeded").alias("outcome"), F.when(bad, F.lit("no answer " + "x" * 300)).alias("error"))

    out = backfill.work_off(queued, attempt, 2, [f"2020-02-0{i}" for i in range(2, 7)])
    assert tries == [["P1", "P2"], ["P2"]]  # two tries at most
    assert {(x.paper_id, x.status, x.attempt_count) for x in out.collect()} == {("P1", "succeeded", 1), ("P2", "failed", 2)}
    assert {(x.status, None if x.bucket is None else len(x.bucket), x.n) for x in backfill.outcome_counts(out).collect()} == {("succeeded", None, 1), ("failed", 120, 1)}


def test_triggers_of_skipped(spark):
    s = spark.createDataFrame([("P1", "INSERT_SKIP_SAME_SOURCE", "a", False, "a"), ("P2", "INSERT_SKIP_SAME_SOURCE", "a", False, "a"), ("P3", "INSERT_APPEND_SOURCE", "a", True, "b"), ("P4", "UPDATE_SAME_SOURCE", "a", False, "a"), ("P5", "INSERT_UPDATE_SAME_SOURCE", "a", False, "b")],
                              "paper_key string, status string, canonical_source string, canonical_changed boolean, source_name string")
    got = {r.paper_key: (r.needs_vector, r.needs_keywords) for r in triggers(s, spark.createDataFrame([("P2",)], "paper_key string")).collect()}
    assert got == {"P1": (False, False), "P2": (False, True), "P3": (True, True), "P4": (True, True), "P5": (False, True)}
    assert {r.paper_key: r.needs_keywords for r in triggers(s).collect()}["P2"] is False


def test_identity_bundle(spark):
    df = spark.createDataFrame([("a", "10.1/x", "7", None), ("b", None, "8", "r8"), ("b", "10.1/y", None, None)], "source_name string, doi string, own string, source_record_id string")
    r = identity_bundle(df, {"a": "own"}).collect()
    assert r[0].identity.source_identifiers == {"a": "7"} and r[1].identity.source_identifiers == {"b": "r8"} and r[0].error is None
    assert r[2].error == "no identifier of its own source" and r[2].identity.doi == "10.1/y" and r[2].identity.arxiv_id is None


def test_normalised_json(spark):
    df = spark.createDataFrame([(1, "s", "10.1/x", "T", None, "en", "P", "2020-01-02", [(1, "A")], ["I"], ["k"], ["r"], "u", None)],
        "record_id int, source_name string, doi string, title string, abstract string, language string, publisher string, online_at string, authors array<struct<sequence:int,name:string>>, institutions array<string>, keywords array<string>, references array<string>, source_url string, error string")
    r = read_normalised(fan_out(df)["paper_source_metadata"]).first()
    assert (r.title, r.doi, r.online_at, r.keywords, r.references, r.authors[0].name, r.institutions[0].name, r.abstract) == ("T", "10.1/x", "2020-01-02", ["k"], ["r"], "A", "I", None)
    k = spark.createDataFrame([(1, "s", [(None, " a  b ", None, None), ("gene", " ", 1.0, "m"), ("gene", "c", 0.5, "m")])], "record_id int, source_name string, keywords array<struct<keyword_type:string,keyword:string,weight:double,source:string>>")
    assert [tuple(x)[1:] for x in keyword_rows(k).collect()] == [("concept", "a b", 1.0, "s"), ("gene", "c", 0.5, "m")]


def test_labels_and_routes(spark):
    names = spark.createDataFrame([("harbour_daily",), ("harbour",), ("Other",), ("",), (None,)], "n string")
    labels = {"harbour": "Harbour", "harbour_": "Harbour Press"}
    assert [r.x for r in names.select(source_label(F.col("n"), labels).alias("x")).collect()] == ["Harbour Press", "Harbour", "Other", "-", "-"]
    assert [r.x for r in names.select(source_label(F.col("n"), labels, key=True).alias("x")).collect()] == ["harbour press", "harbour", "other", "unknown", "unknown"]
    m = spark.createDataFrame([(0, True), (1, False), (2, True)], "shard int, writable boolean")
    routes = {"default": [0, 0, 1], "source:x": [2]}
    ids = lambda *a: sorted(r.shard for r in route_shards(m, *a).collect())
    assert ids("source:x", routes) == [2] and ids("domain:y", routes) == [0, 1] and ids("domain:y", routes, True) == [0] and ids("z", {}) == []
    q = spark.createDataFrame([("metadata_author", "A", None, None), ("author_suggestion", "A", None, None), ("vector", None, "c", "c"), ("vector", None, None, "s"), ("none", None, None, None)], "route string, author string, corrected_query string, suggestion string")
    assert [r.action for r in notice(q).collect()] == ["show_author", "offer_author", "show_corrected", "offer_correction", "none"]
    w = spark.createDataFrame([("word", "two words"), ("word", "none"), (None, "x")], "a string, b string").select(word_similarity(F.col("a"), F.col("b")).alias("x"))
    assert [round(r.x, 3) for r in w.collect()] == [0.8, 0.0, 0.0]


def test_vector_shards(spark, tmp_path):
    v = spark.createDataFrame([(i, [3.0, 4.0] if i != 12 else [0.0, 0.0]) for i in range(5, 15)] + [(99, None), (100, [])], "id int, embedding array<float>")
    m = files.Manifest(spark, str(tmp_path))
    out = {r.shard: (r.min_id, r.max_id, r.n_rows, r.dims) for r in files.write_vector_shards(v, f"{tmp_path}/v", 6, m).collect()}
    assert out == {0: (5, 10, 6, 2), 1: (11, 14, 4, 2)} and m.totals() == {"shards": 2, "rows": 10, "max_id": 14}
    got = {r.id: [round(x, 3) for x in r.embedding] for r in spark.read.parquet(f"{tmp_path}/v").collect()}
    assert got[5] == [0.6, 0.8] and got[12] == [0.0, 0.0]


def test_errors_are_kept(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "bad")], "id int, error string")
    assert [tuple(r) for r in files.split_errors(df, f"{tmp_path}/q").collect()] == [(1,)] and [r.error for r in spark.read.json(f"{tmp_path}/q").collect()] == ["bad"]
    with pytest.raises(ValueError, match="unknown mode"):
        from litmill.operators.upsert import replay_records

        replay_records(df, {}, mode="other")
