"""The modes of the upsert, canonical sources, components."""

from pyspark.sql import functions as F

from litmill.operators.components import components
from litmill.operators.upsert import choose_canonical, replay_records, source_errors

SCHEMA = "seq bigint, record_id bigint, source_name string, version string, online_at timestamp, doi string, choice string"


def rows(spark, *r):
    return spark.createDataFrame([(i, i, *x) for i, x in enumerate(r, 1)], SCHEMA.replace("timestamp", "string")).withColumn("online_at", F.col("online_at").cast("timestamp"))


def test_modes(spark):
    r = rows(spark, ("a", "2", "2020-01-05", "x", None), ("a", "1", "2020-01-04", "x", None), ("b", None, "2020-01-06", "x", None), ("a", None, None, "y", None))
    got = lambda **k: [(x.status, x.canonical_source) for x in replay_records(r, {"doi": "doi"}, **k).orderBy("seq").collect()]
    assert got() == [("INSERT_NEW_PAPER", "a"), ("INSERT_SKIP_SAME_SOURCE", "a"), ("INSERT_APPEND_SOURCE", "b"), ("INSERT_NEW_PAPER", None)]
    assert got(mode="upsert") == [("UPSERT_NEW_PAPER", "a"), ("UPSERT_UPDATE_SAME_SOURCE", "a"), ("UPSERT_APPEND_SOURCE", "b"), ("UPSERT_NEW_PAPER", None)]
    assert {x[0] for x in got(mode="update")} == {"UPDATE_NOT_ALLOWED_NON_SAME_SOURCE"}


def test_chosen_canonical(spark):
    r = rows(spark, ("a", "1", "2020-01-05", "x", "zzz"), ("b", "1", "2020-01-06", "x", None), ("b", "2", "2020-01-07", "x", "a"), ("a", "2", "2020-01-04", "x", "c"), ("a", "3", "2020-01-09", "x", None))
    got = lambda **k: [(x.status, x.canonical_source) for x in replay_records(r, {"doi": "doi"}, mode="upsert", chosen="choice", **k).orderBy("seq").collect()]
    assert got() == [("UPSERT_NEW_PAPER", "a"), ("UPSERT_APPEND_SOURCE", "b"), ("UPSERT_UPDATE_SAME_SOURCE", "a"), ("FAILED", None), ("UPSERT_UPDATE_SAME_SOURCE", "a")]
    assert got(auto=False)[-1] == ("UPSERT_UPDATE_SAME_SOURCE", "a") and got(auto=False)[1] == ("UPSERT_APPEND_SOURCE", "b")


def test_choose_canonical(spark):
    papers = spark.createDataFrame([(1, 10), (2, None)], "paper_id int, canonical_source_id bigint")
    sources = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "paper_id int, paper_source_id bigint")
    choices = spark.createDataFrame([(1, 11), (2, 11), (3, 12)], "paper_id int, canonical_source_id bigint")
    got = {r.paper_id: (r.canonical_source_id, r.error) for r in choose_canonical(papers, sources, choices).collect()}
    assert got == {1: (11, None), 2: (None, "no source of the paper"), 3: (None, "no such paper")}


def test_source_errors(spark):
    df = spark.createDataFrame([("a", "a"), (None, "a"), ("a", None), ("a", "b"), ("z", "z"), (" ", " ")], "p string, k string")
    got = [r.error for r in source_errors(df, "p", "k", ["a", "b"]).collect()]
    assert got == [None, "payload without source", "key without source", "sources differ: b, a", "unknown source: z", "source is blank"]


def test_long_chains(spark):
    chain = [(i, i + 1) for i in range(300)]
    got = {r.id: r.component for r in components(spark.createDataFrame([*chain, (900, 900), (None, 3)], "a bigint, b bigint")).collect()}
    assert got == dict.fromkeys(range(301), 0)
    r = spark.createDataFrame([(i, i, "s", None, None, f"d{i}", f"d{i + 1}") for i in range(60)], "seq bigint, record_id bigint, source_name string, version string, online_at timestamp, doi string, arxiv string")
    linked = r.withColumn("arxiv", F.concat(F.lit("d"), F.col("record_id") + 1))
    out = replay_records(linked, {"id": "doi", "record": "arxiv"}).collect()
    assert len(out) == 60
