"""Intake of several sources, generated keywords, searches, whole papers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from litmill.operators import keywords as kw
from litmill.operators import pipeline, queue
from litmill.operators.payloads import embed, full_papers
from litmill.operators.understand import smart_search


def test_sources():
    assert pipeline.resolve_sources(None, ["a", "b"]) == ["a", "b"] and pipeline.resolve_sources(["b", "b"], ["a", "b"]) == ["b"] and pipeline.resolve_sources(None, ["a"], one=True) == ["a"]
    for call in (lambda: pipeline.resolve_sources("c", ["a"]), lambda: pipeline.resolve_sources(None, ["a", "b"], one=True)):
        with pytest.raises(ValueError):
            call()


def test_transform(spark):
    p = spark.createDataFrame([(1, "T", "A; B"), (2, " ", None)], "record_id bigint, title string, authors string")
    for c in ("author_corresponding_institution", "doi", "date", "version", "category", "abstract", "published", "server"):
        p = p.withColumn(c, F.lit(None).cast("string"))
    raw = {"preprint_daily": p, "pubmed": p.select("record_id"), "elsewhere": p.select("record_id").limit(1)}
    got = {(r.source_name, r.record_id): r.error for r in pipeline.transform(raw).collect()}
    assert got[("preprint_daily", 1)] is None and got[("preprint_daily", 2)] == "title is missing" and got[("pubmed", 1)] == "no adapter for source: pubmed" and len(got) == 5
    stats = {r.source_name: (r.total, r.successful, r.failed, r.success_rate) for r in pipeline.transform_stats(pipeline.transform(raw)).collect()}
    assert stats == {"preprint_daily": (2, 1, 1, 50.0), "pubmed": (2, 0, 2, 0.0), "elsewhere": (1, 0, 1, 0.0)}
    with pytest.raises(ValueError, match="record"):
        pipeline.transform(raw, stop_on_error=True)
    assert pipeline.transform({}) is None
    routed = pipeline.route(spark.createDataFrame([("citation",), ("x",), (None,)], "source_name string")).collect()
    assert [(r.adapter, r.error) for r in routed] == [("citation", None), (None, "unsupported source: x"), (None, "unsupported source: none")]


def test_generated_keywords(spark):
    stored = spark.createDataFrame([(1, "Concept", "Deep Sea", 0.2, "m"), (1, "concept", "deep sea", 0.3, "other"), (3, "gene", "x", None, None)], "paper_id int, keyword_type string, keyword string, weight float, source string")
    new = [
        (1, 1, "concept", " deep  sea ", "0.9"), (1, 2, "concept", "Deep Sea", "0.1"), (1, 3, "gene", "Abc1", "7"), (1, 4, "place", "X", "1"), (1, 5, "gene", " ", "1"), (1, 6, None, "y", "1"),
        (1, 7, "task", "sort", "no number"), (9, 1, "gene", "z", "1"), (2, 1, "gene", "Q", "-1"),
    ]
    out, counts = kw.upsert_generated(stored, spark.createDataFrame(new, "paper_id int, position int, keyword_type string, keyword string, weight string"), spark.createDataFrame([(1,), (2,), (3,)], "paper_id int"), "m")
    rows = {(r.paper_id, r.keyword_type, r.keyword, r.source): None if r.weight is None else round(r.weight, 3) for r in out.collect()}
    assert rows == {(1, "Concept", "Deep Sea", "m"): 0.9, (1, "concept", "deep sea", "other"): 0.3, (3, "gene", "x", None): None, (1, "gene", "Abc1", "m"): 1.0, (1, "task", "sort", "m"): 1.0, (2, "gene", "Q", "m"): 0.0}
    got = {r.paper_id: (r.inserted, r.updated, r.skipped, r.unknown_types, r.error) for r in counts.collect()}
    assert got == {1: (2, 1, 4, 1, None), 2: (1, 0, 0, 0, None), 9: (0, 0, 1, 0, "paper does not exist")}
    e = spark.createDataFrame([(1, 1, "GENE", "(Abc1)"), (1, 2, "gene", "abc1,"), (1, 3, "tissue", "Leaf"), (1, 4, "what", "Leaf"), (1, 5, "DNA", " . ")], "paper_id int, position int, label string, text string")
    assert [(r.keyword_type, r.keyword, r.weight) for r in kw.count_entities(e).orderBy("position").collect()] == [("gene", "Abc1", 1.0), ("concept", "Leaf", 1.0)]


def test_queue_pages(spark):
    s = spark.createDataFrame([(i, "a" if i % 2 else "b", "pending" if i < 8 else "succeeded", 0, None if i == 5 else datetime(2020, 1, 10 - i)) for i in range(9)], "paper_id int, source_name string, status string, attempt_count int, updated_at timestamp")
    page = lambda n: [r.paper_id for r in queue.candidates(s, sources=["a"], page=n, size=2).collect()]
    assert page(0) == [5, 7] and page(1) == [3, 1] and page(2) == [] and queue.candidates(s, states=("succeeded",)).count() == 1


def test_smart_search(spark):
    papers = spark.createDataFrame([(1, "deep sea corals", datetime(2020, 1, 1)), (2, "protein folding", None), (3, "sea ice", datetime(2021, 1, 1))], "paper_id int, canonical_title string, online_at timestamp")
    authors = spark.createDataFrame([(1, [("Ada Lovelace",)]), (2, [("Lovelace Ada",)]), (3, [("Ada  LOVELACE",), ("Bob Roe",)])], "paper_id int, authors array<struct<name:string>>")
    words = spark.createDataFrame([(1, "protein folding", "concept", "m", 1.0)], "paper_id int, keyword string, keyword_type string, source string, weight double")
    vectors = embed(papers.select("paper_id", F.col("canonical_title").alias("text")), "paper_id", "text")
    asked = spark.createDataFrame([(1, "Ada Lovelace"), (2, "protein foldin"), (3, " ")], "query_id int, query string")
    got = {}
    for r in smart_search(asked, papers, authors, words, vectors, 2).collect():
        got.setdefault((r.query_id, r.route), []).append(r.paper_id)
    assert got[(1, "metadata_author")] == [3, 1] and got[(2, "vector")][0] == 2 and len(got) == 2


def test_full_papers(spark):
    papers = spark.createDataFrame([(1, "T"), (2, "U")], "paper_id int, canonical_title string")
    sources = spark.createDataFrame([(1, 10, datetime(2020, 1, 1)), (1, 11, None), (1, 12, datetime(2021, 1, 1))], "paper_id int, paper_source_id int, online_at timestamp")
    authors = spark.createDataFrame([(1, [("A",)])], "paper_id int, authors array<struct<name:string>>")
    words = spark.createDataFrame([(1, "gene", "b", 1.0, "m"), (1, "gene", "a", 1.0, "m")], "paper_id int, keyword_type string, keyword string, weight double, source string")
    refs = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "paper_id int, reference_order int, reference_raw string")
    r = {x.paper_id: x for x in full_papers(papers, sources, authors, words, refs).collect()}
    assert [s.paper_source_id for s in r[1].sources] == [11, 12, 10] and [k.keyword for k in r[1].keywords] == ["a", "b"] and [x.reference_raw for x in r[1].references] == ["x", "y"] and r[2].sources is None
