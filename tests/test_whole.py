"""Queries over all rows and whole texts, on small tables."""

from datetime import datetime

import pytest

from litmill.operators.understand import phrases, route
from litmill.plans import records, retrieval, state


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_version_decisions(spark, folder):
    day = lambda n: datetime(2020, 1, n)
    rows = [
        (1, 7, "s", "1", day(1)), (2, 7, "s", "v2", day(1)), (3, 7, "s", "1.10.0", day(5)), (4, 7, "s", "1.2.0", day(9)), (5, 7, "s", "draft", day(10)), (6, 7, "s", "1.2.0", day(9)),
        (7, 7, "s", None, day(9)), (8, 7, "s", "3", day(11)), (9, 7, "t", "v1", day(1)), (10, 8, "s", "2.0rc1", None), (11, 8, "s", "2.0", None), (12, 8, "s", "v2.0.0", day(1)),
    ]
    d = folder(paper_sources=(rows, "paper_source_id int, paper_id int, source_name string, version string, online_at timestamp_ntz"))
    got = {r.paper_source_id: r.replaces for r in state.version_decisions(spark, d).collect()}
    assert got == {2: True, 3: False, 4: False, 5: True, 6: False, 7: False, 8: True, 11: True, 12: True}


def test_read_days(spark, folder):
    want = {
        "2020-05-06": "2020-05-06", "2020/5/6 23:59": "2020-05-06", "20200506120059": "2020-05-06", "Tue, 26 May 2020 12:00:59 +0200": "2020-05-26", "1st Sept 2020": "2020-09-01",
        "May 6, 2020 at 2:05 PM": "2020-05-06", "6.5.2020": "2020-05-06", "05/06/2020 02:05 PM": "2020-05-06", "26/05/2020": "2020-05-26", "2020年5月6日 14:05": "2020-05-06",
        " 2020-05-06T04:41:47Z ": "2020-05-06", "2020-02-30": None, "2020-05": None, "in press": None, "": None,
    }
    d = folder(papers=([*enumerate(want), (99, None)], "paper_id int, submitted_at string"))
    got = {r.paper_id: r.day for r in records.read_days(spark, d).collect()}
    assert got == dict(enumerate(want.values()))


def test_whole_titles_are_queries(spark, folder):
    """Keywords past the third word are suggested, and the longest tokens are those of the whole title."""
    titles = [(50, "On the role of mitochondria"), (51, "Unasked mitochondria")]
    words = [(1, "mitochondria", "concept", "m", 1.0), (2, "role", "concept", "m", 1.0)]
    d = folder(
        papers=(titles, "paper_id int, canonical_title string"), paper_keywords=(words, "paper_id int, keyword string, keyword_type string, source string, weight double"),
        paper_author_affiliation=([], "paper_id int, authors array<struct<name:string>>"),
    )
    want = {(50, "mitochondria"), (50, "role")}
    for f in (retrieval.suggest_by_token, retrieval.suggest_terms_ranked):
        assert {(r.query_id, r.keyword_key) for r in f(spark, d).collect()} == want
    assert (50, "mitochondria") in {(r.query_id, r.keyword_key) for r in retrieval.suggest_by_trigram(spark, d).collect()}
    assert [r.query for r in retrieval.understand_queries(spark, d).collect()] == ["On the role of mitochondria"]


def test_phrases_of_long_queries_are_corrected(spark):
    q = spark.createDataFrame([(1, "quorum signalling in long runs of seven plain common words"), (2, "mitochondrial fision in island populations"), (3, "something else")], "query_id int, query string")
    got = {}
    for r in phrases(q).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append(r.phrase)
    assert got == {1: ["quorum signalling", "long runs", "seven plain common words"], 2: ["mitochondrial fision", "island populations"], 3: ["something else"]}
    eight = spark.createDataFrame([(1, "one two three four five six seven eight")], "query_id int, query string")
    assert [r.phrase for r in phrases(eight).orderBy("position").collect()] == ["three four five six seven", "eight"]
    words = spark.createDataFrame([(1, "mitochondrial fission", "concept", "m", 1.0)], "paper_id int, keyword string, keyword_type string, source string, weight double")
    authors = spark.createDataFrame([], "paper_id int, authors array<struct<name:string>>")
    out = {r.query_id: r.corrected_query for r in route(q, authors, words).collect()}
    assert out == {1: None, 2: "mitochondrial fission in island populations", 3: None}
