import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from litmill.functions import ids, text
from litmill.functions.trigram import similarity
from litmill.functions.versions import newer, version_key, version_text
from litmill.operators.identity import identifier_rows, match_identity
from litmill.operators.latest import merge_keywords
from litmill.operators.nearest import nearest
from litmill.operators.queue import advance
from litmill.operators.suggest import suggest_terms
from litmill.operators.understand import route
from litmill.operators.upsert import replay_records
from litmill.sources import adapters, files
from litmill.sources.adapters import from_citations, from_preprints
from litmill.sources.store import SnapshotTable


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (ids.doi, "HTTPS://doi.org/10.1145/XXX", "10.1145/xxx"), (ids.doi, " doi:10.1 / a ", "10.1/a"), (ids.doi, "  ", None), (ids.doi, None, None),
        (ids.arxiv, "2301.12345v1", "2301.12345"), (ids.pubmed, " 12345678 ", "12345678"), (ids.pubmed, "none", None),
        (ids.record_of_url, "https://x.org/view/17?a", "17"), (text.language, None, "en"), (text.language, "", "en"), (text.language, "EN", "en"), (text.language, " English ", "en"), (text.language, "中文", "zh"), (text.language, "英文", "en"), (text.language, " ENG ", "eng"), (text.language, "fr", "fr"),
        (adapters.iso_day, " 2020-02-29T23:59:60.5Z", "2020-02-29"), (adapters.iso_day, "2020/01/02", "2020-01-02"), (adapters.iso_day, "20200102", "2020-01-02"), (adapters.iso_day, "2020-02-30", None),
        (adapters.iso_day, "2020/01-02", None), (adapters.iso_day, "2020-01-02 10:00", None), (adapters.iso_day, "2020-01-02T10:00:00.1234567Z", None), (adapters.iso_day, None, None),
        (text.query_text, "  “deep  learning”?! ", "deep learning"), (text.author_like, "Ada Lovelace", True), (text.author_like, "Deep Learning", False),
        (text.correctable, "abc", False), (text.correctable, "1234", False), (text.usable_keyword, "Study", False), (text.author_key, "Doe, A. B.", "doe a b"),
    ],
)
def test_scalars(spark, f, value, want):
    assert one(spark, f, value) == want


def test_versions(spark):
    order = ["1.0.dev1", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0.post1", "1.2.0", "1.10.0", "v2.0.0", "13"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(order)], "i int, v string").select("i", version_key(F.col("v")).alias("k"))
    assert [r.i for r in df.orderBy("k").collect()] == list(range(len(order)))
    order = [*order[:5], "1.0.0", *order[5:], "13.0.1", "13.2"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(order)], "i int, v string").select("i", version_text(F.col("v")).alias("k"))
    assert [r.i for r in df.orderBy("k", "i").collect()] == list(range(len(order))) and df.select("k").distinct().count() == len(order) - 1
    assert one(spark, version_text, "draft") is None
    assert one(spark, version_key, "invalid") is None and one(spark, version_key, None) is None
    cases = [("2.0.0", "1.0.0", 10, 5, True), ("1.0.0", "2.0.0", 10, 5, False), ("1.0.0", "1.0.0", 10, 5, True), ("1.0.0", "1.0.0", 5, 10, False), (None, None, None, None, False), ("invalid", "1.0.0", 10, 5, True)]
    df = spark.createDataFrame(cases, "a string, b string, x int, y int, want boolean")
    assert df.where(newer(F.col("a"), F.col("b"), F.col("x"), F.col("y")) != F.col("want")).count() == 0


def test_trigrams(spark):
    df = spark.createDataFrame([("word", "two words")], "a string, b string")
    assert round(df.select(similarity(F.col("a"), F.col("b")).alias("s")).first().s, 6) == 0.363636


def test_adapters(spark):
    raw = spark.createDataFrame(
        [(1, "T ", "Doe, A.; ;Roe, B.", None, "Inst X & Inst Y", "10.1/A", "2026-04-01", "2", "genetics", "A.", "NA", "S"), (2, " ", None, None, None, None, "x", None, None, None, "10.2/b", None)],
        "record_id bigint, title string, authors string, author_corresponding string, author_corresponding_institution string, doi string, date string, version string, category string, abstract string, published string, server string",
    )
    a, b = from_preprints(raw).orderBy("record_id").collect()
    assert [x.name for x in a.authors] == ["Doe, A.", "Roe, B."] and [x.sequence for x in a.authors] == [1, 2]
    assert a.institutions == ["Inst X", "Inst Y"] and a.online_at == "2026-04-01" and a.is_preprint and a.error is None
    assert b.error == "title is missing" and b.authors == [] and b.online_at is None and b.is_published
    meta = {"citation_title": ["T"], "citation_author": ["A; B"], "citation_keywords": ["x,y"], "citation_reference": ["r1; r2"], "citation_author_institution": ["I, J"]}
    cites = spark.createDataFrame([(1, "https://x/en/view/20", None, None, meta), (2, None, None, None, {}), (3, None, None, None, None)], "record_id bigint, url string, sitemap_lastmod string, fetched_at string, meta map<string,array<string>>")
    a, b, c = from_citations(cites).orderBy("record_id").collect()
    assert [x.name for x in a.authors] == ["A", "B"] and a.keywords == ["x", "y"] and a.references == ["r1", "r2"] and a.institutions == ["I, J"] and a.source_record_id == "20"
    assert b.error == c.error == "title is missing"


def test_identity(spark):
    old = spark.createDataFrame([(10, 1, "s", "d1", "r1"), (11, 2, "t", "d2", "r9"), (12, 3, "t", "d1", None)], "paper_source_id bigint, paper_id bigint, source_name string, doi string, rec string")
    new = spark.createDataFrame([(1, "s", "d1", None), (2, "s", "d2", None), (3, "s", None, "r9"), (4, "t", None, "r9"), (5, "s", "zz", None)], "record_id bigint, source_name string, doi string, rec string")
    kinds = {"doi": "doi", "record": "rec"}
    got = {r.record_id: (r.match, r.paper_source_id) for r in match_identity(identifier_rows(new, ["record_id"], kinds), identifier_rows(old, ["paper_source_id", "paper_id"], kinds)).collect()}
    assert got == {1: ("same_source", 10), 2: ("cross_source", 11), 3: ("none", None), 4: ("same_source", 11), 5: ("none", None)}


SEQUENCES = {
    "A": ([("history", "1", 1), ("history", "2", 3), ("citation", None, 10)], ["NEW_PAPER", "UPDATE_SAME_SOURCE", "APPEND_SOURCE"], ["history", "history", "citation"], [True, False, True]),
    "B": ([("history", "1", 2), ("history", "1", 8), ("citation", None, 5)], ["NEW_PAPER", "UPDATE_SAME_SOURCE", "APPEND_SOURCE"], ["history"] * 3, [True, False, False]),
    "C": ([("citation", None, 1), ("history", "1", 8), ("history", "2", 9), ("citation", None, 0)], ["NEW_PAPER", "APPEND_SOURCE", "UPDATE_SAME_SOURCE", "SKIP_SAME_SOURCE"], ["citation", "history", "history", "history"], [True, True, False, False]),
}


def test_upsert_sequences(spark):
    rows, seq = [], 0
    for i in range(4):
        for name, (steps, *_) in SEQUENCES.items():  # interleaved
            if i < len(steps):
                seq += 1
                s, v, d = steps[i]
                rows.append((seq, seq, s, v, f"2026-04-{d + 1:02d}", f"10.1/{name}", name, i))
    df = spark.createDataFrame(rows, "seq bigint, record_id bigint, source_name string, version string, online_at string, doi string, name string, i int")
    got = {r.record_id: r for r in replay_records(df.withColumn("online_at", F.to_timestamp("online_at")), {"doi": "doi"}).collect()}
    for seq, _, _, _, _, _, name, i in rows:
        _, status, canonical, changed = SEQUENCES[name]
        r = got[seq]
        assert (r.status, r.canonical_source, r.canonical_changed) == (f"INSERT_{status[i]}", canonical[i], changed[i]), (name, i)


def test_merge_keywords_and_queue(spark):
    k = spark.createDataFrame([(1, "concept", "Cell", 0.5, "s", 2), (1, "Concept", " cell ", None, "s", 1), (1, "concept", None, 0.1, "s", 3)], "paper_id int, keyword_type string, keyword string, weight float, source string, created_at int")
    (r,) = merge_keywords(k).collect()
    assert (r.keyword, r.weight, r.merged_rows) == (" cell ", 1.0, 2)
    status = spark.createDataFrame([(1, "pending", 0, None, 0)], "paper_id bigint, status string, attempt_count bigint, error string, updated_at int")
    done = spark.createDataFrame([(1, "failed", "e" * 3000, 1), (1, "succeeded", None, 2), (2, "pending", None, 1)], "paper_id bigint, outcome string, error string, at int")
    got = {r.paper_id: (r.status, r.attempt_count, r.error) for r in advance(status, done).collect()}
    assert got == {1: ("succeeded", 2, None), 2: ("pending", 0, None)}
    (bad,) = advance(status, done.where("outcome = 'failed'")).collect()
    assert len(bad.error) == 2000


def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[5] = x[6]  # a tie
    df = spark.createDataFrame([(i, int(i % 3), [float(v) for v in r]) for i, r in enumerate(x)] + [(900, 1, None), (901, 1, [])], "id bigint, label int, embedding array<double>").repartition(7)
    q = df.where("id % 50 = 0 or id = 900").select(F.col("id").alias("query_id"), "embedding")
    monkeypatch.setattr("litmill.operators.nearest.TOGETHER", 1)  # every block is written before the next
    got = nearest(df, q, 5, block=3).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 300, 50):
        want = sorted(range(300), key=lambda j: (-round(float(u[i] @ u[j]), 6), j))[:5]
        assert [r.id for r in sorted((r for r in got if r.query_id == i), key=lambda r: (-r.score, r.id))] == want
    assert len(got) == 30
    assert len(nearest(df, q, 2, group="label").collect()) == 6 * 3 * 2
    assert nearest(df, q.limit(0), 5).count() == 0


def test_suggest_and_route(spark):
    k = spark.createDataFrame([(i, "concept", w, 0.5, "s") for i, w in enumerate(["machine learning", "Machine Learning", "deep learning", "protein folding"])], "paper_id int, keyword_type string, keyword string, weight float, source string")
    q = spark.createDataFrame([(1, "machne learning"), (2, "Ada Lovelace"), (3, "  "), (4, "protein folding")], "query_id int, query string")
    a = spark.createDataFrame([(1, [("Ada Lovelace", 1, [])])], "paper_id int, authors array<struct<name:string,sequence:int,affiliations:array<string>>>")
    assert suggest_terms(k, q).where("query_id = 1").orderBy(F.desc("score"), F.desc("docs")).first().keyword_key == "machine learning"
    got = {r.query_id: r for r in route(q, a, k).collect()}
    assert got[1].corrected_query == "machine learning" and got[2].route == "metadata_author" and got[3].route == "none"
    assert got[4].correction_score == 1.0 and got[4].corrected_query is None


def test_store(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path), "t", ["id"])
    t.merge(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    t.merge(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"))
    t.delete(spark.createDataFrame([(1,)], "id int"))
    assert {(r.id, r.v) for r in t.read().collect()} == {(2, "c"), (3, "d")}
    assert t.version() == 2 and t.read(0).count() == 2 and t.missing_columns(["id", "w"]) == ["w"]


def test_files(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.jsonl").write_text('{"a": 1}\n\n{bad\n')
    (tmp_path / "in/sub/b.jsonl").write_text('{"a": 2}\n')
    lines = files.parse_lines(files.read_json_lines(spark, str(tmp_path / "in")), "a int").collect()
    assert sorted((r.line_number, r.record.a if r.record else None, r.error) for r in lines if r.file.endswith("a.jsonl")) == [(1, 1, None), (3, None, "line is no JSON")]
    assert len(lines) == 3
    (tmp_path / "in/o.json").write_text(json.dumps({"a": 5}, indent=1))
    assert files.read_json(spark, str(tmp_path / "in")).first().a == 5
    m = files.write_shards(spark.range(5, 30).withColumnRenamed("id", "k"), str(tmp_path / "s"), "k", 10, 4).orderBy("shard").collect()
    assert [(r.shard, r.min_id, r.max_id, r.n_rows) for r in m] == [(0, 5, 14, 10), (1, 15, 24, 10), (2, 25, 29, 5)]
