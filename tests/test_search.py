"""Conditional searches and weighted words."""

import math
import random
from datetime import datetime

from pyspark.sql import functions as F

from litmill.operators import ranking
from litmill.operators.search import by_condition, okapi_rank, search_words, weighted_rank


def test_conditions(spark):
    papers = spark.createDataFrame([(1, "A Switch", datetime(2020, 1, 1)), (2, "switches", None), (3, None, datetime(2021, 1, 1)), (4, "switch", datetime(2021, 5, 1))], "paper_id int, canonical_title string, online_at timestamp")
    authors = spark.createDataFrame([(1, [("Ada",), (None,)]), (2, None), (4, [("ADAM",)])], "paper_id int, authors array<struct<name:string>>")
    words = spark.createDataFrame([(1, "category", " Ecology "), (1, "Category", "ecology"), (4, "gene", "ecology")], "paper_id int, keyword_type string, keyword string")
    ids = lambda **k: [r.paper_id for r in by_condition(papers, authors, words, **k).collect()]
    assert ids(title="SWITCH", limit=9) == [2, 4, 1] and ids(limit=1, offset=1) == [4] and sorted(ids(year=2021)) == [3, 4] and sorted(ids(author="ada")) == [1, 4]
    assert ids(category="Ecology") == [1] and ids(keyword_type="GENE") == [4] and ids(title="switch", author="ada", year=2020) == [1] and sorted(ids()) == [1, 2, 3, 4] and ids(title="%") == []


def test_weighted_words(spark):
    papers = spark.createDataFrame([(1, "sea ice", "ice and ice"), (2, "the sea", None), (3, None, "sea"), (4, None, None)], "paper_id int, canonical_title string, canonical_abstract string")
    q = spark.createDataFrame([(1, "the Sea, the ice"), (2, "the"), (3, None)], "query_id int, query string")
    got = [(r.query_id, r.paper_id, r.rank) for r in weighted_rank(papers, q, 2).orderBy("query_id", "rank", ascending=[True, False]).collect()]
    assert got == [(1, 1, 2.0), (1, 2, 0.7)]


def test_common_words_meet_no_join(spark, monkeypatch):
    """Queries and texts are not joined by words, and the best rows are those of brute force, ties and several chunks and blocks included."""
    r = random.Random(5)
    words = ["sea", "ice", "the", "drift", "salt", "krill", *(f"w{i}" for i in range(30))]
    text = lambda n: " ".join(r.choice(words[: r.choice([4, 36])]) for _ in range(r.randrange(n)))
    rows = [(i, text(6) or None, text(12)) for i in r.sample(range(1000), 300)]
    asked = [(i, text(5)) for i in range(40)]
    papers = spark.createDataFrame(rows, "paper_id int, canonical_title string, canonical_abstract string").repartition(2)
    queries = spark.createDataFrame(asked, "query_id int, query string")
    split = lambda t: [w for w in (t or "").split() if len(w) >= 3 and w != "the"]

    def best(score):
        found = []
        for q, t in asked:
            hits = sorted((-s, i) for i, s in ((i, score(set(split(t)), split(a), split(b))) for i, a, b in rows) if s is not None)
            found += [(q, i, -s) for s, i in hits[:7]]
        return sorted(found)

    ranked = weighted_rank(papers, queries, 7)
    assert "Join" not in ranked._jdf.queryExecution().executedPlan().toString()
    want = best(lambda q, a, b: round(sum(0.7 * a.count(w) + 0.3 * b.count(w) for w in q), 4) or None)
    assert sorted(map(tuple, ranked.collect())) == want
    monkeypatch.setattr(ranking, "TOGETHER", 2)
    monkeypatch.setattr(ranking, "CHUNK", 16)
    texts, split_queries = papers.select(F.col("paper_id").alias("id"), search_words(F.col("canonical_title")).alias("words")), queries.select("query_id", search_words(F.col("query")).alias("words"))
    held = [split(a) for _, a, _ in rows if split(a)]
    mean = sum(map(len, held)) / len(held)
    idf = lambda w: math.log(1 + (len(held) - (n := sum(w in a for a in held)) + 0.5) / (n + 0.5))
    okapi = lambda q, a, _: round(sum(idf(w) * (f := a.count(w)) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(a) / mean)) for w in q), 6) if q & set(a) else None
    got = okapi_rank(texts, split_queries, 7, block=3)
    assert sorted(map(tuple, got.collect())) == best(okapi)
    assert okapi_rank(texts.where("id < 0"), split_queries, 7).count() == 0 and weighted_rank(papers, queries.where("query_id < 0"), 7).count() == 0
