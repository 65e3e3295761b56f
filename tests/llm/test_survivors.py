from datetime import datetime

from pyspark.sql import functions as F

from litmill.llm import survivors as sv

SCHEMA = "paper_id int, work_id string, canonical_title string, canonical_abstract string, merge_status string, updated_at timestamp_ntz, grp string"


def at(day):
    return datetime(2020, 1, day)


ROWS = [
    (1, "W1", "A switch in Foo2 that works", "A whole text. It ends.", "merged", at(1), "x"),
    (2, "W1", "A switch in Foo2 that works", "A whole text. It ends.", " MERGED ", at(3), "x"),
    (3, "W1", "A switch in Foo2 that works", "Later but not merged.", "single_source", at(9), "x"),
    (4, "W1", "A switch in Foo2 th", "A whole text. It en", "merged", at(8), "x"),
    (5, "W2", "Untitled", "<p>Markup.</p>", "merged", at(1), "x"),
    (6, "W2", "Plain title", "N/A", None, at(2), "x"),
    (7, "W3", None, None, None, None, None),
    (8, "W3", "  ", "", None, None, None),
    (9, "W4", "Alone", "Alone.", "merged", at(1), "x"),
    (10, None, "Null", "Null.", "merged", at(1), "x"),
    (11, None, "Null", "Null.", "merged", at(1), "x"),
    (12, "W5", "Same moment", "Text (more)", "merged", at(1), "x"),
    (13, "W5", "Same moment", "Ga�bled text.", "merged", at(1), "x"),
    (14, "W6", "Why it fails in...", "Ends well.", None, at(1), "x"),
    (15, "W6", "Why it fails in the faÃ§ade", "Ends well. ", None, at(2), "x"),
]


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    merged = F.when(F.lower(F.trim("merge_status")) == "merged", 24.0).otherwise(0.0)
    return df, sv.survivors(df, "work_id", "paper_id", ["canonical_title"], ["canonical_abstract"], merged, "updated_at", 150 * 86_400_000_000.0)


def test_winners(spark):
    df, won = run(spark, ROWS)
    got = {(r.grp, r.field): r.id for r in won.collect()}
    assert got == {
        ("W1", "canonical_title"): 2, ("W1", "canonical_abstract"): 2, ("W2", "canonical_title"): 6,
        ("W5", "canonical_title"): 12, ("W6", "canonical_abstract"): 15,
    }
    r = {x.grp: x for x in sv.surviving_records(df, won, "paper_id", ["canonical_title", "canonical_abstract"]).collect()}
    assert r["W1"].canonical_abstract_value == "A whole text. It ends." and r["W2"].canonical_abstract_value is None


def test_empty_and_repeated(spark):
    assert run(spark, [])[1].count() == 0
    got = {(r.grp, r.field): r.id for r in run(spark, ROWS * 2)[1].collect()}
    assert got[("W1", "canonical_title")] == 2 and got[("W4", "canonical_title")] == 9


def test_votes_add_up(spark):
    rows = [("g", "f", 1, "a", 100), ("g", "f", 2, "b", 90), ("g", "f", 3, "b", 90), ("g", "f", 4, None, 10)]
    df = spark.createDataFrame(rows, "grp string, field string, id int, norm string, updated_us bigint")
    assert sv.votes(df, F.lit(0.0), 100.0).first().id == 2  # two slightly older rows outvote one
    assert sv.votes(df, F.lit(0.0), 1.0).first().id == 1  # with a steep decay the newest wins
