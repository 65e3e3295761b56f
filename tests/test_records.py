"""Single changes of stored records."""

from pyspark.sql import functions as F

from litmill.operators import records


def test_changes(spark):
    stored = spark.createDataFrame([(1, "A", 5), (2, "B", None), (3, "A", 7)], "paper_id int, canonical_title string, n int")
    rows, refused = records.create(stored, spark.createDataFrame([(3, "x"), (4, "D"), (5, "E"), (5, "F"), (None, "G")], "paper_id int, canonical_title string"), "paper_id")
    assert sorted((r.paper_id, r.canonical_title, r.n) for r in rows.collect() if r.paper_id > 3) == [(4, "D", None)] and rows.count() == 4
    assert sorted((r.canonical_title, r.reason) for r in refused.collect()) == [("E", "repeated"), ("F", "repeated"), ("G", "no key"), ("x", "stored already")]
    rows, log = records.update(stored, spark.createDataFrame([(1, "A", "6"), (2, None, None), (9, "Z", "1")], "paper_id int, canonical_title string, n string"), "paper_id", F.lit("now"))
    assert sorted((r.paper_id, r.canonical_title, r.n) for r in rows.collect()) == [(1, "A", 6), (2, "B", None), (3, "A", 7)]
    assert [tuple(r) for r in log.collect()] == [(1, "n", "5", "6", "now")]
    left, n = records.remove(stored, "paper_id", title="A")
    assert n == 2 and [r.paper_id for r in left.collect()] == [2]
    left, n = records.remove(stored, "paper_id", ids=spark.createDataFrame([(2,), (8,), (None,)], "paper_id int"))
    assert n == 1 and left.count() == 2 and records.remove(stored, "paper_id")[1] == 0
