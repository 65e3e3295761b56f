import pandas as pd
import pytest
from pyspark.sql import functions as F

from litmill.llm import residue as rs

CONTENT = [
    "Loss of the gene caused a graded shift of membrane repair.", "Removing it for 12 hours restored the yield.", "We mapped 40 sites, of which 3% overlap.",
    "The effect was strongest in leaf samples.", "Carriers showed higher values than controls.", "Blocking the pathway shortened recovery by 9 days.",
    "A linear model attributed 5% of the change to season.", "Together these findings link repair to yield.",
]
BAD = [
    "Error 404 - Not Found\nThe page you asked for is not here. Request id: 8f3a21", "Home | Browse\nService Unavailable\nThe server is down for maintenance.",
    "Traceback (most recent call last):\nKeyError: 'abstract'", "Title: [object Object]\nViews: NaN\nAuthors: undefined", "This site requires JavaScript.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Please enable JavaScript to continue reading.",
    "Dear {{ name }},\nYour text ${ title } was seen by <<editor>>.", "blah blah blah\nblah blah blah\nblah blah blah", "Sample text Sample text Sample text Sample text",
]


@pytest.fixture(scope="module")
def model():
    rows = [("h%d" % (i % 7), 0, " ".join(CONTENT[(i + k) % 8] for k in range(7))) for i in range(80)] + [("h%d" % (i % 7), 1, BAD[i % len(BAD)]) for i in range(70)]
    rows += [("h0", 0, "A title of a work without anything else")] * 5
    rows += [("h%d" % i, 0, " ".join(CONTENT) + " A reviewer noted that the link returned \"page not found\", which we repaired.") for i in range(7)]
    sample = pd.DataFrame(rows, columns=["host", "label", "text"])
    return sample, rs.train(sample, held_out=False)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (BAD[0], True), ("A title\n\nService Unavailable\nThe server is down for maintenance.", True), (CONTENT[0] + "\nThis site requires JavaScript.", True),
        (" ".join(CONTENT) + "\nThis site requires JavaScript.", False), (" ".join(CONTENT), False), ("A title of a work without anything else", False),
        (CONTENT[0] + " A reviewer noted that the link returned \"page not found\", which we repaired.", False),
        (" ".join(CONTENT).replace("the gene", "{{ gene_name }}"), True), (" ".join(CONTENT) + " Templates of the form {{ name }} were expanded.", False),
        ("xxx xxx xxx\nxxx xxx xxx\nxxx xxx xxx", True), ("", False), (None, False), (" ".join(CONTENT * 900), False),
    ],
)
def test_judgement(model, text, want):
    _, (w, b, _) = model
    assert bool(rs.judge(pd.Series([text], dtype=object), w, b)["is_residue"].iloc[0]) is want


def test_held_out(model):
    out = rs.train(model[0], held_out=True)[2]
    assert out["held_out_segments"] > 0 and out["accuracy"] > 0.75


def test_table(spark, model):
    rows = [(i, t, h, "x", 1) for i, (h, _, t) in enumerate(model[0].itertuples(index=False, name=None))] + [(900, None, None, "x", 1), (901, "", "h", "x", 1), (0, model[0].text[0], "h0", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, label string, id int")
    out = rs.residue(df, "doc_id", "text", "source")
    assert out.count() == len(rows)
    bad = {r.id for r in out.where("is_residue").collect()}
    assert bad == {i for i, (_, y, _) in enumerate(model[0].itertuples(index=False, name=None)) if y}
    assert rs.residue(df.limit(0), "doc_id", "text", "source").count() == 0
    assert rs.residue(df.where(F.col("doc_id") == 900), "doc_id", "text", "source").first().is_residue is False
