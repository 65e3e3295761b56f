import re

import pytest
from pyspark.sql import functions as F

from litmill.llm import near_duplicates as nd

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def shingles(t, n):
    w = re.findall("[a-z0-9]+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def brute(texts, n, least):
    s = {i: shingles(t, n) for i, t in texts.items()}
    return {(a, b) for a in s for b in s if a < b and s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= least}


def corpus():
    import random

    r = random.Random(1)
    texts, i = {}, 0
    for _ in range(40):
        base = [r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(60)]
        for edits in (0, 0, 1, 3):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = r.choice(WORDS)
            texts[i] = ("  " if edits else "") + " ".join(w).title()
            i += 1
    return texts


@pytest.mark.parametrize("block", [256, 3])
def test_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)  # 3: every bucket takes the blocked way
    texts = corpus() | {1000: None, 1001: "", 1002: "...", 1003: "one", 1004: "ONE!", 1005: "two"}
    df = spark.createDataFrame([(i, t, i, "x") for i, t in texts.items()] + [(0, texts[0], 9, "y")], "id int, text string, rep int, _sh string")
    links, members = nd.near_duplicates(df, "id", F.col("text"), 3, 0.5)
    got = {(r.a, r.b) for r in nd.member_pairs(links, members).collect()}
    assert got == brute(texts, 3, 0.5)
    groups = {r.id: r.group_id for r in nd.duplicate_groups(links, members).collect()}
    assert len(groups) == len(texts) - 3 and groups[1003] == groups[1004] == 1003
    for a, b in got:
        assert groups[a] == groups[b]


def test_estimate_and_empty(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    links, members = nd.near_duplicates(df, "id", F.col("text"))
    assert links.count() == members.count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long + " tail"), (3, "other words here that differ")], "id bigint, text string")
    links, members = nd.near_duplicates(df, "id", F.col("text"))
    assert [(r.a, r.b) for r in links.collect()] == [(1, 2)] and members.count() == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.id: r.component for r in nd.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert set(got) == {*range(61), 100, 150, 200}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (100, 150, 200)} == {100}
