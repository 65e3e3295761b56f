import pytest

from litmill.llm import entity_match as em


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("Research article: Loss of Foo2 links X to yield", "LOSS OF FOO2 LINKS X TO YIELD.", True),
        ("A Δ-null switch in Foo2 - revised", "A Delta-null switch in Foo2", True),
        ("Tissue regeneration &amp; bone density", "Tissue regeneration and bone density", True),
        ("Loss Foo2 links seed dormancy to yeild", "Loss of Foo2 links seed dormancy to yield", True),
        ("278 days of quorum signalling: a study of...", "278 days of quorum signalling: a study of Foo and Bar", True),
        ("Structural basis of Xsl22-mediated uptake", "Structural basis of Zrb28-mediated uptake", False),
        ("Loss of Foo2 links X to yield, part II", "Loss of Foo2 links X to yield", False),
        ("", "A title", False), (None, None, False), ("Correction", "Correction", True),
    ],
)
def test_titles(a, b, want):
    (x, xc), (y, yc) = em.title_words(a), em.title_words(b)
    assert bool(em.same_title(x, y, xc, yc)[0]) is want


def test_edits():
    assert em.edits("omoic", "osmotic") == 2 and em.edits("ab", "ba") == 1 and em.edits("abc", "abcdefg") == 9


def test_matches(spark):
    schema = "id bigint, title string, authors array<string>, days array<int>, doi array<string>, key string"
    works = [
        (1, "Loss of Foo2 links seed dormancy to crop yield", ["Doe, Ann", "Bob Roe"], [100], ["a"], "k"),
        (2, "Loss of Foo2 links seed dormancy to crop yield", ["Else, Who"], [100], [], "k"),
        (3, "Correction", ["Doe, Ann"], [500], [], "k"), (4, "Correction", ["Roe, Bob"], [500], [], "k"), (5, None, None, [], [], None),
        (6, "Loss of Foo2 links seed dormancy to crop yield", ["Doe, Ann", "Bob Roe"], [900], [], "k"),
    ]
    records = [
        (10, "LOSS OF FOO2 LINKS SEED DORMANCY TO CROP YEILD", ["A. Doe", "Roe, B."], [110], [], "k"),
        (11, "Correction", ["Bob Roe"], [505], [], "k"), (12, "Correction", ["No Body"], [505], [], "k"), (13, None, None, [], [], None),
        (14, "Something else entirely here", ["Ann Doe"], [100], ["a"], "k"), (15, "Correction", ["Bob Roe"], [800], [], "k"),
    ]
    got = {r.record_id: (r.work_id, r.confidence) for r in em.matches(spark.createDataFrame(records, schema), spark.createDataFrame(works, schema)).collect()}
    assert {k: v[0] for k, v in got.items()} == {10: 1, 11: 4}
    assert all(0.5 <= v[1] <= 1 for v in got.values())
    none = spark.createDataFrame([], schema)
    assert em.matches(none, spark.createDataFrame(works, schema)).count() == 0 and em.matches(spark.createDataFrame(records, schema), none).count() == 0
    # A third of all works under one title and one month
    name = lambda i: f"{2 * 'abcdefgh'[i % 8]}x{2 * 'klmnopqr'[i // 8]}urov Ann"
    many = [(100 + i, "Correction", [", ".join(name(i).split())], [500], [], "k") for i in range(60)]
    got = em.matches(spark.createDataFrame([(1, "Correction", [", ".join(name(7).split())], [510], [], "k")], schema), spark.createDataFrame(works + many, schema)).collect()
    assert [(r.record_id, r.work_id) for r in got] == [(1, 107)]


def test_close_vectors_share_a_block(spark):
    """Every pair within the radius of the title vectors is a candidate, by brute force."""
    import random

    r = random.Random(3)
    words = ["membrane", "repair", "quorum", "signalling", "phase", "separation", "cortical", "neurons", "transport", "autophagy", "marker", "yield", "season"]
    titles = [" ".join(r.sample(words, 6)) for _ in range(60)]
    near = [t.replace("e", "", 1) for t in titles]
    schema = "id bigint, title string, authors array<string>, days array<int>, doi array<string>"
    a = em.encoded(spark.createDataFrame([(i, t, [], [10], []) for i, t in enumerate(titles)], schema))
    b = em.encoded(spark.createDataFrame([(i, t, [], [10], []) for i, t in enumerate(near)], schema))
    got = {(x.record_id, x.work_id) for x in em.candidates(a, b).collect()}
    va, vb = ({x.id: x[em.TITLE[0]] for x in d.collect()} for d in (a, b))
    apart = lambda x, y: sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(x, y, strict=True))
    want = {(i, j) for i in va for j in vb if apart(va[i], vb[j]) < em.TITLE[2]}
    assert want and want <= got


def test_matches_without_names(spark):
    """A DOI, or a title that is alone at its time, stands for people that one side does not name."""
    schema = "id bigint, title string, authors array<string>, days array<int>, doi array<string>"
    title = "Loss of {} links seed dormancy to crop yield across {} populations"
    works = [
        (1, title.format("Foo2", "island"), None, [100], ["a"]), (2, title.format("Xsl9", "desert"), [], [100], []),
        (3, title.format("Gar26", "alpine"), None, [100], []), (4, title.format("Gar26", "alpine"), ["Roe, Bob"], [130], []), (5, title.format("Tsl7", "coastal"), ["Doe, Ann"], [100], []),
    ]
    records = [
        (10, title.format("Foo2", "island")[:45] + "...", ["A. Doe"], [110], ["a"]), (11, title.format("Xsl9", "desert").upper(), ["A. Doe"], [110], []),
        (12, title.format("Gar26", "alpine"), ["A. Doe"], [110], []), (13, title.format("Tsl7", "coastal"), None, [110], []), (14, title.format("Xsl9", "desert"), ["A. Doe"], [], []),
        (15, title.format("Xsl9", "desert"), ["A. Doe"], [400], []), (16, title.format("Foo2", "island"), ["A. Doe"], [110], []), (17, title.format("Tsl7", "coastal"), ["Doe, Ann"], [110], []),
    ]
    got = {r.record_id: (r.work_id, r.confidence) for r in em.matches(spark.createDataFrame(records, schema), spark.createDataFrame(works, schema)).collect()}
    assert {k: v[0] for k, v in got.items()} == {10: 1, 11: 2, 13: 5, 16: 1, 17: 5}
    assert got[13][1] < got[17][1]


def test_candidates_need_a_surname(spark):
    """Titles of one pattern do not meet each other: only rows with a surname in common, but for a slip, do."""
    schema = "id bigint, title string, authors array<string>, days array<int>, doi array<string>"
    name = lambda i: f"{2 * 'abcdefgh'[i % 8]}x{2 * 'klmnopqr'[i // 8]}urov"
    works = [(i, "A twin design reveals growth-related wound closure in thymic stroma", [f"{name(i)}, Ann"], [10], []) for i in range(60)]
    slip = "".join([name(7)[:4], name(7)[5:]])
    records = [(100, works[0][1], [f"{slip}, Ann"], [20], []), (101, works[0][1], ["Ann " + name(9)], [], []), (102, works[0][1], ["Ann Else"], [20], []), (103, works[0][1], ["Ann " + name(9)], [100], [])]
    r, w = em.encoded(spark.createDataFrame(records, schema)), em.encoded(spark.createDataFrame(works, schema))
    assert {(x.record_id, x.work_id) for x in em.candidates(r, w).collect()} == {(100, 7), (101, 9)}
    named = lambda names: spark.createDataFrame([(x,) for x in names], "name string")
    got = {tuple(x) for x in em.name_slips(named(["stofan", "smith", "moore", "abc"]), named(["stophan", "smtih", "smiths", "smyth", "smythe", "mure", "smith", "abd", "moora"])).collect()}
    assert got == {("stofan", "stophan"), ("smith", "smtih"), ("smith", "smiths"), ("smith", "smyth"), ("moore", "moora")}


def test_fit_and_reliability_use_all_pairs(spark, monkeypatch):
    """Weights and counts come from every decided pair, however many there are and whatever their tasks."""
    import numpy as np
    import pandas as pd

    n = 30_000
    rng = np.random.default_rng(1)
    good = rng.random(n) < 0.5
    df = pd.DataFrame({c: np.where(good, rng.random(n) * 0.5 + 0.5, rng.random(n) * 0.7) for c in em.FIELDS})
    df = df.assign(record_id=np.arange(n), days=rng.integers(0, 60, n), label=good.astype(int), same_doi=good)
    pairs = spark.createDataFrame(df)
    gradient = next(em._sums(em.calibrate(pairs.repartition(3)))([df]))["x"].to_numpy()[: len(em.PRIOR)]
    assert np.abs(gradient + em.FIRM * (em.calibrate(pairs) - em.PRIOR)).max() < 1e-3
    monkeypatch.setattr(em, "encoded", lambda x: x)
    monkeypatch.setattr(em, "compared", lambda *_: pairs)
    monkeypatch.setattr(em, "labelled", lambda x: x)
    got = em.reliability(spark.range(1), spark.range(1)).collect()
    held = pairs.where("pmod(xxhash64(record_id), 2) = 0").count()
    assert sum(r.pairs for r in got) == held > 14_000 and abs(sum(r.pairs * r.true_share for r in got) / held - 0.5) < 0.02
    assert em.calibrate(pairs.where("false")).tolist() == em.PRIOR.tolist()
