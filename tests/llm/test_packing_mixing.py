import itertools
import os
import random

import numpy as np
import pytest

from litmill.llm import mixing, packing, tokens


def sizes(spark, n=3000, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice([r.randint(1, 60), r.randint(1, 700), r.randint(400, 5000), 0]), r.getrandbits(47)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, n_tokens bigint, curve bigint")


def test_containers(spark):
    rows, df = sizes(spark)
    out = packing.packed(df, [("short", 512), ("long", 2048), (None, 5), ("bad", 0)], stretches=4).toPandas()
    true = {i: n for i, n, _ in rows}
    for kind, cap in (("short", 512), ("long", 2048)):
        k = out[out.container_kind == kind]
        assert k.groupby("container_id")["size"].sum().max() <= cap
        assert k.groupby("id")["size"].sum().to_dict() == true
        assert (k.groupby("id").size() == [max(1, -(-true[i] // cap)) for i in sorted(true)]).all()
        used, n = k["size"].sum(), k.container_id.nunique()
        assert used / (n * cap) > 0.97
    assert set(out.container_kind) == {"short", "long"} and out.container_id.nunique() == sum(out[out.container_kind == k].container_id.nunique() for k in ("short", "long"))


def test_containers_edges(spark):
    empty = spark.createDataFrame([], "id bigint, n_tokens bigint, curve bigint")
    assert packing.packed(empty, [("a", 5)]).count() == 0 and packing.packed(empty, []).count() == 0
    ties = spark.createDataFrame([(i, 5, 1) for i in range(100)], "id bigint, n_tokens bigint, curve bigint")
    assert packing.packed(ties, [("a", 10)]).toPandas().container_id.nunique() == 50


def test_hilbert_keys():
    rng = np.random.default_rng(0)
    p = rng.normal(size=(4000, tokens.DIMS))
    k = tokens.hilbert_keys(p)
    order = np.argsort(k)
    step = np.linalg.norm(np.diff(p[order], axis=0), axis=1).mean()
    assert step < 0.35 * np.linalg.norm(np.diff(p, axis=0), axis=1).mean()
    # Neighbouring cells of the curve differ in one coordinate by one.
    assert len(np.unique(k)) > 3990


def test_tokens(spark):
    if not os.path.exists(tokens.DEFAULT_TOKENIZER):
        pytest.skip("no tokenizer files")
    texts = [(1, "Hello world", "s"), (2, "", "s"), (3, None, None), (4, "x y " * 30_000, "s"), (5, "Hello world", "s")]
    out = {r.id: r for r in tokens.tokenised(spark.createDataFrame(texts, "id bigint, text string, source string"), "id", "text", "source").collect()}
    assert [out[i].n_tokens for i in (1, 2, 3)] == [2, 0, 0] and out[4].n_tokens > 50_000 and out[1].curve == out[5].curve
    enc = tokens.encoding(tokens.DEFAULT_TOKENIZER)
    assert enc.decode(enc.encode_ordinary(texts[3][1])) == texts[3][1]


def test_fit_budget_by_brute_force():
    r = random.Random(2)
    for _ in range(40):
        lengths = {r.randint(1, 30): r.randint(1, 3) for _ in range(4)}
        budget = r.randint(0, sum(n * c for n, c in lengths.items()) + 5)
        best = max(t for t in (sum(n * k for n, k in zip(lengths, ks, strict=True)) for ks in itertools.product(*[range(c + 1) for c in lengths.values()])) if t <= budget)
        take = mixing.fit_budget(lengths, budget)
        assert all(0 <= k <= lengths[n] for n, k in take.items())
        assert sum(n * k for n, k in take.items()) == best


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_DOCS", 50)
    r = random.Random(4)
    rows = [(i, "big", r.choice([10, 10, r.randint(5, 90)])) for i in range(4000)] + [(10_000 + i, "small", r.randint(5, 90)) for i in range(40)] + [(20_000, "other", 50), (20_001, "big", 0), (20_002, None, 5)]
    df = spark.createDataFrame(rows, "id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 3), ("absent", 0.1, 2), (None, 0.1, 1), ("other", None, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mixture(df, targets).toPandas()
    assert mix.id.is_unique and set(mix.source) == {"big", "small"}
    assert mix[mix.source == "big"].n_uses.max() == 1 and mix[mix.source == "small"].n_uses.max() <= 3
    tokens_ = (mix.n_tokens * mix.n_uses).groupby(mix.source).sum()
    assert abs(tokens_["small"] / tokens_.sum() - 0.2) < 0.002
    assert tokens_["small"] >= 3 * sum(n for _, s, n in rows if s == "small") - 90
    again = mixing.mixture(df.repartition(5), targets).toPandas()
    assert sorted(zip(mix.id, mix.n_uses, strict=True)) == sorted(zip(again.id, again.n_uses, strict=True))
    shares = {x.source: x for x in mixing.reached_shares(mixing.mixture(df, targets), targets).collect()}
    assert shares["absent"].tokens == 0 and abs(shares["big"].actual_share - 0.8) < 0.002
    assert mixing.mixture(df.limit(0), targets).count() == 0 and mixing.mixture(df, targets.limit(0)).count() == 0
