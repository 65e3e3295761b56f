"""Recall and precision of linking names and matching records on made-up cases whose truth is known."""

import random

from litmill.llm import entity_match as em
from litmill.llm import name_variants as nv

SYLLABLES = [a + b + c for a in ("b", "d", "fr", "g", "k", "l", "m", "n", "p", "r", "st", "t", "v", "z") for b in "aeiou" for c in ("l", "m", "n", "r", "s", "k")]
GIVEN = ["samuel", "katherine", "robert", "ingrid", "pavel", "yusuf", "margaret", "tomoko", "daniel", "elena", "hassan", "lucia", "oskar", "priya", "william", "zara"]
SHORT = {v[0]: k for k, v in nv.NICKNAMES.items()}


def slipped(w, r):
    i = r.randrange(1, len(w) - 1)
    return w[:i] + w[i + 1] + w[i] + w[i + 2 :] if w[i] != w[i + 1] else w[:i] + w[i] + w[i:]


def test_names(spark):
    r = random.Random(5)
    rows, truth = [], {}
    for i in range(150):
        last, first = "".join(r.sample(SYLLABLES, 3)).title(), r.choice(GIVEN).title()
        forms = [f"{first} {last}", f"{last}, {first}", f"Dr. {first} {last}", f"{last}, {first[0]}.", f"{first[0]} {last}", f"{first.upper()} {last.upper()}", f"{slipped(first.lower(), r).title()} {last}", f"{first} {slipped(last.lower(), r).title()}"]
        if first.lower() in SHORT:
            forms.append(f"{SHORT[first.lower()].title()} {last}")
        for k, f in enumerate(forms):
            if f not in truth:
                truth[f] = i
                rows.append(("person", f, 9 if k < 3 else 1))
    got = {(x.name_a, x.name_b) for x in nv.variant_pairs(nv.entities(spark.createDataFrame(rows, "kind string, name string, n bigint"))).collect()}
    names = sorted(truth)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if truth[a] == truth[b]}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.995 * len(got)


def test_matching(spark):
    r = random.Random(6)
    word = lambda: "".join(r.sample(SYLLABLES, r.randint(1, 3)))
    works, records, truth = [], [], {}
    for i in range(200):
        title = " ".join(word() for _ in range(r.randint(6, 10)))
        people = [f"{r.choice(GIVEN).title()} {''.join(r.sample(SYLLABLES, 3)).title()}" for _ in range(r.randint(1, 5))]
        day = r.randint(10_000, 15_000)
        works.append((i, title.capitalize(), people, [day] if i % 9 else [], [f"10.1/{i}"] if i % 3 else []))
        # Another work under the same title by other people, and another title by the same people.
        works.append((1000 + i, title.capitalize(), [f"Otto {''.join(r.sample(SYLLABLES, 3)).title()}"], [day + 3], []))
        works.append((2000 + i, " ".join(word() for _ in range(8)), people, [day + 5], []))
        words = title.split()
        said = r.choice([title.upper(), "Research article: " + title, " ".join(words[:-2]) + "...", " ".join(slipped(w, r) if len(w) > 5 and k == 2 else w for k, w in enumerate(words)), title])
        named = r.choice([people, people[::-1], [f"{p.split()[1]}, {p[0]}." for p in people]])
        records.append((i, said, named, [day + r.randint(-20, 20)] if i % 7 else [], [f"10.1/{i}"] if i % 6 else []))
        truth[i] = i
        records.append((5000 + i, " ".join(word() for _ in range(8)), people, [day], []))  # no work
    schema = "id bigint, title string, authors array<string>, days array<int>, doi array<string>"
    got = {x.record_id: x.work_id for x in em.matches(spark.createDataFrame(records, schema), spark.createDataFrame(works, schema)).collect()}
    right = sum(truth.get(k) == v for k, v in got.items())
    assert right >= 0.97 * len(truth) and right >= 0.99 * len(got)


def test_reliability(spark):
    schema = "id bigint, title string, authors array<string>, days array<int>, doi array<string>"
    none = spark.createDataFrame([], schema)
    assert em.reliability(none, none).count() == 0
    works = [(i, f"Loss of {SYLLABLES[i]}{SYLLABLES[i + 50]} links seed dormancy to crop yield", [f"Ann {SYLLABLES[i].title()}ov"], [100], [f"10.1/{i}"]) for i in range(40)]
    out = em.reliability(spark.createDataFrame(works, schema), spark.createDataFrame(works, schema)).orderBy("bin").collect()
    # Works that differ by a name and a slip of a surname are told apart, though few pairs are there to fit.
    assert [r.true_share for r in out] == sorted(r.true_share for r in out) and out[0].true_share <= 0.1 and out[-1].true_share >= 0.9
