"""Matching records to works across sources without a shared key.

Titles, title beginnings and author lists are encoded as fixed bit vectors of the two-letter grams
of their words. Close pairs are found by surname: a record's surnames, and those of works that differ from
one by a slip, are join keys with the stretch of dates a pair must share, and the title vectors go along so
that only pairs with near titles and dates leave the join. Rows without a date meet in a join of their own,
without stretches. Where one side names nobody, multi-index Hamming hashing finds the pairs: a vector is cut
into RADIUS + 1 blocks, so two vectors within the radius agree in a block at least, and the blocks of title
and head are join keys with the stretch; a 64-bit fold of the vector goes along, whose distance never exceeds
the vectors' own. Equal DOIs are candidates too.

Field-weighted scores (Dice of the vectors, words and surnames matched one by one, days apart) become a
confidence by a logistic curve fitted on pairs that a DOI decides; an equal DOI adds fixed odds. The
confidence alone decides. ``reliability`` compares it with the share of true pairs on records held out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions.moments import calendar_day, date_parts, epoch_us
from litmill.llm.name_variants import HONORS, PARTICLES, SOUNDS, fold, parse_person, slip_kind
from litmill.session import settle, spread

#: Words of 64 bits and blocks (radius + 1) of each vector.
TITLE, HEAD, PEOPLE = ("title_bits", 4, 12), ("head_bits", 2, 6), ("people_bits", 4, 6)
HEAD_LETTERS = 26
#: A pair's dates lie within so many days; dates are keyed by stretches twice as long.
NEAR_DAYS = 60
CONFIDENT = 0.5
#: What an equal DOI adds to the log of the odds.
DOI_ODDS = 4.0
#: People in common that a pair is taken to have where one side names nobody.
UNNAMED = 0.6
#: How far a title goes that differs by a slip within a name with numbers, which may be another name.
DOUBTFUL = 0.6

# Words of notices before or after a title, words that carry none of it, names of Greek letters.
NOTICE = {"research", "original", "review", "short", "brief", "article", "report", "paper", "preprint", "re", "fwd", "title", "full", "text", "pdf", "reprint"}
LATER = {"version", "revised", "preprint", "accepted", "manuscript", "reprint", "pdf", "v"}
BEFORE = re.compile(r"^\W*([A-Za-z]{1,12}(?: [A-Za-z]{1,12}){0,2})(?:\s*[:\]]+\s*|\s*[\-–—]\s+|\s{2,})")
AFTER = re.compile(r"(?:\s+[\-–—]+\s*|\s*[,;]\s*|\s*[(\[]\s*|\s{2,})([A-Za-z]{1,12}(?: [A-Za-z]{1,12})?)\s*\d*\s*[)\]]?\W*$")
CUT = re.compile(r"(?:\.\.\.|…|\[\.\.\.\]|\(more\))\s*$")
STOP = {"a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "is", "of", "on", "or", "that", "the", "to", "with", "during", "after", "across"}
LONG_STOP = ("during", "after", "across")
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "κ": "kappa", "µ": "mu", "μ": "mu", "λ": "lambda", "σ": "sigma", "ω": "omega", "ε": "epsilon", "θ": "theta", "π": "pi"}


def edits(a: str, b: str) -> int:
    """Single edits and swaps of neighbours between two words; 9 if their lengths are more than two apart."""
    if abs(len(a) - len(b)) > 2:
        return 9
    before, now = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before2, before, now = before, now, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before2[j - 2] + 1)
            now.append(d)
    return now[-1]


@lru_cache(maxsize=200_000)
def _stop(w: str) -> bool:
    """Whether a word carries no meaning, also with a slip in a long one."""
    return w in STOP or any(abs(len(w) - len(k)) < 2 and edits(w, k) <= 1 for k in LONG_STOP)


@lru_cache(maxsize=50_000)
def _notice(w: str, later: bool) -> bool:
    """Whether a word belongs to a notice before or after a title, also with slips."""
    known = LATER if later else NOTICE
    return w in known or any(edits(w, k) <= 1 + (len(k) > 5) for k in known if len(k) > 4 and len(w) > 3)


def title_words(title: str | None) -> tuple[list[str], bool]:
    """(words that carry meaning, whether the title is marked as cut)."""
    if not title:
        return [], False
    t = html.unescape(html.unescape(title))
    t = re.sub(r"</?[a-zA-Z][^<>]*>", "", t)
    t = re.sub(r"&[amp;]{2,6}(?=\s|$)", " ", t)  # a damaged ampersand
    cut = bool(CUT.search(t))
    t = CUT.sub("", t)
    for pattern, later in ((BEFORE, False), (AFTER, True)):
        m = pattern.search(t)
        if m and all(_notice(w, later) for w in m[1].lower().split()):
            t = t[: m.start()] + t[m.end() :]
    t = fold(t)
    for a, b in GREEK.items():
        t = t.replace(a, b)
    return [w for w in re.findall(r"[a-z0-9]+", re.sub(r"(\d)[′']", r"\1", t)) if not _stop(w)], cut


@lru_cache(maxsize=200_000)
def _surname(name: str) -> str:
    return " ".join(w for w in parse_person(name)[0].split() if w not in PARTICLES and w not in HONORS)


def people_of(authors) -> list[str]:
    """Surnames, without accents, of an author list; nulls, blanks and repeats left out."""
    found = [_surname(name) for name in (authors if authors is not None else []) if name and name.strip()]
    return list(dict.fromkeys(x for x in found if x))


class Grams:
    """Bit vectors of the grams of words."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, int], int] = {}

    def word(self, w: str, bits: int) -> int:
        v = self.known.get((w, bits))
        if v is None:
            v = 0
            for i in range(max(len(w) - 1, 1)):
                h = 2166136261
                for c in w[i : i + 2]:
                    h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
                v |= 1 << ((h ^ (h >> 15)) % bits)
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[(w, bits)] = v
        return v

    def code(self, words: list[str], longs: int) -> list[int]:
        v = 0
        for w in words:
            v |= self.word(w, 64 * longs)
        return np.frombuffer(v.to_bytes(8 * longs, "little"), dtype=np.int64).tolist()


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    grams = Grams()
    for df in batches:
        rows = []
        for title, authors in zip(df["title"], df["authors"], strict=True):
            words, cut = title_words(title)
            people = people_of(authors)
            head, size = [], 0
            for w in words:
                if size >= HEAD_LETTERS:
                    break
                head.append(w[: HEAD_LETTERS - size])
                size += len(w)
            rows.append((words, cut, people, grams.code(words, TITLE[1]), grams.code(head, HEAD[1]), grams.code(people, PEOPLE[1])))
        out = pd.DataFrame(rows, columns=["words", "cut", "people", TITLE[0], HEAD[0], PEOPLE[0]])
        yield pd.concat([df[["id", "days", "doi"]].reset_index(drop=True), out], axis=1)


def encoded(works: DataFrame) -> DataFrame:
    """Bit vectors of (id, title, authors array<string>, days array<int>, doi array<string>)."""
    bits = ", ".join(f"{n} array<bigint>" for n, _, _ in (TITLE, HEAD, PEOPLE))
    return works.mapInPandas(_encode, f"id bigint, days array<int>, doi array<string>, words array<string>, cut boolean, people array<string>, {bits}")


def plain_doi(doi: Column) -> Column:
    """A DOI without its dressing: prefix words and addresses, blanks, a closing full stop, a version; null if none is left."""
    d = F.regexp_extract(F.lower(doi), r"(10[.\-]\d{4,9}/\S+)", 1)
    d = F.regexp_replace(F.regexp_replace(d, r"v\d+$", ""), r"[.,;)]+$", "")
    d = F.regexp_replace(d, r"[^a-z0-9/]", "")  # damaged marks do not matter
    return F.when(d != "", d)


def _masks(longs: int, blocks: int) -> list[list[int]]:
    out = []
    for b in range(blocks):
        v = sum(1 << i for i in range(64 * longs) if i % blocks == b)
        out.append(np.frombuffer(v.to_bytes(8 * longs, "little"), dtype=np.int64).tolist())
    return out


def stretches(by: int = 0) -> Column:
    """The stretches of a row's dates, or of all dates within ``by`` days of them."""
    at = lambda x: F.floor(x / (2 * NEAR_DAYS)).cast("int")
    return F.array_distinct(F.flatten(F.transform("days", lambda d: F.sequence(at(d - by), at(d + by)))))


def block_keys(rows: DataFrame, by: int = 0) -> DataFrame:
    """(key, fold, r, id, days): one row per block of title and head that has a gram, and per stretch of dates; vectors with few grams have none."""
    items = []
    for k, (name, longs, blocks) in enumerate((TITLE, HEAD)):
        at = [F.get(F.col(name), F.lit(i)) for i in range(longs)]
        fold_ = at[0]
        for x in at[1:]:
            fold_ = fold_.bitwiseXOR(x)
        size = sum((F.bit_count(x) for x in at), F.lit(0))
        for b, mask in enumerate(_masks(longs, blocks)):
            part = [x.bitwiseAND(F.lit(m)) for x, m in zip(at, mask, strict=True)]
            some = part[0]
            for x in part[1:]:
                some = some.bitwiseOR(x)
            items.append(F.when((some != 0) & (size > blocks), F.struct(F.xxhash64(F.lit(k), F.lit(b), *part).alias("k"), fold_.alias("fold"), F.lit(blocks - 1).alias("r"))))
    x = rows.withColumn("_x", F.explode(F.array_compact(F.array(*items)))).withColumn("_s", F.explode(stretches(by)))
    return x.select(F.xxhash64("_x.k", "_s").alias("key"), F.col("_x.fold").alias("fold"), F.col("_x.r").alias("r"), "id", "days")


def _slips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        yield df[[_slipped(a, b) for a, b in zip(df["name"], df["other"], strict=True)]]


def name_slips(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(name, other): pairs of a surname of ``asked`` and another of ``known`` that are one but for a slip.

    Surnames one edit apart are equal once at most one letter of each is left out; those of one sound are equal by it.
    """
    sound = F.col("name")
    for a, b in SOUNDS:
        sound = F.replace(sound, F.lit(a), F.lit(b))
    less = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.concat(F.substring("name", F.lit(1), i - 1), F.substring("name", i + 1, F.length("name"))))
    keyed = lambda df: df.where("length(name) > 4").distinct().select("name", F.explode(F.array_distinct(F.concat(F.array("name", F.concat(F.lit("~"), sound)), less))).alias("key"))
    near = keyed(asked).join(keyed(known).withColumnRenamed("name", "other"), "key").where("name <> other").select("name", "other").distinct()
    return near.mapInPandas(_slips, "name string, other string")


def dice(a: str, b: str, longs: int) -> Column:
    """Share of common bits of two vectors; 0 if both are empty."""
    both, total = F.lit(0), F.lit(0)
    for i in range(longs):
        x, y = F.get(F.col(a), F.lit(i)), F.get(F.col(b), F.lit(i))
        both, total = both + F.bit_count(x.bitwiseAND(y)), total + F.bit_count(x) + F.bit_count(y)
    return F.when(total > 0, 2.0 * both / total).otherwise(0.0)


def contained(a: str, b: str, longs: int) -> Column:
    """Share of the smaller vector's bits that the other has too; 0 if it is empty."""
    both, m, n = F.lit(0), F.lit(0), F.lit(0)
    for i in range(longs):
        x, y = F.get(F.col(a), F.lit(i)), F.get(F.col(b), F.lit(i))
        both, m, n = both + F.bit_count(x.bitwiseAND(y)), m + F.bit_count(x), n + F.bit_count(y)
    less = F.least(m, n)
    return F.when(less > 0, both / less).otherwise(0.0)


def empty(name: str, longs: int) -> Column:
    """Whether a vector has no bit."""
    return sum((F.bit_count(F.get(F.col(name), F.lit(i))) for i in range(longs)), F.lit(0)) == 0


def apart(a: str, b: str) -> Column:
    """Days between the nearest dates of two rows; null if one has none."""
    return F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.abs(x - y)))))


def near_titles(a: str, b: str) -> Column:
    """Whether two title vectors may be of one title, whole or cut."""
    return (dice(a, b, TITLE[1]) >= 0.5) | (contained(a, b, TITLE[1]) >= 0.7)


def named_pairs(records: DataFrame, works: DataFrame) -> DataFrame:
    """(record_id, work_id) that have a surname in common, but for a slip, near titles and, where both are dated, near dates; a pair may come several times."""
    people = lambda df: df.select("id", "days", TITLE[0], F.explode("people").alias("name"))
    asked, known = people(records), people(works)
    slips = name_slips(asked.select("name"), known.select("name")).groupBy("name").agg(F.collect_list("other").alias("others"))
    every = F.explode(F.concat(F.array("name"), F.coalesce("others", F.array().cast("array<string>"))))
    asked = asked.join(slips, "name", "left").select(F.col("id").alias("record_id"), "days", F.col(TITLE[0]).alias("r_title"), every.alias("name"))
    known = known.select(F.col("id").alias("work_id"), F.col("days").alias("w_days"), F.col(TITLE[0]).alias("w_title"), "name", "days")

    def meet(r: DataFrame, w: DataFrame, on: list[str]) -> DataFrame:
        both = r.join(w.drop("days"), on).where(near_titles("r_title", "w_title"))
        return both.where(F.coalesce(apart("days", "w_days") <= NEAR_DAYS, F.lit(True))).select("record_id", "work_id")

    dated = F.size("days") > 0
    found = meet(asked.withColumn("stretch", F.explode(stretches(NEAR_DAYS))), known.withColumn("stretch", F.explode(stretches())), ["name", "stretch"])
    # Rows without a date meet all rows of the other side, without stretches.
    if not records.where(~dated).isEmpty():
        found = found.unionByName(meet(asked.where(~dated), known, ["name"]))
    if not works.where(~dated).isEmpty():
        found = found.unionByName(meet(asked.where(dated), known.where(~dated), ["name"]))
    return found


def unnamed_pairs(records: DataFrame, works: DataFrame) -> DataFrame:
    """(record_id, work_id) of which one names nobody, that are close in title or head and in time; a pair may come several times."""

    def meet(r: DataFrame, w: DataFrame) -> DataFrame:
        return (
            block_keys(r, NEAR_DAYS).withColumnsRenamed({"id": "record_id", "fold": "rf", "r": "rr"})
            .join(block_keys(w).withColumnsRenamed({"id": "work_id", "fold": "wf", "days": "w_days"}).drop("r"), "key")
            .where((F.bit_count(F.col("rf").bitwiseXOR(F.col("wf"))) <= F.col("rr")) & (apart("days", "w_days") <= NEAR_DAYS))
            .select("record_id", "work_id")
        )

    nobody, found = F.size("people") == 0, None
    for r, w in ((records.where(nobody), works), (records.where(~nobody), works.where(nobody))):
        if not (r if w is works else w).isEmpty():
            found = meet(r, w) if found is None else found.unionByName(meet(r, w))
    return records.sparkSession.createDataFrame([], "record_id bigint, work_id bigint") if found is None else found


def candidates(records: DataFrame, works: DataFrame) -> DataFrame:
    """Distinct (record_id, work_id, same_doi) that have a surname in common or are close in a vector, and are near in time where both are dated, or that share a DOI."""
    close = named_pairs(records, works).unionByName(unnamed_pairs(records, works))
    by_doi = (
        records.select(F.col("id").alias("record_id"), F.explode("doi").alias("doi"))
        .join(works.select(F.col("id").alias("work_id"), F.explode("doi").alias("doi")), "doi")
        .select("record_id", "work_id")
    )
    every = close.withColumn("same_doi", F.lit(False)).unionByName(by_doi.withColumn("same_doi", F.lit(True)))
    return every.groupBy("record_id", "work_id").agg(F.max("same_doi").alias("same_doi"))


def scored(records: DataFrame, works: DataFrame) -> DataFrame:
    """Candidates with their field scores; ``days`` apart is null where a date is missing.

    Where one side names nobody (``unnamed``), the people are taken to agree by UNNAMED.
    The scores need the vectors only; words and names join the few pairs that pass.
    """
    bits = ["days", TITLE[0], PEOPLE[0]]
    side = lambda df, key, letter, names: df.select(F.col("id").alias(key), *[F.col(c).alias(f"{letter}_{c}") for c in names])
    pairs = candidates(records, works).join(side(records, "record_id", "r", bits), "record_id").join(side(works, "work_id", "w", bits), "work_id")
    days = apart("r_days", "w_days")
    unnamed = empty(f"r_{PEOPLE[0]}", PEOPLE[1]) | empty(f"w_{PEOPLE[0]}", PEOPLE[1])
    folk = lambda score: F.when(unnamed, F.lit(UNNAMED)).otherwise(score)
    near = pairs.select(
        "record_id", "work_id", "same_doi", days.alias("days"), unnamed.alias("unnamed"),
        dice(f"r_{TITLE[0]}", f"w_{TITLE[0]}", TITLE[1]).alias("title"),
        contained(f"r_{TITLE[0]}", f"w_{TITLE[0]}", TITLE[1]).alias("inside"),
        folk(dice(f"r_{PEOPLE[0]}", f"w_{PEOPLE[0]}", PEOPLE[1])).alias("people"),
        folk(contained(f"r_{PEOPLE[0]}", f"w_{PEOPLE[0]}", PEOPLE[1])).alias("among"),
    ).where(f"(days is null or days <= {NEAR_DAYS}) and (title >= 0.5 or inside >= 0.7 or same_doi) and (people >= 0.3 or among >= 0.5 or same_doi) and (same_doi or not unnamed or days is not null)")
    full = ["words", "cut", "people"]
    return near.join(side(records, "record_id", "r", full), "record_id").join(side(works, "work_id", "w", full), "work_id")


#: Fields of a pair: Dice and containment of title and people, whether the titles are one word by word and the share of words
#: matched, surnames in common, and both of these together.
FIELDS = ["title", "inside", "people", "among", "same", "share", "folk", "both"]


def _inputs(df: pd.DataFrame) -> np.ndarray:
    days = df["days"].astype(float).fillna(NEAR_DAYS / 2).clip(upper=200)
    return np.column_stack([*(df[c].astype(float) for c in FIELDS), days / 30.0, np.ones(len(df))])


#: Weights used where no DOI decides enough pairs, and how firmly the fitted ones are drawn towards them: the title and the
#: people must both agree; dates count against.
PRIOR, FIRM = np.array([1.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 10.0, -0.5, -7.0]), 20.0


def _sums(weights: np.ndarray):
    """For batches of labelled pairs: the gradient and the curvature of their log-likelihood, as one row of numbers for each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = len(weights)
        total = np.zeros(n + n * n)
        for df in batches:
            x, y = _inputs(df), df["label"].to_numpy(dtype=float)
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            total += np.concatenate([x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
        yield pd.DataFrame({"k": np.arange(len(total)), "x": total})

    return run


def calibrate(pairs: DataFrame) -> np.ndarray:
    """Logistic weights of the fields from all pairs with a label (DOI decides), drawn towards PRIOR. Tasks add up their pairs; only sums come to the driver."""
    w, n = PRIOR.copy(), len(PRIOR)
    rows = settle(pairs.select(*FIELDS, "days", "label"))
    if rows.isEmpty():
        return w
    for _ in range(30):
        sums = rows.mapInPandas(_sums(w), "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).toPandas().sort_values("k")["x"].to_numpy()
        g = sums[:n] + FIRM * (w - PRIOR)
        h = sums[n:].reshape(n, n) + np.diag(np.full(n, FIRM))
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def confidence(df: pd.DataFrame, weights: np.ndarray) -> np.ndarray:
    z = _inputs(df) @ weights + DOI_ODDS * df["same_doi"].to_numpy(dtype=float)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@lru_cache(maxsize=200_000)
def _alike(a: str, b: str) -> int:
    """2 if two words are one but for slips (two in long words), 1 if they may be, else 0.

    Names with numbers may only lose, double or swap signs; where their digits then differ, they may be other names.
    """
    if a == b:
        return 2
    digits = [sorted(c for c in x if c.isdigit()) for x in (a, b)]
    kind = slip_kind(a, b)
    if any(digits):
        if digits[0] == digits[1]:
            return 2 if kind == 2 or (kind == 1 and len(a) != len(b)) or (sorted(a) == sorted(b) and edits(a, b) <= 2) else 0
        return int(all(digits) and min(len(a), len(b)) > 2 and len(a) != len(b) and kind > 0)
    return 2 * (kind == 2 or (kind == 1 and min(len(a), len(b)) > 3) or (min(len(a), len(b)) > 4 and max(len(a), len(b)) > 5 and edits(a, b) <= 2))


def same_title(a: list[str], b: list[str], a_cut: bool, b_cut: bool) -> tuple[float, float]:
    """How far two titles are one but for the way they are written (1, DOUBTFUL or 0), and how much of the longer is matched.

    Words are matched in order; slips match, joined or parted words match by their letters. A word that
    only one of them has makes another title, unless it is one lost word or the end of a cut title.
    """
    if not a or not b:
        return 0.0, 0.0
    if "".join(a) == "".join(b):
        return 1.0, 1.0
    # Longest common order of words, by slips, once equal words at both ends are set aside.
    m, n = len(a), len(b)
    low = 0
    while low < min(m, n) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(m, n) - low and a[m - 1 - high] == b[n - 1 - high]:
        high += 1
    alike = {(i, j): _alike(a[i], b[j]) for i in range(low, m - high) for j in range(low, n - high)}
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for k in range(1, high + 1):
        best[m - k][n - k] = k
    for i in range(m - high, m + 1):
        for j in range(n - high, n + 1):
            best[i][j] = min(m - i, n - j)
    for i in range(m - high - 1, low - 1, -1):
        best[i][n - high :] = [high] * (high + 1)
        for j in range(n - high - 1, low - 1, -1):
            best[i][j] = max(best[i + 1][j] if i + 1 < m - high else high, best[i][j + 1] if j + 1 < n - high else high, 1 + (best[i + 1][j + 1] if i + 1 < m - high and j + 1 < n - high else high) if alike[i, j] else 0)
    lone_a, lone_b = [], []
    i = j = low
    last_a, last_b = low - 1, low - 1
    matched, sure = low + high, 1.0
    while i < m - high and j < n - high:
        if alike[i, j] and best[i][j] == 1 + (best[i + 1][j + 1] if i + 1 < m - high and j + 1 < n - high else high):
            last_a, last_b = i, j
            matched += 1
            sure = min(sure, 1.0 if alike[i, j] == 2 else DOUBTFUL)
            i, j = i + 1, j + 1
        elif (best[i + 1][j] if i + 1 < m - high else high) >= (best[i][j + 1] if j + 1 < n - high else high):
            lone_a.append(i)
            i += 1
        else:
            lone_b.append(j)
            j += 1
    lone_a += range(i, m - high)
    lone_b += range(j, n - high)
    if high:
        last_a, last_b = m - 1, n - 1
    share = matched / max(m, n)
    return sure * _differ(a, b, lone_a, lone_b, last_a, last_b, matched, a_cut or b_cut), share


def _differ(a: list[str], b: list[str], lone_a: list[int], lone_b: list[int], last_a: int, last_b: int, matched: int, cut: bool) -> bool:
    """Whether the words that only one title has leave the titles one."""
    x, y = "".join(a[k] for k in lone_a), "".join(b[k] for k in lone_b)
    if x == y or (lone_a and lone_b and slip_kind(x, y) and sorted(filter(str.isdigit, x)) == sorted(filter(str.isdigit, y))):
        return True
    tail_a = bool(lone_a) and lone_a[0] > last_a
    tail_b = bool(lone_b) and lone_b[0] > last_b
    if not lone_a and lone_b:  # a lost words
        if tail_b:
            return matched >= 2 and not _numbered(b[lone_b[0] : lone_b[0] + 1])
        return len(lone_b) == 1 and matched >= 3 and not any(c.isdigit() for c in b[lone_b[0]])
    if not lone_b and lone_a:
        if tail_a:
            return (cut or matched >= 2) and not _numbered(a[lone_a[0] :])
        return len(lone_a) == 1 and matched >= 3 and not any(c.isdigit() for c in a[lone_a[0]])
    # One is cut within a word.
    if len(lone_a) == 1 and tail_a and tail_b and b[lone_b[0]].startswith(a[lone_a[0]]):
        return matched >= 1
    return len(lone_b) == 1 and tail_b and tail_a and a[lone_a[0]].startswith(b[lone_b[0]]) and matched >= 1


def _numbered(words: list[str]) -> bool:
    """Whether words that follow a title make it another part."""
    return bool(words) and (words[0] in {"part", "ii", "iii", "iv", "follow", "continued", "erratum", "correction", "comment", "reply"} or len(words) > 4)


def _slipped(a: str, b: str) -> bool:
    """Whether two different surnames are one but for a slip."""
    return min(len(a), len(b)) > 4 and slip_kind(a, b) > 0


def _same_people(a: list[str], b: list[str]) -> float:
    """Share of the shorter list that the other holds, but for slips."""
    if not len(a) or not len(b):
        return 0.0
    short, long_ = (list(a), list(b)) if len(a) <= len(b) else (list(b), list(a))
    left = set(long_)
    hit = 0
    for s in short:
        t = s if s in left else next((x for x in left if _slipped(s, x)), None)
        if t is not None:
            left.discard(t)
            hit += 1
    return hit / len(short)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add the fields that need words and names."""
    for df in batches:
        same, share, folk = [], [], []
        for x in df.itertuples():
            f = UNNAMED if x.unnamed else _same_people(x.r_people, x.w_people)
            # Without anybody in common the titles do not matter.
            a, b = same_title(list(x.r_words), list(x.w_words), x.r_cut, x.w_cut) if f else (0.0, 0.0)
            folk.append(f)
            same.append(a)
            share.append(b)
        out = df[["record_id", "work_id", "same_doi", "unnamed", "days", "title", "inside", "people", "among"]].copy()
        out["same"], out["share"], out["folk"] = same, share, folk
        out["both"] = out["same"] * out["folk"]
        yield out


COMPARED = "record_id bigint, work_id bigint, same_doi boolean, unnamed boolean, days int, title double, inside double, people double, among double, same double, share double, folk double, both double"


def compared(records: DataFrame, works: DataFrame) -> DataFrame:
    """Candidates of encoded records and works with all fields."""
    return settle(scored(records, works).mapInPandas(_compare, COMPARED))


def labelled(pairs: DataFrame) -> DataFrame:
    """Pairs of the records whose DOI some similar work has: that decides which of them are true (``label``)."""
    named = pairs.where("not unnamed")
    decided = named.where("same_doi and (title >= 0.5 or inside >= 0.7)").select("record_id").distinct()
    return named.join(decided, "record_id", "left_semi").where("not same_doi or title >= 0.5 or inside >= 0.7").withColumn("label", F.col("same_doi").cast("int"))


def rivalled(judged: DataFrame, records: DataFrame, works: DataFrame) -> DataFrame:
    """(record_id, work_id) of pairs that hold by title and date alone, though another work fits the record or has the title at that time."""
    bare = judged.where("unnamed and not same_doi").select("record_id", "work_id")
    if bare.isEmpty():
        return bare
    fits = bare.join(judged.select("record_id", F.col("work_id").alias("other")), "record_id").where("other <> work_id")
    letters = F.xxhash64(F.array_join("words", ""))
    asked = bare.join(records.select(F.col("id").alias("record_id"), letters.alias("title"), F.col("days").alias("r_days")), "record_id")
    span = 2 * NEAR_DAYS
    at = lambda c, by: F.floor((F.col(c) + by) / span)
    asked = asked.withColumn("r_day", F.explode("r_days")).withColumn("stretch", F.explode(F.array_distinct(F.array(at("r_day", -NEAR_DAYS), at("r_day", NEAR_DAYS)))))
    titled = works.select(F.col("id").alias("other"), letters.alias("title"), F.explode("days").alias("w_day")).withColumn("stretch", at("w_day", 0))
    titles = asked.join(titled, ["title", "stretch"]).where(f"other <> work_id and abs(r_day - w_day) <= {NEAR_DAYS}")
    return fits.select("record_id", "work_id").unionByName(titles.select("record_id", "work_id")).distinct()


def matches(records: DataFrame, works: DataFrame) -> DataFrame:
    """(record_id, work_id, confidence): the one work of each record that has one.

    Both inputs have (id, title, authors array<string>, days array<int>, doi array<string>): title and authors
    may be null, days and doi empty; ids are taken to be unique. Candidates have similar titles or equal DOIs and
    dates within NEAR_DAYS where both are known; those with a confidence of CONFIDENT or more hold. A pair in which
    one side names nobody and no DOI agrees holds only if both are dated and no other work has the title at that time or
    fits the record. Of several works the one with the highest confidence is taken, then the nearest in time, then the smallest id.
    """
    r, w = settle(encoded(spread(records))), settle(encoded(spread(works)))
    pairs = compared(r, w)
    weights = calibrate(labelled(pairs))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = df[["record_id", "work_id", "same_doi", "unnamed", "days"]].copy()
            out["confidence"] = np.round(confidence(df, weights), 6)
            yield out[out["confidence"] >= CONFIDENT]

    judged = settle(pairs.mapInPandas(judge, "record_id bigint, work_id bigint, same_doi boolean, unnamed boolean, days int, confidence double"))
    sure = judged.join(rivalled(judged, r, w), ["record_id", "work_id"], "left_anti")
    best = F.max_by(F.struct("work_id", "confidence"), F.struct("confidence", -F.coalesce("days", F.lit(NEAR_DAYS)), -F.col("work_id")))
    return sure.groupBy("record_id").agg(best.alias("b")).select("record_id", "b.work_id", "b.confidence")


def reliability(records: DataFrame, works: DataFrame, bins: int = 5) -> DataFrame:
    """(bin, pairs, confidence, true_share): how the confidence without the DOI's odds agrees with what the DOI says, on all pairs of half of the decided records, fitted on all of the other half."""
    r, w = settle(encoded(spread(records))), settle(encoded(spread(works)))
    pairs = settle(labelled(compared(r, w)))
    held = F.pmod(F.xxhash64("record_id"), F.lit(2)) == 0
    weights = calibrate(pairs.where(~held))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            p = confidence(df.assign(same_doi=False), weights)
            yield pd.DataFrame({"bin": np.minimum((p * bins).astype(int), bins - 1), "p": p, "y": df["label"].to_numpy(dtype=float)})

    judged = pairs.where(held).mapInPandas(judge, "bin int, p double, y double")
    return judged.groupBy("bin").agg(F.count("*").alias("pairs"), F.round(F.avg("p"), 4).alias("confidence"), F.round(F.avg("y"), 4).alias("true_share"))


def record_rows(citations: DataFrame) -> DataFrame:
    meta = lambda k: F.col("meta").getItem(k)
    iso = F.regexp_replace(F.coalesce(F.get(meta("citation_online_date"), F.lit(0)), F.col("sitemap_lastmod")), "/", "-")
    return citations.select(
        F.col("record_id").cast("long").alias("id"), F.get(meta("citation_title"), F.lit(0)).alias("title"), meta("citation_author").alias("authors"),
        F.array_compact(F.array(F.unix_date(F.substring(iso, 1, 10).try_cast("date")))).alias("days"),
        F.coalesce(F.array_compact(F.transform(meta("citation_doi"), plain_doi)), F.array().cast("array<string>")).alias("doi"),
    )


def work_rows(papers: DataFrame, sources: DataFrame, authors: DataFrame) -> DataFrame:
    """Works with the days they are dated: online or submitted; else created, or a year before, as that date is sometimes late by one."""
    own = sources.groupBy(F.col("paper_id").alias("sid")).agg(F.array_sort(F.collect_set(plain_doi(F.col("doi")))).alias("doi"))
    folk = authors.select(F.col("paper_id").alias("aid"), F.transform("authors", lambda a: a["name"]).alias("authors")).dropDuplicates(["aid"])
    text = F.lower(F.trim("submitted_at"))
    p = papers.select("paper_id", "canonical_title", "online_at", "created_at", date_parts(text).alias("parts"), epoch_us(text).alias("us"))
    online, created = (F.unix_date(F.col(c).cast("date")) for c in ("online_at", "created_at"))
    submitted = F.coalesce(F.unix_date(calendar_day(F.col("parts"))), F.floor(F.col("us") / 86_400_000_000).cast("int"))
    days = F.array_compact(F.array(online, submitted))
    days = F.when(F.size(days) > 0, days).otherwise(F.array_compact(F.array(created, created - 365)))
    p = p.select(F.col("paper_id").cast("long").alias("id"), F.col("canonical_title").alias("title"), days.alias("days"))
    joined = p.join(own, F.col("id") == F.col("sid"), "left").join(folk, F.col("id") == F.col("aid"), "left")
    return joined.select("id", "title", "authors", "days", F.coalesce("doi", F.array().cast("array<string>")).alias("doi"))
