"""Variant spellings of people and organisations, linked through canonical rewritings.

Every distinct spelling is read literally (titles, degrees, departments and acronyms fall away,
accents fold) and rewritten to every canonical form that rules allow: each full name of a nickname,
each long form of a legal or institutional abbreviation, the other token order, initials, and one
dropped letter for one slip of the keyboard. The forms are exploded and equi-joined with the names
that stand literally. How rare a rewriting is makes its score: the share of what it leads to among
all that the name could be rewritten to; a slip must be the rarer spelling, a name that stands beside
many surnames is no slip of another, and initials link only where they fit one full name. Spellings
that end on one canonical key name one entity; an entity's score at a spelling is the product of its
steps' scores.

Names are made distinct first, with counts, so a name that fills a third of all rows is one row here.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmill.session import settle

# Titles and degrees, name particles, and nicknames with the full names they stand for, the usual one first.
HONORS = {"dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "phd", "md", "msc", "bsc", "ma", "mba", "dphil", "dsc", "jr", "sr", "ii", "iii", "esq"}
PARTICLES = {"von", "van", "de", "der", "den", "del", "della", "di", "da", "dos", "du", "la", "le", "ter", "zu", "al", "el", "bin", "ibn"}
NICKNAMES = {
    "abby": ["abigail"], "al": ["albert", "alan", "alfred", "alexander"], "alex": ["alexander", "alexandra", "alexis"], "andy": ["andrew", "andreas"], "bec": ["rebecca"], "becky": ["rebecca"],
    "ben": ["benjamin", "benedict"], "beth": ["elizabeth", "bethany"], "betty": ["elizabeth"], "bill": ["william"], "billy": ["william"], "bob": ["robert"], "bobby": ["robert"],
    "cathy": ["catherine"], "charlie": ["charles", "charlotte"], "chris": ["christopher", "christine", "christina", "christian"], "chuck": ["charles"], "cindy": ["cynthia", "lucinda"],
    "dan": ["daniel"], "danny": ["daniel"], "dave": ["david"], "deb": ["deborah"], "debbie": ["deborah"], "dick": ["richard"], "don": ["donald"], "ed": ["edward", "edmund", "edwin"],
    "eddie": ["edward", "edmund"], "fred": ["frederick", "alfred"], "freddie": ["frederick"], "freddy": ["frederick"], "gabi": ["gabriella", "gabriele"], "gaby": ["gabriella"],
    "greg": ["gregory"], "harry": ["henry", "harold"], "jack": ["john", "jackson"], "jeff": ["jeffrey"], "jen": ["jennifer"], "jenny": ["jennifer"], "jim": ["james"], "jimmy": ["james"],
    "jo": ["josephine", "joanna", "joanne"], "joe": ["joseph"], "jon": ["jonathan"], "josie": ["josephine"], "kat": ["katherine"], "kate": ["katherine"], "kathy": ["katherine", "kathleen"],
    "katie": ["katherine"], "ken": ["kenneth", "kendall"], "larry": ["lawrence"], "liz": ["elizabeth"], "lizzie": ["elizabeth"], "maggie": ["margaret"], "matt": ["matthew"], "meg": ["margaret", "megan"],
    "mick": ["michael"], "mike": ["michael"], "nick": ["nicholas", "nicola"], "ollie": ["oliver"], "pat": ["patricia", "patrick"], "patty": ["patricia"], "peggy": ["margaret"], "pete": ["peter"],
    "phil": ["philip", "philippa"], "rich": ["richard"], "rick": ["richard", "frederick"], "rob": ["robert"], "ron": ["ronald"], "rosie": ["rosa", "rosemary"], "sam": ["samuel", "samantha"],
    "sandy": ["alexandra", "sandra", "alexander"], "sasha": ["alexander", "alexandra"], "sophie": ["sophia"], "steve": ["stephen", "steven"], "sue": ["susan", "suzanne"], "susie": ["susan"],
    "ted": ["edward", "theodore"], "theo": ["theodore"], "tim": ["timothy"], "tom": ["thomas"], "tommy": ["thomas"], "tony": ["anthony", "antonio"], "vic": ["victor", "victoria"], "vicky": ["victoria"],
    "will": ["william", "wilfred"], "zach": ["zachary"],
}
# Words of legal and institutional forms with their long forms, the usual one first, parts of an organisation, and words left out.
LEGAL = {
    "univ": ["university"], "university": ["university"], "universitat": ["university"], "universite": ["university"], "universidad": ["university"],
    "inst": ["institute", "institution"], "institute": ["institute"], "institut": ["institute"], "institution": ["institution"], "acad": ["academy", "academic"], "academy": ["academy"], "sci": ["science", "scientific"],
    "science": ["science"], "sciences": ["science"], "gen": ["general", "genetics"], "general": ["general"], "hosp": ["hospital"], "hospital": ["hospital"],
    "ctr": ["centre"], "cent": ["centre", "central"], "center": ["centre"], "centre": ["centre"], "coll": ["college"], "college": ["college"], "natl": ["national"],
    "national": ["national"], "med": ["medicine", "medical"], "medicine": ["medicine"], "res": ["research"], "research": ["research"], "tech": ["technology", "technical"],
    "technol": ["technology"], "technology": ["technology"], "lab": ["laboratory"], "laboratory": ["laboratory"], "mol": ["molecular"],
    "molecular": ["molecular"], "found": ["foundation"], "foundation": ["foundation"], "assoc": ["association"], "association": ["association"],
    "soc": ["society", "social"], "society": ["society"], "intl": ["international"], "international": ["international"], "co": ["company"], "company": ["company"],
    "corp": ["corporation"], "corporation": ["corporation"], "ltd": ["limited"], "limited": ["limited"], "biol": ["biology", "biological"], "biology": ["biology"],
    "ecol": ["ecology", "ecological"], "ecology": ["ecology"], "academic": ["academic"], "scientific": ["scientific"], "genetics": ["genetics"], "central": ["central"], "medical": ["medical"],
    "technical": ["technical"], "social": ["social"], "biological": ["biological"], "ecological": ["ecological"],
}
#: Readings that a spelling may have at most; no rule set above gives more for names of a few words. A longer product keeps the usual forms.
READINGS = 64
PARTS = {"dept", "department", "ward", "division", "div", "faculty", "unit", "section", "clinic", "school", "group", "lab", "laboratory", "room", "building", "floor"}
SKIPPED = {"of", "for", "the", "and", "at", "in", "de", "der", "des", "fur", "la", "le"}
# Spellings of one sound.
SOUNDS = [("oo", "u"), ("ph", "f"), ("ck", "k")]
#: A name is a slip of another if it stands beside at most this share of the other's counterparts; more if letters are swapped or doubled.
SLIP_SHARE, SWAP_SHARE = 0.2, 0.5
#: A rewriting links if its score is above this.
LEAST = 0.5


def fold(text: str) -> str:
    """Lower-case letters without accents."""
    t = text.casefold()
    if t.isascii():
        return t
    for a, b in (("ł", "l"), ("ø", "o"), ("đ", "d"), ("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ı", "i"), ("’", "'"), ("´", "'")):
        t = t.replace(a, b)
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def slip_kind(a: str, b: str) -> int:
    """0: not one edit apart. 2: letters swapped or doubled, or the same sound. 1: any other single edit."""
    x, y = a, b
    for sound, letter in SOUNDS:
        x, y = x.replace(sound, letter), y.replace(sound, letter)
    if a != b and x == y:
        return 2
    if a == b or abs(len(a) - len(b)) > 1:
        return 0
    if len(a) == len(b):
        at = [i for i in range(len(a)) if a[i] != b[i]]
        if len(at) == 1:
            return 1
        return 2 if len(at) == 2 and at[1] == at[0] + 1 and a[at[0]] == b[at[1]] and a[at[1]] == b[at[0]] else 0
    if len(a) > len(b):
        a, b = b, a
    for i in range(len(b)):
        if b[:i] + b[i + 1 :] == a:
            return 2 if (i > 0 and b[i] == b[i - 1]) or (i + 1 < len(b) and b[i] == b[i + 1]) else 1
    return 0


def parse_person(name: str) -> tuple[str, str, str, str]:
    """(anchor, varied, initials, seconds): surname with particles, joined given names as written or '', initials, and what may follow the first.

    seconds has the letters that stand alone after the first name; of a full name in several parts, their
    first letters follow after a dash.

    A name that has no such parts (groups, single words) is its own anchor.
    """
    text = fold(name)
    head, comma, tail = text.partition(",")
    words = lambda s: [w for w in re.findall(r"[^\W\d_]+(?:['][^\W\d_]+)*", s)]
    shown = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", name)
    if comma and not [w for w in words(tail) if w not in HONORS]:
        head, tail, comma = head, "", ""  # only a degree follows
    if comma:
        left = [w for w in words(head) if w not in HONORS]
        right = [w for w in words(tail) if w not in HONORS]
        surname = [w for w in left if w not in PARTICLES]
        loose = [w for w in right if w in PARTICLES and len(w) > 1]
        prefix = [w for w in left if w in PARTICLES] + loose
        given = [w for w in right if w not in loose]
    else:
        all_ = [w for w in words(head) if w not in HONORS]
        bare = words(head)
        proper = [w for w in all_ if w not in PARTICLES]
        if len(proper) == 1 and bare[-1:] != all_[-1:] and bare[:-1] == all_ and len(bare[-1]) <= 2 and shown[-1].isupper() and not shown[-2].isupper():
            all_ = bare  # "Doe MA" and "von Doe MD" have initials, not a degree
        if len(all_) < 2:
            return " ".join(all_) or text.strip(), "", "", ""
        last = all_[-1]
        # "Surname AB": short capitals at the end are initials.
        capital = next((s for s in reversed(shown) if fold(s) == last), "")
        if (len(last) <= 2 or (len(last) == 3 and not set(last) & set("aeiouy"))) and capital.isupper() and len(all_[0]) > 1 and not all(len(w) == 1 for w in all_[:-1]):
            surname = [w for w in all_[:-1] if w not in PARTICLES]
            prefix = [w for w in all_[:-1] if w in PARTICLES]
            given = list(last)
        else:
            k = next((i for i, w in enumerate(all_[1:], 1) if w in PARTICLES), len(all_) - 1)
            given, rest = all_[:k], all_[k:]
            prefix = [w for w in rest if w in PARTICLES]
            surname = [w for w in rest if w not in PARTICLES]
    if not surname or not given:
        return text.strip(), "", "", ""
    # Capitals such as "MW" behind a comma are initials too.
    if len(given) == 1 and 1 < len(given[0]) <= 3:
        shape = next((s for s in reversed(shown) if fold(s) == given[0]), "")
        if shape.isupper() and not any(s.isupper() and len(s) > 3 for s in shown):
            given = list(given[0])
    anchor = " ".join([*prefix, *surname])
    full = [w for w in given if len(w) > 1]
    initials = "".join(w[0] for w in given)
    if full:
        alone = "".join(w for w in given[1:] if len(w) == 1)
        return anchor, "".join(full), full[0][0], alone + "".join("-" + w[0] for w in full[1:])
    return anchor, "", initials, initials[1:]


def rewritten_person(name: str, anchor: str, varied: str) -> list[tuple[str, str, float]]:
    """Further canonical forms (anchor, varied, weight): full names of a nickname, the usual one weighing 1, and the other token order of two bare words."""
    if not varied:
        return []
    first = next((k for k in (varied, *(varied[:i] for i in range(len(varied) - 1, 1, -1))) if k in NICKNAMES and (k == varied or re.search(rf"(?<![^\W\d_]){k}(?![^\W\d_])", fold(name)))), None)
    out = [(anchor, full + varied[len(first) :], 1.0 if i == 0 else 0.9) for i, full in enumerate(NICKNAMES[first])] if first else []
    if "," not in name and " " not in anchor and re.fullmatch(r"\s*[^\W\d_]{2,}\s+[^\W\d_]{2,}\s*", name):
        out.append((varied, anchor, 0.8))
    return out


def read_organisation(name: str) -> tuple[tuple[str, str], list[tuple[str, str]]]:
    """(literal, readings): sorted words of its form and its proper words, with abbreviations of several meanings as written, and for every meaning, the usual ones first."""
    text = re.sub(r"\([^()]*\)", " ", fold(name))
    parts = [re.findall(r"[^\W_]+", p) for p in text.split(",")]
    whole = [p for p in parts if p and not (PARTS & set(p) and len(parts) > 1 and any(q for q in parts if q is not p and q))] or [p for p in parts if p]
    written, forms, proper = [], [], []
    for w in (w for p in whole for w in p if w not in SKIPPED):
        long = LEGAL.get(w)
        if long is None and len(w) > 4:
            long = next((v for k, v in LEGAL.items() if len(k) > 4 and slip_kind(w, k)), None)
        if long:
            forms.append(long)
            written.append(long[0] if len(long) == 1 else w + ".")
        else:
            proper.append(w)
    if np.prod([len(x) for x in forms], dtype=float) > READINGS:
        forms = [x[:1] for x in forms]
    rest = " ".join(sorted(proper))
    return (" ".join(sorted(written)), rest), list(dict.fromkeys((" ".join(sorted(x)), rest) for x in itertools.product(*forms)))


def parse_organisation(name: str) -> tuple[str, str, str, str]:
    """(anchor, varied, '', '') of the usual reading."""
    return (*read_organisation(name)[1][0], "", "")


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        rows = []
        for kind, name in zip(df["kind"], df["name"], strict=True):
            if kind == "person":
                own = parse_person(name)
                more = rewritten_person(name, *own[:2])
            else:
                literal, readings = read_organisation(name)
                own, more = (*literal, "", ""), [(*x, 0.9 if i else 1.0) for i, x in enumerate(readings) if x != literal]
            rows.append((*own, [{"anchor": x, "varied": y, "weight": w, "place": i} for i, (x, y, w) in enumerate(more)]))
        out = pd.DataFrame(rows, columns=["anchor", "varied", "initials", "seconds", "forms"])
        yield pd.concat([df.reset_index(drop=True), out], axis=1)


def resolve_forms(parsed: DataFrame, keys: DataFrame) -> DataFrame:
    """(kind, anchor, varied, base_anchor, base_varied, score) of names that a rule rewrites to another canonical form.

    All forms are exploded and joined with the names that stand literally (``keys``). A form's score is
    its weight times its share of the occurrences of all forms that the name may be rewritten to, so
    a rewriting that only one known name answers scores highest, and one of two equal ones does not link. A nickname
    or an abbreviation of which no long form is known takes its usual one; the other token order needs a name that is known by it,
    and counts only as far as the surname it gives stands beside more names than the one as written.
    """
    names = ["kind", "anchor", "varied"]
    forms = parsed.select(*names, F.explode("forms").alias("f")).select(*names, F.col("f.anchor").alias("base_anchor"), F.col("f.varied").alias("base_varied"), F.col("f.weight").alias("weight"), F.col("f.place").alias("place")).distinct()
    beside = keys.where("kind = 'person'").groupBy("anchor").agg(F.count("*").alias("beside"))
    known = keys.select("kind", F.col("anchor").alias("base_anchor"), F.col("varied").alias("base_varied"), "n")
    turned = (F.col("kind") == "person") & (F.col("anchor") != F.col("base_anchor"))
    hits = forms.join(known, ["kind", "base_anchor", "base_varied"], "left").where(~turned | F.col("n").isNotNull())
    hits = hits.join(beside.withColumnRenamed("beside", "own"), "anchor", "left").join(beside.withColumnsRenamed({"anchor": "base_anchor", "beside": "theirs"}), "base_anchor", "left")
    hits = hits.withColumn("weight", F.col("weight") * F.when(turned, F.col("theirs") / (F.col("theirs") + F.col("own") - 1)).otherwise(1.0))
    per = hits.groupBy(*names).agg(F.sum(F.coalesce("n", F.lit(0))).alias("all"))
    score = F.col("weight") * F.when(F.col("all") > 0, F.coalesce("n", F.lit(0)) / F.col("all")).when(F.col("place") == 0, 1.0).otherwise(0.0)
    best = hits.join(per, names).withColumn("score", score).where(F.col("score") > LEAST).groupBy(*names).agg(
        F.max_by(F.struct("base_anchor", "base_varied", "score"), F.struct("score", -F.col("place"))).alias("b")
    )
    return best.select(*names, "b.base_anchor", "b.base_varied", "b.score")


def distinct_names(papers_authors: DataFrame, citations: DataFrame) -> DataFrame:
    """(kind, name, n) of all spellings, trimmed, without null and blank ones."""
    author = papers_authors.select(F.explode("authors").alias("a"))
    names = author.select(F.lit("person").alias("kind"), F.col("a.name").alias("name"))
    places = author.select(F.lit("organisation").alias("kind"), F.explode("a.affiliations").alias("name"))
    meta = lambda key, kind: citations.select(F.lit(kind).alias("kind"), F.explode(F.col("meta").getItem(key)).alias("name"))
    every = names.unionByName(places).unionByName(meta("citation_author", "person")).unionByName(meta("citation_author_institution", "organisation"))
    trimmed = F.regexp_replace("name", r"^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$", "")
    return every.select("kind", trimmed.alias("name")).where("name <> ''").groupBy("kind", "name").agg(F.count("*").alias("n"))


def _kind_of_slip(pairs: DataFrame, a: str, b: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            df["slip"] = [slip_kind(x, y) for x, y in zip(df[a], df[b], strict=True)]
            yield df

    schema = ", ".join([*(f"`{c}` {t}" for c, t in pairs.dtypes), "slip int"])
    return pairs.mapInPandas(run, schema).where("slip > 0")


def _dropped(word: Column) -> Column:
    """Array of the word and all words with one letter dropped, as it is and with its sounds spelled alike; short words stay whole."""

    def less(w: Column) -> Column:
        n = F.length(w)
        out = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, n)))
        return F.when(n > 3, F.concat(F.array(w), out)).otherwise(F.array(w))

    alike = word
    for sound, letter in SOUNDS:
        alike = F.replace(alike, F.lit(sound), F.lit(letter))
    return F.array_distinct(F.concat(less(word), less(alike)))


def resolve_slips(keys: DataFrame) -> DataFrame:
    """(kind, anchor, varied, base_anchor, base_varied, score) for keys that are a slip of a more common one.

    ``keys`` has (kind, anchor, varied, n, spellings). The slip may be in the varied part (given name;
    an organisation's proper words) or in a person's anchor (surname). A slipped surname has no given names
    of its own: all but SLIP_SHARE of them, without their slips, stand beside the other too. The score is the
    base's share of the counterparts of both (of the occurrences, where both have the same), and never below LEAST.
    """
    beside_varied = keys.where("kind = 'person'").groupBy("kind", "varied").agg(F.count_distinct("anchor").alias("beside"))
    k = settle(keys.join(beside_varied, ["kind", "varied"], "left").fillna({"beside": 1}))

    def close(k: DataFrame, fixed: str, moving: str, *more: str) -> DataFrame:
        x = k.where(F.length(moving) > 3).withColumn("form", F.explode(_dropped(F.col(moving))))
        cols = ["anchor", "varied", "n", "spellings", *more]
        a = x.select("kind", fixed, "form", *[F.col(c).alias(f"a_{c}") for c in cols])
        b = x.select("kind", fixed, "form", *[F.col(c).alias(f"b_{c}") for c in cols])
        pairs = a.join(b, ["kind", fixed, "form"]).where(F.col(f"a_{moving}") != F.col(f"b_{moving}")).drop("form", fixed).distinct()
        return _kind_of_slip(pairs, f"a_{moving}", f"b_{moving}")

    order = lambda x, *first: F.struct(*[F.col(f"{x}_{c}").alias(c) for c in (*first, "n", "anchor", "varied")])
    rarer = order("a") < order("b")
    person, swapped = F.col("kind") == "person", F.col("slip") == 2
    few = F.col("a_beside") <= F.when(swapped, F.col("b_beside") * SWAP_SHARE).otherwise(F.greatest(F.lit(1), F.col("b_beside") * SLIP_SHARE))
    alone = (F.col("a_beside") == 1) & (F.col("b_beside") == 1) & swapped & rarer
    in_given = settle(close(k, "anchor", "varied", "beside").where((person & ((few & (F.col("a_beside") < F.col("b_beside"))) | alone)) | (~person & rarer)))
    # How often a slip occurs grows with the rows, so a slipped surname is known by its names, not by their number.
    proper = in_given.where(person).groupBy(F.col("a_varied").alias("varied")).agg(F.max_by("b_varied", F.struct("b_beside", "b_varied")).alias("given"))
    people = k.where("kind = 'person' and varied <> ''").join(proper, "varied", "left").withColumn("given", F.coalesce("given", "varied"))
    names = people.groupBy("anchor").agg(F.count_distinct("given").alias("names"))
    near = settle(close(people.join(names, "anchor"), "varied", "anchor", "names").where(order("a", "names") < order("b", "names")))
    own = people.select("anchor", "given").distinct()
    shared = (
        near.select("a_anchor", "b_anchor").distinct()
        .join(own.withColumnRenamed("anchor", "a_anchor"), "a_anchor")
        .join(own.withColumnRenamed("anchor", "b_anchor"), ["b_anchor", "given"])
        .groupBy("a_anchor", "b_anchor").agg(F.count("*").alias("shared"))
    )
    in_surname = near.join(shared, ["a_anchor", "b_anchor"]).where(F.col("shared") >= F.col("a_names") * (1 - SLIP_SHARE))
    ends = ["kind", "a_anchor", "a_varied", "b_anchor", "b_varied", "b_n"]
    rarity = lambda c: F.when(F.col(f"a_{c}") == F.col(f"b_{c}"), F.col("b_n") / (F.col("a_n") + F.col("b_n"))).otherwise(F.col(f"b_{c}") / (F.col(f"a_{c}") + F.col(f"b_{c}")))
    both = in_given.select(*ends, rarity("beside").alias("score")).unionByName(in_surname.select(*ends, rarity("names").alias("score")))
    best = both.groupBy("kind", "a_anchor", "a_varied").agg(F.max_by(F.struct("b_anchor", "b_varied", "score"), F.struct("b_n", "b_anchor", "b_varied")).alias("b"))
    return best.select(
        "kind", F.col("a_anchor").alias("anchor"), F.col("a_varied").alias("varied"), F.col("b.b_anchor").alias("base_anchor"), F.col("b.b_varied").alias("base_varied"),
        F.greatest("b.score", F.lit(LEAST)).alias("score"),
    )


def _follow(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """Replace keys by the base that a step leads to, and multiply the scores."""
    s = steps.select("kind", "anchor", "varied", "base_anchor", "base_varied", F.col("score").alias("_step"))
    out = rows.join(s, ["kind", "anchor", "varied"], "left")
    return out.withColumns(
        {"anchor": F.coalesce("base_anchor", "anchor"), "varied": F.coalesce("base_varied", "varied"), "score": F.col("score") * F.coalesce("_step", F.lit(1.0))}
    ).drop("base_anchor", "base_varied", "_step")


def entities(names: DataFrame) -> DataFrame:
    """(kind, name, n, entity, score) of (kind, name, n): spellings of one entity share ``entity``.

    ``score`` is 1 for a literal form and less the less sure the rewritings are that lead to the entity.
    Names in which nothing can be read (groups, single words) are linked only with those that fold to
    the same letters. Initials that fit several full names, or none, link only with equal initials.
    """
    columns = "kind string, name string, n bigint, anchor string, varied string, initials string, seconds string, forms array<struct<anchor:string,varied:string,weight:double,place:int>>"
    parsed = settle(names.mapInPandas(_parse, columns))
    full = parsed.where("kind = 'organisation' or varied <> ''")
    literal = full.groupBy("kind", "anchor", "varied").agg(F.sum("n").alias("n"))
    full = settle(_follow(full.withColumn("score", F.lit(1.0)).drop("forms"), resolve_forms(full, literal)))
    keys = full.groupBy("kind", "anchor", "varied").agg(F.sum("n").alias("n"), F.count("*").alias("spellings"))
    slip = settle(resolve_slips(keys))
    # A slip of a slip takes two steps, made on the few slips.
    onward = slip.select("kind", F.col("base_anchor").alias("to_anchor"), F.col("base_varied").alias("to_varied"), "anchor", "varied", "score")
    further = slip.select("kind", F.col("anchor").alias("to_anchor"), F.col("varied").alias("to_varied"), F.col("base_anchor").alias("end_anchor"), F.col("base_varied").alias("end_varied"), F.col("score").alias("more"))
    ends = onward.join(further, ["kind", "to_anchor", "to_varied"], "left").select(
        "kind", "anchor", "varied", F.coalesce("end_anchor", "to_anchor").alias("base_anchor"), F.coalesce("end_varied", "to_varied").alias("base_varied"), (F.col("score") * F.coalesce("more", F.lit(1.0))).alias("score")
    )
    full = settle(_follow(full, ends))
    person = full.where("kind = 'person'")
    # What is known of each full name: its first letter, and the letters that followed it somewhere.
    follow = person.where("seconds <> ''").groupBy("anchor", "varied").agg(
        F.collect_set(F.when(~F.col("seconds").startswith("-"), F.substring("seconds", 1, 1))).alias("known"),
        F.collect_set(F.when(F.col("seconds").contains("-"), F.substring_index("seconds", "-", -1))).alias("parts"),
    )
    base = person.select("anchor", "varied", F.substring("varied", 1, 1).alias("first")).distinct().join(follow, ["anchor", "varied"], "left")
    short = parsed.where("kind = 'person' and varied = '' and initials <> ''")

    def fit(rows: DataFrame, to: DataFrame) -> DataFrame:
        # rows: (anchor, initials, seconds) with ``to``: candidate full names under the same anchor
        second = F.substring("seconds", 1, 1)
        known = F.coalesce("known", F.array())
        agrees = (second == "") | (F.size(known) == 0) | F.array_contains(known, second) | F.array_contains(F.coalesce("parts", F.array()), second)
        hits = rows.select("anchor", "initials", "seconds", F.substring("initials", 1, 1).alias("first")).distinct().join(to, ["anchor", "first"]).where(agrees)
        sure = hits.withColumn("exact", (second != "") & (F.array_contains(known, second) | F.array_contains(F.coalesce("parts", F.array()), second)))
        best = sure.groupBy("anchor", "initials").agg(
            F.count_distinct("base_anchor", "varied").alias("m"), F.sum(F.col("exact").cast("int")).alias("e"),
            F.max_by(F.struct("base_anchor", "varied"), F.col("exact").cast("int")).alias("b"),
        )
        # The rarer the full names are that fit, the surer; of several that fit, one by its other initial.
        fits = F.when(F.col("m") == 1, 1.0).otherwise(1.0 / (1.0 + 0.5 * (F.col("m") - 1)))
        return best.where("m = 1 or e = 1").select("anchor", "initials", F.col("b.base_anchor").alias("base_anchor"), F.col("b.varied").alias("base_varied"), F.round(fits, 4).alias("fits"))

    base = settle(base)
    # Surnames that only ever stand with initials may be slips of a surname with full names.
    alone = short.join(base.select("anchor").distinct(), "anchor", "left_anti")
    forms = alone.select("anchor", F.explode(_dropped(F.col("anchor"))).alias("form")).distinct()
    near = forms.join(base.select(F.col("anchor").alias("base_anchor"), F.explode(_dropped(F.col("anchor"))).alias("form")).distinct(), "form")
    near = _kind_of_slip(near.select("anchor", "base_anchor").distinct(), "anchor", "base_anchor").select("anchor", "base_anchor")
    # A surname either has full names of its own or is such a slip, so one pass fits both.
    slipped = base.withColumnRenamed("anchor", "base_anchor").join(near, "base_anchor")
    found = settle(fit(short, base.withColumn("base_anchor", F.col("anchor")).unionByName(slipped)))
    placed = short.join(found, ["anchor", "initials"], "left")
    # Initials without a full name: the shorter ones follow the longer ones if those are of one kind.
    lone = placed.where("base_varied is null").select("anchor", "initials").distinct()
    longer = lone.where(F.length("initials") > 1).groupBy("anchor", F.substring("initials", 1, 1).alias("first")).agg(F.count("*").alias("m"), F.min("initials").alias("long"))
    lone_key = F.when((F.length("initials") == 1) & (F.col("m") == 1), F.col("long")).otherwise(F.col("initials"))
    placed = placed.withColumn("first", F.substring("initials", 1, 1)).join(longer, ["anchor", "first"], "left")
    short_out = placed.select(
        "kind", "name", "n",
        F.when(F.col("base_varied").isNotNull(), F.concat_ws("|", "base_anchor", "base_varied")).otherwise(F.concat_ws("|", F.lit("."), "anchor", lone_key)).alias("entity"),
        F.when(F.col("base_varied").isNotNull(), F.col("fits")).when(lone_key != F.col("initials"), LEAST).otherwise(1.0).alias("score"),
    )
    # One given name with several middle letters names several people; the form without one then belongs to none of them.
    middle = person.where("seconds <> '' and not startswith(seconds, '-')").select("anchor", "varied", F.substring("seconds", 1, 1).alias("mid")).distinct()
    several = middle.groupBy("anchor", "varied").agg(F.count("*").alias("mids")).where("mids > 1")
    mid = F.when((F.coalesce(F.col("mids"), F.lit(0)) > 1) & ~F.col("seconds").startswith("-"), F.substring("seconds", 1, 1))
    full_out = full.join(several, ["anchor", "varied"], "left").select(
        "kind", "name", "n", F.concat_ws("|", "anchor", "varied", F.when(F.col("kind") == "person", mid)).alias("entity"), F.round("score", 4).alias("score")
    )
    bare = parsed.where("kind = 'person' and varied = '' and initials = ''").select("kind", "name", "n", F.concat_ws("|", F.lit("="), "anchor").alias("entity"), F.lit(1.0).alias("score"))
    # Written, as users join the result with itself.
    return settle(full_out.unionByName(short_out).unionByName(bare))


def variant_pairs(named: DataFrame) -> DataFrame:
    """(entity_kind, name_a, name_b), smaller first by code point, of the spellings of one entity."""
    n = named.select("kind", "entity", "name")
    pairs = n.withColumnRenamed("name", "name_a").join(n.withColumnRenamed("name", "name_b"), ["kind", "entity"]).where("name_a < name_b")
    return pairs.select(F.col("kind").alias("entity_kind"), "name_a", "name_b").distinct()
