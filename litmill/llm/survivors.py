"""Best representative of each duplicate group, field by field.

Fields are unpivoted to long rows (group, field, row, value). Values that are not whole
(null, blank, stand-ins, cut short, garbled, with markup) get no vote. A row votes for
its normalised value with its source's trust times a recency decay; votes are summed per
value, the winner of a field is taken by ``max_by``, and the fields are pivoted back.

Votes are kept as powers of two relative to the strongest vote of their field, so that
very steep trusts and decays neither overflow nor lose their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.session import settle

# What stands in for a missing title or abstract, without marks and in lower case.
STAND_INS = [
    "abstract", "abstract not available", "abstract not provided", "abstract unavailable", "abstract pending",
    "abstract to follow", "error", "missing", "n a", "na", "nan", "nil", "no abstract", "no abstract available",
    "no abstract provided", "no title", "no title available", "no title provided", "none", "not applicable",
    "not available", "not provided", "null", "pending", "placeholder", "see full text", "see pdf", "tba", "tbc",
    "tbd", "test", "title", "title not available", "title pending", "title tba", "title to follow", "title unavailable",
    "to be announced", "to be confirmed", "undefined", "unknown", "unknown title", "untitled", "untitled document",
    "x", "xx", "xxx",
]
# Words that do not end a whole title.
OPEN_WORDS = [
    "a", "across", "after", "among", "an", "and", "are", "as", "at", "before", "between", "but", "by", "during",
    "for", "from", "in", "into", "is", "nor", "of", "on", "or", "over", "that", "the", "their", "through", "to",
    "under", "versus", "via", "whereas", "which", "while", "with", "within", "without",
]

CUT_MARK = r"(?i)(?:\.\.\.|…|\[\s*(?:\.\.\.|…|more)\s*\]|\(\s*(?:more|continued|\.\.\.|…)\s*\)|read more)\s*$"
MARKUP = r"(?i)</?[a-z][a-z0-9:]*(?:\s[^<>]*)?/?>|&(?:lt|gt|amp|quot|apos|nbsp|#\d{1,6}|#x[0-9a-f]{1,5});|\\(?:textit|textbf|emph|mathrm)\b"
#: Replacement characters, control characters, and UTF-8 read as a one-byte encoding.
GARBLED = r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x{80}-\x{9F}]|[ÃÂâÎÏÐÑ][\x{80}-\x{BF}€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œŸ]"


def plain(value: Column) -> Column:
    """Lower-case words of a value, joined by single blanks."""
    return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " "))


def presentable(value: Column) -> Column:
    """Whether a value is neither missing, a stand-in, marked as cut, garbled nor left with markup; never null."""
    words = plain(value)
    ok = (words != "") & ~words.isin(STAND_INS) & ~value.rlike(CUT_MARK) & ~value.rlike(MARKUP) & ~value.rlike(GARBLED)
    return F.coalesce(ok, F.lit(False))


def ends_sentence(value: Column) -> Column:
    """Whether running text ends as a sentence does, so that it is not cut."""
    return value.rlike(r"""[.!?。！？]["'”’»)\]]*\s*$""")


def ends_openly(value: Column) -> Column:
    """Whether a title ends in a word that must be followed by another."""
    return F.element_at(F.split(plain(value), " "), -1).isin(OPEN_WORDS)


def cut_titles(titles: DataFrame, group: str, id_col: str, title: str) -> DataFrame:
    """(id) of titles that are the beginning of another title of their group, also within a word.

    Every title lists its beginnings (all words but the last so far, next word); a title is cut if another
    has its first words and goes on with a word that starts with its last. That is an equi-join on
    (group, hash of the first words); beginnings are made distinct first, so copies cost one row.
    """
    t = titles.select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.split(plain(F.col(title)), " ").alias("w")).where("w[0] <> ''")
    head = lambda n: F.xxhash64(F.concat_ws(" ", F.slice("w", 1, n)))
    size = F.size("w")
    goes_on = (
        t.select("g", "w")
        .distinct()
        .withColumn("i", F.explode(F.sequence(F.lit(1), size)))
        .select("g", F.xxhash64(F.concat_ws(" ", F.expr("slice(w, 1, i - 1)"))).alias("h"), F.expr("w[i - 1]").alias("next"), (F.col("i") < size).alias("more"))
        .distinct()
    )
    ends = t.select("g", "id", head(size - 1).alias("h"), F.element_at("w", -1).alias("tail")).alias("e")
    n = goes_on.alias("n")
    longer = (F.length("n.next") > F.length("e.tail")) | F.col("n.more")
    on = (F.col("e.g") == F.col("n.g")) & (F.col("e.h") == F.col("n.h")) & F.col("n.next").startswith(F.col("e.tail")) & longer
    return ends.join(n, on, "left_semi").select("id")


def votes(long: DataFrame, trust_log2: Column, half_life_us: float) -> DataFrame:
    """(grp, field, id): the winning row of each field of each group.

    ``long`` has (grp, field, id, norm, updated_us) and what ``trust_log2`` reads. A vote is
    2 ** (trust_log2 + updated_us / half_life_us); a null trust or time counts as the lowest possible.
    The row shown for the winning value is the one with the strongest vote; ties go to the smallest id.
    """
    x = F.coalesce(trust_log2, F.lit(0.0)) + F.coalesce(F.col("updated_us"), F.lit(0)) / F.lit(float(half_life_us))
    v = long.withColumn("x", x)
    top = v.groupBy("grp", "field").agg(F.max("x").alias("top"))
    power = F.pow(F.lit(2.0), F.greatest(F.col("x") - F.col("top"), F.lit(-1000.0)))
    values = (
        v.join(top, ["grp", "field"])
        .groupBy("grp", "field", "norm")
        .agg(F.sum(power).alias("votes"), F.max_by("id", F.struct("x", -F.col("id"))).alias("id"), F.max("x").alias("x"))
    )
    return values.groupBy("grp", "field").agg(F.max_by("id", F.struct("votes", "x", -F.col("id"))).alias("id"), F.max("votes").alias("votes"))


def survivors(
    rows: DataFrame, group: str, id_col: str, titles: list[str], texts: list[str], trust_log2: Column, updated: str, half_life_us: float, least_rows: int = 2
) -> DataFrame:
    """(grp, field, id, votes): for each group of ``least_rows`` rows or more and each field, the row whose value survives.

    A field of a group without a whole value has no row. ``titles`` are short fields, judged also by
    their last word and by the other titles of the group; ``texts`` must end as a sentence. Rows with
    a null group are no duplicates of each other and are left out. Repeated rows vote again. Extra
    columns of ``rows`` are ignored, whatever their names.
    """
    keep = rows.select(
        F.col(group).alias("grp"), F.col(id_col).alias("id"), F.unix_micros(F.col(updated).cast("timestamp")).alias("updated_us"), trust_log2.cast("double").alias("trust"),
        *[F.col(c).alias(f"f_{c}") for c in titles + texts],
    )
    many = keep.where("grp is not null").groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") >= least_rows).select("grp")
    # Read by every step below, so written once; it holds the rows of groups with several rows only.
    member = settle(keep.join(many, "grp", "left_semi"))
    parts = None
    for c in titles + texts:
        value = F.col(f"f_{c}")
        ok = member.where(presentable(value))
        if c in texts:
            ok = ok.where(ends_sentence(value))
        else:
            ok = ok.where(~ends_openly(value))
            # A longer neighbour shows a title to be cut even if that neighbour is itself marked as cut or damaged.
            cut = cut_titles(member.withColumn("t", F.regexp_replace(value, CUT_MARK, "")), "grp", "id", "t")
            ok = ok.join(cut, "id", "left_anti")
        part = ok.select("grp", F.lit(c).alias("field"), "id", "updated_us", "trust", F.md5(plain(value)).alias("norm"))
        parts = part if parts is None else parts.unionByName(part)
    return votes(settle(parts), F.col("trust"), half_life_us)


def surviving_records(rows: DataFrame, won: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """One record per group: ``grp`` and, for each field, its surviving value and the row it comes from (nulls where none is whole)."""
    values = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in fields])).alias("x"))
    values = values.select("id", "x.field", "x.value").dropDuplicates(["id", "field"])
    return won.join(values, ["id", "field"]).groupBy("grp").pivot("field", fields).agg(F.first("value").alias("value"), F.first("id").alias("from"))
