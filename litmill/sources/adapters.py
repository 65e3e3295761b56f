"""Raw records of the sources to one normalised record; one select each, errors as a column instead of exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions import ids
from litmill.functions.moments import calendar_day, date_parts
from litmill.functions.text import collapse, filled, language, parts

PREPRINT_SITE = "https://www.biorxiv.org/content/"


def day(c: Column) -> Column:
    """The calendar day that a text starts with in one of the accepted forms, as yyyy-MM-dd; else null."""
    return F.date_format(calendar_day(date_parts(F.lower(F.trim(c)))), "yyyy-MM-dd")


def iso_day(c: Column) -> Column:
    """yyyy-MM-dd of the plain forms alone: y-m-d, y/m/d, yyyymmdd and ISO date-times with or without fraction and Z; else null."""
    v = F.trim(c)
    time = r"T([01]\d|2[0-3]):[0-5]\d:([0-5]\d|6[01])(\.\d{1,6})?Z?"
    plain = v.rlike(rf"^(\d{{4}}-\d\d-\d\d({time})?|\d{{4}}/\d\d/\d\d|\d{{8}})$")
    digits = F.substring(F.regexp_replace(v, "[-/]", ""), 1, 8)
    return F.when(plain, F.date_format(F.try_to_timestamp(digits, F.lit("yyyyMMdd")), "yyyy-MM-dd"))


def preprint_institutions(c: Column) -> Column:
    """Several institutions are joined by an ampersand or a semicolon."""
    return F.when(c.contains(" & "), parts(c, " & ")).when(c.contains(";"), parts(c, ";")).otherwise(parts(c, "\\x{0}"))


def from_preprints(raw: DataFrame, source_name: str = "preprint_history") -> DataFrame:
    """Normalised records of a preprint server's API rows.

    A record without a title has ``error`` set and is for quarantine; all others have it null.
    """
    names = parts(F.col("authors"), ";")
    clean = ids.doi(F.col("doi"))
    published = F.coalesce(F.upper(F.trim("published")) != "NA", F.lit(False))
    return raw.select(
        F.lit(source_name).alias("source_name"),
        F.col("record_id"),
        clean.alias("doi"),
        filled(collapse(F.col("title"))).alias("title"),
        filled(collapse(F.col("abstract"))).alias("abstract"),
        F.lit("en").alias("language"),
        F.col("server").alias("publisher"),
        day(F.col("date")).alias("online_at"),
        day(F.col("date")).alias("updated_at_source"),
        filled(F.trim("version")).alias("version"),
        published.alias("is_published"),
        (~published).alias("is_preprint"),
        F.transform(names, lambda n, i: F.struct((i + 1).alias("sequence"), collapse(n).alias("name"))).alias("authors"),
        preprint_institutions(F.col("author_corresponding_institution")).alias("institutions"),
        filled(collapse(F.col("category"))).alias("keyword"),
        F.concat(F.lit(PREPRINT_SITE), F.trim("doi")).alias("abstract_url"),
        F.concat(F.lit(PREPRINT_SITE), F.trim("doi"), F.lit(".full.pdf")).alias("pdf_url"),
        F.when(F.coalesce(collapse(F.col("title")), F.lit("")) == "", "title is missing").alias("error"),
    )


def flat_to_meta(raw: DataFrame) -> DataFrame:
    """Records in the flat form, whose fields stand beside each other as text or lists, in the form with ``meta``.

    A record may combine both: a field of ``meta`` goes before one of the record itself.
    """
    kinds = dict(raw.dtypes)
    own = [c for c in raw.columns if c.startswith("citation_") or c in VERSIONS]
    listed = lambda c: F.col(c).cast("array<string>") if kinds[c].startswith("array") else F.array(F.col(c).cast("string"))
    pairs = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), listed(c).alias("value"))) for c in own])) if own else None
    flat = F.map_from_entries(pairs) if own else F.create_map().cast("map<string,array<string>>")
    meta = F.coalesce("meta", F.create_map().cast("map<string,array<string>>")) if "meta" in kinds else F.create_map().cast("map<string,array<string>>")
    merged = F.map_concat(F.map_filter(flat, lambda k, v: ~F.map_contains_key(meta, k)), meta)
    blank = [F.lit(None).cast("string").alias(c) for c in ("url",) if c not in kinds]
    return raw.withColumn("meta", merged).drop(*own).select("*", *blank)


# Fields that may give a version, in their order, and the publisher of records that name none.
VERSIONS = ["version", "citation_version", "article_version"]
DEFAULT_PUBLISHER = "Citation source"


def _one(key: str) -> Column:
    return F.get(F.col("meta").getItem(key), F.lit(0))


def _many(key: str, comma: bool = True) -> Column:
    """A list field: a single element may hold a separated list (by lines where commas do not part); several elements are taken as they are."""
    xs = F.col("meta").getItem(key)
    one = F.get(xs, F.lit(0))
    split = F.when(one.contains(";"), parts(one, ";"))
    if comma:
        split = split.when(one.contains(",") & ~one.contains(", "), parts(one, ","))
    else:
        split = split.when(one.contains("\n"), parts(one, "\n"))
    split = split.otherwise(parts(one, "\\x{0}"))
    several = F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.when(F.size(xs) == 1, split).otherwise(several), F.array().cast("array<string>"))


def from_citations(raw: DataFrame, source_name: str = "citation") -> DataFrame:
    """Normalised records of citation-meta pages; see from_preprints for errors."""
    title = filled(collapse(_one("citation_title")))
    return raw.select(
        F.lit(source_name).alias("source_name"),
        F.col("record_id"),
        ids.doi(_one("citation_doi")).alias("doi"),
        title.alias("title"),
        filled(collapse(_one("citation_abstract"))).alias("abstract"),
        language(_one("citation_language")).alias("language"),
        F.coalesce(F.nullif(_one("citation_publisher"), F.lit("")), F.lit(DEFAULT_PUBLISHER)).alias("publisher"),
        day(_one("citation_date")).alias("submitted_at"),
        day(F.coalesce(_one("citation_online_date"), _one("citation_publication_date"))).alias("online_at"),
        day(_one("citation_publication_date")).alias("published_at"),
        filled(F.trim(F.coalesce(*[F.nullif(_one(v), F.lit("")) for v in VERSIONS]))).alias("version"),
        F.lit(True).alias("is_preprint"),
        F.lit(False).alias("is_published"),
        F.transform(_many("citation_author"), lambda n, i: F.struct((i + 1).alias("sequence"), collapse(n).alias("name"))).alias("authors"),
        _many("citation_author_institution").alias("institutions"),
        _many("citation_keywords").alias("keywords"),
        _many("citation_reference", comma=False).alias("references"),
        F.coalesce(ids.record_of_url(_one("citation_abstract_html_url")), ids.record_of_url(F.col("url"))).alias("source_record_id"),
        F.col("url").alias("source_url"),
        F.when(title.isNull(), "title is missing").alias("error"),
    )


def funders(raw: DataFrame) -> DataFrame:
    """(record_id, position, name, award) of the funder field, which is "NA" or a JSON array of objects."""
    parsed = F.from_json("funder", "array<struct<name:string,id:string,award:string>>")
    return raw.select("record_id", F.posexplode(parsed).alias("position", "f")).select("record_id", "position", F.col("f.name").alias("name"), F.col("f.award").alias("award"))
