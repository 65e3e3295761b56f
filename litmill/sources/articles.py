"""Literature XML to documents: one select over the parsed rows, every list an array of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions.text import filled

_DATE = "struct<Year: string, Month: string, Day: string>"
_IDS = "struct<ArticleId: array<struct<_VALUE: string, _IdType: string>>>"
_NAMED = "struct<_VALUE: string, _UI: string, _MajorTopicYN: string>"
SCHEMA = f"""
MedlineCitation struct<
  _Status: string, _Owner: string, _IndexingMethod: string,
  PMID: string, DateRevised: {_DATE},
  Article: struct<
    ArticleTitle: string,
    Abstract: struct<AbstractText: array<struct<_VALUE: string, _Label: string, _NlmCategory: string>>>,
    Journal: struct<ISSN: string, Title: string, ISOAbbreviation: string, JournalIssue: struct<Volume: string, Issue: string, PubDate: struct<Year: string, Month: string, Day: string, MedlineDate: string>>>,
    Pagination: struct<MedlinePgn: string>,
    ArticleDate: array<{_DATE}>,
    ELocationID: array<struct<_VALUE: string, _EIdType: string, _ValidYN: string>>,
    AuthorList: struct<Author: array<struct<LastName: string, ForeName: string, Initials: string, CollectiveName: string, AffiliationInfo: array<struct<Affiliation: string>>>>>,
    GrantList: struct<Grant: array<struct<GrantID: string, Acronym: string, Agency: string, Country: string>>>,
    PublicationTypeList: struct<PublicationType: array<struct<_VALUE: string, _UI: string>>>,
    Language: array<string>>,
  ChemicalList: struct<Chemical: array<struct<RegistryNumber: string, NameOfSubstance: struct<_VALUE: string, _UI: string>>>>,
  MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: {_NAMED}, QualifierName: array<{_NAMED}>>>>,
  KeywordList: array<struct<_Owner: string, Keyword: array<string>>>>,
PubmedData struct<
  History: struct<PubMedPubDate: array<struct<_PubStatus: string, Year: string, Month: string, Day: string, Hour: string, Minute: string>>>,
  PublicationStatus: string,
  ArticleIdList: {_IDS},
  ReferenceList: array<struct<Reference: array<struct<Citation: string, ArticleIdList: {_IDS}>>>>>
"""
# Months as they are named in dates, and the stages of a manuscript that count as submission.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SUBMITTED = ["received", "accepted", "revised"]


def month(c: Column) -> Column:
    """A month's number, from digits or the first three letters of its name."""
    name = F.array_position(F.array(*map(F.lit, MONTHS)), F.initcap(F.substring(F.trim(c), 1, 3)))
    return F.coalesce(F.when(F.trim(c).rlike(r"^\d+$"), F.trim(c).try_cast("int")), F.when(name > 0, name.cast("int")))


def partial_date(year: Column, month_: Column, day: Column) -> Column:
    """Y, Y-M or Y-M-D, as far as it is known; null without a year."""
    y, d = F.trim(year).try_cast("int"), F.trim(day).try_cast("int")
    return F.when(month_.isNull(), y.cast("string")).when(d.isNull(), F.format_string("%d-%02d", y, month_)).otherwise(F.format_string("%d-%02d-%02d", y, month_, d))


def _date(d: Column) -> Column:
    return F.when(F.trim(d["Year"]).try_cast("int").isNotNull(), partial_date(d["Year"], month(d["Month"]), d["Day"]))


def _some(c: Column, of, keep=None) -> Column:
    """The list with every element rewritten, without those that ``keep`` refuses."""
    out = F.transform(c, of)
    return F.filter(out, keep) if keep else out


def _ids(c: Column) -> Column:
    return _some(c, lambda x: F.struct(x["_IdType"].alias("type"), filled(F.trim(x["_VALUE"])).alias("id")), lambda x: x["id"].isNotNull())


def _first(ids: Column, kind: str, value: str = "id") -> Column:
    return F.get(F.filter(ids, lambda x: x["type"] == kind), F.lit(0))[value]


def _author(a: Column) -> Column:
    fore, last, initials = (filled(F.trim(a[k])) for k in ("ForeName", "LastName", "Initials"))
    both = F.when(fore.isNotNull() & last.isNotNull(), F.concat_ws(" ", fore, last)).when(last.isNotNull() & initials.isNotNull(), F.concat_ws(" ", last, initials))
    return F.coalesce(filled(F.trim(a["CollectiveName"])), both, fore, last, initials)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of XML files, plain or gzip, one row each; lists that an article lacks are null.

    The DOI is the article's own, else that of its electronic location; the submission date is that of the first stage
    that counts as one. Labelled parts of an abstract are lines with their label in front.
    """
    m, a = "MedlineCitation", "MedlineCitation.Article"
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(SCHEMA).load(path)
    pub = F.col(f"{a}.Journal.JournalIssue.PubDate")
    named_year = F.nullif(F.regexp_extract(pub["MedlineDate"], r"\d{4}", 0), F.lit(""))
    year = F.coalesce(F.when(F.trim(pub["Year"]).rlike(r"^\d+$"), F.trim(pub["Year"])), named_year)
    label = lambda x: F.coalesce(filled(x["_Label"]), filled(x["_NlmCategory"]))
    parts = F.filter(f"{a}.Abstract.AbstractText", lambda x: filled(F.trim(x["_VALUE"])).isNotNull())
    lines = F.transform(parts, lambda x: F.concat_ws(": ", label(x), F.trim(x["_VALUE"])))
    article_ids = _ids(F.col("PubmedData.ArticleIdList.ArticleId"))
    places = _some(F.col(f"{a}.ELocationID"), lambda x: F.struct(x["_EIdType"].alias("type"), x["_ValidYN"].alias("valid"), filled(F.trim(x["_VALUE"])).alias("id")), lambda x: x["id"].isNotNull())
    clock = lambda x: F.when(x["Hour"].try_cast("int").isNotNull() & x["Minute"].try_cast("int").isNotNull(), F.format_string("%02d:%02d", x["Hour"].try_cast("int"), x["Minute"].try_cast("int")))
    history = _some(F.col("PubmedData.History.PubMedPubDate"), lambda x: F.struct(x["_PubStatus"].alias("status"), _date(x).alias("date"), clock(x).alias("time")))
    submitted = F.get(F.filter(history, lambda x: x["status"].isin(SUBMITTED) & x["date"].isNotNull()), F.lit(0))["date"]
    references = _some(F.flatten(F.transform("PubmedData.ReferenceList", lambda x: x["Reference"])), lambda r: F.struct(filled(F.trim(r["Citation"])).alias("citation"), _ids(r["ArticleIdList"]["ArticleId"]).alias("ids")))
    authors = F.transform(
        f"{a}.AuthorList.Author",
        lambda x, i: F.struct(
            (i + 1).alias("sequence"), _author(x).alias("name"),
            F.filter(F.transform(x["AffiliationInfo"], lambda y: filled(F.trim(y["Affiliation"]))), lambda y: y.isNotNull()).alias("affiliations"),
        ),
    )
    named = lambda x: F.struct(F.trim(x["_VALUE"]).alias("name"), x["_UI"].alias("ui"), x["_MajorTopicYN"].alias("major"))
    return raw.select(
        F.col(f"{m}.PMID").alias("pubmed_id"), F.coalesce(_first(article_ids, "doi"), _first(places, "doi")).alias("doi"), filled(F.trim(f"{a}.ArticleTitle")).alias("title"),
        filled(F.array_join(lines, "\n")).alias("abstract"), filled(F.trim(f"{a}.Journal.Title")).alias("venue"), F.get(F.col(f"{a}.Language"), F.lit(0)).alias("language"),
        authors.alias("authors"), article_ids.alias("article_ids"), places.alias("locations"), history.alias("history"), submitted.alias("submitted_at"), _date(F.col(f"{m}.DateRevised")).alias("updated_at"),
        F.coalesce(year.try_cast("int"), F.get(F.col(f"{a}.ArticleDate"), F.lit(0))["Year"].try_cast("int")).alias("year"), F.when(year.isNotNull(), partial_date(year, month(pub["Month"]), pub["Day"])).alias("published_at"),
        _some(F.col(f"{m}.KeywordList"), lambda x: F.struct(x["_Owner"].alias("owner"), F.filter(F.transform(x["Keyword"], lambda k: F.trim(k)), lambda k: k != "").alias("keywords")), lambda x: F.size(x["keywords"]) > 0).alias("keyword_lists"),
        _some(F.col(f"{m}.MeshHeadingList.MeshHeading"), lambda x: F.struct(named(x["DescriptorName"]).alias("descriptor"), F.transform(x["QualifierName"], named).alias("qualifiers"))).alias("headings"),
        _some(F.col(f"{m}.ChemicalList.Chemical"), lambda x: F.struct(x["RegistryNumber"].alias("registry_number"), F.trim(x["NameOfSubstance"]["_VALUE"]).alias("name"), x["NameOfSubstance"]["_UI"].alias("ui"))).alias("chemicals"),
        F.col(f"{a}.GrantList.Grant").alias("grants"),
        _some(F.col(f"{a}.PublicationTypeList.PublicationType"), lambda x: F.struct(x["_UI"].alias("ui"), filled(F.trim(x["_VALUE"])).alias("name")), lambda x: x["name"].isNotNull()).alias("publication_types"),
        F.struct(F.col(f"{a}.Journal.ISSN").alias("issn"), F.col(f"{a}.Journal.ISOAbbreviation").alias("short"), F.col(f"{a}.Journal.JournalIssue.Volume").alias("volume"), F.col(f"{a}.Journal.JournalIssue.Issue").alias("issue"), F.col(f"{a}.Pagination.MedlinePgn").alias("pages")).alias("journal"),
        F.col("PubmedData.PublicationStatus").alias("publication_status"), references.alias("references"),
        F.when(F.col(f"{m}.PMID").isNotNull(), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col(f"{m}.PMID"), F.lit("/"))).alias("source_url"),
    )


def citation_edges(articles: DataFrame, known: DataFrame) -> DataFrame:
    """(pubmed_id, position, cited): the work (pubmed_id, work_id) of a known number, else a tag with the number, the DOI or the citation's text."""
    each = articles.select("pubmed_id", F.posexplode("references").alias("position", "r"))
    each = each.select("pubmed_id", "position", _first(F.col("r.ids"), "pubmed").alias("number"), _first(F.col("r.ids"), "doi").alias("other"), F.col("r.citation").alias("citation"))
    works = known.select(F.col("pubmed_id").alias("number"), F.col("work_id").alias("work")).dropDuplicates(["number"])
    tag = F.coalesce("work", F.concat(F.lit("PMID:"), "number"), F.concat(F.lit("DOI:"), "other"), F.concat(F.lit("CITATION:"), "citation"))
    return each.join(works, "number", "left").select("pubmed_id", "position", tag.alias("cited")).where("cited is not null")


def write_batches(articles: DataFrame, path: str, per_file: int = 10_000) -> DataFrame:
    """One JSON object a line, in files of at most ``per_file`` articles, and (file, articles) of what was written."""
    articles.write.mode("overwrite").option("maxRecordsPerFile", per_file).json(path)
    return articles.sparkSession.read.text(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("articles"))
