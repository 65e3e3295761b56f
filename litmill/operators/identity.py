"""Which existing paper an incoming record belongs to, by any of its identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def identifier_rows(df: DataFrame, id_cols: list[str], kinds: dict[str, str], source: str = "source_name") -> DataFrame:
    """(*id_cols, source_name, kind, value): one row per identifier that a record has."""
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value")) for kind, c in kinds.items()])
    return df.select(*id_cols, F.col(source).alias("source_name"), F.explode(each).alias("_i")).select(*id_cols, "source_name", "_i.kind", "_i.value").where("value is not null and value <> ''")


def match_identity(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(record_id, match, paper_id, paper_source_id): same_source before cross_source before none.

    ``incoming`` has (record_id, source_name, kind, value), ``existing`` also (paper_source_id, paper_id).
    Every kind is an equi-join of its own key, never an OR; a source's own record number matches within
    the source only. Among several hits the smallest source id wins.
    """
    e = existing.select("kind", "value", F.col("source_name").alias("e_source"), "paper_id", "paper_source_id")
    hits = incoming.join(e, ["kind", "value"]).withColumn("same", F.col("source_name") == F.col("e_source"))
    hits = hits.where("same or kind <> 'record'")
    best = hits.groupBy("record_id").agg(F.min_by(F.struct("same", "paper_id", "paper_source_id"), F.struct(~F.col("same"), "paper_source_id")).alias("b"))
    every = incoming.select("record_id").distinct()
    return every.join(best, "record_id", "left").select(
        "record_id", F.when(F.col("b.same"), "same_source").when(F.col("b.same").isNotNull(), "cross_source").otherwise("none").alias("match"),
        F.col("b.paper_id").alias("paper_id"), F.col("b.paper_source_id").alias("paper_source_id"),
    )


def first_seen(identifiers: DataFrame, id_col: str) -> DataFrame:
    """(id, match, earlier): the earliest record with a smaller id that shares an identifier, of the same source if there is one; -1 if none.

    ``identifiers`` has (id, source_name, kind, value). Only the smallest ids of each identifier are looked up, so an
    identifier that many records share costs one row per source, never pairs.
    """
    i = identifiers.withColumnRenamed(id_col, "_id")
    own = i.groupBy("kind", "value", "source_name").agg(F.min("_id").alias("own"))
    low = own.where("kind <> 'record'").groupBy("kind", "value").agg(F.min("own").alias("any"))
    j = i.join(own, ["kind", "value", "source_name"]).join(low, ["kind", "value"], "left")
    # Where a record is its source's first with the identifier, an earlier one is another source's.
    per = j.groupBy("_id").agg(F.min(F.when(F.col("own") < F.col("_id"), F.col("own"))).alias("same"), F.min(F.when(F.col("any") < F.col("_id"), F.col("any"))).alias("other"))
    return per.select(
        F.col("_id").alias(id_col), F.when(F.col("same").isNotNull(), "same_source").when(F.col("other").isNotNull(), "cross_source").otherwise("none").alias("match"),
        F.coalesce("same", "other", F.lit(-1)).alias("earlier"),
    )


def identity_bundle(records: DataFrame, ids: dict[str, str]) -> DataFrame:
    """Add ``identity`` (source_name, doi, arxiv_id, pubmed_id, semantic_scholar_id, source_identifiers) and ``error`` to normalised records.

    ``ids`` maps sources to the column with their own number; a source without one, or a record without that number, takes its
    source_record_id. A record without either has an error, as nothing of its own source would know it again.
    """
    has = set(records.columns)
    text = lambda c: F.col(c).cast("string") if c in has else F.lit(None).cast("string")
    own = F.coalesce(*[F.when(F.col("source_name") == s, text(c)) for s, c in ids.items()], text("source_record_id"))
    numbers = F.map_filter(F.map_from_arrays(F.array("source_name"), F.array(own)), lambda _, v: v.isNotNull())
    bundle = F.struct("source_name", *[text(c).alias(n) for n, c in (("doi", "doi"), ("arxiv_id", "arxiv_id"), ("pubmed_id", "pubmed_id"), ("semantic_scholar_id", "semantic_scholar_id"))], numbers.alias("source_identifiers"))
    return records.withColumns({"identity": bundle, "error": F.when(own.isNull(), "no identifier of its own source")})
