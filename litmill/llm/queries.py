"""Queries of the training-data problems and, where one exists, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.llm import entity_match as em
from litmill.llm import mixing, packing
from litmill.llm import name_variants as nv
from litmill.llm import near_duplicates as nd
from litmill.llm import residue as rs
from litmill.llm import survivors as sv
from litmill.llm.tokens import tokenised
from litmill.session import settle, table

# ---- problem 1: near-duplicate papers; shingles of three words, half or more in common (as the data's statement defines)
P1_SHINGLE, P1_THRESHOLD, P1_MIN_WORDS = 3, 0.5, 40


def _p1(spark: SparkSession, d: str, least: int = 0) -> tuple[DataFrame, DataFrame]:
    papers = table(spark, d, "papers")
    if least:
        papers = papers.where(F.regexp_count(F.lower("canonical_abstract"), F.lit("[a-z0-9]+")) >= least)
    text = F.concat_ws(" ", F.coalesce("canonical_title", F.lit("")), F.coalesce("canonical_abstract", F.lit("")))
    return nd.near_duplicates(papers, "paper_id", text, P1_SHINGLE, P1_THRESHOLD)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nd.member_pairs(*_p1(spark, d, P1_MIN_WORDS)).select(F.col("a").alias("paper_id_a"), F.col("b").alias("paper_id_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per paper with a word in its title or abstract, however short."""
    out = nd.duplicate_groups(*_p1(spark, d))
    return out.withColumnRenamed("id", "paper_id")


# ---- problem 4: surviving values of rows with one work_id
P4_FIELDS = ["canonical_title", "canonical_abstract"]
#: A merged row has the votes of 2 ** 24 others, and a vote halves every 150 days: merged rows come first unless they are ten
#: years older, and among equals the later row unless several earlier ones of the last months agree on another value.
P4_TRUST_LOG2, P4_HALF_LIFE_US = 24.0, 150 * 86_400_000_000.0


def _p4(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    papers = table(spark, d, "papers")
    merged = F.when(F.lower(F.trim("merge_status")) == "merged", P4_TRUST_LOG2).otherwise(0.0)
    return papers, sv.survivors(papers, "work_id", "paper_id", P4_FIELDS[:1], P4_FIELDS[1:], merged, "updated_at", P4_HALF_LIFE_US)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d)[1].select(F.col("grp").alias("work_id"), F.col("field").alias("field_name"), F.col("id").alias("paper_id"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    papers, won = _p4(spark, d)
    return sv.surviving_records(papers, won, "paper_id", P4_FIELDS).withColumnRenamed("grp", "work_id")


# ---- problem 6: containers filled with neighbouring texts
def _p6(spark: SparkSession, d: str) -> tuple[DataFrame, list[tuple[str, int]]]:
    # A fixed table: one row per kind of container.
    kinds = [(r[0], r[1]) for r in table(spark, d, "container_sizes").select("container_kind", "capacity_tokens").collect()]
    # Written once: the range sort reads its input twice, and texts should be tokenised once.
    return settle(tokenised(table(spark, d, "documents"), "doc_id", "text")), kinds


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes, kinds = _p6(spark, d)
    out = packing.packed(sizes, kinds)
    return out.withColumnsRenamed({"id": "doc_id", "start": "start_token", "size": "n_tokens"})


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each kind are."""
    sizes, kinds = _p6(spark, d)
    capacity = F.coalesce(*[F.when(F.col("container_kind") == k, F.lit(c)) for k, c in kinds], F.lit(None))
    used = packing.packed(sizes, kinds).groupBy("container_kind", "container_id").agg(F.sum("size").alias("used"))
    return used.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens")).withColumn(
        "fill", F.round(F.col("tokens") / (F.col("containers") * capacity), 4)
    )


# ---- problem 7: sources mixed to target weights
def _p7(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    docs = table(spark, d, "documents").join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    sizes = settle(tokenised(docs, "doc_id", "text", "source").select("id", "source", "n_tokens"))
    return mixing.mixture(sizes, targets), targets


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d)[0].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached_shares(*_p7(spark, d))


# ---- problem 8: texts without content
def _p8(spark: SparkSession, d: str) -> DataFrame:
    return rs.residue(table(spark, d, "documents"), "doc_id", "text", "source")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d).where("is_residue").select(F.col("id").alias("doc_id"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus without them, by id; the ids to keep are joined back so that texts are read once more, not shuffled."""
    kept = _p8(spark, d).where("not is_residue").select(F.col("id").alias("doc_id"))
    return table(spark, d, "documents").select("doc_id", "source", "section", "lang", "n_chars").join(kept, "doc_id", "left_semi")


def p8_validation(spark: SparkSession, d: str) -> DataFrame:
    return rs.validation(table(spark, d, "documents"), "doc_id", "text", "source")


# ---- problem 3: spellings of people and organisations
def _p3(spark: SparkSession, d: str) -> DataFrame:
    return nv.entities(nv.distinct_names(table(spark, d, "paper_author_affiliation"), table(spark, d, "citation_records")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nv.variant_pairs(_p3(spark, d))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with its entity's most frequent spelling and the score of the rewritings between them."""
    named = _p3(spark, d)
    best = named.groupBy("kind", "entity").agg(F.max_by("name", F.struct("n", "name")).alias("preferred"), F.count("*").alias("spellings"))
    return named.join(best, ["kind", "entity"]).select(F.col("kind").alias("entity_kind"), "name", "n", "preferred", "spellings", "score")


# ---- problem 2: citation records matched to papers
def _p2(spark: SparkSession, d: str) -> DataFrame:
    works = em.work_rows(table(spark, d, "papers"), table(spark, d, "paper_sources"), table(spark, d, "paper_author_affiliation"))
    return em.matches(em.record_rows(table(spark, d, "citation_records")), works)


def p2_reliability(spark: SparkSession, d: str) -> DataFrame:
    """Confidence against truth on pairs that a DOI decides, on records held out of the fit."""
    works = em.work_rows(table(spark, d, "papers"), table(spark, d, "paper_sources"), table(spark, d, "paper_author_affiliation"))
    return em.reliability(em.record_rows(table(spark, d, "citation_records")), works)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d).select("record_id", F.col("work_id").cast("int").alias("paper_id"))


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d).select("record_id", F.col("work_id").cast("int").alias("paper_id"), "confidence")


QUERIES = {
    "p1_found": p1_found, "p1_groups": p1_groups,
    "p2_found": p2_found, "p2_matches": p2_matches, "p2_reliability": p2_reliability,
    "p3_found": p3_found, "p3_entities": p3_entities,
    "p4_found": p4_found, "p4_records": p4_records,
    "p6_packed": p6_packed, "p6_fill": p6_fill,
    "p7_mix": p7_mix, "p7_shares": p7_shares,
    "p8_found": p8_found, "p8_clean": p8_clean, "p8_validation": p8_validation,
}
SQL: dict[str, str] = {}
