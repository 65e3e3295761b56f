"""Choosing one row per key: newest versions, canonical sources, case-insensitive keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in a total order (a key's rows are sorted, spilling if they must)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def best_per_key(df: DataFrame, keys: list[str], order: Column, cols: list[str]) -> DataFrame:
    """The row with the largest ``order`` of each key, by partial aggregation: no sort, so hot keys do no harm."""
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_b"))
    return picked.select(*keys, "_b.*")


def canonical_sources(sources: DataFrame) -> DataFrame:
    """(paper_id, canonical_source_id): the source that came online last, the largest id among equals; papers without dates have none."""
    dated = sources.where("online_at is not null")
    return dated.groupBy("paper_id").agg(F.max_by("paper_source_id", F.struct("online_at", "paper_source_id")).alias("canonical_source_id"))


def merge_keywords(keywords: DataFrame) -> DataFrame:
    """One row per paper, type, keyword and source without regard to case and outer blanks.

    The spelling and time are those of the earliest row (nulls last; then the largest weight, then the
    spelling); the weight is the largest, a missing one counting as 1.
    """
    key = [F.lower(F.trim("keyword_type")).alias("type_key"), F.lower(F.trim("keyword")).alias("keyword_key")]
    k = keywords.where("keyword is not null and trim(keyword) <> ''").withColumns({"type_key": key[0], "keyword_key": key[1]})
    first = F.struct(F.col("created_at").isNull(), "created_at", F.col("weight").isNull(), -F.col("weight"), "keyword")
    return k.groupBy("paper_id", "type_key", "keyword_key", "source").agg(
        F.min_by("keyword", first).alias("keyword"), F.min("created_at").alias("created_at"),
        F.max(F.coalesce("weight", F.lit(1.0).cast("float"))).alias("weight"), F.count("*").alias("merged_rows"),
    )
