"""The queue of papers to embed, and sharding of work by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest error text that is kept.
ERROR_CHARS = 2000


def advance(status: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Apply (paper_id, outcome, error, at) to (paper_id, status, attempt_count, error, updated_at).

    Outcome pending queues a paper and keeps its count; succeeded and failed count an attempt. Papers not
    seen before start at no attempt. Several outcomes of a paper are applied in the order of ``at``: the
    count rises by all its attempts, the status is the last one's.
    """
    per = outcomes.groupBy("paper_id").agg(
        F.max_by(F.struct("outcome", "error"), "at").alias("last"), F.max("at").alias("at"), F.sum(F.col("outcome").isin("succeeded", "failed").cast("long")).alias("tries")
    )
    j = status.join(per, "paper_id", "full_outer")
    return j.select(
        "paper_id", F.coalesce("last.outcome", "status").alias("status"), (F.coalesce("attempt_count", F.lit(0)) + F.coalesce("tries", F.lit(0))).alias("attempt_count"),
        F.when(F.col("at").isNull(), F.col("error")).when(F.col("last.outcome") == "failed", F.substring("last.error", 1, ERROR_CHARS)).alias("error"),
        F.coalesce("at", "updated_at").alias("updated_at"),
    )


def candidates(
    status: DataFrame, most_tries: int = 3, states: tuple[str, ...] = ("pending", "failed"), sources: list[str] | None = None, page: int | None = None, size: int = 100, key: str = "paper_id"
) -> DataFrame:
    """What may be tried again, of some sources if they are named; a page of ``size`` in the order of updated_at, those without first, then of the key."""
    out = status.where(F.col("status").isin(*states) & (F.col("attempt_count") < most_tries))
    if sources is not None:
        out = out.where(F.col("source_name").isin(sources))
    return out if page is None else out.orderBy(F.asc_nulls_first("updated_at"), key).offset(page * size).limit(size)


def missing_sources(papers: DataFrame, keywords: DataFrame, wanted: list[str]) -> DataFrame:
    """(paper_id, source) for every wanted keyword source that a paper lacks."""
    each = papers.select("paper_id", F.explode(F.array(*map(F.lit, wanted))).alias("source"))
    return each.join(keywords.select("paper_id", "source").distinct(), ["paper_id", "source"], "left_anti")


def id_shards(df: DataFrame, id_col: str, shard_rows: int) -> DataFrame:
    """Add ``shard``, the number of the contiguous id range that a row falls in, counted from the smallest id."""
    low = df.agg(F.min(id_col).alias("_low"))
    # One row; a join condition without key would be a cross join, so the value travels as a literal.
    first = low.first()[0] or 0
    return df.withColumn("shard", F.floor((F.col(id_col) - F.lit(first)) / shard_rows).cast("long"))
