"""Backfilling: records are inserted and queued first, the queue is worked off afterwards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.operators.queue import advance, candidates
from litmill.operators.upsert import replay_records, triggers
from litmill.session import settle

#: Work on (paper_id) rows: gives (paper_id, outcome, error), outcome succeeded or failed.
Attempt = Callable[[DataFrame], DataFrame]


def insert_and_queue(records: DataFrame, id_kinds: dict[str, str], status: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(statuses, status): records replayed, and the queue with their papers pending where they need a new vector.

    ``status`` has (paper_id, status, attempt_count, error, updated_at), paper_id being the text by which replays name papers.
    """
    done = settle(replay_records(records, id_kinds))
    named = done.join(records.select("record_id", "source_name"), "record_id")
    new = triggers(named).where("needs_vector").select(F.col("paper_key").alias("paper_id")).distinct()
    outcomes = new.select("paper_id", F.lit("pending").alias("outcome"), F.lit(None).cast("string").alias("error"), F.lit(at).cast(dict(status.dtypes)["updated_at"]).alias("at"))
    return done, advance(status, outcomes)


def work_off(status: DataFrame, attempt: Attempt, most_tries: int, at: list[str]) -> DataFrame:
    """The queue after as many rounds as ``at`` has times: each tries the papers that are pending or failed, of those with tries left.

    The papers of a round are those that stand in the queue when it begins. Rounds end early when nothing is left.
    """
    for time in at:
        due = settle(candidates(status, most_tries).select("paper_id"))
        if due.isEmpty():
            break
        kind = dict(status.dtypes)["updated_at"]
        outcomes = attempt(due).select("paper_id", "outcome", "error", F.lit(time).cast(kind).alias("at"))
        status = settle(advance(status, outcomes))
    return status


def outcome_counts(status: DataFrame, letters: int = 120) -> DataFrame:
    """(status, bucket, n): how many papers stand how, failures by the first letters of their error."""
    return status.groupBy("status", F.when(F.col("status") == "failed", F.substring("error", 1, letters)).alias("bucket")).agg(F.count("*").alias("n"))
