"""Replaying ordered records into papers and source records, with a status per record.

The outcome depends on the order, but records that share no identifier, directly or through others,
never meet. Records are therefore grouped by connected identifiers and every group is replayed on its
own, in order. Groups are usually tiny; a group is one work's history and must fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions.versions import version_text
from litmill.operators.components import components

MODES = ("insert", "update", "upsert")
STATUS = "seq bigint, record_id bigint, status string, paper_key string, canonical_source string, canonical_changed boolean"


def identity_groups(links: DataFrame) -> DataFrame:
    """(record_id, grp) of (record_id, value): the smallest record reachable through shared values.

    Records that share a value are linked with the smallest of them, so a value of many records gives as many links.
    """
    r = links.select("record_id", "value").distinct()
    low = r.groupBy("value").agg(F.min("record_id").alias("low"))
    found = components(r.join(low, "value").select(F.col("record_id").alias("a"), F.col("low").alias("b")))
    return r.select("record_id").distinct().join(found.withColumnRenamed("id", "record_id"), "record_id", "left").select("record_id", F.coalesce("component", "record_id").alias("grp"))


class Replay:
    """Papers of one group of records, as they stand after the records seen so far.

    A record belongs to the paper of its own source that shares an id, else to one of another source,
    else it is new. Only the mode insert skips records that are not newer; the mode update takes no others than
    those of the same source. The canonical source is the one that came online last, unless ``auto`` is off; an
    update of the same source, but in the mode insert, may choose one of the paper's sources instead.
    """

    def __init__(self, mode: str, auto: bool = True) -> None:
        self.mode, self.auto, self.papers = mode, auto, []

    def step(self, record_id: int, source: str, ids: set[str], rank: str | None, online: int | None, seq: int, chosen: str | None = None) -> tuple:
        """(status, paper_key, canonical_source, canonical_changed) of the next record; rank is a text that sorts as the versions do."""
        here = {"ids": ids, "rank": rank, "online": online, "at": seq}
        same = next((p for p in self.papers if source in p["sources"] and ids & p["sources"][source]["ids"]), None)
        shared = {i for i in ids if not i.startswith("record:")}
        paper = same or next((p for p in self.papers if any(shared & s["ids"] for n, s in p["sources"].items() if n != source)), None)
        by_hand = chosen if self.mode != "insert" and same is not None else None
        if by_hand is not None and by_hand not in same["sources"]:
            return "FAILED", None, None, False  # nothing is written
        if same is not None:
            old = same["sources"][source]
            if rank is not None and old["rank"] is not None and rank != old["rank"]:
                newer = rank > old["rank"]
            else:
                newer = online is not None and (old["online"] is None or online > old["online"])
            status = "UPDATE_SAME_SOURCE" if self.mode != "insert" or newer else "SKIP_SAME_SOURCE"
            if status == "UPDATE_SAME_SOURCE":
                here["ids"] = ids | old["ids"]
                same["sources"][source] = here
        elif self.mode == "update":
            return "UPDATE_NOT_ALLOWED_NON_SAME_SOURCE", None, None, False
        elif paper is not None and source not in paper["sources"]:
            status = "APPEND_SOURCE"
            paper["sources"][source] = here
        else:
            status = "NEW_PAPER"
            paper = {"key": f"P{record_id}", "canonical": None, "sources": {source: here}}
            self.papers.append(paper)
        dated = [(s["online"], s["at"], n) for n, s in paper["sources"].items() if s["online"] is not None]
        # Records that are inserted always choose by date.
        canonical = by_hand or (max(dated)[2] if dated and (self.auto or same is None or self.mode == "insert") else paper["canonical"])
        changed = canonical != paper["canonical"]
        paper["canonical"] = canonical
        return status if self.mode == "update" else f"{self.mode.upper()}_{status}", paper["key"], canonical, changed


def _run(mode: str, auto: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by group and position; a group may go on in the next batch.
        group, state = None, None
        for df in batches:
            out = []
            for grp, seq, record_id, source, ids, rank, online, chosen in df[["grp", "seq", "record_id", "source_name", "ids", "rank", "online", "chosen"]].itertuples(index=False, name=None):
                if grp != group or state is None:
                    group, state = grp, Replay(mode, auto)
                out.append((seq, record_id, *state.step(record_id, source, set(ids), rank, None if online != online else int(online), seq, chosen)))
            yield pd.DataFrame(out, columns=["seq", "record_id", "status", "paper_key", "canonical_source", "canonical_changed"])

    return run


def replay_records(records: DataFrame, id_kinds: dict[str, str], mode: str = "insert", auto: bool = True, chosen: str | None = None) -> DataFrame:
    """Statuses of (seq, record_id, source_name, version, online_at, *identifiers) records replayed in order of seq.

    ``id_kinds`` maps identifier kinds to columns; the kind 'record' is a source's own number and ties
    records of that source only. Records without identifiers are new papers of their own. ``mode`` is insert, update
    or upsert; ``auto`` and the column ``chosen`` (a source's name) say how the canonical source is set (see Replay).
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")

    def tag(kind: str, c: str):
        own = F.concat(F.lit("record:"), "source_name", F.lit(":"), F.col(c).cast("string"))
        return own if kind == "record" else F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))

    ids = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), tag(k, c)) for k, c in id_kinds.items()]))
    r = records.select(
        "seq", "record_id", "source_name", version_text(F.col("version")).alias("rank"),
        F.unix_micros(F.col("online_at").cast("timestamp")).alias("online"), ids.alias("ids"), (F.col(chosen) if chosen else F.lit(None).cast("string")).alias("chosen"),
    )
    groups = identity_groups(r.select("record_id", F.explode("ids").alias("value")))
    r = r.join(groups, "record_id", "left").withColumn("grp", F.coalesce("grp", "record_id"))
    r = r.select("grp", "seq", "record_id", "source_name", "ids", "rank", F.col("online").cast("double").alias("online"), "chosen")
    # One sorted stream per task instead of one data frame per group: most groups have a single record.
    return r.repartition("grp").sortWithinPartitions("grp", "seq").mapInPandas(_run(mode, auto), STATUS)


def source_errors(records: DataFrame, payload: str, key: str, allowed: list[str]) -> DataFrame:
    """Add ``error``: why a record's source does not hold, of the payload and of the key, or null. Both must be there, equal and allowed."""
    p, k = F.col(payload), F.col(key)
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    return records.withColumn(
        "error",
        F.when(blank(k), "key without source").when(blank(p), "payload without source").when(k != p, F.concat(F.lit("sources differ: "), k, F.lit(", "), p))
        .when(F.trim(k) == "", "source is blank").when(~k.isin(allowed), F.concat(F.lit("unknown source: "), k)),
    )


def choose_canonical(papers: DataFrame, sources: DataFrame, choices: DataFrame) -> DataFrame:
    """(paper_id, canonical_source_id, error) of (paper_id, canonical_source_id) choices: one that is not the paper's source, or no paper's, is an error and changes nothing."""
    own = sources.select("paper_id", F.col("paper_source_id").alias("_chosen"), F.lit(True).alias("_own"))
    c = choices.select("paper_id", F.col("canonical_source_id").alias("_chosen")).dropDuplicates(["paper_id"])
    now = papers.select("paper_id", F.col("canonical_source_id").alias("_now"), F.lit(True).alias("_known"))
    j = c.join(own, ["paper_id", "_chosen"], "left").join(now, "paper_id", "left")
    return j.select(
        "paper_id", F.when(F.col("_own"), F.col("_chosen")).otherwise(F.col("_now")).alias("canonical_source_id"),
        F.when(F.col("_known").isNull(), "no such paper").when(F.col("_own").isNull(), "no source of the paper").alias("error"),
    )


def triggers(statuses: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """Whether a record's status asks for a new vector and for keywords.

    A skipped record asks for keywords only if its paper lacks some source of them: ``missing`` has the paper_key of such papers.
    """
    new, append = F.col("status").endswith("NEW_PAPER"), F.col("status").endswith("APPEND_SOURCE") & F.col("canonical_changed")
    update = F.col("status").endswith("UPDATE_SAME_SOURCE")
    if missing is not None:
        lacks = missing.select("paper_key", F.lit(True).alias("_lacks")).distinct()
        statuses = statuses.join(lacks, "paper_key", "left")
        update = update | (F.col("status").endswith("SKIP_SAME_SOURCE") & F.coalesce("_lacks", F.lit(False)))
        out = triggers_of(statuses, new, append, F.col("status").endswith("UPDATE_SAME_SOURCE"), update)
        return out.drop("_lacks")
    return triggers_of(statuses, new, append, update, update)


def triggers_of(statuses: DataFrame, new: Column, append: Column, update: Column, words: Column) -> DataFrame:
    return statuses.withColumns({"needs_vector": new | append | (update & (F.col("canonical_source") == F.col("source_name"))), "needs_keywords": new | append | words})
