"""From raw records of several sources to normalised records, with their errors and how many there are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.sources.adapters import from_citations, from_preprints

Adapter = Callable[[DataFrame], DataFrame]
#: What turns the records of a source into normalised ones; others may be added.
ADAPTERS: dict[str, Adapter] = {
    "preprint_history": lambda df: from_preprints(df, "preprint_history"),
    "preprint_daily": lambda df: from_preprints(df, "preprint_daily"),
    "citation": lambda df: from_citations(df, "citation"),
}
#: Sources that are known but have no adapter: their records are errors, not exceptions.
KNOWN = [*ADAPTERS, "arxiv", "pubmed"]
COMMON = ["source_name", "record_id", "doi", "title", "abstract", "language", "publisher", "online_at", "version", "is_preprint", "is_published", "authors", "institutions", "error"]


def resolve_sources(wanted: list[str] | str | None, allowed: list[str], one: bool = False) -> list[str]:
    """The sources that a call means: those named, else all; ``one`` asks for a single one. Unknown names and an open choice are errors."""
    names = [wanted] if isinstance(wanted, str) else list(dict.fromkeys(wanted)) if wanted else list(allowed)
    unknown = [n for n in names if n not in allowed]
    if unknown:
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    if one and len(names) != 1:
        raise ValueError("a source must be named")
    return names


def route(records: DataFrame, source: str = "source_name", known: list[str] | None = None) -> DataFrame:
    """Add ``adapter`` and ``error`` to records by the source they name; unknown ones have no adapter."""
    ok = F.coalesce(F.col(source).isin(known if known is not None else KNOWN), F.lit(False))
    return records.withColumns({"adapter": F.when(ok, F.col(source)), "error": F.when(~ok, F.concat(F.lit("unsupported source: "), F.coalesce(source, F.lit("none"))))})


def transform(batches: dict[str, DataFrame], stop_on_error: bool = False) -> DataFrame:
    """Normalised records of all sources, those that could not be read with their ``error``.

    ``batches`` maps sources to raw records. With ``stop_on_error`` the first record with an error is an exception.
    """
    out = None
    for name, raw in batches.items():
        if name in ADAPTERS:
            part = ADAPTERS[name](raw).select(*COMMON)
        else:
            why = "no adapter for source: " if name in KNOWN else "unsupported source: "
            part = raw.select(F.lit(name).alias("source_name"), "record_id", F.lit(why + name).alias("error"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is not None and stop_on_error:
        bad = out.where("error is not null").select("source_name", "record_id", "error").first()
        if bad:
            raise ValueError(f"{bad[0]}, record {bad[1]}: {bad[2]}")
    return out


def transform_stats(records: DataFrame) -> DataFrame:
    """(source_name, total, successful, failed, success_rate in percent with two digits)."""
    ok = F.col("error").isNull().cast("long")
    per = records.groupBy("source_name").agg(F.count("*").alias("total"), F.sum(ok).alias("successful"))
    return per.select("source_name", "total", "successful", (F.col("total") - F.col("successful")).alias("failed"), F.round(100.0 * F.col("successful") / F.col("total"), 2).alias("success_rate"))
