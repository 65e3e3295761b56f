"""Identifier normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doi(c: Column) -> Column:
    """Lower case, without address, prefix and blanks; null if nothing is left."""
    bare = F.regexp_replace(F.trim(F.lower(c)), r"^(?:https?://(?:dx\.)?doi\.org/|doi\.org/|doi:)", "")
    out = F.regexp_replace(bare, r"\s+", "")
    return F.when(out != "", out)


def arxiv(c: Column) -> Column:
    out = F.regexp_replace(F.trim(c), r"[vV]\d+$", "")
    return F.when(out != "", out)


def pubmed(c: Column) -> Column:
    out = F.regexp_extract(c, r"\d+", 0)
    return F.when(out != "", out)


def semantic_scholar(c: Column) -> Column:
    out = F.lower(F.trim(c))
    return F.when(out != "", out)


def record_of_url(c: Column) -> Column:
    """The number behind /view/ or /download/ in an address."""
    out = F.regexp_extract(c, r"/(?:view|download)/(\d+)", 1)
    return F.when(out != "", out)


def work_id(millis: Column, seed: Column) -> Column:
    """A time-ordered work id ("W" and a version-7 UUID) whose random bits come from a seed, so that it can be repeated."""
    time = F.lpad(F.lower(F.hex(millis)), 12, "0")
    noise = F.sha2(seed.cast("string"), 256)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(noise, 20, 1), 16, 10).cast("int") % 4) + 1, 1)
    return F.concat(
        F.lit("W"), F.substring(time, 1, 8), F.lit("-"), F.substring(time, 9, 4), F.lit("-7"), F.substring(noise, 1, 3), F.lit("-"),
        variant, F.substring(noise, 4, 3), F.lit("-"), F.substring(noise, 7, 12),
    )
