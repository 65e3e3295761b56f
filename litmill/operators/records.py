"""Single changes of stored records: new ones, changed fields, removal, and a log of what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def create(stored: DataFrame, records: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, refused): the stored rows with the new ones; a record whose key is stored, missing or repeated is refused."""
    counted = records.join(records.groupBy(key).agg(F.count("*").alias("_n")), key, "left").join(stored.select(key, F.lit(True).alias("_there")), key, "left")
    ok = F.col(key).isNotNull() & (F.col("_n") == 1) & F.col("_there").isNull()
    reason = F.when(F.col(key).isNull(), "no key").when(F.col("_there"), "stored already").otherwise("repeated")
    rows = stored.unionByName(counted.where(ok).select(*records.columns), allowMissingColumns=True)
    return rows, counted.where(~ok).select(*records.columns, reason.alias("reason"))


def update(stored: DataFrame, changes: DataFrame, key: str, at=None) -> tuple[DataFrame, DataFrame]:
    """(rows, log): stored rows with the fields that ``changes`` gives; a null field is no change, and an unknown key changes nothing.

    ``log`` has (key, field, old_value, new_value, [at]) of every field whose value became another. Of several changes of one key an arbitrary one counts.
    """
    fields = [c for c in changes.columns if c != key and c in stored.columns]
    c = changes.dropDuplicates([key]).select(F.col(key).alias("_k"), *[F.col(f).alias(f"_n_{f}") for f in fields])
    j = stored.join(c, F.col(key) == F.col("_k"), "left")
    kinds = dict(stored.dtypes)
    rows = j.select(*[F.coalesce(F.col(f"_n_{f}").cast(kinds[f]), f).alias(f) if f in fields else F.col(f) for f in stored.columns])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old_value"), F.col(f"_n_{f}").cast("string").alias("new_value")) for f in fields])
    log = j.where("_k is not null").select(key, F.explode(each).alias("x")).select(key, "x.*").where("new_value is not null and not (new_value <=> old_value)")
    return rows, log if at is None else log.withColumn("at", at)


def remove(stored: DataFrame, key: str, ids: DataFrame | None = None, title: str | None = None, title_col: str = "canonical_title") -> tuple[DataFrame, int]:
    """(rows, removed): without the rows of some keys, or with exactly a title; without either nothing goes."""
    if ids is not None:
        gone = stored.join(ids.select(key).distinct(), key, "left_semi").select(key).distinct()
    elif title is not None:
        gone = stored.where(F.col(title_col) == title).select(key).distinct()
    else:
        return stored, 0
    return stored.join(gone, key, "left_anti"), gone.count()
