"""Version comparison as Column expressions: numbers part by part, pre-releases before releases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORM = r"^v?(\d+(?:\.\d+)*)(?:[-_.]?(a|alpha|b|beta|c|rc|pre|preview)[-_.]?(\d*))?(?:(?:[-_.]?(?:post|rev|r)[-_.]?(\d*))|-(\d+))?(?:[-_.]?dev[-_.]?(\d*))?(?:\+[a-z0-9.\-_]+)?$"


def version_key(c: Column) -> Column:
    """A struct that sorts as the versions do; null for null or unreadable versions.

    The release's numbers, without zeros at the end, then the stage: development, a, b, rc, final, post.
    """
    v = F.lower(F.trim(c.cast("string")))
    part = lambda i: F.regexp_extract(v, _FORM, i)
    number = lambda x: F.coalesce(x.try_cast("long"), F.lit(0))
    numbers = F.transform(F.split(F.regexp_replace(part(1), r"(\.0+)+$", ""), r"\."), lambda x: number(x))
    pre = F.when(part(2).isin("a", "alpha"), 1).when(part(2).isin("b", "beta"), 2).when(part(2) != "", 3)
    dev, post = v.rlike(r"dev[-_.]?\d*(\+.*)?$"), v.rlike(r"(post|rev|[-_.]r)[-_.]?\d*|\d-\d+$")
    stage = F.coalesce(pre, F.when(dev & ~post, 0).otherwise(4))
    after = F.when(post, number(F.coalesce(F.nullif(part(4), F.lit("")), part(5)))).otherwise(F.lit(-1).cast("long"))
    before_dev = F.when(dev, number(part(6))).otherwise(F.lit(9_223_372_036_854_775_807))
    return F.when(v.rlike(_FORM), F.struct(numbers.alias("release"), stage.alias("stage"), number(part(3)).alias("pre"), after.alias("post"), before_dev.alias("dev")))


def version_text(c: Column) -> Column:
    """A text that sorts as the versions do, for code that compares values one by one; null for null or unreadable versions."""
    k = version_key(c)
    number = lambda x: F.lpad((x + 1).cast("decimal(20,0)").cast("string"), 20, "0")
    release = F.array_join(F.transform(k["release"], lambda x: F.lpad(x.cast("string"), 19, "0")), ".")
    # A release that another goes on from is followed by a blank, which sorts before the full stop.
    return F.when(k.isNotNull(), F.concat_ws(" ", release, k["stage"].cast("string"), number(k["pre"].cast("decimal(20,0)")), number(k["post"].cast("decimal(20,0)")), number(k["dev"].cast("decimal(20,0)"))))


def newer(new: Column, old: Column, new_date: Column, old_date: Column) -> Column:
    """Whether a record replaces another: by version where both can be read and differ, else by a later date.

    Versions of which one is missing or unreadable are not compared; a missing date never wins.
    """
    a, b = version_key(new), version_key(old)
    comparable = a.isNotNull() & b.isNotNull()
    later = F.coalesce(new_date > old_date, new_date.isNotNull() & old_date.isNull())
    return F.when(comparable & (a != b), a > b).otherwise(F.coalesce(later, F.lit(False)))
