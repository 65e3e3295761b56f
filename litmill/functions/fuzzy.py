"""Scores of how alike two strings are, for which there is no built-in expression: Arrow-batched."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from litmill.functions.text import author_key


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched letters over all letters; 0 for nulls."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def author_score(query: Column, author: Column) -> Column:
    """1 for equal names; up to 0.95 for a part of the name, by its length; else the ratio of matched letters."""
    q, a = author_key(query), author_key(author)
    part = F.least(F.lit(0.95), 0.75 + 0.20 * F.length(q) / F.greatest(F.length(a), F.lit(1)))
    return (
        F.when((q == "") | (a == "") | q.isNull() | a.isNull(), 0.0)
        .when(q == a, 1.0)
        .when(F.contains(a, q), part)
        .otherwise(ratio(q, a))
    )
