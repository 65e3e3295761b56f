"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.operators.timestamps import delivered_moments, normalise_moments
from litmill.session import table


def _moments(spark: SparkSession, d: str) -> DataFrame:
    values = delivered_moments(table(spark, d, "papers"), table(spark, d, "preprint_records"), table(spark, d, "citation_records"))
    return normalise_moments(values, table(spark, d, "publishers"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _moments(spark, d).where("utc_us is not null").select("table_name", "row_id", "field_name", "utc_us")


def p5_readings(spark: SparkSession, d: str) -> DataFrame:
    """How the values of each field were read."""
    return _moments(spark, d).groupBy("table_name", "field_name", "reading").agg(F.count("*").alias("n"))


QUERIES = {"p5_found": p5_found, "p5_readings": p5_readings}
SQL: dict[str, str] = {}
