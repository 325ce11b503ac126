"""Required fields, validity and the report of rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import has_text

ACCEPTED = "accepted"


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose listed texts are all present and not empty."""
    for c in columns:
        df = df.filter(has_text(c))
    return df


def valid_samples(df: DataFrame) -> DataFrame:
    return df.filter(F.col("context").isNotNull() & F.col("target").isNotNull() & F.col("task").isNotNull())


def reject_reason(rules: dict[str, Column]) -> Column:
    """The first reason whose condition holds (an unknown condition does not)."""
    reason = F.lit(ACCEPTED)
    for name, condition in reversed(rules.items()):
        reason = F.when(condition, name).otherwise(reason)
    return reason


def rejects(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Row counts per reason, accepted rows included, so that the counts add up to the input."""
    return df.groupBy(reject_reason(rules).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


def adapter_report(raw: DataFrame, samples: DataFrame, source_id: str = "source_id") -> DataFrame:
    """One row: raw rows, raw rows that gave a sample, raw rows that gave none, and samples.

    ``source_id`` is unique in the raw table.
    """
    given = samples.groupBy(source_id).agg(F.count(F.lit(1)).alias("_n"))
    marked = raw.select(F.col(source_id).alias("_raw")).join(given, F.col("_raw") == F.col(source_id), "left")
    return marked.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("_n").alias("n_accepted"),
        F.count_if(F.col("_n").isNull()).alias("n_rejected"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_samples"),
    )
