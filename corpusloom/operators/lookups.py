"""Joins: lookups by name, reports of missing names, pairing, and lookups that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage

GROUP_ROWS = 65_536  # rows of one key that meet in one task


def first_match(reference: DataFrame, on: str, seq: str) -> DataFrame:
    """One row per name: the first by ``seq``."""
    rest = [c for c in reference.columns if c != on]
    picked = reference.groupBy(on).agg(F.min_by(F.struct(*rest), seq).alias("_row"))
    return picked.select(on, *[F.col(f"_row.{c}").alias(c) for c in rest])


def lookup(df: DataFrame, reference: DataFrame, on: str, seq: str | None = None) -> DataFrame:
    """Left join on the first row of that name. Spark broadcasts the reference only under its size threshold."""
    return df.join(first_match(reference, on, seq) if seq else reference, on, "left")


def missing(df: DataFrame, reference: DataFrame, on: str) -> DataFrame:
    return df.join(reference.select(on), on, "left_anti")


def supported(df: DataFrame, reference: DataFrame, on: str) -> DataFrame:
    return df.join(reference.select(on), on, "left_semi")


def pair(prediction: DataFrame, gold: DataFrame, on: Sequence[str]) -> DataFrame:
    """Predictions next to gold answers, by sample id; samples without a prediction keep a null."""
    return gold.join(prediction, list(on), "left")


def dealt_lookup(
    df: DataFrame,
    reference: DataFrame,
    key: str,
    reference_key: str,
    spread_by: str,
    group_rows: int = GROUP_ROWS,
    n_rows: int | None = None,
) -> DataFrame:
    """Left join to a reference with unique keys, where one key may hold most of ``df``.

    The rows of a key are dealt to ceil(rows / ``group_rows``) tasks by a hash of ``spread_by``, and the key's one
    reference row is copied as often; keys of ``group_rows`` rows or fewer are joined as usual. So the copies
    are at most rows / ``group_rows``, whatever the keys. The count per key runs when this is called; a caller who
    knows that no key has more than ``n_rows`` rows, and these are few, spares it.
    """
    if n_rows is not None and n_rows <= group_rows:
        return df.join(reference, F.col(key) == F.col(reference_key), "left")
    counts = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_large")).agg(F.count(F.lit(1)).alias("_n"))
    deals = F.ceil(F.col("_n") / F.lit(group_rows)).cast("int").alias("_deals")
    large = cut_lineage(counts.filter(F.col("_n") > group_rows).select("_large", deals), "large-keys")
    if large.isEmpty():
        return df.join(reference, F.col(key) == F.col(reference_key), "left")
    deal = F.pmod(F.xxhash64(spread_by), F.coalesce("_deals", F.lit(1))).cast("int")
    dealt = df.join(large, F.col(key) == F.col("_large"), "left").withColumn("_deal", deal).drop("_large", "_deals")
    copies = reference.join(large, F.col(reference_key) == F.col("_large"), "left").drop("_large")
    every = F.sequence(F.lit(0), F.coalesce("_deals", F.lit(1)) - 1)
    copies = copies.withColumn("_copy", F.explode(every)).drop("_deals")
    return dealt.join(
        copies, (F.col(key) == F.col(reference_key)) & (F.col("_deal") == F.col("_copy")), "left"
    ).drop("_deal", "_copy")
