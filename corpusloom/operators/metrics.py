"""Counts, accuracies and figures from training logs: plain aggregates, combined in the tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import norm_answer
from corpusloom.operators.windows import finite

# Datasets whose answers are compared exactly; all others score 0.
EXACT_MATCH_DATASETS = ("mmlu", "arc_easy", "arc_challenge", "gsm8k")

# Name part -> component, first match counts.
COMPONENTS = (
    ("chunk_encoder", "ChunkEncoder"),
    ("aggregator", "Aggregator"),
    ("reasoning_module", "ReasoningModule"),
    ("decompressor", "Decompressor"),
    ("compressor", "Compressor"),
)
OTHER_COMPONENT = "Other"


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def exact_match(
    df: DataFrame, prediction: str, gold: str, by: str, scored: Sequence[str] | None = EXACT_MATCH_DATASETS
) -> DataFrame:
    """Share of answered rows whose normalised prediction equals the gold answer, 0 where none is answered."""
    given = norm_answer(prediction)
    hit = F.when(given.isNotNull(), F.when(given == norm_answer(gold), 1.0).otherwise(0.0))
    score = F.coalesce(F.avg(hit), F.lit(0.0))
    result = df.groupBy(by).agg(score.alias("score"), F.count(hit).alias("n_answered"))
    if scored is None:
        return result
    return result.withColumn("score", F.when(F.col(by).isin(list(scored)), F.col("score")).otherwise(0.0))


def masked_mean(df: DataFrame, value: str, mask: Column, by: Sequence[str]) -> DataFrame:
    """Mean of ``value`` where ``mask`` holds, 0 where it never does."""
    kept = F.when(mask, F.col(value))
    total, n = F.sum(kept).cast("double"), F.count_if(mask)
    return df.groupBy(*by).agg(F.when(n > 0, total / n).otherwise(0.0).alias("mean_value"), n.alias("n_kept"))


def epoch_mean(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Mean over the finite batches and their number; no mean where there are none."""
    kept = F.when(finite(value), F.col(value))
    return df.groupBy(*by).agg(
        (F.sum(kept).cast("double") / F.nullif(F.count(kept), F.lit(0))).alias("mean_value"),
        F.count(kept).alias("n_batches"),
    )


def duplicates(df: DataFrame, key: str, digest: bool = False) -> DataFrame:
    """Keys that occur more than once. ``digest`` groups long texts by their SHA-256 (32 bytes), so no text is
    shuffled, and returns it in hex."""
    grouped = F.unhex(F.sha2(F.col(key), 256)) if digest else F.col(key)
    counted = df.groupBy(grouped.alias(key)).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
    return counted.withColumn(key, F.lower(F.hex(key))) if digest else counted


def component_of(name: str) -> Column:
    lowered = F.lower(F.col(name))
    found = F.lit(OTHER_COMPONENT)
    for part, component in reversed(COMPONENTS):
        found = F.when(lowered.contains(part), component).otherwise(found)
    return found


def component_rollup(df: DataFrame, name: str, value: str) -> DataFrame:
    """Per component: variables without a gradient, with a zero one, and in all."""
    return df.groupBy(component_of(name).alias("component")).agg(
        F.count_if(F.col(value).isNull()).alias("n_null"),
        F.count_if(F.col(value) == 0).alias("n_zero"),
        F.count(F.lit(1)).alias("n_total"),
    )
