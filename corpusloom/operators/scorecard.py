"""Own scores beside published ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OWN = "own"


def scorecard(scores: DataFrame, published: DataFrame, own: str = OWN) -> DataFrame:
    """(dataset, score, models): the own score merged with the published ones into a map.

    Published scores are a fixed list of a few rows; one map per dataset is what the report prints.
    """
    listed = F.sort_array(F.collect_list(F.struct("model", "score")))
    maps = published.groupBy("dataset").agg(F.map_from_entries(listed).alias("_published"))
    joined = scores.join(maps, "dataset", "left")
    mine = F.create_map(F.lit(own), F.col("score"))
    models = F.when(F.col("_published").isNull(), mine).otherwise(F.map_concat(mine, "_published"))
    return joined.select("dataset", "score", models.alias("models"))


def scorecard_rows(card: DataFrame) -> DataFrame:
    return card.select("dataset", F.explode("models").alias("model", "score"))


def scorecard_lines(card: DataFrame, own: str = OWN) -> DataFrame:
    return card.select(
        F.format_string(
            "%s: %s: %s, Top models: %s",
            F.col("dataset"),
            F.lit(own),
            F.col("score").cast("string"),
            F.to_json("models"),
        ).alias("value")
    )
