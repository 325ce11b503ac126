from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lookups, metrics, scorecard
from corpusloom.sources import catalog
from tests.conftest import rows


def test_exact_match(spark):
    df = spark.createDataFrame(
        [("mmlu", " A ", "a"), ("mmlu", "b", "a"), ("mmlu", None, "a"), ("gsm8k", None, "1"), ("mbpp", "x", "x")],
        "dataset string, prediction string, gold string",
    )
    got = rows(metrics.exact_match(df, "prediction", "gold", "dataset"))
    assert got == [("gsm8k", 0.0, 0), ("mbpp", 0.0, 1), ("mmlu", 0.5, 2)]
    assert dict((r[0], r[1]) for r in rows(metrics.exact_match(df, "prediction", "gold", "dataset", None)))["mbpp"] == 1.0


def test_masked_mean(spark):
    df = spark.createDataFrame([("a", 1.0, 7), ("a", 3.0, 7), ("a", 9.0, 1), ("b", 5.0, 1)], "run string, loss double, label int")
    assert rows(metrics.masked_mean(df, "loss", F.col("label") != 1, ["run"])) == [("a", 2.0, 2), ("b", 0.0, 0)]


def test_epoch_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", math.nan), ("a", math.inf), ("a", 2.0), ("b", math.nan)], "run string, loss double")
    assert rows(metrics.epoch_mean(df, "loss", ["run"])) == [("a", 1.5, 2), ("b", None, 0)]


def test_duplicates(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,), (None,)], "k string")
    assert rows(metrics.duplicates(df, "k")) == [(None, 2), ("x", 2)]
    assert sorted(r[1] for r in rows(metrics.duplicates(df, "k", digest=True))) == [2, 2]


def test_component_rollup(spark):
    df = spark.createDataFrame(
        [("Chunk_Encoder/a", 0.0), ("x/decompressor", None), ("compressor_1", 1.0), ("head", 0.0), ("aggregator", 2.0)],
        "name string, g double",
    )
    assert rows(metrics.component_rollup(df, "name", "g")) == [
        ("Aggregator", 0, 0, 1),
        ("ChunkEncoder", 0, 1, 1),
        ("Compressor", 0, 0, 1),
        ("Decompressor", 1, 0, 1),
        ("Other", 0, 1, 1),
    ]


def test_pair_keeps_unanswered(spark):
    gold = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "source_id int, sample_no int, gold string")
    prediction = spark.createDataFrame([(1, 0, "a"), (9, 0, "z")], "source_id int, sample_no int, prediction string")
    got = rows(lookups.pair(prediction, gold, ["source_id", "sample_no"]))
    assert got == [(1, 0, "a", "a"), (2, 0, "b", None)]


def test_scorecard(spark):
    scores = spark.createDataFrame([("mbpp", 0.25), ("sciq", 0.5)], "dataset string, score double")
    card = scorecard.scorecard(scores, catalog.published_scores(spark))
    got = {r["dataset"]: r["models"] for r in card.collect()}
    assert got == {"mbpp": {"own": 0.25, **catalog.PUBLISHED_SCORES["mbpp"]}, "sciq": {"own": 0.5}}
    lines = [r["value"] for r in scorecard.scorecard_lines(card).collect()]
    assert 'sciq: own: 0.5, Top models: {"own":0.5}' in lines


def test_catalog(spark):
    rows_ = catalog.catalog(spark).orderBy("seq").collect()
    assert len(rows_) == 26
    assert rows_[0]["name"] == "code_search_net" and rows_[0]["trust_remote_code"]
    caps = {r["name"]: r["row_cap"] for r in rows_ if r["row_cap"]}
    assert caps == {"nq_open": 5_000, "ultrafeedback": 5_000, "aqua_rat": 5_000, "apps": 5_000, "codecontests": 3_000}
    assert [r["name"] for r in rows_ if r["format"] == "json"] == ["strategyqa"]
    assert len(catalog.BENCHMARK_ORDER) == 25 and len(catalog.EVALUATION_SPLITS) == 18


def test_ordered_subset(spark):
    ordered = catalog.ordered_subset(catalog.catalog(spark), catalog.BENCHMARK_ORDER)
    assert [r["name"] for r in ordered.collect()] == list(catalog.BENCHMARK_ORDER)


@pytest.mark.parametrize("name", ["catalog", "published_scores", "evaluation_splits", "benchmark_order"])
def test_fixed_lists_are_local_relations(spark, name):
    plan = getattr(catalog, name)(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan
