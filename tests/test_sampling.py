from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import sampling
from tests.conftest import rows


def order(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n", [0, 1, 50, 999, 1_000, 5_000])
def test_sample(spark, n):
    sample = sampling.sample_seeded(spark.range(1_000), "id", n)
    assert sorted(r["id"] for r in sample.collect()) == sorted(order(range(1_000))[:n])
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "TakeOrdered" not in plan


def test_sample_per_group(spark):
    df = spark.range(900).withColumn("g", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)))
    got = sampling.sample_per_group(df, "g", ["hot", "g0", "g1"], "id", 70)
    members = {g: [r["id"] for r in df.filter(F.col("g") == g).collect()] for g in ("hot", "g0", "g1")}
    expected = sorted((g, i) for g, ids in members.items() for i in order(ids)[:70])
    assert sorted((r["g"], r["id"]) for r in got.collect()) == expected


@pytest.mark.parametrize("n", [1, 7, 2_000])
def test_first_n(spark, n):
    df = spark.range(1_000).repartition(7).withColumn("x", F.col("id") % 2)
    got = sorted(r["id"] for r in sampling.take_first(df, F.col("x") == 1, "id", n).collect())
    assert got == list(range(1, 1_000, 2))[:n]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1_000])
def test_exact_split(spark, n):
    got = {r["id"]: r["split"] for r in sampling.split_exact(spark.range(n), "id").collect()}
    test = math.ceil(0.2 * n)
    val = math.ceil(0.25 * (n - test))
    ranked = order(range(n))
    assert len(got) == n
    assert {i for i, s in got.items() if s == "test"} == set(ranked[:test])
    assert {i for i, s in got.items() if s == "val"} == set(ranked[test : test + val])


def test_exact_split_does_not_shuffle_rows(spark):
    plan = sampling.split_exact(spark.range(100), "id")._jdf.queryExecution().sparkPlan()
    assert "Exchange" not in plan.nodeName()
    assert plan.nodeName() == "Project"


def test_hash_split_keeps_groups_together(spark):
    df = spark.range(5_000).withColumn("k", F.col("id") % 400)
    split = sampling.split_hash(df, "k")
    assert split.groupBy("k").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    shares = {r["split"]: r["count"] / 5_000 for r in split.groupBy("split").count().collect()}
    assert abs(shares["test"] - 0.2) < 0.08 and abs(shares["val"] - 0.2) < 0.08


def test_thread_split(spark):
    df = spark.createDataFrame([(i, i % 10) for i in range(200)], "id int, root int")
    whole = sampling.split_threads(df, "id", "root")
    assert whole.select("root", "split").distinct().count() == 10
    assert sampling.split_threads(df, "id", "root", leaky=True).select("root", "split").distinct().count() > 10


def test_where_ci(spark):
    df = spark.createDataFrame([("Python",), ("java",), (None,)], "lang string")
    assert rows(sampling.where_ci(df, "lang", "PYTHON")) == [("Python",)]
    assert sampling.where_ci(df, "lang", "").count() == 3


def test_lower_case_column_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([("Python", 1), ("java", 2)], "lang string, id int")
    sampling.with_lower(df, "lang").write.parquet(str(tmp_path / "code"))
    found = sampling.where_ci(spark.read.parquet(str(tmp_path / "code")), "lang", "PYTHON")
    assert rows(found.select("id")) == [(1,)]
    assert "EqualTo(lang_lower,python)" in found._jdf.queryExecution().executedPlan().toString()


def test_first_n_filters_the_scan(spark, tmp_path):
    spark.range(1_000).withColumn("t", F.lit("x")).write.parquet(str(tmp_path / "t"))
    plan = sampling.first_n(spark.read.parquet(str(tmp_path / "t")), "id", 5)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(id,4)" in plan
