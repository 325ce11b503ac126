from __future__ import annotations

import os

import pytest

from corpusloom.plans import corpus
from corpusloom.plans.queries import QUERIES
from corpusloom.session import fresh_path
from corpusloom.sources import catalog
from tests.conftest import rows


def pairs(spark, n=40):
    return spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(n)], "source_id long, input string, target string")


def test_build_isolates_failures_and_resumes(spark):
    out, opened = fresh_path(spark, "corpus"), []

    def good():
        opened.append(1)
        return pairs(spark)

    def broken():
        raise OSError("no such volume")

    sources = {"zz": good, "bbh": good, "mmlu": broken, "kjv_bible": lambda: pairs(spark).select("source_id")}
    for _ in range(2):
        manifest = {r["name"]: (r["status"], r["n_rows"]) for r in corpus.build_corpus(spark, sources, out).collect()}
        assert manifest == {
            "bbh": ("ok", 40),
            "mmlu": ("failed", None),
            "kjv_bible": ("ok", 0),  # finished, all rows rejected
            "zz": ("no adapter", None),
        }
    assert len(opened) == 1
    built = corpus.open_corpus(spark, out)
    assert rows(built.select("dataset").distinct()) == [("bbh",)]
    plan = built.filter("dataset = 'bbh' and split = 'test'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan
    assert {r["split"] for r in built.collect()} <= {"train", "val", "test"}


def test_samples_of_a_row_share_a_split(spark):
    df = spark.createDataFrame([(i, ["a", "b", "c", "d"]) for i in range(60)], "source_id long, dialog array<string>")
    labelled = corpus.split_samples("daily_dialog", df)
    assert labelled.count() == 180
    assert labelled.select("source_id", "split").distinct().count() == 60


def test_threads_do_not_leak(spark):
    messages = []
    for t in range(30):
        messages.append((f"{t}r", None, "user", "root"))
        messages += [(f"{t}a{i}", f"{t}r", "assistant", "answer") for i in range(4)]
    df = spark.createDataFrame(messages, "message_id string, parent_id string, role string, text string")
    split = {r["source_id"]: r["split"] for r in corpus.split_samples("open_assistant", df).collect()}
    assert len(split) == 120
    assert all(len({split[f"{t}a{i}"] for i in range(4)}) == 1 for t in range(30))
    leaky = {r["source_id"]: r["split"] for r in corpus.split_samples("open_assistant", df, leaky=True).collect()}
    assert any(len({leaky[f"{t}a{i}"] for i in range(4)}) > 1 for t in range(30))


def test_tokenise(spark):
    df = spark.createDataFrame([("x y " * 400, " y ", "chat")], "context string, target string, task string")
    row = corpus.tokenise(df, ["x", "y"]).first()
    assert row["context_tokens"] == [5, 6] * 400
    assert len(corpus.tokenise(df, ["x", "y"], context_length=512).first()["context_tokens"]) == 512
    assert row["target_tokens"][:4] == [2, 6, 3, 1] and len(row["target_tokens"]) == 512
    assert row["task"] == "chat"


def test_evaluation_plan(spark):
    status = {r["name"]: r["status"] for r in corpus.evaluation_plan(spark).collect()}
    assert list(status) and set(status) == set(catalog.BENCHMARK_ORDER)
    assert status["mmlu"] == "ok"
    assert status["apps"] == "no evaluation split"


def test_score(spark):
    answers = spark.createDataFrame(
        [("mmlu", "A", "a"), ("mmlu", "b", "a"), ("mbpp", "x", "x"), ("apps", "x", "x"), ("alpaca", "x", "y")],
        "dataset string, prediction string, gold string",
    )
    card = [(r["dataset"], r["score"]) for r in corpus.score(spark, answers).collect()]
    assert card == [("alpaca", 0.0), ("mmlu", 0.5), ("mbpp", 0.0)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_all_datasets_read_shared_tables_once(spark):
    """One pass over documents for its 15 datasets with a sample per row, and one for the labelled ones."""
    plan = QUERIES["set_corpus_all"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "Relation [" in line]
    assert sum("n_chars#" in line for line in scans) == 2, scans
    assert sum("o_orderkey#" in line for line in scans) == 1, scans
