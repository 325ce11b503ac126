"""Block operators against plain Python, with one group holding a third of all rows and blocks far smaller than it."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import blocks, metrics, windows
from tests.conftest import rows

SCHEMA = "g string, o long, t string, v double"


def data(seed: int = 7) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for group, n in [("hot", 90), ("b", 40), (None, 35), ("c", 1), ("d", 3), ("e", 60), ("f", 41)]:
        for o in sorted(rng.sample(range(-60, 400), n)):
            value = rng.choice([rng.randrange(100) / 4, math.nan, math.inf, None])
            out.append((group, o, rng.choice([f"w{o}", "", " x ", None]), value))
    return out


def grouped(table):
    result = {}
    for row in sorted(table, key=lambda r: r[1]):
        result.setdefault(row[0], []).append(row)
    return result


@pytest.fixture(scope="module")
def table():
    return data()


@pytest.fixture(scope="module")
def df(spark, table):
    shuffled = table[:]
    random.Random(1).shuffle(shuffled)
    return spark.createDataFrame(shuffled, SCHEMA).repartition(5)


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_ordinals(df, table, size):
    got = rows(blocks.ordinals(df.select("g", "o"), ["g"], "o", total="n", block_rows=size).select("g", "o", "pos", "n"))
    expected = [(g, r[1], i, len(rs)) for g, rs in grouped(table).items() for i, r in enumerate(rs)]
    assert sorted(map(str, got)) == sorted(map(str, expected))


@pytest.mark.parametrize("size", [1, 2, 5, 10_000])
def test_sliding_context(df, table, size):
    got = rows(windows.sliding_context(df, ["g"], "o", "t", block_rows=size).select("g", "o", "context"))
    expected = []
    for g, rs in grouped(table).items():
        texts = [r[2] or "" for r in rs]
        expected += [(g, rs[i][1], " ".join(texts[i - 3 : i])) for i in range(3, len(rs))]
    assert sorted(map(str, got)) == sorted(map(str, expected))


@pytest.mark.parametrize("size", [1, 16, 10_000])
def test_prefix_context(df, table, size):
    got = rows(windows.prefix_context(df, ["g"], "o", "t", block_rows=size).select("g", "o", "context"))
    expected = []
    for g, rs in grouped(table).items():
        texts = [r[2] or "" for r in rs]
        expected += [(g, rs[i][1], " ".join(texts[:i]).strip()) for i in range(1, len(rs))]
    assert sorted(map(str, got)) == sorted(map(str, expected))


@pytest.mark.parametrize("size", [1, 5, 10_000])
@pytest.mark.parametrize("limit", [1, 4, 30])
def test_prefix_context_with_a_limit(df, table, size, limit):
    got = rows(windows.prefix_context(df, ["g"], "o", "t", limit, size).select("g", "o", "context"))
    expected = []
    for g, rs in grouped(table).items():
        texts = [r[2] or "" for r in rs]
        expected += [(g, rs[i][1], " ".join(texts[:i])[:limit].strip()) for i in range(1, len(rs))]
    assert sorted(map(str, got)) == sorted(map(str, expected))


@pytest.mark.parametrize("size", [7, 10_000])
def test_prefix_lengths(df, table, size):
    got = rows(windows.prefix_lengths(df, ["g"], "o", "t", "n", size).select("g", "o", "n"))
    expected = []
    for g, rs in grouped(table).items():
        texts = [r[2] or "" for r in rs]
        expected += [(g, rs[i][1], len(" ".join(texts[:i]).strip())) for i in range(len(rs))]
    assert sorted(map(str, got)) == sorted(map(str, expected))


@pytest.mark.parametrize("size", [1, 9, 10_000])
def test_ordered_concat(df, table, size):
    got = rows(windows.ordered_concat(df, ["g"], "o", "t", "|", block_rows=size))
    expected = [(g, "|".join(r[2] or "" for r in rs)) for g, rs in grouped(table).items()]
    assert sorted(map(str, got)) == sorted(map(str, expected))


@pytest.mark.parametrize("size", [1, 11, 10_000])
def test_running_avg(df, table, size):
    clean = df.withColumn("v", F.when(windows.finite("v"), F.col("v")))
    got = rows(windows.running_avg(clean, ["g"], "o", "v", "a", block_rows=size).select("g", "o", "a"))
    expected = []
    for g, rs in grouped(table).items():
        seen = []
        for r in rs:
            if r[3] is not None and math.isfinite(r[3]):
                seen.append(r[3])
            expected.append((g, r[1], sum(seen) / len(seen) if seen else None))
    assert sorted(map(str, got)) == sorted(map(str, expected))


def stops(losses, patience):
    best, wait, out = math.inf, 0, []
    for epoch, loss in enumerate(losses, 1):
        if loss is not None and math.isfinite(loss) and loss < best:
            best, wait = loss, 0
            out.append((epoch, best, wait, True))
        else:
            wait += 1
            out.append((epoch, None if best == math.inf else best, wait, False))
            if wait >= patience:
                break
    return out


@pytest.mark.parametrize(("size", "patience"), [(1, 3), (4, 10), (10_000, 4)])
def test_early_stop(spark, table, size, patience):
    runs = {g: [r[3] for r in rs] for g, rs in grouped(table).items()}
    df = spark.createDataFrame(
        [(g, e, x) for g, xs in runs.items() for e, x in enumerate(xs, 1)], "g string, e long, v double"
    )
    result = windows.early_stop(df, ["g"], "e", "v", patience=patience, block_rows=size)
    got = rows(result.select("g", "e", "best_loss", "wait", "improved"))
    expected = [(g, *r) for g, xs in runs.items() for r in stops(xs, patience)]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    kept = rows(windows.checkpoints(df, ["g"], "e", "v", patience=patience, block_rows=size).select("g", "e"))
    assert sorted(map(str, kept)) == sorted(str(r[:2]) for r in expected if r[4])
    last = {g: len(stops(xs, patience)) for g, xs in runs.items() if stops(xs, patience)[-1][2] >= patience}
    assert {(r["g"], r["e"]) for r in result.filter("stopped").collect()} == set(last.items())


@pytest.mark.parametrize("size", [1, 6, 10_000])
@pytest.mark.parametrize("keys", [["g"], []])
def test_islands(spark, size, keys):
    rng = random.Random(3)
    table = [(rng.choice(["a", "a", None]), i, rng.choice(["x", "x", "y", None])) for i in range(0, 400, 2)]
    df = spark.createDataFrame(table, "g string, o long, l string").repartition(4)
    got = rows(windows.islands(df, keys, "o", ["l"], block_rows=size).select("o", "island"))
    state, expected = {}, []
    for g, o, label in table:
        key = g if keys else 0
        number, previous = state.get(key, (0, label))
        number += previous != label
        state[key] = (number, label)
        expected.append((o, number))
    assert sorted(got) == sorted(expected)


def test_island_summary_adds_up(spark):
    df = spark.createDataFrame([(i, "ab"[i // 5 % 2]) for i in range(40)], "o long, l string")
    got = rows(windows.island_summary(df, [], "o", ["l"], block_rows=3))
    assert [r[2:] for r in sorted(got)] == [(5, i, i + 4) for i in range(0, 40, 5)]


@pytest.mark.parametrize("size", [1, 13, 10_000])
def test_microbatch(df, table, size):
    got = rows(windows.microbatch(df, ["g"], "o", "v", 16, block_rows=size))
    expected = []
    for g, rs in grouped(table).items():
        for step in range(0, len(rs), 16):
            part = rs[step : step + 16]
            total = sum(r[3] for r in part if r[3] is not None and math.isfinite(r[3]))
            expected.append((g, step // 16, total / 16, len(part), len(part) == 16))
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_rows_without_an_order_are_refused(spark):
    df = spark.createDataFrame([("a", 1), ("a", None)], "g string, o long")
    with pytest.raises(Exception, match="must not be null"):
        blocks.ordinals(df, ["g"], "o").collect()


def test_sparse_orders_make_few_blocks(spark):
    """Gaps, clusters and ties in the order: blocks about as many as rows / block_rows, in order, none too large."""
    rng = random.Random(5)
    orders = sorted({int(10 ** rng.uniform(0, 17)) for _ in range(3_000)}) + [10**18 + i for i in range(3_000)]
    df = spark.createDataFrame([("hot", o) for o in orders] + [(f"k{i}", i) for i in range(50)], "g string, o long")
    found = blocks.with_block(df, ["g"], "o", 500).groupBy(blocks.KEY, blocks.BLOCK)
    found = found.agg(F.count("*").alias("n"), F.min("o").alias("low"), F.max("o").alias("high")).collect()
    hot = sorted((r for r in found if r[blocks.KEY]["g"] == "hot"), key=lambda r: r[blocks.BLOCK])
    assert len(hot) <= 3 * 6_000 / 500 and max(r["n"] for r in hot) <= 500 and len(found) == len(hot) + 50
    assert all(a["high"] < b["low"] for a, b in zip(hot, hot[1:], strict=False))


def test_ties_stay_together(spark):
    df = spark.createDataFrame([(1, 5)] * 40 + [(1, 6), (1, 4)], "g long, o long")
    found = blocks.with_block(df, ["g"], "o", 10).groupBy(blocks.BLOCK).agg(F.collect_set("o").alias("o")).collect()
    assert sorted(r["o"] for r in found) == [[4], [5], [6]] or sorted(r["o"] for r in found) == [[4], [5, 6]]


def test_epoch_means_feed_early_stop(spark):
    losses = [3.0, 2.0, math.nan, 2.5, 2.0, 1.0]
    batches = [("r", e, x + d) for e, x in enumerate(losses, 1) for d in (-0.5, 0.5)]
    means = metrics.epoch_mean(spark.createDataFrame(batches, "run string, epoch long, loss double"), "loss", ["run", "epoch"])
    got = windows.early_stop(means, ["run"], "epoch", "mean_value", patience=3).orderBy("epoch").collect()
    assert [(r["epoch"], r["wait"], r["stopped"]) for r in got] == [
        (1, 0, False), (2, 0, False), (3, 1, False), (4, 2, False), (5, 3, True),
    ]


def test_top_n_limits_before_the_shuffle(df):
    result = windows.top_n(df, ["g"], ["o"], 3)
    assert result.count() == 3 * 6 + 1
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_last_row_where(df, table):
    got = dict((r["g"], r["o"]) for r in windows.last_row_where(df, ["g"], "o", F.col("t") == "", "t").collect())
    expected = {g: max(r[1] for r in rs if r[2] == "") for g, rs in grouped(table).items() if any(r[2] == "" for r in rs)}
    assert got == expected


def test_rows_are_shuffled_once(spark, df):
    """With sort-merge joins the rows of a running figure cross the network once; the states add small exchanges."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        result = windows.running_avg(df, ["g"], "o", "v")
        plan = result._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = plan.split("SortMergeJoin", 1)[1].splitlines()[1:]
    main_side = [line for line in lines if line.lstrip().startswith(":")]
    assert "SinglePartition" not in plan
    assert sum("Exchange hashpartitioning(_key" in line for line in main_side) == 1


@pytest.mark.parametrize("orders", [[i * 7 for i in range(12_000)], [0] * 12_000 + list(range(1, 40))])
def test_a_group_is_cut_in_few_rounds(spark, monkeypatch, orders):
    """A group of 1,500 blocks needs one round of cuts; one that is nearly all ties does not lose its rows one by one."""
    rounds = []
    keep = blocks.cut_lineage
    monkeypatch.setattr(blocks, "cut_lineage", lambda df, label: rounds.append(label) or keep(df, label))
    df = spark.createDataFrame([("hot", o) for o in orders], "g string, o long")
    found = blocks.with_block(df, ["g"], "o", 8).groupBy(blocks.BLOCK)
    found = found.agg(F.count("*").alias("n"), F.min("o").alias("low"), F.max("o").alias("high")).orderBy(blocks.BLOCK).collect()
    assert sum(r["n"] for r in found) == len(orders) and all(r["n"] <= 8 or r["low"] == r["high"] for r in found)
    assert all(a["high"] < b["low"] for a, b in zip(found, found[1:], strict=False))
    assert rounds.count("block-cuts") <= 2
