from __future__ import annotations

import random

import pytest

from corpusloom.operators import vectors
from tests.conftest import rows


def tree(leaves):
    """Level by level, an odd last node promoted."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        nodes = [[(a + b) / 2 for a, b in zip(below[i], below[i + 1])] for i in range(0, len(below) - 1, 2)]
        levels.append(nodes + ([below[-1]] if len(below) % 2 else []))
    return levels


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(9)
    return {n: [[rng.randrange(-8, 8) / 4 for _ in range(3)] for _ in range(n)] for n in [*range(1, 34), 64, 65, 255, 256, 257, 300, 513]}


@pytest.fixture(scope="module")
def df(spark, docs):
    data = [(n, i * 3 + n, v) for n, vs in docs.items() for i, v in enumerate(vs)]
    random.Random(2).shuffle(data)
    return spark.createDataFrame(data, "doc int, seq long, vec array<float>").repartition(6)


@pytest.mark.parametrize("copy", [False, True])
def test_embedding_tree(df, docs, copy):
    got = {(r["doc"], r["level"], r["pos"]): r["vec"] for r in vectors.embedding_tree(df, "doc", "seq", "vec", 3, copy).collect()}
    expected = {}
    for n, leaves in docs.items():
        levels = tree(leaves)
        for level, nodes in enumerate(levels + ([levels[-1]] if copy else [])):
            for pos, vec in enumerate(nodes):
                expected[(n, level, pos)] = vec
    assert got.keys() == expected.keys()
    for key, vec in expected.items():
        assert got[key] == pytest.approx(vec), key


def test_second_moment(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 0.0]), ("b", [1.0, 1.0])], "k string, v array<float>")
    assert rows(vectors.second_moment(df, "k", "v", 2)) == [("a", 0, 5.0), ("a", 1, 2.0), ("b", 0, 1.0), ("b", 1, 1.0)]
    per_batch = rows(vectors.second_moment(df, "k", "v", 2, divisor="batches", batch_size=2))
    assert per_batch[0] == ("a", 0, 10.0)
    with pytest.raises(ValueError):
        vectors.second_moment(df, "k", "v", 2, divisor="tokens")


def test_weighted_drift_ignores_names_on_one_side(spark):
    current = spark.createDataFrame([("w", 0, 2.0), ("w", 1, 1.0), ("new", 0, 9.0)], "name string, idx int, value double")
    snapshots = spark.createDataFrame(
        [(0, "w", 0, 0.5, 1.0), (0, "w", 1, 2.0, 1.5), (1, "w", 0, 1.0, 2.0), (1, "gone", 0, 1.0, 1.0)],
        "task_no int, name string, idx int, importance double, anchor double",
    )
    assert rows(vectors.weighted_drift(current, snapshots)) == [(0, 500.0), (1, 0.0)]


def test_sum_squares(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0],)], "v array<float>")
    assert vectors.sum_squares(df, "v").first()["l2"] == pytest.approx(14e-6)


def test_pad_vectors(spark):
    df = spark.createDataFrame(
        [(0, "a", 0, [1.0]), (0, "a", 1, [2.0]), (0, "a", 2, [3.0]), (0, "b", 0, [4.0]), (1, "c", 0, [5.0])],
        "batch int, doc string, pos long, vec array<float>",
    )
    got = rows(vectors.pad_vectors(df, "batch", "doc", "pos", "vec", 1))
    assert sorted(got) == [
        (0, "a", 0, [1.0]), (0, "a", 1, [2.0]), (0, "a", 2, [3.0]),
        (0, "b", 0, [4.0]), (0, "b", 1, [0.0]), (0, "b", 2, [0.0]),
        (1, "c", 0, [5.0]),
    ]


def test_concat_pairs(df, docs):
    got = {(r["doc"], r["pair_no"]): r["vec"] for r in vectors.concat_pairs(df, "doc", "seq", "vec").collect()}
    expected = {(n, i // 2): vs[i] + vs[i + 1] for n, vs in docs.items() for i in range(0, n - 1, 2)}
    assert got == expected


def test_tree_of_trees(spark):
    """A document of three rounds of blocks, a group without a name, null vectors."""
    big = [(None, i, [float(i % 7), 1.0]) for i in range(70_000)] + [(1, 0, None), (1, 1, [2.0, 4.0]), (1, 2, None)]
    got = vectors.embedding_tree(spark.createDataFrame(big, "doc int, seq long, vec array<float>").repartition(4), "doc", "seq", "vec", 2)
    found = {(r["level"], r["pos"]): r["vec"] for r in got.filter("doc IS NULL AND level > 7").collect()}
    levels = tree([v for d, _, v in big if d is None])
    assert found.keys() == {(n, p) for n in range(8, len(levels)) for p in range(len(levels[n]))}
    assert all(found[n, p] == pytest.approx(levels[n][p]) for n, p in found)
    small = {(r["level"], r["pos"]): r["vec"] for r in got.filter("doc = 1").collect()}
    assert small == {(0, 0): None, (0, 1): [2, 4], (0, 2): None, (1, 0): [2, 4], (1, 1): None, (2, 0): [2, 4]}


def test_vectors_of_another_length_stop_the_tree(spark):
    bad = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [1.0, 2.0])], "doc int, seq long, vec array<float>")
    with pytest.raises(Exception, match="has not 2 cells"):
        vectors.embedding_tree(bad, "doc", "seq", "vec", 2).collect()


@pytest.mark.parametrize("dims", [1, 63, 64, 65, 768, 4096])
def test_second_moment_of_any_width(spark, dims):
    data = [("a", [float((i * 7 + d) % 5) for d in range(dims)]) for i in range(6)] + [("b", [1.0] * dims), ("b", None)]
    df = spark.createDataFrame(data, "k string, v array<float>").repartition(3)
    got = {(r["k"], r["idx"]): r["moment"] for r in vectors.second_moment(df, "k", "v", dims).collect()}
    assert got == {
        **{("a", d): pytest.approx(sum(v[d] ** 2 for k, v in data[:6]) / 6) for d in range(dims)},
        **{("b", d): 0.5 for d in range(dims)},
    }
    plan = vectors.second_moment(df, "k", "v", dims)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sum(") <= 3 * vectors.SLICE
    with pytest.raises(Exception, match="cells"):
        vectors.second_moment(df, "k", "v", dims + 1).collect()
