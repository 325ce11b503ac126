from __future__ import annotations

import random

import pytest

from corpusloom.operators import lookups, threads
from corpusloom.operators.adapters import adapt
from corpusloom.session import cut_lineage
from tests.conftest import rows

SCHEMA = "message_id string, parent_id string, role string, text string"


def contexts(messages, limit=None):
    """The walk up, message by message."""
    index = {m[0]: m for m in messages if m[0] and m[3]}
    out = {}
    for name in index:
        path, current, seen = [], name, set()
        while current is not None and current in index and current not in seen:
            seen.add(current)
            path.append(index[current])
            current = index[current][1]
        if current in seen:
            out[name] = (None, None, None, True)
            continue
        above = "\n".join(m[3] for m in reversed(path[1:]))[:limit]
        out[name] = (path[-1][0], len(path) - 1, above if len(path) > 1 else None, False)
    return out


def tree(n, seed, deep=False):
    rng = random.Random(seed)
    out = [("m0", None, "user", "root " * 30)]
    for i in range(1, n):
        parent = i - 1 if deep else (0 if rng.random() < 0.4 else rng.randrange(i))
        text = rng.choice(["", f"t{i} é𝄞", f"long {i} " * 40, "  "])
        if deep and text == "":
            text = "d"
        out.append((f"m{i}", f"m{parent}", rng.choice(["user", "assistant"]), text))
    return out


MESSAGES = [
    *tree(120, 5),
    ("orphan", "nowhere", "assistant", "alone"),
    ("c1", "c3", "assistant", "a"),
    ("c2", "c1", "assistant", "b"),
    ("c3", "c2", "user", "c"),
    ("below", "c1", "assistant", "under a cycle"),
    ("self", "self", "assistant", "me"),
    (None, "m0", "assistant", "no id"),
    ("blank", "m0", "assistant", None),
]


def check(spark, messages, **options):
    df = spark.createDataFrame(messages, SCHEMA).repartition(4)
    got = {
        r["message_id"]: (r["root_id"], r["depth"], r["context"], r["cyclic"])
        for r in threads.thread_paths(df, **options).collect()
    }
    assert got == contexts(messages, options.get("max_len"))


def test_walk(spark):
    check(spark, MESSAGES)


def test_hot_parents_are_spread(spark):
    check(spark, MESSAGES, group_rows=3)


def test_deep_thread(spark):
    check(spark, tree(300, 2, deep=True), max_len=90)


def test_last_duplicate_counts(spark):
    df = spark.createDataFrame(
        [("a", None, "user", "old", 1), ("a", None, "user", "new", 2), ("b", "a", "assistant", "x", 3)],
        SCHEMA + ", seq int",
    )
    got = rows(threads.thread_paths(df, order="seq").select("message_id", "context"))
    assert got == [("a", None), ("b", "new")]


def test_adapter(spark):
    messages = [("a", None, "user", " q "), ("b", "a", "assistant", " r "), ("c", "a", "assistant", " "), ("d", None, "assistant", "x")]
    got = rows(adapt("open_assistant", spark.createDataFrame(messages, SCHEMA)))
    assert got == [("b", 0, " q ", "r", "chat")]


def test_adapter_with_numbered_rows(spark):
    messages = [
        (7, "a", None, "user", "old"),
        (8, "a", None, "user", "new"),
        (9, "b", "a", "assistant", "x"),
        (10, "b", "a", "assistant", "y"),
    ]
    got = rows(adapt("open_assistant", spark.createDataFrame(messages, "source_id long, " + SCHEMA)))
    assert got == [(10, 0, "new", "y", "chat"), (9, 0, "new", "x", "chat")]


def test_max_depth_reports_the_rest(spark):
    messages = [*tree(40, 3, deep=True), ("c1", "c2", "user", "a"), ("c2", "c1", "user", "b"), ("o", "nowhere", "user", "c")]
    df = spark.createDataFrame(messages, SCHEMA)
    walked = contexts(messages)
    for bound in (0, 1, 2, 7, 8, 60):
        got = threads.thread_paths(df, max_depth=bound).collect()
        assert len(got) == len(walked)
        for r in got:
            root, depth, context, cyclic = walked[r["message_id"]]
            deep = cyclic or depth > bound
            assert (r["too_deep"], r["cyclic"]) == (deep, False)
            assert (r["root_id"], r["depth"], r["context"]) == ((None,) * 3 if deep else (root, depth, context))


def test_long_contexts_are_whole(spark):
    messages = [("a", None, "user", "x" * 5_000), ("b", "a", "user", "y" * 5_000), ("c", "b", "assistant", "z")]
    got = {r["message_id"]: r["context"] for r in threads.thread_paths(spark.createDataFrame(messages, SCHEMA)).collect()}
    assert got == {"a": None, "b": "x" * 5_000, "c": "x" * 5_000 + "\n" + "y" * 5_000}


@pytest.mark.parametrize("group_rows", [1, 7, 10_000])
def test_dealt_lookup_equals_plain_join(spark, group_rows):
    left = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 7}") for i in range(300)] + [(900, None)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "rk string, x int")
    got = lookups.dealt_lookup(left, right, "k", "rk", "i", group_rows=group_rows)
    expected = left.join(right, left.k == right.rk, "left")
    assert rows(got.select("i", "k", "x")) == rows(expected.select("i", "k", "x"))


def test_cycles_end_and_their_paths_stay_short(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 5}", "user", "x") for i in range(5)]
    chain = [(f"d{i}", f"d{i - 1}" if i else None, "user", "y") for i in range(200)]
    check(spark, ring + chain + [("below", "r2", "user", "z"), ("lower", "below", "user", "z")])
    nodes = threads.thread_nodes(spark.createDataFrame(ring + chain, SCHEMA), "message_id", "parent_id", "text")
    longest = {r["id"][0]: len(r["path"]) for r in sorted(threads.thread_links(nodes).collect(), key=lambda r: len(r["path"]))}
    assert longest == {"r": 0, "d": 199}


def test_rounds_move_no_texts(spark, monkeypatch):
    """What the rounds write has ids and no text."""
    written = []
    monkeypatch.setattr(threads, "cut_lineage", lambda df, label: (written.append((label, df.columns)), cut_lineage(df, label))[1])
    df = spark.createDataFrame(tree(50, 8), SCHEMA)
    threads.thread_paths(df).collect()
    rounds = [columns for label, columns in written if label == "thread-links"]
    assert rounds and all(c == ["id", "next", "root", "depth", "path", "cyclic"] for c in rounds)


def test_lookups(spark):
    ref = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 1, "b")], "name string, seq int, x string")
    df = spark.createDataFrame([("a",), ("c",), (None,)], "name string")
    assert rows(lookups.lookup(df, ref, "name", "seq").select("name", "x")) == [(None, None), ("a", "early"), ("c", None)]
    assert rows(lookups.missing(df, ref, "name")) == [(None,), ("c",)]
    assert rows(lookups.supported(df, ref, "name")) == [("a",)]
