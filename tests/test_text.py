from __future__ import annotations

import sys

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import arrays, text, unions
from corpusloom.functions.hashing import in_share, share_bound


def one(spark, expression, **columns):
    names = list(columns)
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} string" for n in names)) if names else spark.range(1)
    return df.select(expression.alias("x")).first()["x"]


def test_whitespace_is_what_python_strips():
    every = {chr(i) for i in range(sys.maxunicode + 1) if not chr(i).strip()}
    assert set(text.WHITESPACE) == every


@pytest.mark.parametrize("value", [None, "", "  ", " a b ", "\x1cx\x85", "\n\ty z\r\n"])
def test_strip_is_pythons(spark, value):
    assert one(spark, text.strip("c"), c=value) == (value or "").strip()


@pytest.mark.parametrize(
    ("instruction", "task"),
    [("Decode this", "code"), ("PROGRAMMING tips", "code"), ("tell me", "chat"), ("", "chat"), (None, "chat")],
)
def test_task(spark, instruction, task):
    assert one(spark, text.task_of("c"), c=instruction) == task


def test_preview_counts_code_points(spark):
    value = "é𝄞" * 300
    assert one(spark, text.preview("c"), c=value) == value[:200] + "..."


@pytest.mark.parametrize("value", ["", " ", "a", " a  b\nc\t", None])
def test_words(spark, value):
    assert one(spark, text.words("c"), c=value) == (value or "").split()


def test_norm_answer_keeps_null(spark):
    assert one(spark, text.norm_answer("c"), c=None) is None
    assert one(spark, text.norm_answer("c"), c=" YES\n") == "yes"


@pytest.mark.parametrize(
    ("value", "normal", "first"),
    [
        ('["a", 1, true, null]', ["a", "1", "True", "None"], "a"),
        ("[]", [], None),
        ("null", [], None),
        (None, [], None),
        ('"a"', ["a"], "a"),
        ("false", ["False"], "false"),
    ],
)
def test_union_typed_fields(spark, value, normal, first):
    parsed = F.try_parse_json("c")
    assert one(spark, unions.list_normalize(parsed), c=value) == normal
    assert one(spark, unions.first_or_self(parsed), c=value) == first


def test_target_ids(spark):
    for n in (0, 1, 509, 510, 511, 2_000):
        tokens = list(range(5, 5 + n))
        df = spark.createDataFrame([(tokens,)], "t array<int>")
        for cut in (False, True):
            ids = arrays.target_ids("t", cut=cut)
            got = df.select(ids.alias("x"), arrays.filled(ids).alias("n")).first()
            expected = [arrays.BEGIN_ID, *(tokens[:510] if cut else tokens), arrays.END_ID]
            assert got["x"] == expected + [arrays.PAD_ID] * (512 - len(expected))
            assert got["n"] == len(expected)


def test_first_and_last_where(spark):
    df = spark.createDataFrame([([1, 5, 6, 2],), ([1],), ([],), (None,)], "a array<int>")
    got = df.select(
        arrays.first_where("a", lambda x: x > 4).alias("f"),
        arrays.last_where("a", lambda x: x > 4).alias("l"),
        arrays.last("a").alias("e"),
    ).collect()
    assert [tuple(r) for r in got] == [(5, 6, 2), (None, None, 1), (None, None, None), (None, None, None)]


def test_in_share_of_none_some_and_all(spark):
    hashes = spark.range(400).select(F.md5(F.col("id").cast("string")).alias("h"))
    for k in range(21):
        n = hashes.where(in_share(F.col("h"), k / 20)).count()
        assert abs(n - 20 * k) <= 45 and (k not in (0, 20) or n == 20 * k)
    with pytest.raises(ValueError):
        in_share(F.col("h"), 1.5)


def test_share_bound():
    assert share_bound(0.2) == "33333333"
    assert share_bound(0.4) == "66666666"
