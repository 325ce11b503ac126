"""Candidates of the secret scan against a plain scanner that looks back; plans; names that clash; long and repeated texts."""

from __future__ import annotations

import random
import re as plain_re
from collections import Counter

import pytest
import regex

from corpusloom.llm import secrets

# The same candidates said by look-behind: what stands before a value, then the value.
LOOK_BACK = regex.compile(
    r"(?<=[ \t\"'=:(\[{<])(?<=(?:[=:]|" + secrets.SECRET_WORDS + r"[\"']?[ \t](?:is[ \t])?)[ \t]{0,8}[\"'(\[{<]?)(?![=:(\[{<])"
    + secrets.VALUE + "|" + secrets.RUN
)
RUN = regex.compile(secrets.RUN)


def plain(text):
    out = []
    for m in LOOK_BACK.finditer(text):
        out.append((m.group(), m.start()))
        if not regex.fullmatch(secrets.RUN, m.group()):
            out += [(r.group(), m.start() + r.start()) for r in RUN.finditer(m.group())]
    return out


def texts(n):
    rng = random.Random(11)
    parts = (
        "token password key api private secret_key myapi Bearer auth = == : := ' \" ( [ , . ; ) & &a=b ?x=y abc é漢 🙂 12 "
        "abcdefghijklmnop ABCDEFGHIJKLMNOPQRST0123+/ x=y= a-b/c_d0123456789abc= pwd=hunter2 \t \n https://e.org/?token=abc"
    ).split(" ")
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(parts) + rng.choice([" ", " ", "", "", "  ", "\t", "\n"]) for _ in range(rng.randint(0, 40))))
    return out


@pytest.fixture(scope="module")
def rows():
    long = " ".join(f"word{i} token=" + "k9" * 9 + f" password: p{i}!" for i in range(3_000))
    found = [*texts(1_500), None, "", long, "x" * 50_000, "= " * 20_000]
    return list(enumerate(found)) + [(3, found[3]), (None, found[4])]


def test_candidates_equal_a_plain_scanner(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = Counter((r["doc_id"], r["value"], r["start"]) for r in secrets.candidates(docs, "doc_id").collect())
    assert got == Counter((i, v, at) for i, t in rows for v, at in plain(t or ""))


def test_neighbourhoods_are_whole(spark, rows):
    docs = spark.createDataFrame([r for r in rows if r[0] is not None and r[0] != 3], "doc_id long, text string")
    whole = dict(rows)
    for r in secrets.candidates(docs, "doc_id").collect():
        text, end = whole[r["doc_id"]], r["start"] + len(r["value"])
        assert text[r["start"] : end] == r["value"] and r["after"] == text[end : end + secrets.NEAR]
        assert r["before"] == text[max(0, r["start"] - secrets.NEAR) : r["start"]]


def test_a_text_is_cut_once(spark, rows):
    docs = spark.createDataFrame(rows[:5], "doc_id long, text string")
    plan = secrets.candidates(docs, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plain_re.findall(r"regexp_replace\(", plan)) == 2  # the text, and the values found in it


def test_redact_with_clashing_names_and_repeats(spark):
    key = "AKIA" + "Q7Z3M9X1K5W8R2T6"
    kind = "doc_id long, text string, secrets string, of int, row int, `a.b` int, n_chars int"
    made = [(1, f"access key {key} here", "s", 1, 2, 3, 0)] * 2 + [(2, None, "s", 1, 2, 3, None), (3, "", "s", 1, 2, 3, 0)]
    out = secrets.redact(spark.createDataFrame(made, kind))
    assert out.columns == ["doc_id", "text", "secrets", "of", "row", "a.b", "n_chars"]
    got = sorted(map(tuple, out.collect()))
    masked = f"access key {secrets.MASK} here"
    assert got == [(1, masked, "s", 1, 2, 3, len(masked))] * 2 + [(2, None, "s", 1, 2, 3, None), (3, "", "s", 1, 2, 3, 0)]


def test_redact_without_rows(spark):
    assert secrets.redact(spark.createDataFrame([], "doc_id long, text string, of int")).collect() == []
