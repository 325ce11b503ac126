"""Importance resampling against a plain version, with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from corpusloom.llm import resampling
from corpusloom.llm.common import slices

DOCS = "doc_id long, text string, lang string, rank long, part long, gain double"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    both = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return [zlib.crc32(f.encode()) % 10000 for f in both], len(words)


def plain(rows, target):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(plain_features(text)[0])
    for text in target:
        t.update(plain_features(text)[0])
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in rows:
        found, n_words = plain_features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(found), weight, score, n_words >= 20))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = able[: len(able) * 25 // 100]
    result = [(*r[:4], i + 1) for i, r in enumerate(drawn)]
    rest = Counter(out)
    rest.subtract(Counter(drawn))
    return Counter(result) + Counter({(*r[:4], None): n for r, n in rest.items() if n > 0})


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = [f"{w}{i}" for w in ("Alpha", "beta", "ÉPSILON", "漢字", "x") for i in range(30)]
    texts = [rng.choice([" ", ", ", "\n", "--"]).join(rng.choices(words, k=rng.randint(0, 120))) for _ in range(150)]
    texts += [None, "", " .,;\x00\x7f", "one", "A-b_C", "word " * 19, "word " * 20, " ".join(rng.choices(words, k=30_000))]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [(None, texts[3]), (None, texts[4]), out[7], out[7], (9000, texts[7])]


def test_resample_equals_plain(spark, rows):
    target = [rows[3][1], "alpha1 beta2 Alpha1 beta2", None, ""]
    docs = spark.createDataFrame([(i, t, "en", 5, 6, 0.5) for i, t in rows], DOCS).repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = Counter(tuple(r) for r in resampling.resample(docs, bench).collect())
    assert got == plain(rows, target)


def test_empty_tables(spark, rows):
    none = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([("alpha1",)], "text string")
    assert resampling.resample(none, bench).collect() == []
    docs = spark.createDataFrame([(i, t, "en", 5, 6, 0.5) for i, t in rows], DOCS)
    got = Counter(tuple(r) for r in resampling.resample(docs, bench.limit(0)).collect())
    assert got == plain(rows, [])


def test_slices_are_bounded_and_whole():
    texts = pa.array(["a" * n for n in (5, 0, 40, 3, 3, 3)] + [None])
    parts = list(slices(texts, 9))
    assert [t for p in parts for t in p.to_pylist()] == texts.to_pylist()
    assert [len(p) for p in parts] == [2, 1, 4]
