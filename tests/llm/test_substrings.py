"""Substring dedup against a plain version: nulls, empty and long texts, copies, repeats inside a text, repeated ids."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import substrings

DOCS = "doc_id long, text string, source string, start int, ord string, key long"
N = substrings.WINDOW


def plain(rows):
    tokens = [(t or "").encode().split() for _, t in rows]
    order = [substrings.LAST if i is None else i for i, _ in rows]
    low = {}
    for o, words in zip(order, tokens, strict=True):
        for i in range(len(words) - N + 1):
            key = b" ".join(words[i : i + N])
            low[key] = min(o, low.get(key, o))
    out = []
    for (doc_id, _), o, words in zip(rows, order, tokens, strict=True):
        gone = [False] * len(words)
        for i in range(len(words) - N + 1):
            if low[b" ".join(words[i : i + N])] < o:
                gone[i : i + N] = [True] * N
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def some_rows(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "c", "naïve", "漢字", "x.y"]) + str(rng.randint(0, 50))
    run = lambda n: [word() for _ in range(n)]
    gap = lambda: rng.choice([" ", "  ", "\n", "\t "])
    passages = [run(n) for n in (49, 50, 51, 60, 200, 30)]
    texts = []
    for _ in range(60):
        parts = [run(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(passages)
            cut = rng.randint(0, 10) if rng.random() < 0.5 else 0
            parts += [passage[cut:], run(rng.choice([0, 1, 5, 60]))]
        texts.append("".join(w + gap() for p in parts for w in p))
    same = ["same"] * 300
    near = passages[4][:]
    near[100] = "other"
    texts += [None, "", " \n", "one", " ".join(passages[1]), " ".join(passages[0]), " ".join(same), " ".join(same[:120])]
    texts += [texts[3]] * 4 + [" ".join(near), " ".join(near + passages[4]), " ".join(passages[4] * 3)]
    rng.shuffle(texts)
    rows = [(i * 2, t) for i, t in enumerate(texts)]
    return [*rows, (None, texts[0]), (None, texts[5]), rows[9], rows[9], (4, texts[30]), (4, texts[31])]


@pytest.mark.parametrize(("seed", "chunk", "block"), [(1, 1 << 18, 8192), (2, 128, 3)])
def test_dedup_equals_plain(spark, monkeypatch, seed, chunk, block):
    monkeypatch.setattr(substrings, "BLOCK_ROWS", block)
    rows = some_rows(seed)
    docs = spark.createDataFrame([(i, t, "s", 3, "clash", 9) for i, t in rows], DOCS).repartition(6)
    assert Counter(tuple(r) for r in substrings.dedup(docs).collect()) == plain(rows)


def test_windows_choose_seeds_by_their_words_alone():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 2**63, 90).astype(np.uint64)
    chosen = []
    for lead in (0, 7, 120):
        values = np.concatenate([rng.integers(0, 2**63, lead).astype(np.uint64), passage])
        part, start, n, place = substrings.segments(values, np.array([0, len(values)]))
        at = {s + j - lead: p - lead for s, c, p in zip(start, n, place, strict=True) for j in range(c)}
        chosen.append({i: p for i, p in at.items() if i >= 0})
    assert chosen[0] == chosen[1] == chosen[2] and sorted(chosen[0]) == list(range(41))
    assert all(i <= p <= i + N - substrings.SEED_WORDS for i, p in chosen[0].items())


def test_long_texts_are_cut_into_parts_without_loss(monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 100)
    words = [b"%d" % i for i in range(333)]
    seen = []
    for values, text, begins, first in substrings.chunks([words, words[:49], words[:50]], substrings.WordHashes()):
        part, start, n, _ = substrings.segments(values, begins)
        for p, s, c in zip(part, start, n, strict=True):
            seen += [(text[p], s - begins[p] + first[p] + j) for j in range(c)]
    assert sorted(seen) == [(0, i) for i in range(284)] + [(2, 0)]


def test_cut_out_returns_the_texts_left(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, passage), (2, f"new {passage} end"), (3, "else")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in substrings.cut_out(docs).collect()}
    assert got == {1: passage, 2: "new end"}


def test_no_documents(spark):
    assert substrings.dedup(spark.createDataFrame([], DOCS)).collect() == []
