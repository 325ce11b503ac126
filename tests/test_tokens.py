from __future__ import annotations

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.arrays import FIRST_WORD_ID, PAD_ID, UNKNOWN_ID
from corpusloom.operators import tokens
from tests.conftest import rows

TEXTS = ["a b  a\nc", "", None, "  ", "b c b", "zz a", " a b\t", "é 𝄞 é"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(3)


def plain_vocabulary(k):
    counts = Counter(w for t in TEXTS for w in _words(t))
    return [w for w, _ in sorted(counts.items(), key=lambda c: (-c[1], c[0].encode()))[:k]]


def _words(t):
    return [w for w in __import__("re").split(r"[ \t\n\x0b\f\r]+", (t or "").strip()) if w]


@pytest.mark.parametrize("k", [1, 3, 100])
def test_vocabulary(docs, k):
    got = [(r["token_id"], r["word"]) for r in tokens.vocabulary(docs, "text", k).orderBy("token_id").collect()]
    assert got == [(FIRST_WORD_ID + i, w) for i, w in enumerate(plain_vocabulary(k))]


def test_vocabulary_holds_a_word(docs):
    with pytest.raises(ValueError):
        tokens.vocabulary(docs, "text", 0)


def test_both_ways_to_rank_agree(docs, monkeypatch):
    whole = rows(tokens.vocabulary(docs, "text", 50))
    monkeypatch.setattr(tokens, "MAX_VOCABULARY", 1)
    assert rows(tokens.vocabulary(docs, "text", 50)) == whole


@pytest.mark.parametrize("k", [2, 100])
def test_encode_and_decode(docs, k):
    vocab = tokens.vocabulary_words(tokens.vocabulary(docs, "text", k))
    ids = {w: FIRST_WORD_ID + i for i, w in enumerate(vocab)}
    encoded = tokens.encode(docs, "text", vocab)
    got = {r["id"]: list(r["tokens"]) for r in encoded.collect()}
    assert got == {i: [ids.get(w, UNKNOWN_ID) for w in _words(t)] for i, t in enumerate(TEXTS)}
    back = {r["id"]: r["text"] for r in tokens.decode(encoded, "tokens", vocab).collect()}
    assert back == {i: " ".join(w if w in ids else "<unk>" for w in _words(t)) for i, t in enumerate(TEXTS)}


def test_decode_drops_marks_and_strips_code(spark):
    df = spark.createDataFrame([("code", [2, 5, 6, 3, 1, 1]), ("chat", [6])], "task string, tokens array<int>")
    got = {r["task"]: r["text"] for r in tokens.decode(df, "tokens", ["x", " y"], task="task").collect()}
    assert got == {"code": "x  y", "chat": " y"}


def test_other_tokenizers(docs):
    lengths = tokens.tokenizer_ids(lambda: lambda text: [len(w) for w in text.split()])
    got = {r["id"]: list(r["t"]) for r in docs.select("id", lengths(F.col("text")).alias("t")).collect()}
    assert got == {i: [len(w) for w in (t or "").split()] for i, t in enumerate(TEXTS)}


def plain_chunks(ts, size, stride, least):
    effective = max(len(ts), size + (least - 1) * stride)
    count = max(math.ceil((effective - size) / stride) + 1, least)
    out = []
    for i in range(count):
        part = ts[i * stride : i * stride + size]
        out.append(part + [PAD_ID] * (size - len(part)))
    return out


@pytest.mark.parametrize(("size", "stride", "least"), [(128, 64, 2), (4, 4, 1), (5, 3, 3), (3, 7, 1), (1, 1, 1)])
def test_chunks(spark, size, stride, least):
    lists = [list(range(10, 10 + n)) for n in (0, 1, 2, 3, 4, 5, 9, 64, 128, 191, 192, 193, 400)]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, tokens array<int>")
    got = rows(tokens.chunk_tokens(df, "tokens", size, stride, least).select("id", "chunk_no", "tokens"))
    expected = [(i, n, c) for i, ts in enumerate(lists) for n, c in enumerate(plain_chunks(ts, size, stride, least))]
    assert sorted(got) == sorted(expected)


def test_chunks_refuse_bad_sizes(spark):
    df = spark.createDataFrame([([1],)], "tokens array<int>")
    for bad in ({"size": 0}, {"stride": 0}, {"min_chunks": 0}):
        with pytest.raises(ValueError):
            tokens.chunk_tokens(df, **bad)


def test_blocks(spark):
    df = spark.createDataFrame([(1, list(range(7))), (2, [])], "id int, tokens array<int>")
    got = rows(tokens.token_blocks(df, size=3))
    assert sorted(got) == [(1, i // 3, i % 3, i) for i in range(7)]


def test_next_pairs(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1],), ([],)], "tokens array<int>")
    got = [(list(r["inputs"]), list(r["labels"])) for r in tokens.next_token_pairs(df).collect()]
    assert got == [([1, 2], [2, 3]), ([], []), ([], [])]


@pytest.mark.parametrize("size", [1, 3, 16])
def test_padded_batches(spark, size):
    rng = random.Random(4)
    lists = {i: [rng.randrange(5, 99) for _ in range(rng.randrange(12))] for i in range(150)}
    df = spark.createDataFrame(list(lists.items()), "id int, tokens array<int>")
    got = tokens.padded_batches(df, "id", batch_size=size, digits=1).collect()
    assert {r["id"]: r["tokens"][: r["n_tokens"]] for r in got} == lists
    batches = {}
    for r in got:
        batches.setdefault((r["shard"], r["batch_no"]), []).append(r)
    shards = Counter(s for s, _ in batches)
    for (shard, number), members in batches.items():
        assert len({len(r["tokens"]) for r in members}) == 1
        assert len(members[0]["tokens"]) == max(r["n_tokens"] for r in members)
        assert sorted(r["pos"] for r in members) == list(range(len(members)))
        assert len(members) == size or number == shards[shard] - 1
        for r in members:
            assert set(r["tokens"][r["n_tokens"] :]) <= {PAD_ID}


def test_shard_digits():
    assert [tokens.shard_digits(n, 100) for n in (0, 100, 1_600, 1_601, 25_600, 25_601)] == [1, 1, 1, 2, 2, 3]


def test_batches_need_no_global_order(spark):
    df = spark.createDataFrame([(1, [5])], "id int, tokens array<int>")
    plan = tokens.padded_batches(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and plan.count("Exchange") == 1


def test_joins_equal_lists(spark):
    texts = ["b a a", "", None, " a\tc  b ", "zz zz a", "a " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    vocab = tokens.vocabulary(df.filter("id <> 4"), "text", 10)
    by_list = tokens.encode(df, "text", tokens.vocabulary_words(vocab)).select("id", "tokens")
    by_join = tokens.encode_join(df, "id", "text", vocab)
    assert rows(by_join) == rows(by_list)
    back = tokens.decode(by_list, "tokens", tokens.vocabulary_words(vocab)).select("id", "text")
    assert rows(tokens.decode_join(by_join, "id", "tokens", vocab)) == rows(back)


def test_vocabulary_of_any_size(spark):
    """300,000 words, more than a list may hold: ranks by counted ranges, ids by joins."""
    n, each = 300_000, 50
    ids = F.sequence(F.col("id") * each, F.col("id") * each + each - 1)
    text = F.concat_ws(" ", F.transform(ids, lambda i: F.concat(F.lit("w"), i.cast("string"))), F.lit("w7 w7 w299999"))
    df = spark.range(n // each).select("id", text.alias("text"))
    vocab = tokens.vocabulary(df, "text", n)
    ends = vocab.agg(F.min("token_id"), F.max("token_id"), F.count_distinct("token_id")).first()
    assert tuple(ends) == (5, n + 4, n)
    first = {r["token_id"]: r["word"] for r in vocab.filter("token_id < 8").collect()}
    assert first == {5: "w7", 6: "w299999", 7: "w0"}
    with pytest.raises(ValueError):
        tokens.vocabulary_words(vocab)
    got = tokens.encode_join(df, "id", "text", vocab).filter("id = 0").first()["tokens"]
    assert got[-3:] == [5, 5, 6] and len(got) == each + 3 and got[0] == 7
    assert tokens.encode_join(df, "id", "text", vocab).filter(F.array_contains("tokens", 4)).count() == 0


def test_consecutive_batches_are_full(spark):
    data = [(i * 3, list(range(i % 7))) for i in range(103)]
    df = spark.createDataFrame(data, "id long, tokens array<int>").repartition(7)
    got = sorted(tokens.consecutive_batches(df, "id", batch_size=10).collect(), key=lambda r: r["id"])
    assert [(r["batch_no"], r["pos"]) for r in got] == [(i // 10, i % 10) for i in range(103)]
    for r in got:
        longest = max(len(t) for i, t in data if i // 3 // 10 == r["batch_no"])
        assert r["width"] == longest and len(r["tokens"]) == longest


def test_batches_are_split_in_small_pieces(monkeypatch):
    """A worker splits a bounded part of a batch at once, with the words of the whole batch."""
    rng = random.Random(4)
    texts = [None if rng.random() < 0.1 else " \t".join(rng.choice(["a", "é漢", "x" * 30]) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    batch = pa.array(texts)
    for size in (1, 40, 1 << 20):
        monkeypatch.setattr(tokens, "PIECE_BYTES", size)
        pieces = list(tokens._pieces(batch))
        assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.to_pylist()) <= size for p in pieces)
        assert [w for p in pieces for w in tokens._split(p).to_pylist()] == [(t or "").split() for t in texts]


def test_join_encoding_shuffles_documents_not_words(spark):
    df = spark.createDataFrame([(i, "a b " * i + "zz") for i in range(20)] + [(20, None), (21, " ")], "id long, text string")
    vocab = tokens.vocabulary(df, "text", 2)
    encoded = tokens.encode_join(df, "id", "text", vocab)
    decoded = tokens.decode_join(encoded, "id", "tokens", vocab)
    words = {i: "a b " * i + "<unk>" for i in range(20)} | {20: "", 21: ""}
    assert {r["id"]: r["text"] for r in decoded.collect()} == words
    for made in (encoded, decoded):
        assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
