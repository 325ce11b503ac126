"""A bigram language model as a weighted backoff automaton, trained on the corpus and applied to all of it.

Model: P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), the last share being that of all unknown words, and
P(w | u) = (c(u w) + PRIOR P(w)) / (c(u) + PRIOR). As an automaton: every known word u is a state with an arc for each
word seen after it; its failure arc leads to the root and weighs PRIOR / (c(u) + PRIOR); the root has an arc for every
word. A text starts at the root, goes through one left-to-right traversal that carries the state, and ends with the end
token. Counts c are those of the training rows only.

The automaton grows with the corpus, so no task ever holds all of it. Documents are dealt to chunks. A chunk sends the
distinct words and word pairs it holds, as sorted 64-bit hashes with its training counts, to the shards of the count
table (one packed row per chunk and shard). A shard adds up the counts and answers each chunk, in the order of its
hashes, with the corpus-wide ones: the part of the automaton the chunk can reach. Chunks then score their documents.
Nothing is dropped: every word and pair of every training row counts.

Words are told apart by a 64-bit hash (XXH64). Null texts are empty and score their end token alone. Null doc_ids are in
fold 'none' (crc32 of a null is null) and are learned from. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fold_of, stored

FOLDS = 5
HELD_OUT = 1
PRIOR = 300.0
END_KEY = np.uint64(xxhash.xxh64_intdigest(b"", 1))  # no word is empty
PAIR = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier that sets pair keys apart from word keys
NO_STATE = np.int64(-1)


class Words:
    """Keys of lower-cased words, memoised within a task."""

    def __init__(self, most: int = 500_000) -> None:
        self.memo: dict[bytes, int] = {}
        self.most = most

    def keys(self, text: bytes) -> np.ndarray:
        """Keys of the text's tokens, the end token included."""
        words = text.lower().split()
        memo = self.memo
        if len(memo) > self.most:
            memo.clear()
        try:
            found = [memo[w] for w in words]
        except KeyError:
            digest = xxhash.xxh64_intdigest
            for w in set(words).difference(memo):
                memo[w] = digest(w, 0)
            found = [memo[w] for w in words]
        out = np.empty(len(found) + 1, dtype=np.uint64)
        out[:-1] = found
        out[-1] = END_KEY
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them (xor-shifts and an odd product)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * PAIR + second)


class Chunk:
    """Tokens of a chunk's documents in a row, and its distinct keys."""

    def __init__(self, texts: list[bytes], trained: np.ndarray) -> None:
        words = Words()
        tokens = [words.keys(t) for t in texts]
        self.sizes = np.array([len(t) for t in tokens])
        self.tokens = np.concatenate(tokens) if tokens else np.empty(0, dtype=np.uint64)
        self.starts = np.r_[0, np.cumsum(self.sizes)[:-1]].astype(np.int64)
        first = np.zeros(len(self.tokens), dtype=bool)
        first[self.starts] = True
        pairs = np.zeros(len(self.tokens), dtype=np.uint64)
        pairs[1:] = pair_keys(self.tokens[:-1], self.tokens[1:])
        self.trained = np.repeat(trained, self.sizes)
        self.words = np.unique(self.tokens)
        self.pairs = np.unique(pairs[~first])
        self._all_pairs, self._inner = pairs, ~first

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often the training documents hold each distinct word and pair."""

        def count(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
            return np.bincount(np.searchsorted(keys, found), minlength=len(keys))

        return (
            count(self.words, self.tokens[self.trained]),
            count(self.pairs, self._all_pairs[self._inner & self.trained]),
        )


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte plane by byte plane: high planes of a dense shard are mostly zero."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    kind = "<u1" if not len(counts) or counts.max() < 256 else "<u8"
    return kind.encode() + zlib.compress(counts.astype(kind).tobytes(), 1)


def unpacked_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[3:]), dtype=raw[:3].decode()).astype(np.int64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Cut positions of sorted keys by equal ranges of their values."""
    bounds = [(k << 64) // shards for k in range(1, shards)]
    return np.r_[0, np.searchsorted(keys, np.array(bounds, dtype=np.uint64)), len(keys)]


def _requests(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["chunk"].iloc[0])
        chunk = Chunk([t or b"" for t in pdf["text"]], ~pdf["held_out"].to_numpy(dtype=bool))
        rows = []
        for kind, keys, counts in zip((0, 1), (chunk.words, chunk.pairs), chunk.counts(), strict=True):
            cuts = shard_of(keys, shards)
            for s in range(shards):
                some = slice(cuts[s], cuts[s + 1])
                if cuts[s] < cuts[s + 1]:
                    rows.append((number, kind, s, packed_keys(keys[some]), packed_counts(counts[some])))
        return pd.DataFrame(rows, columns=["chunk", "kind", "shard", "keys", "counts"])

    return run


def _answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """Add up a shard and answer its chunks; with the shard's own totals: tokens and distinct words of the training."""
    pdf = pdf.sort_values("chunk")
    keys = [unpacked_keys(k) for k in pdf["keys"]]
    counts = [unpacked_counts(c) for c in pdf["counts"]]
    known, places = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(places, weights=np.concatenate(counts), minlength=len(known)).astype(np.int64)
    rows, at = [], 0
    for chunk, own in zip(pdf["chunk"], keys, strict=True):
        rows.append((chunk, packed_counts(total[places[at : at + len(own)]]), 0, 0))
        at += len(own)
    rows.append((-1, b"", int(total.sum()), int((total > 0).sum())))
    out = pd.DataFrame(rows, columns=["chunk", "counts", "tokens", "types"])
    out["kind"], out["shard"] = pdf["kind"].iloc[0], pdf["shard"].iloc[0]
    return out


class Automaton:
    """The states and arcs that a chunk can reach.

    A state is the place of its word among the chunk's words. Arcs are sorted by their pair key.
    """

    def __init__(self, words: np.ndarray, word_counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray,
                 tokens: int, types: int, prior: float = PRIOR) -> None:
        self.words, self.context = words, word_counts
        self.root = (word_counts + 0.5) / (tokens + 0.5 * (types + 1))
        seen = pair_counts > 0
        self.arcs, self.seen = pairs[seen], pair_counts[seen]
        self.prior = prior

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Log10 weight of reading a word in a state: its own arc, else the failure arc and then the root's."""
        weight = self.root[word]
        inner = state >= 0
        context = np.where(inner, self.context[state], 0)
        key = pair_keys(self.words[state], self.words[word])
        at = np.minimum(np.searchsorted(self.arcs, key), max(len(self.arcs) - 1, 0))
        count = np.where(inner & (self.arcs[at] == key), self.seen[at], 0) if len(self.arcs) else 0
        return np.log10((count + self.prior * weight) / (context + self.prior))

    def traverse(self, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of texts, all read from left to right at once, one token of each in a step."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        state = np.full(len(order), NO_STATE)
        score = np.zeros(len(order))
        place = np.searchsorted(self.words, tokens)
        longest = int(sizes[0]) if len(sizes) else 0
        left = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # texts that have a t-th token
        for t in range(longest):
            n = left[t]
            word = place[starts[:n] + t]
            score[:n] += self.step(state[:n], word)
            state[:n] = word
        out = np.empty(len(order))
        out[order] = score
        return out


def _scores(tokens: int, types: int, shards: int):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame(columns=[c.split()[0] for c in SCHEMA.split(", ")])
        chunk = Chunk([t or b"" for t in docs["text"]], ~docs["held_out"].to_numpy(dtype=bool))
        answers = answers.sort_values(["kind", "shard"])
        word_counts, pair_counts = (
            np.concatenate([np.empty(0, dtype=np.int64), *map(unpacked_counts, answers["counts"][answers["kind"] == k])])
            for k in (0, 1)
        )
        automaton = Automaton(chunk.words, word_counts, chunk.pairs, pair_counts, tokens, types)
        place = np.searchsorted(chunk.words, chunk.tokens)
        base = np.log10(automaton.root)[place]
        return pd.DataFrame(
            {
                "doc_id": docs["doc_id"].to_numpy(),
                "held_out": docs["held_out"].to_numpy(),
                "n_tokens": chunk.sizes,
                "n_known": np.add.reduceat((word_counts > 0)[place].astype(np.int64), chunk.starts),
                "train_tokens": tokens,
                "base_score": np.add.reduceat(base, chunk.starts),
                "score": automaton.traverse(chunk.tokens, chunk.starts, chunk.sizes),
            }
        )

    return run


SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Chunks and shards are as many as shuffle partitions, so both stay of one size as the input grows; a row's chunk comes from its id and its place in the scan, so that
    repeated ids don't meet in one chunk. The dealt texts are written once and read by both passes.
    """
    spark = docs.sparkSession
    chunks = shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(chunks)).cast("int").alias("chunk"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.encode(F.col("text").cast("string"), "UTF-8").alias("text"),
    )
    rows = stored(rows, "lm-rows")
    requests = rows.groupBy("chunk").applyInPandas(
        _requests(shards), "chunk int, kind int, shard int, keys binary, counts binary"
    )
    answers = requests.groupBy("kind", "shard").applyInPandas(
        _answers, "chunk int, counts binary, tokens long, types long, kind int, shard int"
    )
    answers = stored(answers, "lm-counts")
    totals = answers.where("chunk = -1 AND kind = 0").agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = int(totals[0] or 0), int(totals[1] or 0)
    parts = answers.where("chunk >= 0").select("chunk", "kind", "shard", "counts")
    return (
        rows.groupBy("chunk").cogroup(parts.groupBy("chunk")).applyInPandas(_scores(tokens, types, shards), SCHEMA)
    )
