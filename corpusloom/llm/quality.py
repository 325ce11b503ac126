"""Quality rules: counts of a text, and a linear-chain CRF that marks its lines as content or boilerplate.

Base: a text fails with fewer than MIN_WORDS words or if over MAX_REPEATED percent of its words lie in 5-word windows that
occur twice or more in it. Texts that pass are labelled line by line: each line with a word has features (below), the
CRF's most likely sequence of labels is found by Viterbi, and the text is kept if content lines hold at least
CONTENT_SHARE of its words.

The CRF is trained on all lines of at most TRAIN_DOCS labelled documents (quality 1: content, 0: boilerplate; the first
ones in the order of a seeded hash, both kinds alike), by gradient ascent on the conditional likelihood with Adam's
steps. All lines of a document have its label (there are no labels of lines), so no training sequence changes its label
and the weights of such steps only fall. Labels reach it only through the training rows. Without labels of both kinds it marks every line as content.

Null texts have no words, fail the base and are not kept. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import byte_texts

MIN_WORDS = 10
MAX_REPEATED = 20
WINDOW = 5
CONTENT_SHARE = 0.5
TRAIN_DOCS = 2000  # bound of the labelled sample
ROUNDS = 60
RATE = 0.1
CONTENT_WEIGHT = 4.0  # of a content line in training; losing a clean text is worse than keeping a poor one
RIDGE = 1e-3
SEED = 42
SYMBOLS = b"#*$%&|<>"
FEATURES = ("bias", "symbols", "symbol words", "capitals", "capital line", "length", "short", "repeat", "line again",
            "digits", "stop")


def n_symbols(text: bytes) -> int:
    return len(text) - len(text.translate(None, SYMBOLS))


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words that lie in an n-word window found twice or more, the first one included."""
    if len(words) <= n:
        return 0
    windows = list(zip(*(words[i:] for i in range(n)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total, covered = 0, 0  # covered: first word not counted yet
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + n - max(at, covered)
            covered = at + n
    return total


def line_features(line: bytes, words: list[bytes], again: bool) -> list[float]:
    """What the CRF sees of a line with words; all in 0..1."""
    size, n = len(line), len(words)
    symbols = n_symbols(line)
    lower = line.lower()
    capitals = sum(map(int.__ne__, line, lower)) if lower != line else 0
    letters = size - line.count(b" ") - symbols
    capital = capitals / max(1, letters)
    digits = size - len(line.translate(None, b"0123456789"))
    return [
        1.0,
        min(1.0, 4.0 * symbols / size),
        min(1.0, symbols / n),
        min(1.0, capital),
        1.0 if capital > 0.5 else 0.0,
        min(1.0, n / 40.0),
        1.0 if n < 4 else 0.0,
        1.0 - len(set(words)) / n,
        1.0 if again else 0.0,
        digits / size,
        min(1.0, sum(len(w) < 4 for w in words) / n),
    ]


class Crf:
    """Two labels (0 boilerplate, 1 content): state weights (2 x features), transitions and start weights."""

    def __init__(self, state: np.ndarray, step: np.ndarray, start: np.ndarray) -> None:
        self.state, self.step, self.start = state, step, start

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The most likely labels of one sequence; ties go to content."""
        scores = features @ self.state.T
        back = np.zeros((len(scores), 2), dtype=np.int8)
        step = self.step.tolist()
        rows = scores.tolist()
        best = [self.start[0] + rows[0][0], self.start[1] + rows[0][1]]
        for t in range(1, len(rows)):
            from0 = (best[0] + step[0][0], best[1] + step[1][0])
            from1 = (best[0] + step[0][1], best[1] + step[1][1])
            k0, k1 = int(from0[1] >= from0[0]), int(from1[1] >= from1[0])
            back[t, 0], back[t, 1] = k0, k1
            best = [from0[k0] + rows[t][0], from1[k1] + rows[t][1]]
        labels = np.empty(len(rows), dtype=np.int8)
        labels[-1] = int(best[1] >= best[0])
        for t in range(len(rows) - 1, 0, -1):
            labels[t - 1] = back[t, labels[t]]
        return labels


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def trained(sequences: list[np.ndarray], labels: list[int], rounds: int = ROUNDS) -> Crf:
    """Fit by gradient ascent with forward-backward; sequences within a power of two in length are worked on together.

    All lines of a sequence have its label.
    """
    width = len(FEATURES)
    state, step, start = np.zeros((2, width)), np.zeros((2, 2)), np.zeros(2)
    if len(set(labels)) < 2:
        state[1, 0] = 1.0
        return Crf(state, step, start)
    groups: dict[int, list[int]] = {}
    for i, s in enumerate(sequences):
        groups.setdefault((len(s) - 1).bit_length(), []).append(i)
    batches = []
    for rows in groups.values():
        sizes = np.array([len(sequences[i]) for i in rows])
        x = np.zeros((len(rows), sizes.max(), width))
        for row, i in enumerate(rows):
            x[row, : sizes[row]] = sequences[i]
        there = np.arange(sizes.max()) < sizes[:, None]  # the others fill up to the longest
        batches.append((x, np.array([labels[i] for i in rows]), sizes, there))
    total = sum(len(s) for s in sequences)
    # weights of the labels, whatever the sample holds of them
    mass = [sum(len(s) for s, y in zip(sequences, labels, strict=True) if y == k) for k in (0, 1)]
    weight = np.array([1.0, CONTENT_WEIGHT]) * total / (1.0 + CONTENT_WEIGHT) / np.maximum(1, mass)
    mean, square = np.zeros(2 * width + 6), np.zeros(2 * width + 6)
    for turn in range(1, rounds + 1):
        g_state, g_step, g_start = -RIDGE * state, -RIDGE * step, -RIDGE * start
        for x, y, sizes, there in batches:
            n, length, _ = x.shape
            w = weight[y]
            scores = x @ state.T
            forward = np.empty((n, length, 2))
            backward = np.zeros((n, length, 2))
            forward[:, 0] = start + scores[:, 0]
            for t in range(1, length):
                more = log_sum(forward[:, t - 1, :, None] + step, 1) + scores[:, t]
                forward[:, t] = np.where(there[:, t, None], more, forward[:, t - 1])
            for t in range(length - 2, -1, -1):
                more = log_sum(step + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
                backward[:, t] = np.where(there[:, t + 1, None], more, 0.0)
            norm = log_sum(forward[:, -1], 1)
            marginal = np.exp(forward + backward - norm[:, None, None])
            true = np.eye(2)[y]
            miss = (true[:, None, :] - marginal) * (w[:, None] * there)[:, :, None] / total
            g_state = g_state + np.einsum("ntk,ntf->kf", miss, x)
            g_start = g_start + miss[:, 0].sum(axis=0)
            if length > 1:
                pairs = (
                    forward[:, :-1, :, None]
                    + step
                    + (scores[:, 1:] + backward[:, 1:])[:, :, None, :]
                    - norm[:, None, None, None]
                )
                pairs = np.where(there[:, 1:, None, None], pairs, -np.inf)
                seen = np.einsum("nj,nk->njk", true, true) * (sizes - 1)[:, None, None]
                g_step = g_step + ((seen - np.exp(pairs).sum(axis=1)) * w[:, None, None]).sum(axis=0) / total
        gradient = np.concatenate([g_state.ravel(), g_step.ravel(), g_start])
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        move = RATE * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
        state = state + move[: 2 * width].reshape(2, width)
        step, start = step + move[2 * width : -2].reshape(2, 2), start + move[-2:]
    return Crf(state, step, start)


def text_lines(text: bytes) -> tuple[list[list[bytes]], list[bytes], list[bool]]:
    """Words, bytes and 'seen before in this text' of the lines that hold a word."""
    words, lines, again = [], [], []
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        found = line.split()
        if found:
            words.append(found)
            lines.append(line)
            again.append(line in seen)
            seen.add(line)
    return words, lines, again


def feature_rows(text: bytes) -> np.ndarray:
    words, lines, again = text_lines(text)
    rows = [line_features(*x) for x in zip(lines, words, again, strict=True)]
    return np.array(rows).reshape(len(rows), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> Crf:
    """Only the chosen rows, at most ``bound``, come to the driver, and of each only the features of its lines."""
    from corpusloom.functions.hashing import seeded_hash

    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "quality").distinct()
    ranked = known.select("doc_id", "quality", seeded_hash(F.col("doc_id"), SEED).alias("order"))
    some = None
    for kind in (0, 1):
        part = ranked.where(F.col("quality") == kind).orderBy("order").limit(bound // 2)
        some = part if some is None else some.union(part)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = chosen.join(F.broadcast(some), "doc_id").select("doc_id", "quality", "text").mapInArrow(_features, _FEATURE_DDL)
    found = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["quality"], r["lines"], r["features"]))
    found = found[:bound] if len(found) > bound else found
    sequences = [np.array(r["features"]).reshape(r["lines"], len(FEATURES)) for r in found if r["lines"]]
    return trained(sequences, [r["quality"] for r in found if r["lines"]])


_FEATURE_DDL = "doc_id long, quality int, lines int, features array<double>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = [feature_rows(t) for t in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(batch.column("quality").to_pylist(), pa.int32()),
                    pa.array([len(r) for r in rows], pa.int32()),
                    pa.array([r.ravel().tolist() for r in rows], pa.list_(pa.float64())),
                ],
                ["doc_id", "quality", "lines", "features"],
            )


def judged(text: bytes, crf: Crf) -> tuple[int, int, int, int, int, bool, bool, float]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content share."""
    line_words, lines, again = text_lines(text)
    words = [w for ws in line_words for w in ws]
    n = len(words)
    repeated = repeated_words(words)
    word_chars = len(b"".join(words).decode())
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    share = 0.0
    if n:
        features = np.array([line_features(*x) for x in zip(lines, line_words, again, strict=True)])
        content = crf.viterbi(features)
        share = sum(len(ws) for ws, c in zip(line_words, content.tolist(), strict=True) if c) / n
    return n, word_chars, n_symbols(text), sum(again), repeated, failed, not failed and share >= CONTENT_SHARE, share


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double"
)
_TYPES = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64()]


def _judge(crf: Crf):
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = zip(*(judged(t, crf) for t in byte_texts(batch.column("text"))), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(found, _TYPES, strict=True))],
                    ["doc_id", *names],
                )

    return run


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts, base and verdict of every row."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(_judge(train(docs, labels)), f"doc_id long, {SCHEMA}")


def _filter(crf: Crf, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = [judged(t, crf)[6] for t in byte_texts(batch.column(at))]
                yield batch.filter(pa.array(kept, pa.bool_()))

    return run


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are, without a shuffle."""
    return docs.mapInArrow(_filter(train(docs, labels), docs.columns.index("text")), docs.schema)
