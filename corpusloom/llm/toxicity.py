"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks, over sentences.

Strings: a text is lower-cased and cut into sentences at line ends and at . ! ? before a blank. A sentence is a string of
characters, blanks and signs among them; its windows are all runs of WINDOW characters, which never cross its ends.
Kernel: two windows are alike by the three-character subsequences they share, each weighing DECAY to the power of the
stretch it covers (up to SPAN characters), divided by that of a window whose subsequences all differ. Inserted characters,
blanks and gaps only lengthen a stretch, so 'id-iot', 'id iot' and 'idxxiot' stay close to 'idiot'. Nystroem: a window is
described by its kernel with landmark windows of both kinds, whitened by the landmarks' own kernel matrix. A linear
machine on that description is, summed up, one weight per subsequence, so that windows are scored from a table. The
margin of a sentence is its best window's; that of the best sentence gives the score.

Training: documents marked toxic or not, folds 1 to 4 of 5 by crc32 of the id; at most TRAIN_DOCS rows in the order of a
seeded hash, half of them toxic where there are as many. Labels are of texts, so the toxic windows are found in rounds
(multiple instances): words that toxic texts share and clean ones lack begin, then each text's best window takes
part. Each toxic place also trains through changed copies: letters put in or doubled, blanks, signs and digits inside.
Clean windows are taken evenly, then those that come closest to the toxic ones. The curve from margins to scores comes
from texts that the machine at hand was not trained on (PARTS of the training rows in turn).
Labels, language, source and id are no inputs of a score.

Null and empty texts have the margin of no characters. Without labels of both kinds, or without words that toxic texts
share, every score is 0. Repeated rows give repeated rows. A null doc_id is in no fold and counts as not held out.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import seeded_hash
from corpusloom.llm.common import byte_texts, fold_of, slices

FOLDS = 5
HELD_OUT = 0
TRAIN_DOCS = 2000  # bound of the labelled sample, in rows
DECAY = 0.75
SPAN = 8
WINDOW = 12
LANDMARKS = 320  # of each kind
MIN_TOXIC = 4  # training texts a beginning word occurs in
CLEAN_RATIO = 20  # so much rarer it is in clean texts
ROUNDS = 3
PLACES = 1000  # toxic places of the sample a machine is trained on at most, taken evenly
PLAIN = 2  # copies of a toxic place as it is between clean words
CHANGES = 6  # and changed ones, one of each kind
EVEN = 5000  # clean windows taken evenly
CLEAN_SHARE = 0.7  # weight of clean windows
CLOSE = 5000  # clean windows that come closest, in each round
RIDGE = 2e-5
PARTS = 3  # of the training rows, each judged by a machine of the others, for the curve
STEPS = 20
MISSED = 3.0  # a missed toxic text weighs as much as so many false ones
REACH = 1.5  # margins beyond count as this
SEED = 42
CHUNK = 1 << 16  # windows scored at once

# Codes: letters, a blank, a sign, digits by rest of three, the end of a sentence, and the last byte of other characters
# by its rest of 32, which is the same for small and capital letters of many scripts. First bytes of those are left out.
LETTERS = 64
BLANK, SIGN, DIGIT, END, OTHER = 26, 27, 28, 31, 32


def _codes() -> np.ndarray:
    out = np.full(256, SIGN, dtype=np.uint8)
    for b in range(26):
        out[97 + b] = out[65 + b] = b
    for b in range(10):
        out[48 + b] = DIGIT + b % 3
    out[list(b" \t\r\v\f")] = BLANK
    out[ord("\n")] = END
    out[128:] = OTHER + np.arange(128) % 32
    return out


CODE = _codes()
STOPS = np.isin(np.arange(256), list(b".!?"))
WORDS = re.compile(rb"[^\x1a\x1b\x1f]{3,}")


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of texts one after the other, ends of sentences WINDOW - 1 times, and where each text begins."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    codes = CODE[raw]
    after = np.append(codes[1:], END)
    codes[STOPS[raw] & ((after == BLANK) | (after == END))] = END
    before = np.append(np.uint8(END), codes[:-1])
    times = np.where(codes == END, WINDOW - 1, 1)
    times[(raw >= 0xC0) | ((codes == BLANK) & ((before == BLANK) | (before == END)))] = 0
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1].astype(np.int64)
    return np.repeat(codes, times), np.concatenate([[0], np.cumsum(times)])[at]


def _triples() -> tuple[np.ndarray, np.ndarray]:
    """Positions of all subsequences of length three within SPAN in a window, and their weights."""
    n = WINDOW
    at = np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))])
    weight = DECAY ** (at[:, 2] - at[:, 0] + 1.0)
    return at, weight / np.sqrt((weight**2).sum())


TRIPLES, SPREAD = _triples()
UNIT = float((SPREAD / DECAY ** (TRIPLES[:, 2] - TRIPLES[:, 0] + 1.0))[0])


def features(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence codes and weights of windows (a row of codes each); subsequences with an end weigh nothing."""
    x = windows.astype(np.int32)
    a, b, c = (x[:, TRIPLES[:, k]] for k in range(3))
    ends = (a == END) | (b == END) | (c == END)
    return (a * LETTERS + b) * LETTERS + c, np.where(ends, 0.0, SPREAD).astype(np.float32)


def kernels(windows: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The kernel of each window with each landmark."""
    codes, values = features(marks)
    used = np.unique(codes)
    row_of = np.zeros(LETTERS**3, dtype=np.int32)  # row 0: what no landmark has
    row_of[used] = np.arange(1, len(used) + 1)
    table = np.zeros((len(used) + 1, len(marks)), dtype=np.float32)
    np.add.at(table, (row_of[codes], np.arange(len(marks))[:, None]), values)
    out = np.zeros((len(windows), len(marks)), dtype=np.float32)
    for start in range(0, len(windows), 1024):
        part = slice(start, start + 1024)
        codes, values = features(windows[part])
        rows = row_of[codes]
        for t in range(rows.shape[1]):
            out[part] += values[:, t, None] * table[rows[:, t]]
    return out


def scan(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For the window at each place, the table's weights of its subsequences, summed."""
    padded = np.concatenate([codes, np.full(WINDOW + SPAN, END, dtype=np.uint8)]).astype(np.int32)
    out = np.empty(len(codes), dtype=np.float32)
    for start in range(0, len(codes), CHUNK):
        n = min(CHUNK, len(codes) - start)
        m = n + WINDOW - 1
        c = padded[start : start + m + SPAN]
        pairs = [None, *((c[:m] * LETTERS + c[a : a + m]) * LETTERS for a in range(1, SPAN - 1))]
        total = np.zeros(n)
        for b in range(2, SPAN):
            sums = np.zeros(m, dtype=np.float32)
            last = c[b : b + m]
            for a in range(1, b):
                sums += table[pairs[a] + last]
            run = np.concatenate([[0.0], np.cumsum(sums, dtype=np.float64)])
            total += (UNIT * DECAY ** (b + 1)) * (run[WINDOW - b : WINDOW - b + n] - run[:n])
        out[start : start + n] = total
    return out


class Machine:
    """The trained machine: weights of subsequences, offset, and the logistic curve."""

    def __init__(self, table: np.ndarray, offset: float, slope: float, shift: float) -> None:
        self.table, self.offset, self.slope, self.shift = table.astype(np.float32), offset, slope, shift

    def __getstate__(self) -> dict:
        used = np.flatnonzero(self.table)
        return {"used": used, "values": self.table[used], "rest": (self.offset, self.slope, self.shift)}

    def __setstate__(self, state: dict) -> None:
        self.table = np.zeros(LETTERS**3, dtype=np.float32)
        self.table[state["used"]] = state["values"]
        self.offset, self.slope, self.shift = state["rest"]

    def margins(self, codes: np.ndarray) -> np.ndarray:
        """Of the windows that begin at each character; at an end of a sentence begins none."""
        return np.where(codes == END, np.float32(0), scan(codes, self.table)) + np.float32(self.offset)

    def best(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each text: the margin of its best sentence, cut at REACH either way."""
        return np.clip(np.maximum.reduceat(self.margins(codes), starts), -REACH, REACH)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.best(*encode(texts)).astype(np.float64) * self.slope + self.shift)))


NOTHING = Machine(np.zeros(LETTERS**3), 0.0, 0.0, -500.0)


def sentences(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where sentences and texts begin."""
    end = codes == END
    return np.union1d(starts, np.flatnonzero(end[:-1] & ~end[1:]) + 1)


def window_at(codes: np.ndarray, places: np.ndarray) -> np.ndarray:
    padded = np.concatenate([codes, np.full(WINDOW, END, dtype=np.uint8)])
    return padded[places[:, None] + np.arange(WINDOW)]


def changed(word: bytes, kind: int, rng: random.Random) -> bytes:
    """A copy of a word's codes with a change of one of CHANGES kinds inside."""
    at = rng.randrange(1, len(word))
    if kind == 0:
        return word[:at] + bytes([rng.randrange(26)]) + word[at:]
    if kind == 1:
        return word[:at] + bytes([rng.randrange(26)] * 2) + word[at:]
    if kind == 2:
        return word[:at] + word[at - 1 : at] * rng.randint(1, 2) + word[at:]
    if kind == 3:
        return word[:at] + bytes([BLANK]) + word[at:]
    if kind == 4:
        return word[:at] + bytes([SIGN]) + word[at:]
    at = rng.randrange(1, max(2, len(word) - 1))
    return word[:at] + bytes([rng.choice([SIGN, DIGIT, DIGIT + 1, DIGIT + 2])]) + word[at + 1 :]


def places_of(text: bytes, words: dict[bytes, float]) -> list[tuple[int, int]]:
    """First places of listed words in a text's codes."""
    found: dict[bytes, tuple[int, int]] = {}
    for m in WORDS.finditer(text):
        if m[0] in words:
            found.setdefault(m[0], m.span())
    return sorted(found.values())


def strings_at(text: bytes, start: int, end: int, clean: bytes, rng: random.Random) -> list[bytes]:
    """A toxic place as it is, at the end of a sentence, and with changes between words of clean texts."""
    word = text[start:end]
    out = [text[max(0, start - 3) : start] + word + text[end : end + WINDOW], bytes([END]) + word + bytes([END])]
    copies = [*[word] * PLAIN, *(changed(word, kind, rng) for kind in range(CHANGES))] if len(word) > 2 else []
    for copy in copies:
        at = rng.randrange(max(1, len(clean) - WINDOW))
        out.append(bytes([BLANK]) + copy + bytes([BLANK]) + clean[at : at + WINDOW])
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weights (the last one of the constant column) of the least squared hinge loss with a ridge, by Newton's steps."""
    weight = np.zeros(x.shape[1])
    diagonal = RIDGE * np.eye(x.shape[1])
    diagonal[-1, -1] = 1e-9
    for _ in range(STEPS):
        inside = y * (x @ weight) < 1
        part, counts = x[inside].astype(np.float64), share[inside]
        found = np.linalg.solve(diagonal + (part * counts[:, None]).T @ part, part.T @ (counts * y[inside]))
        if np.allclose(found, weight, atol=1e-5):
            break
        weight = found
    return weight


def machine_of(texts: list[bytes], labels: np.ndarray) -> Machine | None:
    """The machine of coded texts, without its curve; None where toxic texts share no words."""
    rng = random.Random(SEED)
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for text, y in zip(texts, labels.tolist(), strict=True):
        seen[y].update(set(WORDS.findall(text)))
    n = np.bincount(labels, minlength=2)
    telling = {w: c for w, c in seen[1].items() if c >= MIN_TOXIC and seen[0][w] * n[1] * CLEAN_RATIO < c * n[0]}
    if not telling:
        return None
    toxic = [t for t, y in zip(texts, labels.tolist(), strict=True) if y == 1]
    plain = b"".join(t for t, y in zip(texts, labels.tolist(), strict=True) if y == 0)
    clean = np.frombuffer(plain, dtype=np.uint8)
    lengths = np.array([len(t) for t in toxic])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    whole = np.frombuffer(b"".join(toxic), dtype=np.uint8)
    found = {i: places_of(t, telling) for i, t in enumerate(toxic)}
    open_places = np.flatnonzero(clean != END)
    negative = window_at(clean, open_places[:: max(1, len(open_places) // EVEN)])
    even = len(negative)
    machine, marks = None, np.empty((0, WINDOW), dtype=np.uint8)
    for step in range(ROUNDS):
        if machine is not None:  # texts without a place take their best window, if it is a toxic one
            margins = machine.margins(whole)
            for i, t in enumerate(toxic):
                own = margins[starts[i] : starts[i] + lengths[i]]
                best = int(own.argmax())
                if not found[i] and own[best] > 0:
                    words = [m.span() for m in WORDS.finditer(t[best : best + WINDOW])]
                    if words:
                        start, end = max(words, key=lambda s: s[1] - s[0])
                        found[i] = [(best + start, best + end)]
        spots = [(i, *p) for i, ps in found.items() for p in ps]
        spots = spots[:: max(1, -(-len(spots) // PLACES))]
        pieces = [p for i, s, e in spots for p in strings_at(toxic[i], s, e, plain, rng)]
        joined = np.frombuffer(b"".join(p + bytes([END]) * (WINDOW - 1) for p in pieces), dtype=np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(p) + WINDOW - 1 for p in pieces])[:-1]]).astype(np.int64)
        if machine is None:
            places = begins + np.array([1 if p[0] == END else 0 for p in pieces])
        else:
            margins = machine.margins(joined)
            ends = np.append(begins[1:], len(joined))
            places = np.array([b + int(margins[b:e].argmax()) for b, e in zip(begins, ends, strict=True)])
        positive = window_at(joined, places)
        if machine is not None:
            margins = machine.margins(clean)
            begin = sentences(clean, np.zeros(1, dtype=np.int64))
            best = np.maximum.reduceat(margins, begin)
            close = np.argsort(-best, kind="stable")[:CLOSE]
            at = [begin[i] + int(margins[begin[i] : (begin[i + 1] if i + 1 < len(begin) else None)].argmax()) for i in close]
            negative = np.concatenate([negative, window_at(clean, np.array(at, dtype=np.int64))])
        if step < 2:  # landmarks once more when close clean windows are known
            distinct = np.unique(positive, axis=0)
            far = negative[even:] if step else negative
            marks = np.concatenate([distinct[:: max(1, -(-len(distinct) // LANDMARKS))], far[:: max(1, -(-len(far) // LANDMARKS))]])
            marks = np.unique(marks, axis=0)
            values, vectors = np.linalg.eigh(kernels(marks, marks).astype(np.float64))
            keep = values > 1e-4 * values[-1]
            whiten = vectors[:, keep] / np.sqrt(values[keep])
        negative = np.unique(negative, axis=0)
        windows = np.concatenate([positive, negative])
        x = np.concatenate([kernels(windows, marks) @ whiten, np.ones((len(windows), 1))], axis=1).astype(np.float32)
        y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
        share = np.where(y > 0, (1 - CLEAN_SHARE) / len(positive), CLEAN_SHARE / len(negative))
        weight = squared_hinge(x, y, share)
        codes, spread = features(marks)
        table = np.zeros(LETTERS**3)
        np.add.at(table, codes, spread * (whiten @ weight[:-1])[:, None])
        machine = Machine(table, float(weight[-1]), 0.0, -500.0)
    return machine


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slope and shift of the most likely logistic curve, by Newton's steps with a little ridge."""
    z = np.stack([x, np.ones(len(x))], axis=1)
    a = np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ a, -30, 30)))
        gradient = z.T @ (weight * (y - p)) - 1e-2 * a
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        a = a + np.linalg.solve(curve, gradient)
    return a


def best_of(machine: Machine, texts: list[bytes]) -> np.ndarray:
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
    return machine.best(np.frombuffer(b"".join(texts), dtype=np.uint8), starts)


def trained(docs: list[tuple[int, bytes]], toxic_share: float) -> Machine:
    """From (label, codes) of the sample; toxic_share: of the labelled rows before sampling."""
    labels = np.array([y for y, _ in docs], dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        return NOTHING
    texts = [t for _, t in docs]
    prior = np.where(labels == 1, MISSED * toxic_share / labels.mean(), (1 - toxic_share) / (1 - labels.mean()))
    part = np.arange(len(docs)) % PARTS
    described = np.zeros(len(docs))
    for k in range(PARTS):
        own, others = np.flatnonzero(part == k), np.flatnonzero(part != k)
        machine = machine_of([texts[i] for i in others], labels[others])
        if machine is None:
            return NOTHING
        if len(own):
            described[own] = best_of(machine, [texts[i] for i in own])
    machine = machine_of(texts, labels)
    machine.slope, machine.shift = map(float, logistic(described, labels.astype(float), prior))
    return machine


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            found = [encode([t])[0].tobytes() for t in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "codes"]
            )


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> Machine:
    """Only the sampled rows come to the driver, at most ``bound`` of them, whole."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.distinct().withColumn("order", seeded_hash(F.col("doc_id"), SEED))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for kind in (0, 1):
        some = known.where(F.col("toxic") == kind).orderBy("order", "doc_id").limit(bound // 2)
        rows = chosen.join(F.broadcast(some), "doc_id").orderBy("order", "doc_id", F.xxhash64("text")).limit(bound // 2)
        rows = rows.select("doc_id", "toxic", "text").mapInArrow(_sample, "doc_id long, toxic int, codes binary")
        found += [(r["doc_id"], r["toxic"], bytes(r["codes"])) for r in rows.collect()]
    found.sort()
    return trained([(y, t) for _, y, t in found], float(share))


def _score(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = np.concatenate([machine.scores(byte_texts(part)) for part in slices(batch.column("text"))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("held_out"),
                        pa.array(scores),
                        pa.array((scores >= 0.5).astype(np.int32)),
                    ],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    machine = train(docs, labels)
    return rows.mapInArrow(_score(machine), "doc_id long, held_out boolean, score double, predicted int")
