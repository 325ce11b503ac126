"""Byte-level BPE: encoding by backtracking over longest matches, decoding by an offset table.

Encoding: an Aho-Corasick automaton finds the longest token that starts at each place. Tokens are laid from left to
right, each checked against the one before it by the table of compatible pairs (two tokens are compatible if merging
their joined text leaves them as they are); where none fits, the last token gives way to the next shorter prefix, and a
place that led nowhere is never tried again. A sequence of pairwise compatible tokens is what merging would give, so the
result is exact, in time linear in the text.

Whole texts are encoded. A blank before a non-blank always begins a new piece, so texts fall into units at such blanks,
and units seen before are taken from a memo of bounded size. Null texts are empty: no ids, empty decoded text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import compress
from operator import not_
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO_BYTES = 300 << 20  # of units and their ids, with what Python adds to each
MEMO_ENTRY = 220  # bytes that Python adds
MEMO_CHARS = 256  # longest unit that is remembered
DOCS_AT_ONCE = 256


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 for itself, all others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


# Fixed value: how byte-level BPE cuts a text into pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
BLANK_BEFORE = re.compile(r"(?= \S)")
ODD_BLANK = re.compile(r" (?!\S)")
ODD_LINE = re.compile(r"\n(?!\S)")
GLUED = "\0"  # begins a unit that no blank precedes


class ByteBpe:
    """Tables of a vocabulary file, built once per process."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab: dict[str, int] = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens") or []}
        self.letter = byte_letters()
        byte = {c: b for b, c in self.letter.items()}
        self.table = {b: self.letter[b] for b in range(256)}
        words = {i: w for w, i in vocab.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        self.merge_rank = {(vocab[a], vocab[b]): n for n, (a, b) in enumerate(merges)}
        self.rank = dict.fromkeys(vocab.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        for n, (a, b) in enumerate(merges):
            joined = vocab[a + b]
            if joined not in self.parts:
                self.rank[joined], self.parts[joined] = n, (vocab[a], vocab[b])
        self.compatible = functools.lru_cache(1 << 20)(self._compatible)
        # tokens that merging their own text gives back; others can't occur
        usable = {w: i for w, i in vocab.items() if len(w) == 1 or (i in self.parts and self._reachable(i))}
        self.length = {i: len(w) for w, i in usable.items()}
        self.automaton = ahocorasick.Automaton()
        for w, i in usable.items():
            self.automaton.add_word(w, i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        for w, i in usable.items():
            for cut in range(len(w) - 1, 0, -1):
                if (prefix := usable.get(w[:cut])) is not None:
                    self.shorter[i] = prefix
                    break
        # decoding: bytes of all tokens in a row, and where each begins
        size = max([*words, *self.special.values()]) + 1
        spelled = [b""] * size
        for i, w in words.items():
            spelled[i] = bytes(byte[c] for c in w) if all(c in byte for c in w) else w.encode()
        for w, i in self.special.items():
            spelled[i] = w.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])
        self.spelled = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.special_at = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.memo = Memo()

    def _reachable(self, token: int) -> bool:
        left, right = self.parts[token]
        return self._compatible(left, right, self.rank[token])

    def _compatible(self, a: int, b: int, limit: int | None = None) -> bool:
        """Whether a boundary between a and b survives merging.

        The later merge is undone first. A merge over the boundary that came earlier would have taken the boundary
        away; of equal merges the left one comes first.
        """
        most = len(self.merge_rank) if limit is None else limit
        while True:
            over = self.merge_rank.get((a, b))
            if over is not None and over < most:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                most, a = min(most, ra), self.parts[a][1]
            else:
                most, b = min(most, rb + 1), self.parts[b][0]

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one piece, given in byte letters."""
        longest: dict[int, int] = {}
        length, compatible, shorter = self.length, self.compatible, self.shorter
        for end, token in self.automaton.iter(piece):
            longest[end + 1 - length[token]] = token  # later ends are longer
        n, at = len(piece), 0
        if length.get(longest.get(0)) == n:
            return [longest[0]]
        dead = bytearray(n + 1)
        laid: list[int] = []
        token: int | None = longest[0]
        while at < n:
            if token is None:  # nothing fits here: the last token gives way
                dead[at] = 1
                token = laid.pop()
                at -= length[token]
            end = at + length[token]
            if not dead[end] and (not laid or compatible(laid[-1], token)):
                laid.append(token)
                at = end
                token = longest.get(at)
            else:
                token = shorter.get(token)
        return laid

    def plain_ids(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        out: list[int] = []
        for piece in PIECES.findall(text):
            out += self.piece_ids(piece.encode().decode("latin-1").translate(self.table))
        return out

    def unit_ids(self, text: str) -> list[int]:
        """Ids of any text, special tokens included."""
        if self.special_at is None or not self.special_at.search(text):
            return self.plain_ids(text)
        out, at = [], 0
        for found in self.special_at.finditer(text):
            out += self.plain_ids(text[at : found.start()])
            out.append(self.special[found[0]])
            at = found.end()
        return out + self.plain_ids(text[at:])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoded_units([text])[0], dtype="<u4")

    def encoded_units(self, texts: list[str]) -> list[bytes]:
        def encode(units: list[str]) -> list[bytes]:
            return [pack(f"<{len(ids)}I", *ids) for ids in map(self.unit_ids, units)]

        return encode_by_units(texts, self.memo, encode, list(self.special))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, gathered from the table of offsets."""
        begin = self.offsets[ids]
        sizes = self.offsets[ids + 1] - begin
        total = int(sizes.sum())
        if not total:
            return b""
        shift = np.repeat(begin - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        return self.spelled[shift + np.arange(total)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


class Memo:
    """Ids (little-endian, 32 bits) of units: those behind a blank by their text after it, others by their whole text.

    It holds units of at most MEMO_CHARS characters, and about MEMO_BYTES of them and their ids.
    """

    def __init__(self, most: int = MEMO_BYTES) -> None:
        self.behind: dict[str, bytes] = {}
        self.other: dict[str, bytes] = {"": b""}
        self.most, self.size = most, 0

    def trim(self) -> None:
        if self.size > self.most:
            self.behind.clear()
            self.other = {"": b""}
            self.size = 0

    def keep(self, known: dict[str, bytes], fresh: dict[str, bytes]) -> None:
        short = {u: ids for u, ids in fresh.items() if len(u) <= MEMO_CHARS}
        known.update(short)
        self.size += MEMO_ENTRY * len(short) + sum(map(len, short)) + sum(map(len, short.values()))


def encode_by_units(
    texts: list[str], memo: Memo, encode: Callable[[list[str]], list[bytes]], whole: list[str]
) -> list[bytes]:
    """Ids of each text; ``encode`` gives those of the units that the memo lacks.

    Texts are cut before every blank that a non-blank follows and around a line end between two non-blanks, where pieces
    always end. Texts with one of ``whole`` (special tokens) stay in one piece.
    """
    memo.trim()
    cut: list[tuple[list[str], list[str]]] = []
    for text in texts:
        if any(w in text for w in whole):
            cut.append(([text], []))
        elif GLUED in text or ODD_BLANK.search(text):
            cut.append((BLANK_BEFORE.split(text), []))
        else:
            if not ODD_LINE.search(text):
                text = text.replace("\n", " \0\n \0")
            parts = text.split(" ")
            cut.append((parts[:1], parts[1:]))
    found, gaps = [], []
    lacking: set[str] = set()
    for _, parts in cut:
        ids = list(map(memo.behind.get, parts))
        gap = list(compress(range(len(ids)), map(not_, ids)))
        lacking.update(map(parts.__getitem__, gap))
        found.append(ids)
        gaps.append(gap)
    others = list({u for units, _ in cut for u in units}.difference(memo.other))
    behind = list(lacking)
    new_behind = dict(zip(behind, encode([p[1:] if p[:1] == GLUED else " " + p for p in behind]), strict=True))
    new_others = dict(zip(others, encode(others), strict=True))
    both = {u: memo.other[u] for units, _ in cut for u in units if u in memo.other} | new_others
    memo.keep(memo.behind, new_behind)
    memo.keep(memo.other, new_others)
    out = []
    for (units, parts), ids, gap in zip(cut, found, gaps, strict=True):
        for i in gap:
            ids[i] = new_behind[parts[i]]
        out.append(b"".join([*map(both.__getitem__, units), *ids]))
    return out


@functools.lru_cache(4)
def tables(path: str) -> ByteBpe:
    return ByteBpe(path)


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tables(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start in range(0, batch.num_rows, DOCS_AT_ONCE):
                some = [t or "" for t in texts.slice(start, DOCS_AT_ONCE).to_pylist()]
                ids = bpe.encoded_units(some)
                rest = [batch.column(i).slice(start, DOCS_AT_ONCE) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(ids, pa.binary())], [*batch.schema.names[:-1], "ids"]
                )

    return run


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All columns but text, and ids (binary: little-endian unsigned 32-bit integers) under the name ``ids``.

    A column of ``docs`` that is called ids already is replaced.
    """
    rest = [c for c in docs.columns if c not in ("text", "ids")]
    chosen = docs.select(*(F.col(f"`{c}`") for c in rest), F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(_encoder(path or default_path()), f"{schema}{', ' if rest else ''}ids binary")


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tables(path)
        for batch in _encoder(path)(batches):
            n, ids_sha, text_sha = [], [], []
            for raw in batch.column("ids").to_pylist():
                ids = np.frombuffer(raw, dtype="<u4").astype(np.int64)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, sha256 of the ids and of the text decoded from them, for every row."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(
        _round_trip(path or default_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tables(path)
        for batch in batches:
            raw = batch.column(batch.num_columns - 1).to_pylist()
            texts = [bpe.decode(np.frombuffer(r or b"", dtype="<u4").astype(np.int64)) for r in raw]
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    return run


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """All columns but ids, and the text the ids stand for."""
    rest = [c for c in tokens.columns if c not in ("text", "ids")]
    chosen = tokens.select(*(F.col(f"`{c}`") for c in rest), "ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(_decoder(path or default_path()), f"{schema}{', ' if rest else ''}text string")


def both_ways(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All columns of ``docs``, with ids, and the text that the ids decode to in place of text."""
    path = path or default_path()
    rest = [c for c in docs.columns if c not in ("text", "ids")]
    chosen = docs.select(*(F.col(f"`{c}`") for c in rest), F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tables(path)
        for batch in _encoder(path)(batches):
            ids = batch.column("ids")
            texts = [bpe.decode(np.frombuffer(i, dtype="<u4").astype(np.int64)) for i in ids.to_pylist()]
            columns = [*(batch.column(i) for i in range(len(rest))), pa.array(texts, pa.string()), ids]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "text", "ids"])

    return chosen.mapInArrow(run, f"{schema}{', ' if rest else ''}text string, ids binary")
