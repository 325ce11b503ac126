"""Token files coded by a static range asymmetric numeral system.

A file holds the ids of consecutive documents (ascending doc_id) and one frequency table, shared by all its blocks.
Blocks of BLOCK ids are coded independently, each by LANES interleaved coders that share one stream of 32-bit words.
The header's checkpoints give every block's place, coder states and CRC-32, so blocks are decoded in parallel and
damage is found. Tokens come from the tokenizers library; the end id closes every document.

The work: documents are range-partitioned by doc_id (the only shuffle of texts), each task tokenizes and writes files of
about FILE_TOKENS ids and returns a row per file; reading deals the files to tasks, decodes all blocks of a file and
splits them at the document table. A file is the unit of memory and of recovery: a retried task writes new files.

Null texts are empty (the end id alone). Null doc_ids come first; equal doc_ids keep the order in which they are read.
An empty table gives no files and no rows.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.bpe import DOCS_AT_ONCE, Memo, default_path, encode_by_units
from corpusloom.llm.common import shared_path, stored

MAGIC = b"RANS0001"
PRECISION = 20
LANES = 32
BLOCK = 1 << 16
FILE_TOKENS = 1 << 21
END = 2
LOW = np.uint64(1 << 32)
BLANK_FIRST = re.compile(r" \S")


def scaled(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies of at least one that sum to 2**precision."""
    total, size = int(counts.sum()), 1 << precision
    if len(counts) > size:
        raise ValueError("more symbols than slots")
    freq = np.maximum(counts.astype(np.float64) * size / total, 1).astype(np.int64)
    excess = int(freq.sum()) - size
    if excess < 0:
        freq[np.argmax(freq)] -= excess
    order = np.argsort(-freq, kind="stable")
    while excess > 0:  # take from the most frequent, as evenly as they allow
        take = np.minimum(freq[order] - 1, -(-excess // max(1, int((freq > 1).sum()))))
        take = np.minimum(take, np.maximum(0, excess - np.r_[0, np.cumsum(take)[:-1]]))
        freq[order] -= take
        excess -= int(take.sum())
    return freq


def encode_blocks(symbols: np.ndarray, freq: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Word streams and final states of blocks; symbols are indices into freq, padded to whole blocks."""
    blocks = symbols.reshape(-1, BLOCK // LANES, LANES)
    steps = blocks.shape[1]
    start = np.r_[0, np.cumsum(freq)[:-1]].astype(np.uint64)
    freq = freq.astype(np.uint64)
    limit = freq << np.uint64(64 - PRECISION)
    state = np.full((len(blocks), LANES), LOW, dtype=np.uint64)
    words = np.empty((len(blocks), steps, LANES), dtype=np.uint32)
    sent = np.empty((len(blocks), steps, LANES), dtype=bool)
    scale = np.uint64(PRECISION)
    for t in range(steps - 1, -1, -1):
        s = blocks[:, t]
        f = freq[s]
        out = state >= limit[s]
        if 1 == len(freq):  # the one symbol fills all slots: nothing to say
            out[:] = False
        words[:, t], sent[:, t] = state.astype(np.uint32), out
        state = np.where(out, state >> np.uint64(32), state)
        whole = state // f
        state = (whole << scale) + (state - whole * f) + start[s] if len(freq) > 1 else state
    return [words[b][sent[b]].astype("<u4").tobytes() for b in range(len(blocks))], state


def decode_blocks(streams: list[bytes], state: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Symbols of all blocks at once; raises if a stream is not used up exactly."""
    if len(freq) == 1:
        return np.zeros(len(streams) * BLOCK, dtype=np.int64)
    start = np.r_[0, np.cumsum(freq)[:-1]].astype(np.uint64)
    slots = np.repeat(np.arange(len(freq)), freq)
    freq = freq.astype(np.uint64)
    sizes = np.array([len(s) // 4 for s in streams])
    words = np.frombuffer(b"".join(streams) + bytes(4), dtype="<u4").astype(np.uint64)
    cursor = np.r_[0, np.cumsum(sizes)[:-1]]
    ends = cursor + sizes
    steps = BLOCK // LANES
    out = np.empty((len(streams), steps, LANES), dtype=np.int64)
    mask, scale = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION)
    state = state.copy()
    for t in range(steps):
        slot = state & mask
        s = slots[slot]
        out[:, t] = s
        state = freq[s] * (state >> scale) + slot - start[s]
        need = state < LOW
        at = np.cumsum(need, axis=1)
        word = words[np.minimum(cursor[:, None] + at - 1, len(words) - 1)]
        state = np.where(need, (state << np.uint64(32)) | word, state)
        cursor = cursor + at[:, -1]
    if (cursor != ends).any() or (state != LOW).any():
        raise ValueError("a block doesn't end where it should")
    return out.reshape(-1)


def pack_file(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A whole file: magic, header length, header, packed tables, word streams."""
    counts = np.bincount(ids)  # ids are those of a vocabulary
    values = np.flatnonzero(counts)
    place = np.zeros(len(counts), dtype=np.int64)
    place[values] = np.arange(len(values))
    symbols = place[ids]
    freq = scaled(counts[values])
    blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(blocks * BLOCK, dtype=np.int64)
    padded[: len(ids)] = symbols
    padded[len(ids) :] = int(np.argmax(freq))
    streams, states = encode_blocks(padded, freq)
    tables = zlib.compress(
        values.astype("<u4").tobytes()
        + freq.astype("<u4").tobytes()
        + sizes.astype("<u8").tobytes()
        + np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()
        + np.array([d is None for d in doc_ids], dtype="u1").tobytes()
        + states.astype("<u8").tobytes(),
        3,
    )
    checks = [zlib.crc32(padded_ids(values, padded, b, len(ids))) for b in range(blocks)]
    places = np.r_[0, np.cumsum([len(s) for s in streams])].tolist()
    header = json.dumps(
        {
            "symbols": len(values),
            "docs": len(doc_ids),
            "tokens": len(ids),
            "block": BLOCK,
            "lanes": LANES,
            "precision": PRECISION,
            "tables": len(tables),
            "places": places,
            "crc32": checks,
        }
    ).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, tables, *streams])


def padded_ids(values: np.ndarray, symbols: np.ndarray, block: int, n: int) -> bytes:
    return values[symbols[block * BLOCK : min(n, (block + 1) * BLOCK)]].astype("<u4").tobytes()


def unpack_file(raw: bytes, first: int = 0, last: int | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, tokens per document, and the ids of blocks first to last (all by default), checksums verified."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    (n,) = struct.unpack("<I", raw[8:12])
    header = json.loads(raw[12 : 12 + n])
    if (header["block"], header["lanes"], header["precision"]) != (BLOCK, LANES, PRECISION):
        raise ValueError("a token file of other parameters")
    body = 12 + n + header["tables"]
    tables = zlib.decompress(raw[12 + n : body])
    at = 0

    def column(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(tables, dtype=kind, count=count, offset=at)
        at += found.nbytes
        return found

    docs, blocks = header["docs"], len(header["crc32"])
    values, freq = column("<u4", header["symbols"]), column("<u4", header["symbols"]).astype(np.int64)
    sizes, numbers, missing = column("<u8", docs).astype(np.int64), column("<i8", docs), column("u1", docs)
    states = column("<u8", blocks * LANES).reshape(blocks, LANES).astype(np.uint64)
    last = blocks if last is None else last
    streams = [raw[body + header["places"][b] : body + header["places"][b + 1]] for b in range(first, last)]
    symbols = decode_blocks(streams, states[first:last], freq)
    total = min(header["tokens"] - first * BLOCK, (last - first) * BLOCK)
    for b in range(last - first):
        if zlib.crc32(padded_ids(values, symbols, b, total)) != header["crc32"][first + b]:
            raise ValueError(f"block {first + b} doesn't match its checksum")
    names = [None if m else int(d) for d, m in zip(numbers, missing, strict=True)]
    return names, sizes, values[symbols[:total]]


class Library:
    """The tokenizers library with a memo of units; a blank before a non-blank always begins a new piece."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Memo()
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int64)  # one letter of a token is one byte
        for word, i in vocab.items():
            self.width[i] = len(word)

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of units; those that begin with a blank and a non-blank begin new pieces and are encoded in a row."""
        together = "\n".join(units)
        special = [w for w in self.whole if w in together]
        out: dict[str, bytes] = {}
        joint = []
        for unit in units:
            if BLANK_FIRST.match(unit) and not any(w in unit for w in special):
                joint.append(unit)
            else:
                ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
                out[unit] = np.array(ids, dtype="<u4").tobytes()
        for start in range(0, len(joint), 4096):
            some = joint[start : start + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.cumsum([len(u.encode()) for u in some])
            cuts = (4 * np.searchsorted(np.cumsum(self.width[ids]), ends) + 4).tolist()
            raw = ids.tobytes()
            out.update(zip(some, map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
        return [out[u] for u in units]

    def encode(self, texts: list[str]) -> list[bytes]:
        return encode_by_units(texts, self.memo, self._units, self.whole)


@functools.lru_cache(4)
def library(path: str) -> Library:
    return Library(path)


def _writer(folder: str, path: str, end: int, file_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, closing = library(path), np.array([end], dtype="<u4").tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[bytes] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            store, base = fs.FileSystem.from_uri(folder)
            store.create_dir(base, recursive=True)
            file = f"{uuid.uuid4().hex}.rans"
            sizes = np.array([len(h) // 4 for h in held])
            with store.open_output_stream(f"{base}/{file}", compression=None) as out:
                out.write(pack_file(names, sizes, np.frombuffer(b"".join(held), dtype="<u4")))
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int64()), (file, None), (tokens, pa.int64()))],
                ["part", "seq", "file", "tokens"],
            )

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for start in range(0, batch.num_rows, DOCS_AT_ONCE):
                some = tokenizer.encode([t or "" for t in texts.slice(start, DOCS_AT_ONCE).to_pylist()])
                for name, raw in zip(ids[start : start + DOCS_AT_ONCE], some, strict=True):
                    names.append(name)
                    held.append(raw + closing)
                    tokens += len(raw) // 4 + 1
                    if tokens >= file_tokens:
                        yield flush()
                        names, held, tokens, seq = [], [], 0, seq + 1
        if names:
            yield flush()

    return write


def write_tokens(
    docs: DataFrame, folder: str, path: str | None = None, end: int = END, file_tokens: int = FILE_TOKENS
) -> DataFrame:
    """Write token files below ``folder``; a row per file (file, start, tokens), start: ids in all files before it.

    Starts add up per part first, so what is ranked as a whole is one row per part of the range.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("nth"),
        F.col("text").cast("string").alias("text"),
    )
    ranged = rows.repartitionByRange(parts, "doc_id", "nth").sortWithinPartitions("doc_id", "nth")
    files = ranged.select("doc_id", "text").mapInArrow(
        _writer(folder, path or default_path(), end, file_tokens), "part int, seq long, file string, tokens long"
    )
    files = stored(files, "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.groupBy("part").agg(F.sum("tokens").alias("total"))
    totals = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    return files.join(totals, "part").select("file", starts.alias("start"), "tokens")


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{file}") as source:
                    names, sizes, ids = unpack_file(source.read())
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int64()),
                        pa.array(start + ends - sizes),
                        pa.array(sizes),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return read


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, crc32 of the ids of every document in the files."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.repartition(parts, "file")
    return dealt.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    folder = shared_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, path), folder)
