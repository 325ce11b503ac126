"""Substring dedup by seed and extend: repeats of WINDOW words or more, over all documents.

Seeds: every document is winnowed. Each window of WINDOW words picks, of its runs of SEED_WORDS words, the one with the
least hash, the leftmost of equals. The choice depends on the window's words alone, so two documents that share a window
share its seed, at the same place in it. The consecutive windows that pick one seed are its segment: the seed extended
both ways as far as a repeat through it can still be told from its neighbours'.

Join: only seeds that occur in two documents or more go on. A segment that is equal, as a whole, to one of a smaller
document is a repeat; of equal segments only the smallest document's is looked at further, so groups of copies shrink to
one member first. Segments of one seed that differ are extended window by window: a window's hash meets the
equal ones of the other segments, and it is a repeat if one of them starts in a smaller document. Neighbouring repeats of
a document touch or overlap; their union, cut out of the text, is its maximal repeats.

No pairs are formed: seeds, segments and windows are grouped by hash (96 bits for segments and windows) and compared with
the group's smallest document; large groups are dealt to several tasks. Seeds whose segments are all equal need no windows.

Documents are ordered by doc_id. Rows without doc_id come after all others and not before one another; rows that share a
doc_id are not smaller than one another. Null texts have no words. Repeated rows give repeated rows. Texts are worked on
in chunks of CHUNK words that overlap by a window, so a very long one needs no more memory than its own words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import byte_texts, slices, stored

WINDOW = 50
SEED_WORDS = 12
CHUNK = 1 << 18  # words worked on at once
SLICE = 1 << 20  # bytes of text worked on at once
MEMO = 1 << 18  # words whose hashes a task remembers
MEMO_CHARS = 64
BLOCK_ROWS = 8_192
LAST = (1 << 63) - 1
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so they have inverses modulo 2^64
PLACE = np.uint64((1 << 20) - 1)
assert CHUNK <= 1 << 20

SEEDS = "ord long, key long, start int, n int, seed long, s1 long, s2 int, n_words long, kept_sha256 string"


class WordHashes(dict):
    """64-bit hashes of words; remembers up to MEMO short ones."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO and len(word) <= MEMO_CHARS:
            self[word] = found
        return found


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Runs:
    """Hashes of runs of words out of one chunk: a polynomial in an odd base, from prefix sums, modulo 2^64."""

    _tables: dict = {}

    def __init__(self, words: np.ndarray, lane: int) -> None:
        if (lane, CHUNK) not in self._tables:
            base = BASES[lane]
            self._tables[lane, CHUNK] = powers(base, CHUNK + 1), powers(pow(base, -1, 2**64), CHUNK + 1)
        self.up, self.down = self._tables[lane, CHUNK]
        values = mixed(words) if lane else words
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(values * self.up[: len(words)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def chunks(tokens: list[list[bytes]], hashes: WordHashes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Word hashes of several texts in a row; and per text or part of one: its number, its beginning in the chunk and in
    the text. Parts of a text overlap by a window less one word, so each of its windows lies in one part.
    """
    step = CHUNK - WINDOW + 1
    parts, size = [], 0
    for i, words in enumerate(tokens):
        for first in range(0, max(1, len(words) - WINDOW + 1), step):
            part = words[first : first + CHUNK]
            if len(part) < WINDOW:
                continue
            if size + len(part) > CHUNK and parts:
                yield _chunk(parts, hashes)
                parts, size = [], 0
            parts.append((i, first, part))
            size += len(part)
    if parts:
        yield _chunk(parts, hashes)


def _chunk(parts: list, hashes: WordHashes) -> tuple:
    sizes = np.array([len(p) for _, _, p in parts])
    total = int(sizes.sum())
    values = np.fromiter((hashes[w] for _, _, p in parts for w in p), np.uint64, total)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return values, np.array([i for i, _, _ in parts]), begins, np.array([f for _, f, _ in parts])


def least_over(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours, by doubling."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = np.minimum(out[: len(out) - step], out[step:])
        reach += step
    return out


def segments(values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Part, start, windows and seed place of every segment of a chunk, by winnowing."""
    grams = Runs(values, 0).of(np.arange(len(values) - SEED_WORDS + 1), np.arange(SEED_WORDS, len(values) + 1))
    ranked = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    place = (least_over(ranked, WINDOW - SEED_WORDS + 1) & PLACE).astype(np.int64)
    sizes = np.diff(begins)
    part = np.repeat(np.arange(len(sizes)), sizes)[: len(place)]
    whole = np.arange(len(place)) + WINDOW <= begins[part + 1]
    starts = np.flatnonzero(whole)
    place, part = place[starts], part[starts]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (part[1:] != part[:-1])])
    n = np.diff(np.r_[first, len(starts)])
    return part[first], starts[first], n, place[first]


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of each text, and a row with its word count and the hash of its joined words (start is null)."""
    hashes = WordHashes()
    for batch in batches:
        if not batch.num_rows:
            continue
        ords, keys = (batch.column(i).to_numpy() for i in (0, 1))
        at = count = 0
        for part_ in slices(batch.column(2), SLICE):
            at += count
            tokens = [t.split() for t in byte_texts(part_)]
            count = len(tokens)
            whole = [hashlib.sha256(b" ".join(t)).hexdigest() for t in tokens]
            nothing = pa.nulls(count)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ords[at : at + count]), pa.array(keys[at : at + count]),
                    *(nothing.cast(t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())),
                    pa.array([len(t) for t in tokens], pa.int64()), pa.array(whole),
                ],
                SEED_COLUMNS,
            )
            for values, text, begins, first in chunks(tokens, hashes):
                part, start, n, place = segments(values, begins)
                end = start + n + WINDOW - 1
                runs = [Runs(values, lane) for lane in (0, 1)]
                s1, s2 = (r.of(start, end).view(np.int64) for r in runs)
                row = at + text[part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ords[row]), pa.array(keys[row]),
                        pa.array((start - begins[part] + first[part]).astype(np.int32)), pa.array(n.astype(np.int32)),
                        pa.array(runs[0].of(place, place + SEED_WORDS).view(np.int64)),
                        pa.array(s1), pa.array((s2 >> 32).astype(np.int32)),
                        pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.string()),
                    ],
                    SEED_COLUMNS,
                )


SEED_COLUMNS = [c.split()[0] for c in SEEDS.split(", ")]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows of the wanted segments."""
    hashes = WordHashes()
    for batch in batches:
        ords, keys = (batch.column(i).to_numpy() for i in (0, 1))
        for row in range(batch.num_rows):
            wanted = batch.column(3)[row].as_py()
            if not wanted:
                continue
            tokens = [byte_texts(batch.column(2).slice(row, 1))[0].split()]
            at = np.unique(np.concatenate([np.arange(w["start"], w["start"] + w["n"]) for w in wanted]))
            for values, _, _, first in chunks(tokens, hashes):
                own = at[(at >= first[0]) & (at + WINDOW <= first[0] + len(values))]
                if not len(own):
                    continue
                at = at[at > own[-1]]
                inside = own - first[0]
                h1, h2 = (Runs(values, lane).of(inside, inside + WINDOW).view(np.int64) for lane in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(own), ords[row])), pa.array(np.full(len(own), keys[row])),
                        pa.array(own.astype(np.int32)), pa.array(h1), pa.array((h2 >> 32).astype(np.int32)),
                    ],
                    ["ord", "key", "start", "h1", "h2"],
                )


def _cutter(with_text: bool):
    """Texts without their covered words, as hashes or themselves."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept = [], [], []
            for row in range(batch.num_rows):
                words = byte_texts(batch.column("text").slice(row, 1))[0].split()
                edges = np.zeros(len(words) + 1, np.int64)
                for name in ("covered", "repeats"):
                    spans_ = batch.column(name).slice(row, 1).flatten()
                    if len(spans_):
                        start = spans_.field("start").to_numpy()
                        np.add.at(edges, start, 1)
                        np.add.at(edges, start + spans_.field("n").to_numpy() + WINDOW - 1, -1)
                stays = np.cumsum(edges[:-1]) == 0
                left = b" ".join(w for w, s in zip(words, stays.tolist(), strict=True) if s)
                sizes.append(len(words))
                gone.append(len(words) - int(stays.sum()))
                kept.append(left.decode() if with_text else hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept" if with_text else "kept_sha256"],
            )

    return cut


def grouped(rows: DataFrame, by: list[str], label: str, *more: Column) -> DataFrame:
    """by, _n, first, more: the groups of ``rows`` that hold several documents, and the smallest of these. Stored."""
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("ord").alias("first"), F.max("ord").alias("_last"), *more)
    return stored(groups.where("first < _last").drop("_last"), label)


def met(rows: DataFrame, groups: DataFrame, by: list[str], how: str) -> DataFrame:
    """``rows`` (stored) with what their group knows.

    Groups above BLOCK_ROWS rows, at most rows / BLOCK_ROWS of them, are dealt to several tasks each; their one row of
    the group table is copied as often.
    """
    deals = F.ceil(F.col("_n") / F.lit(BLOCK_ROWS)).cast("int")
    large = groups.where(F.col("_n") > BLOCK_ROWS).select(*by, deals.alias("_deals"))
    dealt = F.lit(0)
    if not large.isEmpty():
        rows = rows.join(large, by, "left")
        dealt = F.pmod(F.xxhash64("ord", "key", "start"), F.coalesce("_deals", F.lit(1))).cast("int")
    copies = groups.withColumn("_deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("_n")
    return rows.withColumn("_deal", dealt).join(copies, [*by, "_deal"], how).drop("_deal", "_deals")


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, ord, key, text: what a row is told by, and the place of its document in the order."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("ord"), F.xxhash64(text).alias("key"), text.alias("text")
    )


def spans(start: str = "start", n: Column | str = "n") -> Column:
    return F.struct(F.col(start).alias("start"), (F.col(n) if isinstance(n, str) else n).cast("int").alias("n"))


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts that hold a seed of another document, with their repeats; all rows' word counts and hashes)."""
    rows = numbered(docs)
    seeds = stored(rows.select("ord", "key", "text").mapInArrow(_seeds, SEEDS), "seeds")
    whole = seeds.where("start IS NULL").select("ord", "key", "n_words", "kept_sha256")
    seeds = seeds.where("start IS NOT NULL").select("ord", "key", "start", "n", "seed", "s1", "s2")
    several = grouped(seeds, ["seed"], "seed-groups", (F.min("s1") < F.max("s1")).alias("varied")).drop("first")
    shared = stored(met(seeds, several, ["seed"], "inner").drop("seed"), "shared-seeds")
    # a segment that no other document has is its own first: first stays null
    compared = met(shared, grouped(shared, ["s1", "s2"], "equal-segments"), ["s1", "s2"], "left")
    repeat = F.col("ord") > F.col("first")
    touched = compared.where(F.col("varied") | repeat).groupBy("ord", "key").agg(
        F.collect_list(F.when(repeat, spans())).alias("covered"),
        F.collect_list(F.when(F.coalesce(~repeat, F.lit(True)), spans())).alias("open"),
    )
    texts = stored(rows.join(touched, ["ord", "key"]), "touched-texts")
    windows = texts.where(F.size("open") > 0).select("ord", "key", "text", "open").mapInArrow(
        _windows, "ord long, key long, start int, h1 long, h2 int"
    )
    windows = stored(windows, "open-windows")
    again = met(windows, grouped(windows, ["h1", "h2"], "equal-windows"), ["h1", "h2"], "inner").where("ord > first")
    found = again.groupBy("ord", "key").agg(F.collect_list(spans("start", F.lit(1))).alias("repeats"))
    return texts.join(found, ["ord", "key"], "left"), whole


def _cut_texts(texts: DataFrame, with_text: bool) -> DataFrame:
    kind = f"doc_id long, n_words long, n_removed long, {'kept' if with_text else 'kept_sha256'} string"
    return texts.select("doc_id", "text", "covered", "repeats").mapInArrow(_cutter(with_text), kind)


def cut_out(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space) of the texts that share a seed with another
    document; the others have no repeat.
    """
    return _cut_texts(repeats(docs)[0], True)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    texts, whole = repeats(docs)
    cut = _cut_texts(texts, False)
    rest = whole.join(texts.select("ord", "key"), ["ord", "key"], "left_anti")
    doc_id = F.when(F.col("ord") < F.lit(LAST), F.col("ord")).alias("doc_id")
    return cut.unionByName(rest.select(doc_id, "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256"))


SQL = rf"""
    WITH worded AS (
        SELECT doc_id, row_number() OVER () AS row,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), starts AS (
        SELECT doc_id, row, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM (
            SELECT doc_id, row, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM worded WHERE len(w) >= {WINDOW}
        ) AS s
    ), repeats AS (
        SELECT row, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS low FROM starts) AS l WHERE doc_id > low
    ), words AS (
        SELECT doc_id, row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM worded
    ), marked AS (
        SELECT doc_id, w.row, word, w.i, count(r.i) OVER (PARTITION BY w.row ORDER BY w.i
            ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) > 0 AS gone
        FROM words AS w LEFT JOIN repeats AS r ON w.row = r.row AND w.i = r.i
    ), kept AS (
        SELECT row, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
        FROM marked GROUP BY row
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
        sha256(coalesce(kept, '')) AS kept_sha256 FROM worded LEFT JOIN kept USING (row)"""
