"""Vocabulary, encoding, chunks, blocks and padded batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.functions.arrays import FIRST_WORD_ID, PAD_ID, UNKNOWN_ID, pad_to
from corpusloom.functions.hashing import bucket, seeded_hash
from corpusloom.functions.text import strip
from corpusloom.operators.blocks import in_order
from corpusloom.session import cut_lineage

CHUNK_SIZE = 128
CHUNK_STRIDE = 64
MIN_CHUNKS = 2
SHARD_ROWS = 100_000
PIECE_BYTES = 1 << 20  # text that a Python worker splits at once
ID_BYTES = 8  # about what an id's word takes
CHUNK_BYTES = 4 << 20  # texts, or ids, that ask a vocabulary table together

# A list of words travels to every task, so its size is bounded here and checked in ``vocabulary_words``. Larger
# vocabularies stay tables: ``encode_join`` and ``decode_join``.
MAX_VOCABULARY = 262_144


def vocabulary(df: DataFrame, text: str, k: int) -> DataFrame:
    """The ``k`` most frequent words (ties by word) with ids: (token_id, word, n)."""
    if k <= 0:
        raise ValueError("a vocabulary holds a word at least")
    counted = df.select(strip(text).alias("_text")).mapInArrow(_word_counts, "word string, n long")
    counted = counted.groupBy("word").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("word")]
    if k <= MAX_VOCABULARY:  # the rows that Spark keeps per task and merges fit anywhere
        placed = counted.orderBy(*order).limit(k).withColumn("_place", F.row_number().over(Window.orderBy(*order)) - 1)
    else:
        placed = in_order(cut_lineage(counted, "word-counts"), order, "_place").filter(F.col("_place") < k)
    return placed.select((F.col("_place") + FIRST_WORD_ID).cast("int").alias("token_id"), "word", "n")


def vocabulary_words(vocab: DataFrame) -> list[str]:
    rows = vocab.select("token_id", "word").take(MAX_VOCABULARY + 1)
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary holds at most {MAX_VOCABULARY} words")
    return [r["word"] for r in sorted(rows, key=lambda r: r["token_id"])]


def _relist(lists: pa.Array, values: pa.Array) -> pa.Array:
    """Lists of the same lengths as ``lists`` around new values."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    ends = pc.cumulative_sum(pc.cast(lengths, pa.int32()))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cast(ends, pa.int32())])
    return pa.ListArray.from_arrays(offsets, values)


def _pieces(batch: pa.Array) -> Iterator[pa.Array]:
    """A batch of texts, or of lists of ids, in runs of rows of up to PIECE_BYTES, a longer row by itself: what is made
    of a run, several times its size, stays small whatever rows Spark put into the batch."""
    listed = pa.types.is_list(batch.type)
    sizes = pc.multiply(pc.list_value_length(batch), ID_BYTES) if listed else pc.binary_length(batch)
    ends = pc.cumulative_sum(pc.cast(pc.fill_null(sizes, 0), pa.int64())).to_numpy()
    start = 0
    while start < len(batch):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(ends.searchsorted(before + PIECE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _split(texts: pa.Array) -> pa.Array:
    """Words of stripped texts, as ``functions.text.words`` splits them; a null or an empty text has none."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.string()))
    words = lists.flatten()
    blank = pc.fill_null(pc.equal(texts, ""), False)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy() - blank.to_numpy(zero_copy_only=False)
    offsets = pa.array([0, *lengths.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, words.filter(pc.not_equal(words, "")))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of stripped texts, a row per word and piece."""
    for batch in batches:
        for piece in _pieces(batch.column(0)):
            counts = pc.value_counts(_split(piece).flatten())
            yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], names=["word", "n"])
        pa.default_memory_pool().release_unused()


def word_ids(vocab: list[str]) -> Callable[[Column], Column]:
    """Stripped text -> ids, split and looked up by pieces of Arrow batches; a word outside the vocabulary is unknown."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pa.array(vocab, pa.string())
        for batch in batches:
            for piece in _pieces(batch):
                lists = _split(piece)
                found = pc.index_in(lists.flatten(), value_set=known)
                yield _relist(lists, pc.fill_null(pc.add(found, FIRST_WORD_ID), UNKNOWN_ID).cast(pa.int32()))
            pa.default_memory_pool().release_unused()

    return ids


def id_words(vocab: list[str], unknown: str = "<unk>") -> Callable[[Column], Column]:
    """ids -> words; special ids other than 'unknown' become null."""

    @F.arrow_udf("array<string>")
    def spelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = pa.array([None] * UNKNOWN_ID + [unknown] + vocab, pa.string())
        for batch in batches:
            for piece in _pieces(batch):
                yield _relist(piece, table.take(piece.flatten()))
            pa.default_memory_pool().release_unused()

    return spelled


def tokenizer_ids(load: Callable[[], Callable[[str], list[int]]]) -> Callable[[Column], Column]:
    """text -> ids by any tokenizer; ``load`` runs once per task."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode_text = load()
        for batch in batches:
            yield pa.array([encode_text(t or "") for t in batch.to_pylist()], pa.list_(pa.int32()))

    return ids


def encode(df: DataFrame, text: str, vocab: list[str], out: str = "tokens") -> DataFrame:
    return df.withColumn(out, word_ids(vocab)(strip(text)))


def decode(df: DataFrame, tokens: str, vocab: list[str], out: str = "text", task: str | None = None) -> DataFrame:
    """Words joined by a space, special marks left out; stripped where the task is code."""
    spelled = df.withColumn("_words", id_words(vocab)(F.col(tokens)))
    joined = F.array_join("_words", " ")
    if task:
        joined = F.when(F.col(task) == "code", strip(joined)).otherwise(joined)
    return spelled.withColumn(out, joined).drop("_words")


def _answered(
    df: DataFrame, id_col: str, value: Column, n_bytes: Column, items: Callable[[pa.Array], pa.Array], table: DataFrame
) -> DataFrame:
    """(id, answers): each item of a row's value replaced by what the table (_item, _answer) says, null if nothing.

    Rows are dealt to chunks of about CHUNK_BYTES by the hash of their id. A chunk asks once for each distinct item, so
    a word that is everywhere costs a row per chunk at the table, and the answers meet their chunk's rows as one group:
    neither words nor places are rows of a shuffle.
    """
    types = {c: table.schema[c].dataType for c in ("_item", "_answer")}
    rows = cut_lineage(df.select(F.col(id_col).alias("_id"), value.alias("_value"), n_bytes.alias("_bytes")), "asking")
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    chunks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / CHUNK_BYTES))
    chunked = rows.select(F.pmod(F.xxhash64("_id"), F.lit(chunks)).alias("_chunk"), "_id", "_value")
    answer_type = to_arrow_type(types["_answer"])

    def ask(group: pa.Table) -> pa.Table:
        asked = pc.unique(items(_column(group, "_value")).flatten()).drop_null()
        return pa.table({"_chunk": pa.repeat(group["_chunk"][0], len(asked)), "_item": asked})

    def answer(group: pa.Table, told: pa.Table) -> pa.Table:
        lists = items(_column(group, "_value"))
        wanted = lists.flatten()
        if told.num_rows:
            found = _column(told, "_answer").take(pc.index_in(wanted, value_set=_column(told, "_item")))
        else:
            found = pa.nulls(len(wanted), answer_type)
        return pa.table({"_id": group["_id"], "_answers": _relist(lists, found)})

    asked = chunked.groupBy("_chunk").applyInArrow(ask, f"_chunk long, _item {types['_item'].simpleString()}")
    told = asked.join(table, "_item").select("_chunk", "_item", "_answer")
    answered = chunked.groupBy("_chunk").cogroup(told.groupBy("_chunk"))
    answered = answered.applyInArrow(answer, f"_id {rows.schema['_id'].dataType.simpleString()}, _answers array<{types['_answer'].simpleString()}>")
    return answered.withColumnRenamed("_id", id_col)


def _column(table: pa.Table, name: str) -> pa.Array:
    """A column of a group as one array of its own."""
    chunks = table[name].chunks
    return pa.concat_arrays(chunks) if chunks else pa.array([], table[name].type)


def encode_join(df: DataFrame, id_col: str, text: str, vocab: DataFrame, out: str = "tokens") -> DataFrame:
    """(id, tokens): ``encode`` with a vocabulary of any size, by joins. ``id_col`` is unique and not null."""
    table = vocab.select(F.col("word").alias("_item"), F.col("token_id").cast("int").alias("_answer"))
    stripped = strip(text)
    rows = _answered(df, id_col, stripped, F.octet_length(stripped), _split, table)
    ids = F.transform("_answers", lambda answer: F.coalesce(answer, F.lit(UNKNOWN_ID)))
    return rows.select(id_col, ids.alias(out))


def decode_join(
    df: DataFrame, id_col: str, tokens: str, vocab: DataFrame, out: str = "text", unknown: str = "<unk>"
) -> DataFrame:
    """(id, text): ``decode`` with a vocabulary of any size, by joins. ``id_col`` is unique and not null."""
    table = vocab.select(F.col("token_id").cast("int").alias("_item"), F.col("word").alias("_answer"))
    special = vocab.sparkSession.range(1).select(F.lit(UNKNOWN_ID).alias("_item"), F.lit(unknown).alias("_answer"))
    table = table.filter(F.col("_item") != UNKNOWN_ID).unionAll(special)
    ids = F.col(tokens).cast("array<int>")
    rows = _answered(df, id_col, ids, F.lit(ID_BYTES) * F.greatest(F.size(ids), F.lit(0)), lambda lists: lists, table)
    return rows.select(id_col, F.array_join("_answers", " ").alias(out))


def chunk_tokens(
    df: DataFrame,
    tokens: str = "tokens",
    size: int = CHUNK_SIZE,
    stride: int = CHUNK_STRIDE,
    min_chunks: int = MIN_CHUNKS,
    pad_id: int = PAD_ID,
) -> DataFrame:
    """One row per overlapping window of ``size`` tokens, ``stride`` apart, the last ones padded."""
    if size <= 0 or stride <= 0 or min_chunks <= 0:
        raise ValueError("size, stride and min_chunks must be positive")
    effective = F.greatest(F.size(tokens), F.lit(size + (min_chunks - 1) * stride))
    steps = ((effective - size + (stride - 1)) / stride).cast("int") + 1
    count = F.greatest(steps, F.lit(min_chunks))
    numbered = df.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), count - 1)))
    window = F.slice(F.col(tokens), F.col("chunk_no") * stride + 1, size)
    return numbered.withColumn(tokens, pad_to(window, size, pad_id))


def token_blocks(df: DataFrame, tokens: str = "tokens", size: int = CHUNK_SIZE) -> DataFrame:
    """One row per token with the number of its block and its position inside the block."""
    if size <= 0:
        raise ValueError("size must be positive")
    rest = [c for c in df.columns if c != tokens]
    rows = df.select(*rest, F.posexplode(tokens).alias("_at", "token"))
    return rows.select(
        *rest, F.expr(f"int(_at div {size})").alias("block_no"), (F.col("_at") % size).alias("pos"), "token"
    )


def next_token_pairs(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Inputs without the last token, labels without the first."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return df.withColumn("inputs", F.slice(F.col(tokens), F.lit(1), n)).withColumn(
        "labels", F.slice(F.col(tokens), F.lit(2), n)
    )


def shard_digits(n_rows: int, rows_per_shard: int = SHARD_ROWS) -> int:
    """Hex digits of the hash that give shards of at most about ``rows_per_shard`` rows."""
    return max(1, math.ceil(math.log(max(n_rows / rows_per_shard, 1), 16)))


def padded_batches(
    df: DataFrame, id_col: str, tokens: str = "tokens", batch_size: int = 16, digits: int = 2, pad_id: int = PAD_ID
) -> DataFrame:
    """Group rows into batches of ``batch_size`` and pad their tokens to the longest of the batch.

    Rows are dealt to 16**digits shards by the hash of their id and are ordered inside their shard only, so a
    shard is one task's work whatever the data; see ``shard_digits``. A shard's last batch may be short.
    """
    shard = Window.partitionBy("shard").orderBy(id_col)
    batch = Window.partitionBy("shard", "batch_no")
    return (
        df.withColumn("shard", bucket(seeded_hash(id_col), digits))
        .withColumn("_place", F.row_number().over(shard) - 1)
        .withColumn("batch_no", F.expr(f"int(_place div {int(batch_size)})"))
        .withColumn("pos", F.col("_place") % batch_size)
        .withColumn("n_tokens", F.size(tokens))
        .withColumn("width", F.max("n_tokens").over(batch))
        .withColumn(tokens, pad_to(tokens, F.col("width"), pad_id))
        .drop("_place")
    )


def consecutive_batches(
    df: DataFrame, id_col: str, tokens: str = "tokens", batch_size: int = 16, pad_id: int = PAD_ID
) -> DataFrame:
    """Batches of ``batch_size`` rows in the order of their ids, padded to the longest: all but the last one are full.

    Rows are numbered over counted ranges (``blocks.in_order``), so the work is cut as the data grows and a batch
    may span two ranges.
    """
    rows = in_order(df.withColumn("n_tokens", F.size(tokens)), [F.asc(id_col)], "_place", "batches")
    batch = Window.partitionBy("batch_no")
    return (
        rows.withColumn("batch_no", F.expr(f"_place div {int(batch_size)}"))
        .withColumn("pos", (F.col("_place") % batch_size).cast("int"))
        .withColumn("width", F.max("n_tokens").over(batch))
        .withColumn(tokens, pad_to(tokens, F.col("width"), pad_id))
        .drop("_place")
    )
