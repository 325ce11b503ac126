"""Importance resampling towards a target distribution, over hashed word and word-pair features.

Texts are lower-cased (A-Z only) and cut into words (digits, letters, anything beyond ASCII). Features are the words and
the pairs of neighbouring words; a feature's bucket is its CRC-32 modulo BUCKETS. A bucket's gain is the log ratio of its
smoothed share among the target's features to its share among all documents' features, in thousandths, floored. A
document's weight is the floored mean of its features' gains; seeded Gumbel noise is added, and the highest scores among
the documents with LEAST_WORDS words or more are drawn, so the draw follows the weights without replacement.

Arrow kernels do the work inside a task: ascii_lower, split_pattern_regex, list_flatten and dictionary_encode turn a
slice of texts into word indices; shifted indices are pairs; only distinct words and pairs are hashed; their buckets (or
gains) are taken by index and reduced over each document's segment. Tasks work on at most 4 MB of text (or one text)
at once. Counts leave a task as one row per bucket; the gains, BUCKETS numbers whatever the corpus, travel back to tasks.

Ranks: rows are range-sorted by (score, doc_id), numbered inside each range, and the ranges' sizes are summed up, so no
task sees all rows. Nulls: a null text has no words, a null doc_id draws its noise from the empty string and ties after
all others. Repeated rows are rows of their own and rank one after the other. No documents give no rows; an empty
target leaves every gain to the smoothing alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import slices, stored

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between words, after lower-casing
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of the texts, the document of each (its place in ``texts``), and the words per document.

    Words come first, then pairs; both in the order of the documents.
    """
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=GAP)
    words = pc.list_flatten(lists)
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    real = pc.greater(pc.binary_length(words), 0)
    words, owner = words.filter(real), owner[real.to_numpy(zero_copy_only=False)]
    n_words = np.bincount(owner, minlength=len(texts))
    if not len(words):
        return np.zeros(0, np.int64), owner, n_words
    coded = words.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known = [w.encode() for w in coded.dictionary.to_pylist()]
    alone = np.fromiter(map(zlib.crc32, known), np.int64, len(known)) % BUCKETS
    same = owner[1:] == owner[:-1]
    pairs = pa.array(index[:-1][same] * len(known) + index[1:][same]).dictionary_encode()
    crc = zlib.crc32
    begun = [crc(w + b" ") for w in known]
    distinct = pairs.dictionary.to_numpy(zero_copy_only=False)
    left, right = (distinct // len(known)).tolist(), (distinct % len(known)).tolist()
    joint = np.fromiter((crc(known[j], begun[i]) for i, j in zip(left, right, strict=True)), np.int64, len(distinct))
    taken = pc.take(pa.array(joint % BUCKETS), pairs.indices).to_numpy(zero_copy_only=False)
    return np.concatenate([alone[index], taken]), np.concatenate([owner, owner[1:][same]]), n_words


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in slices(batch.column(0)):
            counts += np.bincount(features(part)[0], minlength=BUCKETS)
    filled = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(counts[filled])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket, n: features of the whole table in each bucket."""
    each = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted, "bucket long, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket, one row a bucket."""
    s = bucket_counts(docs).withColumnRenamed("n", "s")
    t = bucket_counts(target).withColumnRenamed("n", "t")
    both = docs.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket")
    both = both.join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    whole = Window.partitionBy()  # BUCKETS rows
    s_all, t_all = (F.sum(c).over(whole).cast("double") + BUCKETS for c in ("s", "t"))
    ratio = (F.col("t") + 1).cast("double") * s_all / ((F.col("s") + 1).cast("double") * t_all)
    rows = both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r["bucket"]] = r["gain"]
    return out


def segment_sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values of each owner 0..n-1; owners ascend."""
    ends = np.searchsorted(owner, np.arange(n), side="right")
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[np.concatenate([[0], ends])])


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, weight, n_words of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                bucket, owner, words = features(part)
                n_pairs = np.maximum(words - 1, 0)
                cut = int(words.sum())
                value = gain[bucket]
                total = segment_sums(value[:cut], owner[:cut], len(part))
                total += segment_sums(value[cut:], owner[cut:], len(part))
                n = words + n_pairs
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                ids = batch.column(0).slice(at, len(part))
                at += len(part)
                columns = [ids, *(pa.array(c.astype(np.int64)) for c in (n, weight, words))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_features", "weight", "n_words"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_features long, weight long, n_words long")


def gumbel(doc_id: Column) -> Column:
    """Seeded noise in thousandths, floored."""
    key = F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``rank`` 1, 2, 3... of the drawn rows in the order of score, the rest null; scored: a stored table."""
    spark = scored.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    enough = (F.col("n_words") >= LEAST_WORDS).alias("enough")
    order = [F.desc("enough"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")]
    rows = scored.select("*", enough, F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), "draw-order")
    part = F.shiftrightunsigned("place", 33).alias("part")
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("enough").cast("long")).alias("able"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = sizes.select(
        "part",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"),
        F.floor(F.sum("able").over(Window.partitionBy()) * F.lit(percent) / F.lit(100)).cast("long").alias("drawn"),
    )
    numbered = rows.withColumn("part", part).join(F.broadcast(starts), "part")  # as many rows as ranges
    rank = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.select(
        "doc_id", "n_features", "weight", "score", F.when(rank <= F.col("drawn"), rank).alias("rank")
    )


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; ``target`` has a column text."""
    rows = weighed(docs, gains(docs, target))
    scored = stored(rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"))), "draw-scores")
    return ranked(scored, percent)


# CRC-32 by its table, which a rule builds, over the bytes of distinct features.
SQL = rf"""
    WITH crc_table AS (
        SELECT list(list_reduce(range(8), lambda c, k:
                    CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, n) ORDER BY n) AS t
        FROM range(256) AS r(n)
    ), texts AS (
        SELECT true AS own, doc_id, text FROM documents UNION ALL SELECT false, NULL, text FROM benchmark
    ), worded AS (
        SELECT own, doc_id, row_number() OVER () AS row, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
    ), counted AS (
        SELECT own, row, f, count(*) AS k FROM (
            SELECT own, row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM worded
        ) AS e GROUP BY own, row, f
    ), hashed AS (
        SELECT f, xor(4294967295, list_reduce(
            list_transform(range(0, length(x), 2), lambda i: ('0x' || x[i + 1:i + 2])::BIGINT),
            lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT)) % {BUCKETS} AS bucket
        FROM (SELECT f, hex(encode(f)) AS x FROM counted GROUP BY f) AS d, crc_table
    ), buckets AS (
        SELECT bucket, coalesce(sum(k) FILTER (own), 0)::BIGINT AS s, coalesce(sum(k) FILTER (NOT own), 0)::BIGINT AS t
        FROM counted JOIN hashed USING (f) GROUP BY bucket
    ), gain AS (
        SELECT bucket, floor(1000.0::DOUBLE * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE
            / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM buckets
    ), weights AS (
        SELECT row, sum(k)::BIGINT AS n_features, floor(sum(k * gain)::DOUBLE / sum(k)::DOUBLE)::BIGINT AS weight
        FROM counted JOIN hashed USING (f) JOIN gain USING (bucket) WHERE own GROUP BY row
    ), scored AS (
        SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
            + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
            / 4294967296.0::DOUBLE)))::BIGINT AS score, len(w) >= {LEAST_WORDS} AS enough
        FROM worded LEFT JOIN weights USING (row) WHERE own
    )
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM (
        SELECT *, row_number() OVER (ORDER BY enough DESC, score DESC, doc_id) AS place,
            floor({PERCENT} * count(*) FILTER (enough) OVER () / 100)::BIGINT AS drawn FROM scored
    ) AS p"""
