"""One-permutation MinHash fingerprints, in column expressions only.

A text's five-word shingles (words as they are; a text with fewer words is one shingle) are hashed once by XXH64. The
top BIN_BITS bits choose one of BINS bins, each bin keeps its smallest hash. An empty bin borrows from the bin that a
universal hash of (bin, attempt) names, attempt after attempt until that bin is not empty (optimal densification); after
ATTEMPTS attempts the rest of the sequence is the order of a hash of (bin, candidate), whose first filled bin is taken at
once. Of each bin the low BITS bits are stored, packed into hexadecimal. Two fingerprints that agree in a share m of the
bins have likeness (m - c) / (1 - c), at least 0, where c = 2**-BITS is the share that agrees by chance.

Null texts are empty. Texts without words have the empty fingerprint, which is like itself only (1, else 0). Equal texts
have equal fingerprints. Rows without doc_id are numbered first in ascending order, repeated ids by their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import BLANKS, let

WORDS = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 8
ATTEMPTS = 8
ZONES_PER_PARTITION = 4


def shingle_hashes(text: Column) -> Column:
    """XXH64 of every shingle; a word is hashed once, a shingle is the hash of its words' hashes."""

    def shingles(h: Column) -> Column:
        n = F.size(h)
        several = F.transform(
            F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WORDS)))
        )
        # the number of words goes first, so a short text's shingle is no prefix of a longer one's
        whole = F.array(F.xxhash64(F.aggregate(h, n.cast("long"), lambda a, x: F.xxhash64(a, x))))
        return F.when(n >= WORDS, several).when(n > 0, whole).otherwise(F.array().cast("array<long>"))

    words = F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), lambda w: w != "")
    return let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def bins(hashes: Column) -> Column:
    """The smallest hash of every bin, null where it is empty. Sorted hashes lie bin by bin, the smallest first."""
    place = 64 - BIN_BITS
    lowest, highest = -(BINS // 2), BINS // 2 - 1  # bins are numbered as the hashes are signed

    def number(x: Column) -> Column:
        return F.shiftright(x, place).cast("int")

    def gap(n: Column) -> Column:
        return F.array_repeat(F.lit(None).cast("long"), n)

    def spaced(new: Column) -> Column:
        before = F.transform(
            new,
            lambda x, i: F.concat(
                gap(number(x) - F.when(i == 0, F.lit(lowest - 1)).otherwise(number(F.get(new, i - 1))) - 1), F.array(x)
            ),
        )
        behind = gap(F.lit(highest) - number(F.get(new, F.size(new) - 1)))
        return F.when(F.size(new) == 0, gap(F.lit(BINS))).otherwise(F.concat(F.flatten(before), behind))

    def firsts(h: Column) -> Column:
        new = F.filter(
            F.transform(
                h, lambda x, i: F.when((i == 0) | (number(x) != number(F.get(h, i - 1))), x)
            ),
            lambda x: x.isNotNull(),
        )
        return let(new, spaced)

    return let(F.array_sort(hashes), firsts)


def densified(minima: Column) -> Column:
    """Every bin filled, or null if all are empty."""

    def borrowed(m: Column, filled: Column, i: Column) -> Column:
        tries = [
            F.get(m, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(1, ATTEMPTS + 1)
        ]
        rest = F.array_min(F.transform(filled, lambda j: F.struct(F.xxhash64(i, j, F.lit(0)).alias("h"), j.alias("j"))))
        return F.coalesce(F.get(m, i), *tries, F.get(m, rest["j"]))

    def fill(m: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.lit(BINS - 1))
        filled = F.filter(numbers, lambda j: F.get(m, j).isNotNull())
        return F.when(
            F.exists(m, lambda x: x.isNotNull()),
            let(filled, lambda f: F.transform(numbers, lambda i: borrowed(m, f, i))),
        )

    return let(minima, fill)


def low_bits(full: Column) -> Column:
    """The stored bits of each bin as small integers; empty if there are none."""
    low = F.transform(full, lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("short"))
    return F.coalesce(low, F.array().cast("array<smallint>"))


def fingerprint(text: Column) -> Column:
    return low_bits(densified(bins(shingle_hashes(text))))


def packed(low: Column) -> Column:
    digits = BITS // 4
    return F.array_join(F.transform(low, lambda x: F.lower(F.lpad(F.hex(x), digits, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles of two fingerprints, 0 to 1."""
    chance = 2.0**-BITS
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    estimate = F.greatest((same - chance) / (1.0 - chance), F.lit(0.0))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(estimate)


def with_next(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``rows`` with next_<column>: the values of the next row in descending doc_id, and of the first after the last.

    Rows go to zones of neighbouring ids, cut at quantiles, in one shuffle. The first row of the next zone also visits
    the zone before it, so no row needs another task's rows. Zones are a few per shuffle partition; their bounds and
    heads, one number each, are what the driver holds.
    """
    spark = rows.sparkSession
    zones = ZONES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.percentile_approx("doc_id", [k / zones for k in range(1, zones)], 10 * zones)
    cuts = sorted(set(rows.agg(spread).first()[0] or []))
    bounds = F.array(*map(F.lit, cuts)).cast("array<long>")
    zone = F.coalesce(F.size(F.filter(bounds, lambda c: F.col("doc_id") > c)), F.lit(0))  # null ids: below all others
    zone = F.when(F.col("doc_id").isNull(), 0).otherwise(zone)
    ids = rows.select("doc_id", zone.alias("zone"))
    heads = sorted(ids.groupBy("zone").agg(F.max("doc_id").alias("head")).collect(), key=lambda r: r["zone"])
    head, visits = [None] * (len(cuts) + 1), [None] * (len(cuts) + 1)
    for k, row in enumerate(heads):
        head[row["zone"]] = row["head"]
        visits[row["zone"]] = heads[(k + 1) % len(heads)]["zone"]  # the zone above; from the top one the lowest
    placed = rows.withColumn("zone", zone)
    is_head = F.col("doc_id").eqNullSafe(F.get(F.array(*map(F.lit, head)).cast("array<long>"), F.col("zone")))
    visited = F.when(is_head, F.get(F.array(*map(F.lit, visits)).cast("array<int>"), F.col("zone")))
    stays = F.array(
        F.struct(F.col("zone").alias("zone"), F.lit(0).alias("guest")),
        F.struct(visited.alias("zone"), F.lit(1).alias("guest")),
    )
    placed = placed.withColumn("stay", F.explode(F.filter(stays, lambda s: s["zone"].isNotNull())))
    placed = placed.select(*rows.columns, F.col("stay.zone").alias("zone"), F.col("stay.guest").alias("guest"))
    order = Window.partitionBy("zone").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    following = [F.lead(c).over(order).alias(f"next_{c}") for c in columns]
    return placed.select(*rows.columns, "guest", *following).where("guest = 0").drop("guest")


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many, or all, of the next text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they and the next document's are."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    rows = rows.withColumn("low", fingerprint(F.col("text")))
    rows = with_next(rows, ("text", "low")).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "low",
        "next_low",
        fingerprint(F.col("edited")).alias("edited_low"),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        packed(F.col("low")).alias("fingerprint"),
        packed(F.col("edited_low")).alias("edited_fingerprint"),
        likeness(F.col("low"), F.col("edited_low")).alias("near_edited"),
        likeness(F.col("low"), F.col("next_low")).alias("near_next"),
    )
