"""Mixing sources to target weights along a curriculum that changes over training.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words; a target stops
at twice its source's words and the excess is shared again by weight. Documents of a source pass in a seeded order,
floor(target / words) whole passes and part of one more, which ends nearest to the target.

Curriculum: the rate of a source at time t of training (0 to 1) is proportional to 1 + ramp * (2 t - 1); its integral is
the source's cumulative demand. A copy whose middle word is the q-th share of what its source gives is due at the time
the demand reaches q. Rows are range-sorted by that position.

Order within a source is md5 of the seed and doc_id, then size, so reruns agree. Null texts and texts without words have
size 0 and are never taken; null doc_ids and repeated rows count as rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import SQL_WORD, WORD, stored

WEIGHTS = (3, 1, 2)
RAMPS = (0.5, 0.0, -0.5)
SHARE = 1.5
MOST = 2
SEED = 42
BUCKET_DIGITS = 3  # 4,096 buckets of a source: prefix sums over buckets, then inside each


def _cycled(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size and the seeded order of every row."""
    key = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
        F.substring(key, 1, BUCKET_DIGITS).alias("bucket"),
        *more,
    )


def targets(sizes: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per source: source, source_size, ramp, target. Only this table, a row per source, is ranked as a whole."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("source_size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(by_name))
    per = per.select(
        "source",
        "source_size",
        _cycled(WEIGHTS, F.col("rank")).cast("double").alias("weight"),
        _cycled(RAMPS, F.col("rank")).cast("double").alias("ramp"),
        (F.col("source_size") * F.lit(MOST)).cast("double").alias("most"),
    )
    # sources fill up in the order of most / weight: the level is the first one that leaves its own source unfilled
    up = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    per = per.select(
        "*",
        F.row_number().over(up).alias("nth"),
        (
            (
                F.sum("source_size").over(whole).cast("double") * F.lit(float(share))
                - F.coalesce(F.sum("most").over(before), F.lit(0.0))
            )
            / F.sum("weight").over(after)
        ).alias("level"),
    )
    per = per.withColumn(
        "first", F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("nth"))).over(whole)
    )
    level = F.max(F.when(F.col("nth") == F.col("first"), F.col("level"))).over(whole)
    return per.withColumn("chosen", level).select(
        "source",
        "source_size",
        "ramp",
        F.when(F.col("nth") < F.col("first"), F.col("most"))
        .otherwise(F.least(F.col("chosen") * F.col("weight"), F.col("most")))
        .alias("target"),
    )


def due(q: Column, ramp: Column) -> Column:
    """Time at which the integral (1 - ramp) t + ramp t^2 of the rate reaches q."""
    flat = F.lit(1.0) - ramp
    return F.lit(2.0) * q / (flat + F.sqrt(flat * flat + F.lit(4.0) * ramp * q))


def mix(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and the positions of the first and the last copy, for every row.

    Prefix sums go over the buckets of each source (at most 4,096 rows) and then inside each bucket, so a source with a
    third of all rows is spread like any other.
    """
    rows = stored(sized(docs, *more), "sizes")
    blocks = rows.groupBy("source", "bucket").agg(F.sum("size").alias("block_size"))
    sums = blocks.groupBy("source").agg(F.sum("block_size").alias("source_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before_block", F.coalesce(F.sum("block_size").over(earlier), F.lit(0)))
    per = targets(sums).withColumnRenamed("source", "of")
    blocks = blocks.join(per, F.col("source").eqNullSafe(F.col("of"))).select(
        F.coalesce("source", F.lit("")).alias("b_source"),
        F.col("source").isNull().alias("b_null"),
        F.col("bucket").alias("b_bucket"),
        "before_block",
        "source_size",
        "ramp",
        "target",
    )
    rows = rows.withColumn("b_source", F.coalesce("source", F.lit(""))).withColumn("b_null", F.col("source").isNull())
    rows = rows.withColumnRenamed("bucket", "b_bucket").join(blocks, ["b_source", "b_null", "b_bucket"])
    inside = Window.partitionBy("b_source", "b_null", "b_bucket").orderBy("key", "doc_id", "size")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", F.col("before_block") + before)
    words, target = F.col("source_size").cast("double"), F.col("target")
    passes = F.when(F.col("source_size") > 0, F.floor(target / words)).otherwise(0).cast("long")
    rest = target - passes.cast("double") * words
    more_ = (F.col("before") * 2 + F.col("size")).cast("double") <= rest * F.lit(2.0)
    copies = F.when(F.col("size") > 0, passes + F.when(more_, 1).otherwise(0)).otherwise(0).cast("long")
    q = (F.col("before").cast("double") + F.col("size").cast("double") / F.lit(2.0)) / target
    last = q + (F.col("copies") - 1).cast("double") * words / target
    rows = rows.withColumn("copies", copies)
    return rows.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
        F.when(F.col("copies") > 0, F.round(due(F.least(q, F.lit(1.0)), F.col("ramp")), 9)).alias("position"),
        F.when(F.col("copies") > 0, F.round(due(F.least(last, F.lit(1.0)), F.col("ramp")), 9)).alias("last_position"),
        "before",
        "ramp",
        *more,
    )


RESULT = ("doc_id", "size", "source_size", "target", "taken", "copies", "position", "last_position")


def in_order(docs: DataFrame) -> DataFrame:
    """The result columns of every row, range-sorted by the position of the first copy; rows that are not taken come last.

    MOST bounds the copies of a row by two, so the first and the last position are all of them.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_last("position"), F.asc_nulls_last("doc_id")]
    rows = stored(mix(docs).select(*RESULT), "mix")
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def training_order(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, a row for each copy the mix takes, range-sorted by position in training.

    Rows travel once, with their text, to the bucket of their source and once more to their place in the order.
    """
    columns = list(docs.columns)
    row = F.struct(*(docs[f"`{c}`"] for c in columns)).alias("whole_row")
    wide = docs.select(docs["doc_id"], docs["source"], docs["text"], row)
    mixed = mix(wide, "whole_row").where("copies > 0")
    middle = F.col("before").cast("double") + F.col("size").cast("double") / F.lit(2.0)
    copies = mixed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    q = (F.col("copy") * F.col("source_size") + middle) / F.col("target")
    at = due(F.least(q, F.lit(1.0)), F.col("ramp"))
    placed = copies.select("whole_row", at.alias("at"), F.col("doc_id").alias("tie"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, "at", "tie").sortWithinPartitions("at", "tie")
    return ordered.select(*(F.col("whole_row").getField(c).alias(c) for c in columns))


SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{SQL_WORD}')), 0)::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
         CASE (rk - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS ramp,
         (2 * source_size)::DOUBLE AS most FROM per),
ranked AS (
  SELECT *, row_number() OVER up AS nth,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (
            ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW up AS (ORDER BY most / w, source NULLS LAST)),
chosen AS (SELECT min(nth) AS first, min_by(level, nth) AS level FROM ranked WHERE level <= most / w),
targets AS (
  SELECT r.source, r.source_size, r.ramp,
         CASE WHEN r.nth < c.first THEN r.most ELSE least(c.level * r.w, r.most) END AS target
  FROM ranked r, chosen c),
placed AS (
  SELECT s.*, t.source_size, t.ramp, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST, s.size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size::DOUBLE)::BIGINT ELSE 0 END AS passes
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE passes + CASE WHEN (before * 2 + size)::DOUBLE
            <= (target - passes::DOUBLE * source_size::DOUBLE) * 2.0::DOUBLE THEN 1 ELSE 0 END END AS copies
  FROM placed),
due AS (
  SELECT *, least((before::DOUBLE + size::DOUBLE / 2.0::DOUBLE) / target, 1.0::DOUBLE) AS q,
         1.0::DOUBLE - ramp AS flat FROM counted)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies,
       CASE WHEN copies > 0 THEN round(2.0::DOUBLE * q / (flat + sqrt(flat * flat + 4.0::DOUBLE * ramp * q)), 9) END
         AS position,
       CASE WHEN copies > 0 THEN round(2.0::DOUBLE * r / (flat + sqrt(flat * flat + 4.0::DOUBLE * ramp * r)), 9) END
         AS last_position
FROM (SELECT *, least((before::DOUBLE + size::DOUBLE / 2.0::DOUBLE) / target
                      + (copies - 1)::DOUBLE * source_size::DOUBLE / target, 1.0::DOUBLE) AS r FROM due) AS d
"""
