"""Seeded samples, first-N and exact splits without sorting the data.

A wanted position is found on the id column alone: the rows are counted per bucket (at most 16**BUCKET_DIGITS
buckets of a hash, or of a value range), the counts tell the bucket that holds the position, and only the ids of
that bucket are ranked. The cut found this way then filters or labels the full rows where they are, so the rows
themselves are never sorted or shuffled beyond those that are returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.hashing import SEED, bucket, in_share, seeded_hash

TEST_SHARE = 0.2
VALIDATION_SHARE = 0.25
LOWER = "_lower"
LAST_BUCKET = "g"  # sorts after every hex digit
N_RANGES = 65_536


def _cumulated(buckets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Running row counts over the bucket counts of each group."""
    order = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = buckets.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    return counts.withColumn("_upto", F.sum("_n").over(order))


def _last_bucket(n: int) -> Column:
    """The bucket that holds the n-th row, or one behind all others where there are fewer rows."""
    return F.coalesce(F.min(F.when(F.col("_upto") >= n, F.col("_bucket"))), F.lit(LAST_BUCKET))


def _place(id_col: str, seed: int) -> Column:
    """A row's place in seeded order."""
    return F.struct(seeded_hash(id_col, seed).alias("_hash"), F.col(id_col).alias("_id"))


def sample_seeded(df: DataFrame, id_col: str, n: int, seed: int = SEED) -> DataFrame:
    """The first min(n, rows) rows in seeded order, by unique ids; the rows themselves stay where they are, unsorted.

    Two small jobs on the ids find where to cut.
    """
    ids = df.select(_place(id_col, seed).alias("_place"), bucket(seeded_hash(id_col, seed)).alias("_bucket"))
    last = _cumulated(ids.select("_bucket")).agg(_last_bucket(n)).first()[0]
    first = ids.filter(F.col("_bucket") <= last).orderBy("_place").limit(n)
    cut = first.agg(F.max("_place")).first()[0]
    if cut is None:
        return df.limit(0)
    hashed = seeded_hash(id_col, seed)
    inside = (hashed < cut["_hash"]) | ((hashed == cut["_hash"]) & (F.col(id_col) <= F.lit(cut["_id"])))
    return df.filter(inside)


def sample_per_group(
    df: DataFrame, group: str, groups: Sequence[str], id_col: str, cap: int, seed: int = SEED
) -> DataFrame:
    """The first min(cap, rows) rows in seeded order of each of the listed groups."""
    rows = df.filter(F.col(group).isin(list(groups)))
    ids = rows.select(
        group, _place(id_col, seed).alias("_place"), bucket(seeded_hash(id_col, seed)).alias("_bucket")
    )
    # Both broadcasts have one row per listed group.
    last = _cumulated(ids.select(group, "_bucket"), [group]).groupBy(group).agg(_last_bucket(cap).alias("_last"))
    near = ids.join(F.broadcast(last), group).filter(F.col("_bucket") <= F.col("_last"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_place"))
    first = near.withColumn("_rank", rank).filter(F.col("_rank") <= cap)
    cuts = first.groupBy(group).agg(F.max("_place").alias("_cut"))
    return rows.join(F.broadcast(cuts), group).filter(_place(id_col, seed) <= F.col("_cut")).drop("_cut")


def first_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest values of the unique, numeric column ``order``.

    Three small jobs on that column find the n-th value; as a literal filter on the full rows it lets the scan
    skip row groups by their statistics. The rows stay where they are, unsorted.
    """
    ids = df.select(F.col(order).alias("_id")).filter(F.col("_id").isNotNull())
    low, high = ids.agg(F.min("_id"), F.max("_id")).first()
    if low is None or n <= 0:
        return df.limit(0)
    ranges = F.width_bucket(F.col("_id").cast("double"), F.lit(float(low)), F.lit(float(high) + 1), F.lit(N_RANGES))
    counted = ids.groupBy(ranges.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_high"))
    upto = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    bound = counted.withColumn("_upto", upto).agg(F.min(F.when(F.col("_upto") >= n, F.col("_high")))).first()[0]
    if bound is None:  # fewer than n rows
        return df.filter(F.col(order).isNotNull())
    cut = ids.filter(F.col("_id") <= F.lit(bound)).orderBy("_id").limit(n).agg(F.max("_id")).first()[0]
    return df.filter(F.col(order) <= F.lit(cut))


def take_first(df: DataFrame, predicate, order: str, n: int = 1_000) -> DataFrame:
    """First ``n`` rows that satisfy the predicate; fewer where there are fewer."""
    return first_n(df.filter(predicate), order, n)


def split_hash(
    df: DataFrame,
    key: str,
    test: float = TEST_SHARE,
    validation: float = VALIDATION_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """Label rows train/val/test by their key's hash: no shuffle, all rows of a key together, sizes approximate."""
    hashed = seeded_hash(key, seed)
    return df.withColumn(
        "split",
        F.when(in_share(hashed, test), "test")
        .when(in_share(hashed, test + (1 - test) * validation), "val")
        .otherwise("train"),
    )


def split_exact(
    df: DataFrame,
    id_col: str,
    test: float = TEST_SHARE,
    validation: float = VALIDATION_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """Label rows train/val/test with exact sizes: test = ceil(test * n), then val = ceil(validation * rest)."""
    ids = df.select(_place(id_col, seed).alias("_at"), bucket(seeded_hash(id_col, seed)).alias("_bucket"))
    counts = _cumulated(ids.select("_bucket")).withColumn("_total", F.sum("_n").over(Window.partitionBy()))
    n_test = F.ceil(F.col("_total") * F.lit(test))
    n_validation = F.ceil((F.col("_total") - n_test) * F.lit(validation))
    ends = F.array(
        F.struct(F.lit("test").alias("_cut"), n_test.alias("_end")),
        F.struct(F.lit("val").alias("_cut"), (n_test + n_validation).alias("_end")),
    )
    wanted = (
        counts.select("_bucket", "_n", "_upto", F.inline(ends))
        .filter((F.col("_end") > F.col("_upto") - F.col("_n")) & (F.col("_end") <= F.col("_upto")))
        .select("_bucket", "_cut", (F.col("_end") - F.col("_upto") + F.col("_n")).alias("_place"))
    )
    # ``wanted`` has two rows, so this joins two buckets' ids at most.
    rank = F.row_number().over(Window.partitionBy("_cut").orderBy("_at"))
    found = (
        ids.join(F.broadcast(wanted), "_bucket").withColumn("_rank", rank).filter(F.col("_rank") == F.col("_place"))
    )
    cuts = found.agg(
        F.max(F.when(F.col("_cut") == "test", F.col("_at"))).alias("test"),
        F.max(F.when(F.col("_cut") == "val", F.col("_at"))).alias("val"),
    )
    here = _place(id_col, seed)
    return df.withColumn(
        "split",
        F.when(here <= cuts.select("test").scalar(), "test")
        .when(here <= cuts.select("val").scalar(), "val")
        .otherwise("train"),
    )


def split_threads(samples: DataFrame, id_col: str, root: str, leaky: bool = False, **options) -> DataFrame:
    """Split thread samples by their root, so no thread lies in two splits; ``leaky`` splits single samples."""
    return split_hash(samples, id_col if leaky else root, **options)


def with_lower(df: DataFrame, column: str) -> DataFrame:
    """Add the column in lower case at ingest, so that later filters on it reach the scan."""
    return df.withColumn(f"{column}{LOWER}", F.lower(column))


def where_ci(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Case-insensitive equality; no value, no filter. Uses the lower-case column where the table has one."""
    if not value:
        return df
    stored = f"{column}{LOWER}"
    return df.filter((F.col(stored) if stored in df.columns else F.lower(column)) == value.lower())
