"""Ordered work on groups of any size.

A window over a whole group runs in one task, so a group with a third of all rows would stop the job. Here a
group of more than ``block_rows`` rows is cut into blocks at quantiles of its order column, whatever the order's
values and gaps: a count per group finds the large groups, a map-side combined quantile sketch finds their cuts,
and a block that is still too large is cut again. Groups at or below ``block_rows`` are one block and cost
the count only. Each block is summarised with an ordinary (map-side combined) aggregate, the few summaries (about
rows / ``block_rows`` of a group) are folded per group, and the fold is joined back as the block's starting state.
Only (group, block) is ever one task's work.

The order is a number, date or time. Rows of a group that tie in it stay in one block, so a block exceeds
``block_rows`` only where that many rows tie.

The group columns are packed into one struct: a struct of nulls equals another, so a plain equi join treats null
groups as a grouping does and shares the hash partitioning of the windows. Windows inside a block come before
the join, whose sort order they then already have: one shuffle and one sort of the rows in all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corpusloom.session import cut_lineage

KEY = "_key"
BLOCK = "_block"
BLOCK_ROWS = 65_536
FILL = 0.75  # share of block_rows that the cuts aim at
FAN_OUT = 4_096  # parts a block is cut into at once, at most
MARKS = 4  # quantiles per part of the largest block
SKETCH_ACCURACY = 10_000


def with_block(df: DataFrame, keys: Sequence[str], order: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the group and block columns; a row without an order has no place in its group and is an error.

    Blocks are numbered in the order of their rows. The counts run as jobs when this is called; the cuts are
    written to the work folder, so that all uses of the result see the same ones.
    """
    key = F.struct(*keys) if keys else F.lit(0)
    refused = F.raise_error(F.lit(f"column {order} orders the rows and must not be null")).cast("bigint")
    rows = df.withColumns({KEY: key, BLOCK: F.when(F.col(order).isNull(), refused).otherwise(F.lit(0).cast("bigint"))})
    while True:
        large = cut_lineage(_large_blocks(rows, order, block_rows), "large-blocks")
        if large.isEmpty():
            return rows
        cuts = cut_lineage(_cuts(rows, large, order, block_rows), "block-cuts")
        inner = F.when(F.col("_cuts").isNotNull(), _passed("_cuts", F.col(order))).otherwise(0)
        rows = rows.join(cuts, [KEY, BLOCK], "left")
        rows = rows.withColumn(BLOCK, F.col(BLOCK) * FAN_OUT + inner).drop("_cuts").select(*df.columns, KEY, BLOCK)


def _large_blocks(rows: DataFrame, order: str, block_rows: int) -> DataFrame:
    """Blocks above ``block_rows`` that can be cut: their rows do not all tie."""
    sizes = rows.groupBy(KEY, BLOCK).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_low"), F.max(order).alias("_high")
    )
    return sizes.filter((F.col("_n") > block_rows) & (F.col("_low") < F.col("_high")))


def _passed(cuts: str, at: Column) -> Column:
    """How many of the rising cuts are at or below a value, by halving: a row looks at a dozen of them, not at all."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((FAN_OUT - 1).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda n, step: n + F.when(F.get(F.col(cuts), n + step - 1) <= at, step).otherwise(0)
    )


def _cuts(rows: DataFrame, large: DataFrame, order: str, block_rows: int) -> DataFrame:
    """Per large block: the first order of each of its parts but the first, at most FAN_OUT - 1 of them.

    The sketch has as many quantiles, and is as fine, as the largest block's parts ask for, so one round is enough but
    for ties and blocks of more than FAN_OUT parts. A block where hardly any row exceeds the lowest loses the ties.
    """
    wanted = F.ceil(F.col("_n") / F.lit(FILL * block_rows))  # room for the sketch's error
    fan = int(large.agg(F.least(F.lit(FAN_OUT), F.max(wanted))).first()[0])
    marks = MARKS * fan
    shares = F.expr(f"array({', '.join(f'{i / marks}D' for i in range(1, marks))})")
    sketch = F.percentile_approx(order, shares, max(SKETCH_ACCURACY, 4 * marks))
    above = F.min(F.when(F.col(order) > F.col("_low"), F.col(order)))
    sketched = rows.join(large, [KEY, BLOCK]).groupBy(KEY, BLOCK, "_n", "_low").agg(sketch.alias("_marks"), above.alias("_above"))
    parts = F.least(F.lit(FAN_OUT), wanted).cast("int")
    evenly = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get("_marks", (F.floor(i * F.lit(marks) / parts) - 1).cast("int")))
    inner = F.array_distinct(F.filter(evenly, lambda c: c > F.col("_low")))
    return sketched.select(
        KEY, BLOCK, F.when(F.size(inner) > 0, inner).otherwise(F.array(F.col("_above"))).alias("_cuts")
    )


def in_block(order: str | Column) -> WindowSpec:
    return Window.partitionBy(KEY, BLOCK).orderBy(order)


def up_to_here(order: str) -> WindowSpec:
    return in_block(order).rowsBetween(Window.unboundedPreceding, 0)


def summarise(blocked: DataFrame, **partials: Column) -> DataFrame:
    return blocked.groupBy(KEY, BLOCK).agg(*[c.alias(n) for n, c in partials.items()])


def fold(
    summary: DataFrame, before: dict[str, Column] | None = None, overall: dict[str, Column] | None = None
) -> DataFrame:
    """Per group and block: aggregates over the summaries of the earlier blocks and of all blocks."""
    whole = Window.partitionBy(KEY)
    prior = whole.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(
        KEY,
        BLOCK,
        *[c.over(prior).alias(n) for n, c in (before or {}).items()],
        *[c.over(whole).alias(n) for n, c in (overall or {}).items()],
    )


def join_blocks(rows: DataFrame, states: DataFrame) -> DataFrame:
    return rows.join(states, [KEY, BLOCK], "left")


def ordinals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    position: str = "pos",
    total: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the 0-based position of each row in its group and, on request, the group's row count."""
    blocked = with_block(df, keys, order, block_rows)
    states = fold(
        summarise(blocked, _rows=F.count(F.lit(1))),
        before={"_start": F.sum("_rows")},
        overall={total: F.sum("_rows")} if total else None,
    )
    rows = blocked.withColumn("_local", F.row_number().over(in_block(order)) - 1)
    placed = join_blocks(rows, states).withColumn(position, F.coalesce("_start", F.lit(0)) + F.col("_local"))
    return placed.drop("_start", "_local", KEY, BLOCK)


def in_order(df: DataFrame, order: Sequence[Column], position: str = "pos", label: str = "ordered") -> DataFrame:
    """Number all rows from 0 in the given order, which need not be unique: ``position`` is added.

    Rows are range-sorted and written; each range is numbered by itself and the sizes of the ranges, one row each, are
    summed up. So no task holds more than a range. ``df`` is read twice (ranges are cut by a sample).
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    rows = cut_lineage(sorted_.withColumn("_sorted", F.monotonically_increasing_id()), label)
    part = F.shiftrightunsigned("_sorted", 33)
    sizes = rows.groupBy(part.alias("_range")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    inside = F.col("_sorted").bitwiseAND(F.lit((1 << 33) - 1))
    placed = rows.withColumn("_range", part).join(F.broadcast(starts), "_range")  # a row per range
    return placed.withColumn(position, F.col("_start") + inside).drop("_range", "_sorted", "_start")
