"""Contexts, running figures and groups of adjacent rows, all over blocks (see ``blocks``).

``order`` is an integer column that is unique within a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import as_column, strip
from corpusloom.operators.blocks import (
    BLOCK,
    BLOCK_ROWS,
    KEY,
    fold,
    in_block,
    join_blocks,
    ordinals,
    summarise,
    up_to_here,
    with_block,
)

TEXT_BLOCK_ROWS = 16_384
PREFIX_BLOCK_ROWS = 256
CONTEXT_ROWS = 3
PATIENCE = 10
ACCUMULATION = 16


def finite(c: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    c = as_column(c)
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))


def sliding_context(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    text: str,
    k: int = CONTEXT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For each row after the first ``k`` of its group: the ``k`` texts before it, joined by a space, as ``context``.

    A block's first rows take the missing texts from the tails of the blocks before it; ``k`` blocks hold enough.
    """
    blocked = with_block(df, keys, order, block_rows)
    last_rows = (
        blocked.select(KEY, BLOCK, order, text, F.row_number().over(in_block(F.desc(order))).alias("_back"))
        .filter(F.col("_back") <= k)
    )
    tail = F.sort_array(F.collect_list(F.struct(F.col(order), F.coalesce(F.col(text), F.lit("")).alias("_text"))))
    recent = Window.partitionBy(KEY).orderBy(BLOCK).rowsBetween(-k, -1)
    states = summarise(last_rows, _tail=tail).select(
        KEY, BLOCK, F.flatten(F.collect_list("_tail").over(recent)).alias("_earlier")
    )
    inside = F.collect_list(F.coalesce(F.col(text), F.lit(""))).over(in_block(order).rowsBetween(-k, -1))
    rows = join_blocks(blocked.withColumn("_inside", inside), states)
    earlier = F.transform(F.col("_earlier"), lambda r: r["_text"])
    texts = F.when(F.size("_inside") >= k, F.col("_inside")).otherwise(F.concat(earlier, F.col("_inside")))
    return (
        rows.withColumn("_texts", texts)
        .filter(F.size("_texts") >= k)
        .withColumn("context", F.array_join(F.slice(F.col("_texts"), F.size("_texts") - k + 1, k), " "))
        .drop("_inside", "_texts", "_earlier", KEY, BLOCK)
    )


def _joined(order: str, text: str, separator: str) -> Column:
    """A block's texts in order as one text."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order), F.coalesce(F.col(text), F.lit("")).alias("_text"))))
    return F.array_join(F.transform(parts, lambda p: p["_text"]), separator)


def ordered_concat(
    df: DataFrame, keys: Sequence[str], order: str, text: str, separator: str = "", block_rows: int = TEXT_BLOCK_ROWS
) -> DataFrame:
    """One text per group: the rows' texts in order, null as empty. Blocks are joined first, then their texts."""
    blocks = summarise(with_block(df, keys, order, block_rows), _text=_joined(order, text, separator))
    whole = blocks.groupBy(KEY).agg(_joined(BLOCK, "_text", separator).alias(text))
    return whole.select(*[F.col(KEY)[k].alias(k) for k in keys], text)


def prefix_context(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    text: str,
    max_chars: int | None = None,
    block_rows: int = PREFIX_BLOCK_ROWS,
) -> DataFrame:
    """For each row but a group's first: all texts before it, joined by a space and stripped, as ``context``.

    The result grows with the square of a group by definition; ``max_chars`` keeps the first code points of the
    joined texts only. A row takes the text of earlier blocks from the fold, so one task writes the contexts of
    one block only, and with ``max_chars`` a fold holds just the blocks that begin inside the limit.
    """
    blocked = with_block(df, keys, order, block_rows)
    joined = _joined(order, text, " ")
    kept = F.substring(joined, 1, max_chars) if max_chars else joined
    summary = summarise(blocked, _text=kept, _chars=F.sum(F.length(F.coalesce(F.col(text), F.lit(""))) + 1))
    if max_chars:
        begin = F.sum("_chars").over(Window.partitionBy(KEY).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1))
        summary = summary.withColumn("_begin", F.coalesce(begin, F.lit(0)))
        summary = summary.withColumn("_text", F.when(F.col("_begin") < max_chars, F.col("_text")))
    states = fold(summary, before={"_earlier": F.collect_list("_text"), "_before": F.count(F.lit(1))})
    prior = in_block(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.collect_list(F.coalesce(F.col(text), F.lit(""))).over(prior)
    context = F.array_join(F.concat("_earlier", "_inside"), " ")
    return (
        join_blocks(blocked.withColumn("_inside", inside), states)
        .filter(F.col("_before") + F.size("_inside") > 0)
        .withColumn("context", strip(F.substring(context, 1, max_chars) if max_chars else context))
        .drop("_inside", "_earlier", "_before", KEY, BLOCK)
    )


def prefix_lengths(
    df: DataFrame, keys: Sequence[str], order: str, text: str, name: str = "context_chars", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The length of each row's ``prefix_context``, 0 for a group's first row, without building any context.

    The stripped context reaches from the first to the last character before the row that is no blank. So three running
    figures are enough: the characters so far, and the least and the greatest place of a text's own ends.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    inner = strip(value)
    lead = F.when(inner != "", F.instr(value, inner) - 1)  # its first place, for it begins with no blank
    blocked = with_block(df, keys, order, block_rows)
    before = in_block(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = blocked.withColumns({"_size": (F.length(value) + 1).cast("long"), "_lead": lead, "_own": F.length(inner)})
    rows = rows.withColumn("_begin", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    rows = rows.withColumns({"_from": F.col("_begin") + F.col("_lead"), "_to": F.col("_begin") + F.col("_lead") + F.col("_own")})
    rows = rows.withColumns({"_low1": F.min("_from").over(before), "_high1": F.max("_to").over(before)})
    prior = Window.partitionBy(KEY).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    summary = summarise(rows, _chars=F.sum("_size"), _first=F.min("_from"), _last=F.max("_to"))
    summary = summary.withColumn("_base", F.coalesce(F.sum("_chars").over(prior), F.lit(0)))
    states = summary.select(
        KEY,
        BLOCK,
        "_base",
        F.min(F.col("_base") + F.col("_first")).over(prior).alias("_low0"),
        F.max(F.col("_base") + F.col("_last")).over(prior).alias("_high0"),
    )
    low = F.least("_low0", F.col("_base") + F.col("_low1"))
    high = F.greatest("_high0", F.col("_base") + F.col("_high1"))
    placed = join_blocks(rows, states).withColumn(name, F.coalesce(high - low, F.lit(0)))
    return placed.select(*df.columns, name)


def running_avg(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    name: str = "avg_value",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Average of ``value`` over the group's rows up to and including this one."""
    blocked = with_block(df, keys, order, block_rows)
    states = fold(
        summarise(blocked, _sum=F.sum(value), _n=F.count(value)),
        before={"_sum0": F.sum("_sum"), "_n0": F.sum("_n")},
    )
    rows = blocked.withColumns(
        {"_sum1": F.sum(value).over(up_to_here(order)), "_n1": F.count(value).over(up_to_here(order))}
    )
    total = F.coalesce("_sum0", F.lit(0)) + F.coalesce("_sum1", F.lit(0))
    n = F.coalesce("_n0", F.lit(0)) + F.col("_n1")
    return (
        join_blocks(rows, states)
        .withColumn(name, F.when(n > 0, total.cast("double") / n))
        .drop("_sum0", "_n0", "_sum1", "_n1", KEY, BLOCK)
    )


def early_stop(
    df: DataFrame,
    keys: Sequence[str],
    epoch: str,
    loss: str,
    patience: int = PATIENCE,
    first_epoch: int = 1,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Best loss so far, epochs waited and whether the epoch improved, up to the epoch that stops the run.

    An epoch improves when its loss is below all earlier ones; the latest improvement therefore is the first
    epoch that reached the running minimum, so one running minimum of (loss, epoch) gives both. An epoch whose
    loss is not finite counts as waited. Epochs are consecutive numbers from ``first_epoch``.
    """
    point = F.when(finite(loss), F.struct(F.col(loss).alias("loss"), F.col(epoch).alias("epoch")))
    blocked = with_block(df.withColumn("_point", point), keys, epoch, block_rows)
    states = fold(summarise(blocked, _low=F.min("_point")), before={"_low0": F.min("_low")})
    rows = join_blocks(blocked.withColumn("_low1", F.min("_point").over(up_to_here(epoch))), states)
    best = F.least("_low0", "_low1")
    waited = (
        rows.withColumn("_best", best)
        .withColumn("best_loss", F.col("_best.loss"))
        .withColumn("wait", F.col(epoch) - F.coalesce(F.col("_best.epoch"), F.lit(first_epoch - 1)))
        .withColumn("improved", F.col("wait") == 0)
        .drop("_low0", "_low1", "_best", "_point")
    )
    stop = F.min(F.when(F.col("wait") >= patience, F.col(epoch)))
    stops = fold(summarise(waited, _stop=stop), overall={"_first_stop": F.min("_stop")})
    return (
        join_blocks(waited, stops)
        .filter(F.col("_first_stop").isNull() | (F.col(epoch) <= F.col("_first_stop")))
        .withColumn("stopped", F.coalesce(F.col(epoch) == F.col("_first_stop"), F.lit(False)))
        .drop("_first_stop", KEY, BLOCK)
    )


def checkpoints(df: DataFrame, keys: Sequence[str], epoch: str, loss: str, **options) -> DataFrame:
    """The epochs whose weights would have been kept: those that improved before the stop."""
    rows = early_stop(df, keys, epoch, loss, **options)
    return rows.filter("improved").select(*keys, epoch, loss)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 3) -> DataFrame:
    """First ``n`` rows of each group. Spark keeps n per group and task before the shuffle (WindowGroupLimit)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rn", rank).filter(F.col("rn") <= n)


def last_row_where(df: DataFrame, keys: Sequence[str], order: str, predicate: Column, value: str) -> DataFrame:
    """Per group: ``value`` of the last row that satisfies the predicate; groups without one are left out."""
    kept = df.filter(predicate)
    return kept.groupBy(*keys).agg(F.max(order).alias(order), F.max_by(value, order).alias(value))


def islands(
    df: DataFrame, keys: Sequence[str], order: str, labels: Sequence[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Number the runs of adjacent rows with equal labels: ``island`` counts from 0 within a group."""
    blocked = with_block(df.withColumn("_label", F.struct(*labels)), keys, order, block_rows)
    changed = _differs(F.lag("_label").over(in_block(order)), F.col("_label"))
    rows = blocked.withColumn("_change", changed)
    summary = summarise(
        rows, _inner=F.sum("_change"), _first=F.min_by("_label", order), _last=F.max_by("_label", order)
    )
    across = Window.partitionBy(KEY).orderBy(BLOCK)
    borders = summary.withColumn("_border", _differs(F.lag("_last").over(across), F.col("_first")))
    entered = F.sum("_border").over(across.rowsBetween(Window.unboundedPreceding, 0))
    passed = F.sum("_inner").over(across.rowsBetween(Window.unboundedPreceding, -1))
    states = borders.select(KEY, BLOCK, (entered + F.coalesce(passed, F.lit(0))).alias("_start"))
    numbered = rows.withColumn("_inside", F.sum("_change").over(up_to_here(order)))
    return (
        join_blocks(numbered, states)
        .withColumn("island", F.col("_start") + F.col("_inside"))
        .drop("_label", "_change", "_inside", "_start", KEY, BLOCK)
    )


def _differs(previous: Column, current: Column) -> Column:
    """1 where there is a previous label and it is another one; labels are structs, so null labels compare too."""
    return F.when(previous.isNotNull() & (previous != current), 1).otherwise(0)


def island_summary(df: DataFrame, keys: Sequence[str], order: str, labels: Sequence[str], **options) -> DataFrame:
    numbered = islands(df.select(*keys, order, *labels), keys, order, labels, **options)
    # The labels are the same throughout an island; as grouping columns they keep the aggregate in a hash map.
    return numbered.groupBy(*keys, "island", *labels).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(order).alias("first_row"),
        F.max(order).alias("last_row"),
    )


def microbatch(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    n: int = ACCUMULATION,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Sum of value/n over each run of ``n`` consecutive rows; a short last run is marked incomplete.

    A value that is not finite adds nothing but keeps its place in the run.
    """
    placed = ordinals(df, keys, order, "_place", block_rows=block_rows)
    return (
        placed.groupBy(*keys, F.expr(f"_place div {int(n)}").alias("step"))
        .agg(
            F.sum(F.when(finite(value), F.col(value))).alias("_sum"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        .select(
            *keys,
            "step",
            (F.coalesce(F.col("_sum").cast("double"), F.lit(0.0)) / n).alias("accumulated"),
            "n_rows",
            (F.col("n_rows") == n).alias("complete"),
        )
    )
