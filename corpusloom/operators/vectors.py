"""Vectors: embedding trees, moments, drift and padding.

``dims`` is the fixed length of the vectors. Sums run over slices of a vector with one accumulator per place in a
slice, so a row is a few rows in the aggregate rather than ``dims`` exploded ones, and tasks combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import concat_vectors
from corpusloom.operators.blocks import ordinals
from corpusloom.session import cut_lineage

DRIFT_LAMBDA = 1_000.0
NORM_SCALE = 1e-6
SLICE = 64  # cells of a vector that are summed side by side


def per_dim(vec: str, dims: int, aggregate: str) -> Column:
    """An array of one SQL aggregate per dimension, ``{x}`` standing for the dimension's value as double.

    A vector of another length stops the job; a null vector counts as nulls.
    """
    fits = f"`{vec}` IS NULL OR size(`{vec}`) = {dims}"
    first = f"IF({fits}, double(`{vec}`[0]), double(raise_error('a vector has not {dims} cells')))"
    cells = [aggregate.format(x=first if i == 0 else f"double(`{vec}`[{i}])") for i in range(dims)]
    return F.expr(f"array({', '.join(cells)})")


TREE_LEVELS = 8  # levels built in one block of 2**8 neighbours


def tree_levels(leaves: np.ndarray, there: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, vectors, which of them are not null) above the leaves: means of neighbours, an odd last one promoted.

    The mean of a vector and a null is the vector.
    """
    for level in range(1, most + 1):
        odd = len(leaves) % 2
        left, right = leaves[: len(leaves) - odd : 2], leaves[1::2]
        a, b = there[: len(there) - odd : 2], there[1::2]
        both = (a & b)[:, None]
        means = np.where(both, (left + right) / 2, np.where(a[:, None], left, right))
        leaves = np.concatenate([means, leaves[len(leaves) - odd :]])
        there = np.concatenate([a | b, there[len(there) - odd :]])
        yield level, leaves, there


def _block_trees(dims: int):
    """Rows (group, block, leaf, leaves left above, vec), sorted, to the nodes of each block's levels.

    A block is held whole, 2**TREE_LEVELS vectors; nothing else is.
    """

    def cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        there = column.is_valid().to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(column).drop_null()
        if len(sizes) and not pc.all(pc.equal(sizes, dims)).as_py():
            raise ValueError(f"a vector has not {dims} cells")
        out = np.zeros((len(column), dims))
        out[there] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        return out, there

    def nodes(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        leaves, there = cells(block.column("vec"))
        first, n = block.column("leaf")[0].as_py(), block.column("n")[0].as_py()
        most = min(TREE_LEVELS, max(n - 1, 0).bit_length())
        levels, places, vectors, known = [], [], [], []
        for level, rows, valid in tree_levels(leaves, there, most):
            levels.append(np.full(len(rows), level, np.int32))
            places.append((first >> level) + np.arange(len(rows)))
            vectors.append(rows)
            known.append(valid)
        total = sum(map(len, places))
        flat = np.concatenate(vectors) if total else np.zeros((0, dims))
        valid = np.concatenate(known) if total else np.zeros(0, bool)
        offsets = pa.array(np.arange(0, (total + 1) * dims, dims, dtype=np.int32)[: total + 1] if dims else np.zeros(total + 1, np.int32))
        lists = pa.ListArray.from_arrays(offsets, pa.array(flat.reshape(-1)), mask=pa.array(~valid))
        group = pa.concat_arrays([block.column("group").slice(0, 1)] * total) if total else block.column("group").slice(0, 0)
        level = pa.array(np.concatenate(levels) if total else np.zeros(0, np.int32))
        place = pa.array(np.concatenate(places) if total else np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([group, level, place, lists], ["group", "level", "pos", "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = batch.column("block").to_numpy()
            starts = batch.column("leaf").to_numpy() % (1 << TREE_LEVELS) == 0
            cuts = np.flatnonzero(starts | np.r_[True, blocks[1:] != blocks[:-1]])
            for a, b in zip(cuts, np.append(cuts[1:], batch.num_rows), strict=True):
                if starts[a] and held:
                    yield nodes(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield nodes(held)

    return run


def embedding_tree(
    df: DataFrame, doc: str, order: str, vec: str, dims: int, include_root_copy: bool = False
) -> DataFrame:
    """All nodes of each document's pairwise mean tree: (doc, level, pos, vec).

    Leaves are a document's rows in ``order``; level by level neighbours (0,1), (2,3).. are averaged and an odd
    last node is promoted. Aligned blocks of 2**TREE_LEVELS leaves are built bottom-up, each in one pass over its
    vectors, and only the blocks' roots go up, to be the leaves of the blocks above them: a document of any size is spread
    over blocks, and a vector is copied once per TREE_LEVELS levels. Null vectors add nothing to a mean.
    """
    placed = ordinals(df.select(doc, order, vec), [doc], order, "_leaf", total="_leaves")
    doubles = F.transform(vec, lambda x: x.cast("double")).alias("vec")
    leaves = placed.select(F.col(doc).alias("group"), F.col("_leaf").alias("leaf"), F.col("_leaves").alias("n"), doubles)
    leaves = cut_lineage(leaves, "tree-leaves")
    most = leaves.agg(F.max("n")).first()[0] or 0
    group_type = leaves.schema["group"].dataType.simpleString()
    made, level, below = [], 0, leaves
    while most > 1:
        blocks = below.withColumn("block", F.shiftright("leaf", TREE_LEVELS))
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = blocks.repartition(parts, "group", "block").sortWithinPartitions("group", "block", "leaf")
        nodes = blocks.mapInArrow(_block_trees(dims), f"group {group_type}, level int, pos bigint, vec array<double>")
        nodes = cut_lineage(nodes.withColumn("level", F.col("level") + level), "tree-nodes")
        made.append(nodes)
        level, most = level + TREE_LEVELS, -(-most >> TREE_LEVELS)
        if most > 1:
            sizes = leaves.select(F.col("group").alias("_of"), F.ceil(F.col("n") / F.lit(2**level)).alias("n")).distinct()
            roots = nodes.filter(F.col("level") == level).select("group", F.col("pos").alias("leaf"), "vec")
            below = roots.join(sizes.filter("n > 1"), F.col("group").eqNullSafe(F.col("_of"))).drop("_of")
    own = leaves.select("group", F.lit(0).alias("level"), F.col("leaf").alias("pos"), "vec")
    nodes = reduce(DataFrame.unionByName, made, own)
    if include_root_copy:
        top = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0).alias("_top")
        tops = leaves.select(F.col("group").alias("_of"), top).distinct()
        same = F.col("group").eqNullSafe(F.col("_of")) & (F.col("level") == F.col("_top"))
        root = nodes.filter("pos = 0").join(tops, same)
        nodes = nodes.unionByName(root.select("group", (F.col("level") + 1).alias("level"), "pos", "vec"))
    return nodes.select(F.col("group").alias(doc), "level", "pos", F.col("vec").alias(vec))


def second_moment(
    df: DataFrame, key: str, vec: str, dims: int, divisor: str = "rows", batch_size: int = 32
) -> DataFrame:
    """Sum of squares per key and dimension over the number of rows or of batches: (key, idx, moment).

    A vector goes in slices of SLICE cells, each with its number, to SLICE accumulators: plan and buffers are of one size
    whatever ``dims``, and tasks combine before the shuffle. A null vector counts as a row of nulls.
    """
    if divisor not in ("rows", "batches"):
        raise ValueError("divisor is 'rows' or 'batches'")
    wrong = F.raise_error(F.lit(f"a vector has not {dims} cells")).cast(df.schema[vec].dataType)
    checked = F.when(F.col(vec).isNull() | (F.size(vec) == dims), F.col(vec)).otherwise(wrong)
    width = min(SLICE, dims)
    begins = F.sequence(F.lit(0), F.lit(-(-dims // width) - 1))
    slices = F.transform(begins, lambda s: F.slice(checked, s * width + 1, width))
    rows = df.select(key, F.posexplode(slices).alias("_slice", "_cells"))
    cells = [F.get("_cells", F.lit(i)).cast("double") for i in range(width)]
    n = F.count(F.lit(1))
    n = F.ceil(n / F.lit(batch_size)) if divisor == "batches" else n
    sums = rows.groupBy(key, "_slice").agg(F.array(*[F.sum(x * x) for x in cells]).alias("_sums"), n.alias("_n"))
    each = sums.select(key, "_n", "_slice", F.posexplode("_sums").alias("_at", "_sum"))
    idx = (F.col("_slice") * width + F.col("_at")).alias("idx")
    return each.select(key, idx, (F.col("_sum") / F.col("_n")).alias("moment")).filter(F.col("idx") < dims)


def weighted_drift(current: DataFrame, snapshots: DataFrame, lam: float = DRIFT_LAMBDA) -> DataFrame:
    """Penalty per snapshot: lam/2 * sum(importance * (value - anchor)^2) over the names both sides have.

    ``current`` is (name, idx, value), ``snapshots`` is (task_no, name, idx, importance, anchor).
    """
    moved = F.col("value") - F.col("anchor")
    return (
        snapshots.join(current, ["name", "idx"])
        .groupBy("task_no")
        .agg((F.sum(F.col("importance") * moved * moved) * F.lit(lam / 2)).alias("penalty"))
    )


def sum_squares(df: DataFrame, vec: str, by: Sequence[str] = (), scale: float = NORM_SCALE) -> DataFrame:
    squares = F.aggregate(F.col(vec), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return df.groupBy(*by).agg((F.sum(squares) * F.lit(scale)).alias("l2"))


def pad_vectors(df: DataFrame, batch: str, doc: str, pos: str, vec: str, dims: int) -> DataFrame:
    """Rows (batch, doc, pos, vec) plus zero vectors up to the largest count of each batch.

    Only counts are grouped; the vectors stay where they are.
    """
    counts = df.groupBy(batch, doc).agg(F.count(F.lit(1)).alias("_n"))
    width = counts.groupBy(batch).agg(F.max("_n").alias("_width"))
    short = counts.join(width, batch).filter(F.col("_n") < F.col("_width"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dims)
    padding = short.select(
        batch,
        doc,
        F.explode(F.sequence(F.col("_n"), F.col("_width") - 1)).alias(pos),
        zeros.alias(vec),
    )
    return df.select(batch, doc, pos, vec).unionByName(padding)


def concat_pairs(df: DataFrame, doc: str, order: str, vec: str) -> DataFrame:
    """Vectors of neighbours (0,1), (2,3).. of a document put one behind the other: (doc, pair_no, vec)."""
    placed = ordinals(df.select(doc, order, vec), [doc], order, "_leaf")
    even = F.col("_leaf") % 2 == 0
    pairs = placed.groupBy(doc, F.expr("_leaf div 2").alias("pair_no")).agg(
        F.max(F.when(even, F.col(vec))).alias("_a"), F.max(F.when(~even, F.col(vec))).alias("_b")
    )
    return pairs.filter(F.col("_b").isNotNull()).select(doc, "pair_no", concat_vectors("_a", "_b").alias(vec))
