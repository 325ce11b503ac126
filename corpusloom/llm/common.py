"""What the operators share: words, tables, bindings inside expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import fresh_path

# A word is a run of anything but these six characters. They are also what bytes.split() splits at.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"
SQL_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder below the one all executors share; a cluster has to name that one in spark.checkpoint.dir."""
    return fresh_path(spark, label)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the table: what is dear is done once and outlives executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often and however deep in lambdas the body names it."""
    return F.transform(F.array(value), body)[0]


def fold_of(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo the folds."""
    return F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(folds))


def byte_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of a text column; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


SLICE = 4 << 20  # bytes of text worked on at once


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """Consecutive parts of a text column of at most ``most`` bytes each, or one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def per_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterable], Iterator]:
    """A mapInArrow function from one that turns a batch into a batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield make(batch)

    return run
