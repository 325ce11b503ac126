"""Streams: take the first matches, adapt rows as they land, and a running loss per run.

Every sink writes one directory per micro-batch and overwrites it when the batch is repeated, so a restart from the
checkpoint gives the same output. Streams of groups keep versioned buckets, see ``groups``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.adapters import adapt
from corpusloom.operators.sampling import first_n
from corpusloom.streaming import groups

# Adapters that look at one row at a time; the others need complete groups.
GROUPED_ADAPTERS = ("kjv_bible", "open_assistant")


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType | str, files: str = "*.parquet", files_per_batch: int = 1_000
) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", files)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def read_table_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 1_000) -> DataFrame:
    """A parquet table as a stream, whether ``path`` is one file or a folder of files.

    A stream takes a folder or a pattern, never a file; the pattern here matches the path alone and does for both.
    """
    return read_stream(spark, f"{path[:-1]}[{path[-1]}]", schema, files_per_batch=files_per_batch)


def _batches(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.parquet(out)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing there, or no rows yet
            raise
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))


def stream_take(rows: DataFrame, predicate: Column, order: str, n: int, out: str, checkpoint: str) -> StreamingQuery:
    """Write matching rows until ``n`` are written; within a batch the smallest ``order`` come first."""

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _batches(spark, out, batch.schema).filter(F.col("batch") < batch_id)
        wanted = n - before.count()
        if wanted > 0:
            first_n(batch, order, wanted).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        rows.filter(predicate)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def adapt_stream(rows: DataFrame, name: str) -> DataFrame:
    """The same adapter on a stream; adapters that need whole groups run on complete tables instead."""
    if name in GROUPED_ADAPTERS:
        raise ValueError(f"{name} needs complete groups of rows")
    return adapt(name, rows)


def adapt_group_stream(
    rows: DataFrame, name: str, out: str, checkpoint: str, bucket_rows: int = groups.BUCKET_ROWS
) -> StreamingQuery:
    """Run an adapter that needs whole groups (chapters, threads) on all that has arrived, whatever lands together.

    Read the result with ``groups.read_samples``: it always equals the adapter on the rows so far, and a sample whose
    group grows later is replaced. A batch works on the groups it touches only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if name == "open_assistant":
            groups.write_threads(batch, batch_id, out, bucket_rows)
        else:
            groups.write_runs(batch, batch_id, out, name, bucket_rows)

    if name not in GROUPED_ADAPTERS:
        raise ValueError(f"{name} works row by row, see adapt_stream")
    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_to_table(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def running_loss(rows: DataFrame, run: str, value: str) -> DataFrame:
    return rows.groupBy(run).agg(F.sum(value).alias("total"), F.count(value).alias("n_batches"))


def running_loss_stream(rows: DataFrame, run: str, value: str, out: str, checkpoint: str) -> StreamingQuery:
    """Write the runs that changed in each micro-batch; the last state per run is the current figure."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        running_loss(rows, run, value)
        .writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_loss(spark: SparkSession, out: str, run: str) -> DataFrame:
    states = spark.read.parquet(out)
    last = states.groupBy(run).agg(F.max_by(F.struct("total", "n_batches"), "batch").alias("_s"))
    return last.select(
        run, (F.col("_s.total").cast("double") / F.col("_s.n_batches")).alias("avg_loss"), F.col("_s.n_batches")
    )
