"""Reading and writing datasets."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.unions import list_normalize
from corpusloom.operators.adapters import SOURCE_ID
from corpusloom.operators.sampling import sample_per_group, sample_seeded
from corpusloom.operators.windows import ordered_concat
from corpusloom.session import cut_lineage, local_table
from corpusloom.sources.catalog import JSON_DATASETS, MULTI_CONFIGS
from corpusloom.sources.schemas import RAW

log = logging.getLogger(__name__)

ROWS_PER_FILE = 1 << 40
SPLIT_SUMS = "_file long, _split long, _quotes long, _out long, _in long"
RECORD_PARTS = "_file long, _split long, part int, ended boolean, text string"
MANIFEST_SCHEMA = "name string, status string, n_rows long, error string"


def read_source(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    format: str = "parquet",
    config: str | None = None,
    split: str | None = None,
    id_col: str | None = None,
    row_cap: int | None = None,
) -> DataFrame:
    """One dataset; optionally one configuration and split (partition columns) and a seeded sample of its rows."""
    reader = spark.read.format(format)
    if schema is not None:
        reader = reader.schema(schema)
    elif format != "parquet":
        raise ValueError("only parquet carries its schema; pass one")
    if format == "json":
        reader = reader.option("multiLine", True)
    df = reader.load(path)
    for column, value in (("config", config), ("split", split)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    if row_cap is None:
        return df
    if id_col is None:
        raise ValueError("a row cap needs the id column that orders the rows")
    return sample_seeded(df, id_col, row_cap)


def with_source_id(df: DataFrame, name: str = SOURCE_ID) -> DataFrame:
    """Number the rows of a parquet dataset by file and place in the file.

    The ids rise in file order and are the same in every run over the same files.
    """
    files = sorted({_plain_path(f) for f in df.inputFiles()})
    listed = local_table(df.sparkSession, [(f, i) for i, f in enumerate(files)] or [("", 0)], "_file string, _no long")
    numbers = listed.select(F.xxhash64("_file").alias("_hash"), "_no")
    if numbers.agg(F.count_distinct("_hash")).first()[0] != max(len(files), 1):
        raise ValueError("two file names share a hash; give the rows an id column")
    path = F.regexp_replace("_metadata.file_path", "^([^:/]+):/+", "$1:/")
    placed = df.select("*", F.xxhash64(path).alias("_path"), F.col("_metadata.row_index").alias("_row"))
    # Two integers per file; Spark knows the size of the local table and chooses the join by it.
    numbered = placed.join(numbers, F.col("_path") == F.col("_hash"))
    return numbered.withColumn(name, F.col("_no") * F.lit(ROWS_PER_FILE) + F.col("_row")).drop(
        "_path", "_row", "_hash", "_no"
    )


def _plain_path(uri: str) -> str:
    return re.sub("^([^:/]+):/+", r"\1:/", uri)


def open_catalogued(spark: SparkSession, root: str, name: str, row_cap: int | None = None) -> DataFrame:
    """A dataset of the catalogue as its adapter reads it: by its format, with source ids, whole unless capped.

    The catalogue lists caps (ROW_CAPS); only a caller applies one.
    """
    path = f"{root}/{name}"
    if name in JSON_DATASETS:
        rows = read_json_array(spark, path, RAW[name])
        rows = rows.withColumn("evidence", list_normalize("evidence")).withColumnRenamed("qid", SOURCE_ID)
    else:
        rows = spark.read.parquet(path)
        rows = rows if SOURCE_ID in rows.columns else with_source_id(rows)
    return rows if row_cap is None else sample_seeded(rows, SOURCE_ID, row_cap)


def open_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_multi(
    spark: SparkSession,
    root: str,
    id_col: str,
    configs: Sequence[str] = MULTI_CONFIGS,
    cap: int | None = None,
    config_col: str = "config",
) -> DataFrame:
    """One dataset made of several configurations (partition directories), whole or each capped."""
    return capped_configs(spark.read.parquet(root), config_col, configs, id_col, cap)


def capped_configs(df: DataFrame, config_col: str, configs: Sequence[str], id_col: str, cap: int | None) -> DataFrame:
    if cap is None:
        return df.filter(F.col(config_col).isin(list(configs)))
    return sample_per_group(df, config_col, configs, id_col, cap)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The objects of files that hold one JSON array each, read by as many tasks as a file has splits.

    Spark's text reader cuts the files at every closing brace, whatever split it lies in. Which braces end a record
    follows from two running figures over the pieces of a file: the quotes so far tell whether a piece begins inside a
    string, the braces outside strings how deep it ends; a record ends where the depth is back at zero. Each split is
    summed up for a beginning outside and inside a string, the sums of the splits before it, a row each, give the state
    it begins in, and a second walk puts the pieces of its records together. No row is sorted or shuffled but a split's
    ends, where a record reaches into the next one. Records are parsed by ``schema``. Files of objects one behind the
    other, without an array around them, read the same.
    """
    pieces = _json_pieces(spark.read.option("lineSep", "}").text(path))
    sums = pieces.drop("value").mapInArrow(_split_sums, SPLIT_SUMS)
    prior = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.withColumn("_inside", (F.coalesce(F.sum("_quotes").over(prior), F.lit(0)) % 2).cast("int"))
    deeper = F.when(F.col("_inside") == 0, F.col("_out")).otherwise(F.col("_in"))
    states = begun.withColumn("_depth", F.coalesce(F.sum(deeper).over(prior), F.lit(0)))
    states = cut_lineage(states.select("_file", "_split", "_inside", "_depth"), "json-splits")
    placed = pieces.join(F.broadcast(states), ["_file", "_split"])  # a row per split; the pieces stay in order
    records = cut_lineage(placed.mapInArrow(_split_records, RECORD_PARTS), "json-records")
    ends = records.filter("part <> 1")
    earlier = Window.partitionBy("_file").orderBy("_split", "part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = ends.withColumn("_record", F.coalesce(F.sum(F.col("ended").cast("int")).over(earlier), F.lit(0)))
    parts = F.sort_array(F.collect_list(F.struct("_split", "part", "text")))
    joined = F.array_join(F.transform(parts, lambda p: p["text"]), "}").alias("text")
    across = numbered.groupBy("_file", "_record").agg(joined, F.max("ended").alias("ended")).filter("ended")
    texts = F.concat(F.regexp_replace("text", "^[^{]*", ""), F.lit("}"))
    whole = records.filter("part = 1").select("text").unionAll(across.select("text"))
    return whole.select(F.from_json(texts, schema).alias("_r")).select("_r.*")


def _json_pieces(text: DataFrame) -> DataFrame:
    """Per piece: its quotes, and how much deeper it ends, its closing brace included, if it begins outside a string
    (``_out``) or inside one (``_in``)."""
    escaped = F.col("value").contains("\\")
    bare = F.when(escaped, F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    rows = text.select(
        F.xxhash64("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        "value",
        bare.alias("_bare"),
    )
    rows = rows.withColumn("_quotes", _count_of("_bare", '"')).withColumn("_braces", _count_of("_bare", "{"))
    outside = F.regexp_replace(F.regexp_replace("_bare", '"[^"]*"', ""), '(?s)"[^"]*$', "")
    rows = rows.withColumn("_outside", F.when((F.col("_braces") > 0) & (F.col("_quotes") > 0), outside).otherwise(F.col("_bare")))
    rows = rows.withColumn("_opened", _count_of("_outside", "{"))
    return rows.select(
        "_file",
        "_split",
        "value",
        "_quotes",
        (F.col("_opened") - (F.col("_quotes") + 1) % 2).alias("_out"),
        (F.col("_braces") - F.col("_opened") - F.col("_quotes") % 2).alias("_in"),
    )


def _count_of(column: str, char: str) -> Column:
    return F.length(column) - F.length(F.replace(F.col(column), F.lit(char), F.lit("")))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The batches cut where another split begins."""
    for batch in batches:
        if batch.num_rows:
            file, split = (batch.column(c).to_numpy() for c in ("_file", "_split"))
            starts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (split[1:] != split[:-1])) + 1).tolist(), len(file)]
            for start, stop in zip(starts, starts[1:]):
                yield (int(file[start]), int(split[start])), batch.slice(start, stop - start)


def _split_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: its quotes and how much deeper it ends, begun outside and inside a string."""
    sums: dict[tuple[int, int], list[int]] = {}
    for key, run in _runs(batches):
        quotes, out, in_ = (run.column(c).to_numpy() for c in ("_quotes", "_out", "_in"))
        so_far = sums.setdefault(key, [0, 0, 0])
        inside = (so_far[0] + np.cumsum(quotes) - quotes) % 2 == 1
        so_far[0] += int(quotes.sum())
        so_far[1] += int(np.where(inside, in_, out).sum())
        so_far[2] += int(np.where(inside, out, in_).sum())
    rows = [(*key, *figures) for key, figures in sums.items()]
    names = ["_file", "_split", "_quotes", "_out", "_in"]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=names)


def _split_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each split: first (part 0) what ends in it first, then the whole ones (1), then what is left (2)."""
    key, pending = None, []  # the pieces of the record that is open

    def rows(part: int, ended: bool, texts: pa.Array) -> pa.RecordBatch:
        n = len(texts)
        columns = [pa.array([v] * n, t) for v, t in zip((*key, part, ended), (pa.int64(), pa.int64(), pa.int32(), pa.bool_()))]
        return pa.RecordBatch.from_arrays([*columns, texts], names=["_file", "_split", "part", "ended", "text"])

    for run_key, run in _runs(batches):
        if run_key != key:
            if pending:
                yield rows(2, False, pa.array(["}".join(pending)]))
            key, pending, part = run_key, [], 0
            quotes_before, depth = run.column("_inside")[0].as_py(), run.column("_depth")[0].as_py()
        quotes, out, in_ = (run.column(c).to_numpy() for c in ("_quotes", "_out", "_in"))
        so_far = quotes_before + np.cumsum(quotes)
        depths = depth + np.cumsum(np.where((so_far - quotes) % 2 == 1, in_, out))
        quotes_before, depth = int(so_far[-1]), int(depths[-1])
        ends = np.flatnonzero((depths == 0) & (so_far % 2 == 0)) + 1
        values = run.column("value")
        if len(ends):
            lists = pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), values)
            texts = pc.binary_join(lists, "}")
            yield rows(part, True, pa.array(["}".join([*pending, texts[0].as_py()])]))
            yield rows(1, True, texts[1:])
            pending, part, values = [], 1, values[int(ends[-1]) :]
        pending.extend(values.to_pylist())
    if pending:
        yield rows(2, False, pa.array(["}".join(pending)]))


def to_dataset(spark: SparkSession, rows: Sequence, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def page_texts(pages: DataFrame, doc: str, page_no: str, text: str) -> DataFrame:
    """One text per document: its pages in order, a missing page as empty."""
    return ordered_concat(pages, [doc], page_no, text)


def materialize(
    spark: SparkSession, build: Callable[[], DataFrame], path: str, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Open the dataset if it was written to the end, build and write it otherwise.

    The marker that Spark writes last tells; a fault while looking for it, or while reading, goes up and overwrites
    nothing. A finished dataset without rows has no files to tell its schema, so the builder's plan does.
    """
    if not _finished(spark, path):
        log.info("building %s", path)
        save(build(), path, partition_by, "overwrite", rebalance=False)
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.createDataFrame([], build().schema)


def _finished(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def load_all(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Open every dataset; one that fails is reported and the others go on: (name, status, n_rows, error)."""
    rows = []
    for name, path in paths.items():
        try:
            rows.append((name, "ok", spark.read.parquet(path).count(), None))
        except Exception as error:  # noqa: BLE001 - a broken dataset must not stop the rest
            log.warning("skipping %s: %s", name, error)
            rows.append((name, "failed", None, type(error).__name__))
    return local_table(spark, rows, MANIFEST_SCHEMA)


def save(
    df: DataFrame,
    path: str,
    by: Sequence[str] = ("dataset", "split"),
    mode: str = "errorifexists",
    rebalance: bool = True,
) -> None:
    """Write parquet partitioned by ``by``.

    With many partitions a rebalance gathers each one's rows into few files and splits a large one. With few
    partitions leave it out: every task then writes its own rows and nothing is shuffled.
    """
    gathered = df.hint("rebalance", *by) if by and rebalance else df
    gathered.write.mode(mode).partitionBy(*by).parquet(path)


def save_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON Lines in UTF-8; nulls are written out."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def save_text(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).text(path)
