"""Sessions, the shared work folder and lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def get_spark(app: str = "corpusloom", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators expect; cluster settings given by spark-submit stay."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting gets a folder
    beside its warehouse; anywhere else the folder must be named.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-work"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and continue from the table, so a lost executor repeats no earlier round."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A table from a fixed list of rows. It enters the plan as a local relation, so Spark knows its size."""
    schema = T.StructType.fromDDL(ddl)
    columns = [pa.array([row[i] for row in rows]) for i in range(len(schema))]
    return spark.createDataFrame(pa.table(columns, names=schema.names), schema)


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a small scan to all cores before costly row work; a scan with enough splits stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
