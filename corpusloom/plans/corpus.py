"""Whole runs: raw datasets -> corpus table -> batches, and predictions -> scorecard."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.arrays import target_ids
from corpusloom.functions.text import strip
from corpusloom.operators import lookups, metrics, scorecard, tokens
from corpusloom.operators.adapters import ADAPTERS, SOURCE_ID, adapt, thread_samples
from corpusloom.operators.sampling import split_hash, split_threads
from corpusloom.session import local_table
from corpusloom.sources import catalog, tables
from corpusloom.sources.schemas import SAMPLE

log = logging.getLogger(__name__)

THREAD_DATASETS = ("open_assistant",)
SAMPLE_COLUMNS = [SOURCE_ID, "sample_no", "context", "target", "task", "split"]


def split_samples(name: str, raw: DataFrame, leaky: bool = False) -> DataFrame:
    """A dataset's samples with their split: all samples of a raw row, or of a thread, share one."""
    if name in THREAD_DATASETS:
        labelled = split_threads(thread_samples(raw), SOURCE_ID, "root_id", leaky)
    else:
        labelled = split_hash(adapt(name, raw), SOURCE_ID)
    return labelled.select(F.col(SOURCE_ID).cast("string").alias(SOURCE_ID), *SAMPLE_COLUMNS[1:])


def build_corpus(
    spark: SparkSession, sources: Mapping[str, Callable[[], DataFrame]], out: str, parallel: int = 4
) -> DataFrame:
    """Adapt, split and write every dataset to ``out`` as partitions (dataset, split); returns the manifest.

    Datasets start in benchmark order, others after them, ``parallel`` at a time, so that small ones do not
    leave the cluster idle. One that is there already is kept, one without an adapter or with an error is
    reported, and the rest go on.
    """
    order = {name: i for i, name in enumerate(catalog.BENCHMARK_ORDER)}

    def build(name: str) -> tuple:
        if name not in ADAPTERS:
            return (name, "no adapter", None, None)
        try:
            written = tables.materialize(
                spark, lambda: split_samples(name, sources[name]()), f"{out}/dataset={name}", ["split"]
            )
            return (name, "ok", written.count(), None)
        except Exception as error:  # noqa: BLE001 - a broken dataset must not stop the rest
            log.warning("skipping %s: %s", name, error)
            return (name, "failed", None, type(error).__name__)

    names = sorted(sources, key=lambda n: (order.get(n, len(order)), n))
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(build), names))
    return local_table(spark, rows, tables.MANIFEST_SCHEMA)


def open_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The built corpus; filters on dataset and split choose directories."""
    return spark.read.schema(SAMPLE).parquet(path)


def tokenise(samples: DataFrame, vocab: list[str], context_length: int | None = None) -> DataFrame:
    """Context ids without marks, whole unless a length is given; target ids with marks, padded. Texts are left behind."""
    ids = tokens.word_ids(vocab)
    encoded = samples.withColumns({"_c": ids(strip("context")), "_t": ids(strip("target"))})
    return encoded.select(
        *[c for c in samples.columns if c not in ("context", "target")],
        (F.slice("_c", 1, context_length) if context_length else F.col("_c")).alias("context_tokens"),
        target_ids("_t").alias("target_tokens"),
    )


def evaluation_plan(spark: SparkSession) -> DataFrame:
    """For each dataset in benchmark order: its configuration and evaluation split, or why it is left out."""
    adapters = local_table(spark, [(n, True) for n in sorted(ADAPTERS)], "name string, adapted boolean")
    listed = lookups.lookup(catalog.benchmark_order(spark), catalog.catalog(spark), "name", seq="seq")
    listed = lookups.lookup(lookups.lookup(listed, catalog.evaluation_splits(spark), "name"), adapters, "name")
    return listed.select("pos", "name", "repo", "config", "eval_split", plan_status().alias("status"))


def plan_status() -> Column:
    return (
        F.when(F.col("repo").isNull(), "no configuration")
        .when(F.col("eval_split").isNull(), "no evaluation split")
        .when(F.col("adapted").isNull(), "no adapter")
        .otherwise("ok")
    )


def score(spark: SparkSession, answers: DataFrame, own: str = scorecard.OWN) -> DataFrame:
    """Scorecard of (dataset, prediction, gold) rows for the datasets that the evaluation plan allows."""
    allowed = evaluation_plan(spark).filter("status = 'ok'").select(F.col("name").alias("dataset"), "pos")
    scores = metrics.exact_match(answers, "prediction", "gold", "dataset")
    listed = scores.join(allowed, "dataset")
    card = scorecard.scorecard(listed, catalog.published_scores(spark), own)
    return card.join(allowed, "dataset").orderBy("pos").drop("pos")
