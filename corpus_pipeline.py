"""Documents to training tokens: five stages, each written and read again, each on all that its predecessor kept.

1. quality rules: documents that the rules or the line labels reject go.
2. SimHash near-dedup: of each group one document stays, the one with the smallest id.
3. secret scans: found secrets are masked; no document goes.
4. mixing: documents are repeated or left out so that sources reach their targets, in their order of training.
5. BPE: token ids of every row, and the text decoded from them.

Stages keep the columns of documents; the last one adds ids and n_tokens, and its text is the decoded one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, mixing, quality, secrets, simhash
from corpusloom.llm.common import shared_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.training_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Both directions in one pass over the rows: the ids, and the text that they decode to."""
    rest = [c for c in docs.columns if c not in ("text", "ids", "n_tokens")]
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    columns = [F.col(f"`{c}`") for c in rest]
    return bpe.both_ways(docs.select(*columns, "text")).select(*columns, "text", "ids", n_tokens)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("secret scans", masked_secrets),
    ("mixing to target weights", mixed_sources),
    ("bpe encoding and decoding", tokens),
]

#: Trained models and fingerprints can't be said in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage{n}")
        done = stage(spark, docs, sf_dir)
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return docs
