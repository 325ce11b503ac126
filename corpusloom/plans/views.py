"""Raw-dataset shapes derived from the given tables, the same in Spark and in the SQL to compare with.

Every view covers its whole table and whole texts; blanks, nulls, missing marks and bad indices are planted in
some rows so that each rule of an adapter has rows to accept and rows to reject.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# name -> (table, Spark expressions, DuckDB expressions where they differ)
SHAPES: dict[str, tuple[str, list[str], list[str] | None]] = {
    "v_pair": (
        "documents",
        [
            "doc_id AS source_id",
            "text AS input",
            "CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE source END AS target",
        ],
        None,
    ),
    "v_qa": (
        "documents",
        [
            "doc_id AS source_id",
            "text AS question",
            "CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL ELSE source END AS support",
            "CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS correct_answer",
        ],
        None,
    ),
    "v_marked": (
        "orders",
        [
            "o_orderkey AS source_id",
            "concat('order ', o_orderkey) AS question",
            "concat('work ', o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 "
            "THEN concat(' #### 1 #### ', o_custkey) ELSE concat(' #### ', o_custkey) END) AS answer",
        ],
        None,
    ),
    "v_mcq": (
        "part",
        [
            "p_partkey AS source_id",
            "p_name AS question",
            "array(p_name, p_brand, p_type, '') AS choices",
            "p_size % 6 - 1 AS answer",
            "CASE WHEN p_size % 9 = 0 THEN '' ELSE cast(p_size % 6 - 1 AS string) END AS label",
            "p_partkey % 10 = 0 AS pic_choice",
            "array(p_name, p_brand, p_type) AS answers",
            "array(p_size % 2, p_size % 3) AS labels",
        ],
        [
            "p_partkey AS source_id",
            "p_name AS question",
            "[p_name, p_brand, p_type, ''] AS choices",
            "p_size % 6 - 1 AS answer",
            "CASE WHEN p_size % 9 = 0 THEN '' ELSE cast(p_size % 6 - 1 AS varchar) END AS label",
            "p_partkey % 10 = 0 AS pic_choice",
            "[p_name, p_brand, p_type] AS answers",
            "[p_size % 2, p_size % 3] AS labels",
        ],
    ),
    "v_mcq_labeled": (
        "part",
        [
            "p_partkey AS source_id",
            "p_name AS question",
            "named_struct('text', array(p_name, p_brand, p_type, ''), 'label', array('A','B','C','D')) AS choices",
            "substr('ABCDE', p_size % 5 + 1, 1) AS answerKey",
        ],
        [
            "p_partkey AS source_id",
            "p_name AS question",
            "{'text': [p_name, p_brand, p_type, ''], 'label': ['A','B','C','D']} AS choices",
            "substr('ABCDE', p_size % 5 + 1, 1) AS answerKey",
        ],
    ),
    "v_instruction": (
        "documents",
        [
            "doc_id AS source_id",
            "concat(CASE doc_id % 5 WHEN 0 THEN 'Write CODE ' WHEN 1 THEN 'Decode ' WHEN 2 THEN 'Programming ' "
            "ELSE 'Tell ' END, lang) AS instruction",
            "CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END AS input",
            "CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE text END AS output",
        ],
        None,
    ),
    "v_options": (
        "part",
        [
            "p_partkey AS source_id",
            "p_name AS Problem",
            "array(concat('a ) ', p_name), concat('b ) ', p_brand), concat('C ) ', p_type), 'z') AS options",
            "substr('ABcX', p_size % 4 + 1, 1) AS correct",
        ],
        [
            "p_partkey AS source_id",
            "p_name AS Problem",
            "[concat('a ) ', p_name), concat('b ) ', p_brand), concat('C ) ', p_type), 'z'] AS options",
            "substr('ABcX', p_size % 4 + 1, 1) AS correct",
        ],
    ),
    "v_nested_dialog": (
        "part",
        [
            "p_partkey AS source_id",
            "array(named_struct('history', array(p_name, p_type), 'candidates', array(p_brand, p_type)), "
            "named_struct('history', filter(array(p_name), x -> p_size % 2 = 0), 'candidates', array(p_name))) "
            "AS utterances",
            "filter(array(p_brand, p_type), x -> p_partkey % 7 <> 0) AS solutions",
            "p_name AS problem",
            "CASE p_size % 4 WHEN 0 THEN array(p_name) WHEN 1 THEN array(p_name, p_brand) "
            "WHEN 2 THEN array(p_name, '', p_brand, p_type) ELSE array('', p_type, p_name, p_brand, p_name) END "
            "AS dialog",
        ],
        [
            "p_partkey AS source_id",
            "[{'history': [p_name, p_type], 'candidates': [p_brand, p_type]}, "
            "{'history': list_filter([p_name], lambda x: p_size % 2 = 0), 'candidates': [p_name]}] AS utterances",
            "list_filter([p_brand, p_type], lambda x: p_partkey % 7 <> 0) AS solutions",
            "p_name AS problem",
            "CASE p_size % 4 WHEN 0 THEN [p_name] WHEN 1 THEN [p_name, p_brand] "
            "WHEN 2 THEN [p_name, '', p_brand, p_type] ELSE ['', p_type, p_name, p_brand, p_name] END AS dialog",
        ],
    ),
    "v_chosen": (
        "part",
        [
            "p_partkey AS source_id",
            "concat(CASE WHEN p_size % 3 = 0 THEN 'Some code for ' ELSE 'On ' END, p_name) AS prompt",
            "array(named_struct('role', 'user', 'content', p_name), "
            "named_struct('role', 'assistant', 'content', CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END), "
            "named_struct('role', 'assistant', 'content', CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END), "
            "named_struct('role', 'user', 'content', p_type)) AS chosen",
        ],
        [
            "p_partkey AS source_id",
            "concat(CASE WHEN p_size % 3 = 0 THEN 'Some code for ' ELSE 'On ' END, p_name) AS prompt",
            "[{'role': 'user', 'content': p_name}, "
            "{'role': 'assistant', 'content': CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END}, "
            "{'role': 'assistant', 'content': CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END}, "
            "{'role': 'user', 'content': p_type}] AS chosen",
        ],
    ),
    "v_union": (
        "events",
        [
            "event_id AS source_id",
            "concat('q ', event_id) AS question",
            "CASE event_id % 4 WHEN 0 THEN concat('[\"', event_type, '\",\"x\"]') "
            "WHEN 1 THEN concat('\"', event_type, '\"') WHEN 2 THEN 'null' ELSE NULL END AS answer",
        ],
        None,
    ),
    "v_thread": (
        "conversations",
        [
            "conv_id * 1000 + turn AS message_id",
            "CASE WHEN turn = 0 THEN NULL WHEN turn < 4 THEN conv_id * 1000 + turn - 1 "
            "ELSE conv_id * 1000 + turn - 2 END AS parent_id",
            "role",
            "CASE WHEN (conv_id + turn) % 17 = 0 THEN '' ELSE text END AS text",
        ],
        None,
    ),
    "v_loss": (
        "events",
        [
            "user_id AS run",
            "event_id AS batch_idx",
            "CASE WHEN event_id % 50 = 0 THEN cast('NaN' AS double) ELSE value END AS loss",
            "CASE WHEN event_id % 6 = 0 THEN 1 ELSE 7 END AS label",
        ],
        None,
    ),
    "v_names": (
        "part",
        [
            "p_partkey AS seq",
            "concat(CASE p_size % 6 WHEN 0 THEN 'chunk_encoder' WHEN 1 THEN 'Aggregator' WHEN 2 THEN "
            "'reasoning_module' WHEN 3 THEN 'compressor_1' WHEN 4 THEN 'decompressor' ELSE 'head' END, '/', p_name) "
            "AS name",
            "CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 8 = 0 THEN cast(0 AS double) "
            "ELSE p_retailprice END AS grad_norm",
        ],
        None,
    ),
    "v_risk": (
        "part",
        [
            "p_partkey AS source_id",
            "concat('Contents\\nA01:2021 - ', p_name, '\\n', p_type, '\\nExample Scenario: ', p_brand, "
            "' Notable Common Weakness Enumerations ', p_type, p_name, ' Prevention ', p_type, "
            "'A02:2021 – ', p_brand, '\\nSee A03:2021 -\\nExample Scenario:', p_name) AS text",
        ],
        None,
    ),
    "v_risk_2023": (
        "part",
        [
            "p_partkey AS source_id",
            "concat('intro LLM01 is meant\\nLLM01:2025 ', p_name, '\\nDescription\\n', p_type, '\\nTypes of risk\\n1.\\n"
            "Prevention and Mitigation Strategies\\n', p_brand, '\\nExample Attack Scenarios\\n', p_type, ' ', p_size, "
            "'\\nReference Links\\nx', 'LLM02:2025 - ', p_brand, '\\nDescription\\n', p_name) AS text",
        ],
        None,
    ),
}


def view(name: str) -> Callable[[SparkSession, str], DataFrame]:
    source, expressions, _ = SHAPES[name]
    return lambda spark, sf_dir: table(spark, sf_dir, source).selectExpr(*expressions)


def raw_row(name: str, **renamed: str) -> Column:
    """The view's row as a struct of its table's columns; ``renamed`` maps new names to the view's."""
    names = {v: k for k, v in renamed.items()}
    fields = [e.rpartition(" AS ") for e in SHAPES[name][1]]
    return F.struct(*[F.expr(value or column).alias(names.get(column, column)) for value, _, column in fields])


def view_sql(name: str) -> str:
    """The view as DuckDB SQL."""
    source, expressions, other = SHAPES[name]
    text = f"SELECT {', '.join(other or expressions)} FROM {source}"
    return text.replace("\\n", "\n")


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One validation loss per run and epoch: a user's events in order."""
    from corpusloom.operators.blocks import ordinals

    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", "value")
    placed = ordinals(events, ["run"], "event_id", "_place")
    return placed.select("run", (F.col("_place") + 1).alias("epoch"), F.col("value").alias("val_loss"))


EPOCHS_SQL = (
    "SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, "
    "value AS val_loss FROM events"
)
