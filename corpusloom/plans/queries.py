"""One query per operator, each over whole tables. Array results are joined into texts for comparison."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import arrays
from corpusloom.functions.text import has_text, preview, strip, task_of
from corpusloom.functions.unions import list_normalize
from corpusloom.operators import (
    filters,
    lookups,
    metrics,
    sampling,
    scorecard,
    sections,
    threads,
    tokens,
    vectors,
    windows,
)
from corpusloom.operators.adapters import (
    ADAPTERS,
    SINGLE_ADAPTERS,
    adapt,
    adapt_beside,
    labelled,
    row_adapter,
    union_corpus,
)
from corpusloom.operators.blocks import ordinals
from corpusloom.plans import corpus
from corpusloom.plans.views import SHAPES, epochs, raw_row, table, view
from corpusloom.session import cut_lineage, fresh_path, spread
from corpusloom.sources import catalog, tables
from corpusloom.streaming import groups, streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VOCABULARY_SIZE = 1_000
DIMS = 64
GROUP_SAMPLE = 100
SAMPLE_SIZE = 200
LISTED_NATIONS = ("NATION_7", "NATION_3", "NATION_21", "NATION_0", "NATION_12")
CENTS = "decimal(18,2)"

DOCUMENTS_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Queries that run one adapter over a view: the view, and the adapter's columns that it has under another name.
ADAPTED: dict[str, tuple[str, dict[str, str]]] = {}


def adapted(key: str, name: str, shape: str, **renamed: str) -> None:
    """A query that runs one adapter over a view; ``renamed`` maps the adapter's columns to the view's."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = view(shape)(spark, sf_dir).withColumnsRenamed({v: k for k, v in renamed.items()})
        return adapt(name, raw)

    QUERIES[key] = run
    ADAPTED[key] = (shape, renamed)


def joined(c: Column | str) -> Column:
    return F.array_join(F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("string")), " ")


def cells(df: DataFrame, vec: str) -> DataFrame:
    rest = [c for c in df.columns if c != vec]
    rows = df.select(*rest, F.posexplode(vec).alias("dim", "_x"))
    return rows.select(*rest, "dim", F.round(F.col("_x").cast("double"), 6).alias("x"))


# --- sources and sinks -------------------------------------------------------------------------------------------


@query
def src_read(spark, sf_dir):
    return tables.read_source(spark, f"{sf_dir}/documents.parquet", DOCUMENTS_SCHEMA)


@query
def src_reopen(spark, sf_dir):
    path = fresh_path(spark, "conversations")
    tables.materialize(spark, lambda: table(spark, sf_dir, "conversations"), path)
    return tables.open_dataset(spark, path)


def _dataset_no() -> Column:
    """Documents stand for the datasets of the catalogue by the number of their source."""
    return F.expr("int(substr(source, 4))")


@query
def src_catalog(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(_dataset_no().alias("seq"))
    rows = lookups.lookup(catalog.catalog(spark), metrics.counts(docs, "seq"), "seq")
    return rows.select(
        "seq",
        "name",
        "repo",
        "split",
        F.coalesce("config", F.lit("")).alias("config"),
        "trust_remote_code",
        "format",
        F.coalesce("row_cap", F.lit(0)).alias("row_cap"),
        F.coalesce("n_rows", F.lit(0)).alias("n_docs"),
    )


@query
def src_multi_config(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    return tables.capped_configs(docs, "lang", ["en", "fr", "de", "es"], "doc_id", None)


@query
def smp_per_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    return sampling.sample_per_group(docs, "lang", ["en", "fr", "de", "es"], "doc_id", GROUP_SAMPLE)


@query
def src_json(spark, sf_dir):
    props = F.from_json("props", "k int")
    return table(spark, sf_dir, "events").select("event_id", props["k"].alias("k"))


@query
def src_json_array(spark, sf_dir):
    """Events written as one file with one JSON array, read back by several tasks."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props", "value")
    note = F.concat(F.lit('} "\\{'), F.col("event_type"), F.lit("}]")).alias("note")  # braces and quotes inside strings
    nested = F.struct(F.col("event_id").alias("id"), F.array("event_type", "props").alias("words")).alias("of")
    first, last = events.agg(F.min("event_id"), F.max("event_id")).first()
    begin = F.when(F.col("event_id") == first, "[").otherwise("")
    end = F.when(F.col("event_id") == last, "]").otherwise(",")
    line = F.concat(begin, F.to_json(F.struct("event_id", note, nested)), end).alias("line")
    path = fresh_path(spark, "array")
    events.select("event_id", line).coalesce(1).sortWithinPartitions("event_id").select("line").write.text(path)
    kind = "event_id long, note string, of struct<id: long, words: array<string>>"
    rows = tables.read_json_array(spark, path, kind)
    return rows.select("event_id", "note", F.col("of.id").alias("id"), F.array_join("of.words", "|").alias("words"))


@query
def src_read_config(spark, sf_dir):
    """One configuration and split of a dataset that is stored by both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("config"))
    path = fresh_path(spark, "configs")
    tables.save(sampling.split_hash(docs, "doc_id"), path, by=("config", "split"))
    rows = tables.read_source(spark, path, config="en", split="train")
    return rows.select("doc_id", "text", "config", "split")


@query
def snk_json(spark, sf_dir):
    """JSON lines written and read back."""
    path = fresh_path(spark, "lines")
    tables.save_json(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return spark.read.schema("doc_id long, text string, lang string").json(path)


@query
def src_rebuild(spark, sf_dir):
    """A dataset that was written to the end is opened; one without its marker is built again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    whole, broken = fresh_path(spark, "whole"), fresh_path(spark, "broken")
    tables.materialize(spark, lambda: docs, whole)
    tables.materialize(spark, lambda: docs.withColumn("lang", F.lit("built twice")), whole)
    docs.limit(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(broken)
    tables.materialize(spark, lambda: docs.withColumn("lang", F.upper("lang")), broken)
    opened = tables.open_dataset(spark, whole).withColumn("path", F.lit("whole"))
    return opened.unionByName(tables.open_dataset(spark, broken).withColumn("path", F.lit("broken")))


@query
def ad_rows(spark, sf_dir):
    """An adapter written as a Python generator over one row."""

    def numbered(row):
        for place, choice in enumerate(row["choices"]):
            yield {"context": f"{row['question']} {place}", "target": choice, "task": "chat"}

    return row_adapter(numbered)(view("v_mcq")(spark, sf_dir).select("source_id", "question", "choices"))


@query
def tok_plugin(spark, sf_dir):
    """Ids by a tokenizer that the caller brings: here the code points of a text."""
    ids = tokens.tokenizer_ids(lambda: lambda text: [ord(c) for c in text])
    docs = table(spark, sf_dir, "documents").select("doc_id", ids(F.col("lang")).alias("ids"))
    return docs.select("doc_id", joined("ids").alias("ids"))


@query
def doc_parse_2023(spark, sf_dir):
    return sections.parse_sections(view("v_risk_2023")(spark, sf_dir), "text", 2023)


@query
def snk_parquet_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "dataset")
    path = fresh_path(spark, "corpus")
    tables.save(sampling.split_hash(docs, "doc_id"), path)
    return tables.open_dataset(spark, path).select("doc_id", "text", "dataset", "split")


def _scores(spark, sf_dir) -> DataFrame:
    marks = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    numbered = marks.withColumn("pos", _dataset_no())
    named = numbered.join(catalog.benchmark_order(spark), "pos").withColumnRenamed("name", "dataset")
    answers = named.select(
        "dataset", F.col("toxic").cast("string").alias("prediction"), F.col("quality").cast("string").alias("gold")
    )
    return metrics.exact_match(answers, "prediction", "gold", "dataset").withColumn("score", F.round("score", 6))


def _card(spark, sf_dir) -> DataFrame:
    return scorecard.scorecard(_scores(spark, sf_dir), catalog.published_scores(spark))


@query
def jn_scorecard(spark, sf_dir):
    return scorecard.scorecard_rows(_card(spark, sf_dir))


@query
def snk_scorecard_lines(spark, sf_dir):
    path = fresh_path(spark, "scorecard")
    tables.save_text(scorecard.scorecard_lines(_card(spark, sf_dir)), path)
    return spark.read.text(path)


@query
def src_page_concat(spark, sf_dir):
    return tables.page_texts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query
def src_manifest(spark, sf_dir):
    paths = {name: f"{sf_dir}/{name}.parquet" for name in [*TABLES, "absent"]}
    return tables.load_all(spark, paths).select("name", "status", F.coalesce("n_rows", F.lit(-1)).alias("n_rows"))


@query
def vocab_topk(spark, sf_dir):
    path = fresh_path(spark, "vocabulary")
    tables.save(_vocabulary_table(spark, sf_dir), path, by=())
    return tables.open_dataset(spark, path)


def _vocabulary_table(spark, sf_dir) -> DataFrame:
    return tokens.vocabulary(spread(table(spark, sf_dir, "documents").select("text")), "text", VOCABULARY_SIZE)


# --- projections and filters -------------------------------------------------------------------------------------


@query
def prj_strip(spark, sf_dir):
    wrapped = F.concat(F.lit(" \t "), F.col("text"), F.lit("  \n"))
    return table(spark, sf_dir, "documents").select("doc_id", strip(wrapped).alias("text"))


@query
def flt_required(spark, sf_dir):
    pairs = view("v_pair")(spark, sf_dir)
    stripped = pairs.select("source_id", strip("input").alias("input"), strip("target").alias("target"))
    return filters.require(stripped, "input", "target")


@query
def flt_valid(spark, sf_dir):
    rows = view("v_qa")(spark, sf_dir)
    return filters.valid_samples(
        rows.select("source_id", F.col("question").alias("context"), F.col("support").alias("target"), task_of("question").alias("task"))
    )


@query
def flt_lang(spark, sf_dir):
    return sampling.where_ci(table(spark, sf_dir, "documents"), "lang", "EN").select("doc_id", "lang")


@query
def flt_role(spark, sf_dir):
    return threads.assistant_messages(view("v_thread")(spark, sf_dir)).select("message_id", "text")


@query
def prj_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", preview("text").alias("preview"))


@query
def prj_task(spark, sf_dir):
    return view("v_instruction")(spark, sf_dir).select("source_id", task_of("instruction").alias("task"))


@query
def rpt_rejects(spark, sf_dir):
    choice = F.get("choices", F.col("answer"))
    rules = {
        "no question": ~has_text(strip("question")),
        "no choices": F.size("choices") == 0,
        "index below 0": F.col("answer") < 0,
        "index past the end": F.col("answer") >= F.size("choices"),
        "blank choice": strip(choice) == "",
    }
    return filters.rejects(view("v_mcq")(spark, sf_dir), rules)


@query
def rpt_empty_lists(spark, sf_dir):
    rules = {"no solution": F.size("solutions") == 0, "no problem": ~has_text(strip("problem"))}
    return filters.rejects(view("v_nested_dialog")(spark, sf_dir), rules)


@query
def rpt_adapters(spark, sf_dir):
    """What each adapter makes of its raw rows: accepted + rejected = rows."""
    shapes = {"hellaswag": "v_mcq", "sciq": "v_qa", "gsm8k": "v_marked", "daily_dialog": "v_nested_dialog"}
    renamed = {"hellaswag": {"question": "ctx", "choices": "endings"}}
    reports = []
    for name, shape in shapes.items():
        raw = view(shape)(spark, sf_dir).withColumnsRenamed(renamed.get(name, {}))
        reports.append(filters.adapter_report(raw, adapt(name, raw)).withColumn("dataset", F.lit(name)))
    return reduce(DataFrame.unionByName, reports)


@query
def flt_finite(spark, sf_dir):
    rows = view("v_loss")(spark, sf_dir).filter(windows.finite("loss"))
    return rows.select("run", "batch_idx", "loss")


@query
def cat_ordered(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    customers = metrics.counts(table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey")
    return catalog.ordered_subset(nations.join(customers, "n_nationkey"), LISTED_NATIONS).select("pos", "name", "n_rows")


# --- adapters ----------------------------------------------------------------------------------------------------

adapted("ad_pair", "bigbench_hard", "v_pair")
adapted("ad_pair_code", "math", "v_pair", problem="input", solution="target")
adapted("ad_best_answer", "truthfulqa", "v_pair", question="input", best_answer="target")
adapted("ad_docstring", "code_search_net", "v_pair", docstring="input", code="target")
adapted("ad_canonical", "human_eval", "v_pair", prompt="input", canonical_solution="target")
adapted("ad_text_code", "mbpp", "v_pair", text="input", code="target")
adapted("ad_instruction_context", "wizardlm", "v_instruction", context="input", response="output")
adapted("ad_question_answer", "owasp", "v_pair", question="input", answer="target")
adapted("ad_hellaswag", "hellaswag", "v_mcq", ctx="question", endings="choices")
adapted("ad_sciq", "sciq", "v_qa")
adapted("ad_gsm8k", "gsm8k", "v_marked")
adapted("ad_mmlu", "mmlu", "v_mcq")
adapted("ad_arc", "arc_easy", "v_mcq_labeled")
adapted("ad_stem", "stem", "v_mcq", problem="question", answer_idx="answer")
adapted("ad_dialog", "daily_dialog", "v_nested_dialog")
adapted("ad_persona", "personachat", "v_nested_dialog")
adapted("ad_thread", "open_assistant", "v_thread")
adapted("ad_first_solution", "apps", "v_nested_dialog")
adapted("ad_instruction", "alpaca", "v_instruction")
adapted("ad_mathqa", "mathqa", "v_options")
adapted("ad_rationale", "aqua_rat", "v_qa", rationale="support", correct="correct_answer")
adapted("ad_last_assistant", "ultrafeedback", "v_chosen")
adapted("ad_first_positive", "wikiqa", "v_mcq")
adapted("ad_dolly", "dolly", "v_instruction", context="input", response="output")


@query
def ad_sliding(spark, sf_dir):
    verses = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1_000 + F.col("turn")).alias("source_id"),
        F.lit("book").alias("Book"),
        F.col("conv_id").alias("Chapter"),
        F.col("text").alias("Text"),
    )
    return adapt("kjv_bible", verses)


@query
def ad_nested_solution(spark, sf_dir):
    rows = view("v_nested_dialog")(spark, sf_dir)
    return adapt(
        "codecontests",
        rows.select("source_id", F.col("problem").alias("description"), F.struct(F.col("solutions").alias("solution")).alias("solutions")),
    )


@query
def ad_bool(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("question"))
    marks = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("answer"))
    return adapt("strategyqa", marks.join(docs, "doc_id").withColumnRenamed("doc_id", "source_id"))


@query
def ad_first_answer(spark, sf_dir):
    return adapt("nq_open", view("v_union")(spark, sf_dir).withColumn("answer", F.try_parse_json("answer")))


@query
def fn_list_normalize(spark, sf_dir):
    items = list_normalize(F.try_parse_json("answer"))
    rows = view("v_union")(spark, sf_dir).withColumn("items", items)
    return rows.select("source_id", F.size("items").alias("n_items"), F.array_join("items", "|").alias("items"))


# --- joins -------------------------------------------------------------------------------------------------------


@query
def jn_thread_context(spark, sf_dir):
    paths = threads.thread_paths(view("v_thread")(spark, sf_dir))
    return paths.select("message_id", "root_id", "depth", F.coalesce("context", F.lit("")).alias("context"), "cyclic")


@query
def jn_config_lookup(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 7).alias("n_regionkey"))
    nations = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name")
    found = lookups.lookup(customers, nations, "n_regionkey", seq="n_nationkey")
    return found.select("c_custkey", "n_regionkey", F.coalesce("n_name", F.lit("none")).alias("n_name"))


@query
def jn_missing_anti(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nationkey"))
    rich = table(spark, sf_dir, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("nationkey"))
    return lookups.missing(customers, rich, "nationkey")


@query
def jn_semi_supported(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nationkey"))
    asia = table(spark, sf_dir, "region").filter("r_name = 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"))
    nations = lookups.supported(table(spark, sf_dir, "nation"), asia, "n_regionkey")
    return lookups.supported(customers, nations.select(F.col("n_nationkey").alias("nationkey")), "nationkey")


@query
def jn_eval_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(_dataset_no().alias("pos"))
    named = lookups.lookup(metrics.counts(docs, "pos"), catalog.benchmark_order(spark), "pos")
    return lookups.lookup(named, catalog.evaluation_splits(spark), "name").select(
        "name", F.coalesce("eval_split", F.lit("none")).alias("eval_split"), "n_rows"
    )


@query
def jn_evaluation_plan(spark, sf_dir):
    docs = metrics.counts(table(spark, sf_dir, "documents").select(_dataset_no().alias("pos")), "pos")
    planned = lookups.lookup(docs, corpus.evaluation_plan(spark), "pos")
    return planned.select("pos", "name", "repo", F.coalesce("eval_split", F.lit("none")).alias("eval_split"), "status", "n_rows")


@query
def jn_pair_predictions(spark, sf_dir):
    on = ["source_id", "sample_no"]
    gold = adapt("mmlu", view("v_mcq")(spark, sf_dir)).select(*on, "target")
    found = adapt("wikiqa", view("v_mcq")(spark, sf_dir)).select(*on, F.col("target").alias("prediction"))
    return lookups.pair(found, gold, on).select(*on, "target", F.coalesce("prediction", F.lit("")).alias("prediction"))


# --- aggregates --------------------------------------------------------------------------------------------------


@query
def agg_counts(spark, sf_dir):
    return metrics.counts(table(spark, sf_dir, "documents"), "source", "lang")


@query
def agg_accuracy(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    answers = marks.select("lang", F.col("toxic").cast("string").alias("prediction"), F.col("quality").cast("string").alias("gold"))
    return metrics.exact_match(answers, "prediction", "gold", "lang", scored=None).withColumn("score", F.round("score", 6))


def _finite_losses(spark, sf_dir) -> DataFrame:
    """Losses in cents, so that sums are exact in any order."""
    rows = view("v_loss")(spark, sf_dir)
    return rows.withColumn("loss", F.when(windows.finite("loss"), F.col("loss")).cast(CENTS))


@query
def agg_masked_mean(spark, sf_dir):
    rows = _finite_losses(spark, sf_dir)
    return metrics.masked_mean(rows, "loss", (F.col("label") != arrays.PAD_ID) & F.col("loss").isNotNull(), ["run"])


@query
def agg_epoch_mean(spark, sf_dir):
    return metrics.epoch_mean(_finite_losses(spark, sf_dir), "loss", ["run"])


@query
def agg_second_moment(spark, sf_dir):
    rows = vectors.second_moment(table(spark, sf_dir, "embeddings"), "label", "embedding", DIMS)
    return rows.withColumn("moment", F.round("moment", 6))


@query
def agg_weighted_drift(spark, sf_dir):
    """Mean vectors per label against their smallest and largest values, weighted by the second moment."""
    vecs = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "name")
    grouped = vecs.groupBy("name").agg(
        vectors.per_dim("embedding", DIMS, "avg({x})").alias("mean"),
        vectors.per_dim("embedding", DIMS, "min({x})").alias("low"),
        vectors.per_dim("embedding", DIMS, "max({x})").alias("high"),
        vectors.per_dim("embedding", DIMS, "avg({x} * {x})").alias("weight"),
    )
    current = grouped.select("name", F.posexplode("mean").alias("idx", "value"))
    kept = [
        grouped.select(
            F.lit(task_no).alias("task_no"), "name", F.posexplode(F.arrays_zip("weight", anchor)).alias("idx", "_p")
        ).select("task_no", "name", "idx", F.col("_p.weight").alias("importance"), F.col(f"_p.{anchor}").alias("anchor"))
        for task_no, anchor in enumerate(["low", "high"])
    ]
    drift = vectors.weighted_drift(current, kept[0].unionByName(kept[1]))
    return drift.withColumn("penalty", F.round("penalty", 4))


@query
def agg_l2(spark, sf_dir):
    rows = vectors.sum_squares(table(spark, sf_dir, "embeddings"), "embedding", ["label"], scale=1.0)
    return rows.withColumn("l2", F.round("l2", 6))


@query
def agg_duplicates(spark, sf_dir):
    return metrics.duplicates(table(spark, sf_dir, "documents"), "text", digest=True)


@query
def agg_component_rollup(spark, sf_dir):
    return metrics.component_rollup(view("v_names")(spark, sf_dir), "name", "grad_norm")


@query
def agg_islands(spark, sf_dir):
    return windows.island_summary(table(spark, sf_dir, "events"), ["user_id"], "event_id", ["event_type"])


@query
def agg_microbatch(spark, sf_dir):
    return windows.microbatch(_finite_losses(spark, sf_dir), ["run"], "batch_idx", "loss")


# --- windows -----------------------------------------------------------------------------------------------------


@query
def win_sliding_context(spark, sf_dir):
    rows = windows.sliding_context(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")
    return rows.select("conv_id", "turn", "context", "text")


@query
def win_prefix_context(spark, sf_dir):
    rows = windows.prefix_context(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")
    return rows.select("conv_id", "turn", "context", "text")


@query
def win_last_assistant(spark, sf_dir):
    said = (F.col("role") == "assistant") & has_text("text")
    return windows.last_row_where(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", said, "text")


@query
def win_running_avg(spark, sf_dir):
    rows = _finite_losses(spark, sf_dir).filter(F.col("loss").isNotNull())
    return windows.running_avg(rows, ["run"], "batch_idx", "loss", "avg_loss").select("run", "batch_idx", "avg_loss")


@query
def win_early_stop(spark, sf_dir):
    return windows.early_stop(epochs(spark, sf_dir), ["run"], "epoch", "val_loss")


@query
def win_checkpoints(spark, sf_dir):
    return windows.checkpoints(epochs(spark, sf_dir), ["run"], "epoch", "val_loss")


@query
def win_top3(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return windows.top_n(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order, 3).select("l_orderkey", "rn", *order)


def _far_apart(spark, sf_dir):
    """Events under an order with large, uneven gaps, as time-based ids have."""
    place = (F.col("event_id") * 1_000_003 + F.pmod(F.col("event_id") * 7919, F.lit(1000))).alias("place")
    return table(spark, sf_dir, "events").select("event_type", "user_id", place, F.col("value").cast("decimal(18,2)").alias("value"))


SPARSE_BLOCK_ROWS = 4_096


@query
def win_running_avg_sparse(spark, sf_dir):
    rows = _far_apart(spark, sf_dir)
    result = windows.running_avg(rows, ["event_type"], "place", "value", "avg_value", block_rows=SPARSE_BLOCK_ROWS)
    return result.select("event_type", "place", "avg_value")


@query
def agg_islands_sparse(spark, sf_dir):
    return windows.island_summary(_far_apart(spark, sf_dir), [], "place", ["event_type"], block_rows=SPARSE_BLOCK_ROWS)


# --- samples, splits, sets ---------------------------------------------------------------------------------------


@query
def smp_seeded(spark, sf_dir):
    return sampling.sample_seeded(table(spark, sf_dir, "documents"), "doc_id", SAMPLE_SIZE).select("doc_id", "text")


@query
def lim_first_n(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sampling.take_first(docs, F.lower("lang") == "en", "doc_id", SAMPLE_SIZE).select("doc_id", "text")


@query
def split_exact(spark, sf_dir):
    return sampling.split_exact(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query
def split_hash(spark, sf_dir):
    return sampling.split_hash(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query
def split_hash_shares(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("doc_id")
    shares = ((0.0, 0.5), (0.5, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0))
    parts = [
        sampling.split_hash(ids, "doc_id", test, val).select(F.lit(n).alias("variant"), "doc_id", "split")
        for n, (test, val) in enumerate(shares)
    ]
    return reduce(DataFrame.unionAll, parts)


@query
def split_by_thread(spark, sf_dir):
    answers = threads.thread_context(view("v_thread")(spark, sf_dir))
    return sampling.split_threads(answers, "message_id", "root_id").select("message_id", "root_id", "split")


@query
def set_corpus_union(spark, sf_dir):
    shapes = [("alpaca", "v_instruction"), ("mmlu", "v_mcq"), ("gsm8k", "v_marked"), ("sciq", "v_qa"), ("bbh", "v_pair")]
    return union_corpus([(name, adapt(name, view(shape)(spark, sf_dir))) for name, shape in shapes])


# One raw table per adapter: the query that runs it, for names that share an adapter the same one.
ADAPTER_QUERIES = {
    "alpaca": "ad_instruction", "code_alpaca": "ad_instruction", "wizardlm": "ad_instruction_context", "dolly": "ad_dolly",
    "open_assistant": "ad_thread", "daily_dialog": "ad_dialog", "personachat": "ad_persona", "mmlu": "ad_mmlu",
    "code_search_net": "ad_docstring", "human_eval": "ad_canonical", "mbpp": "ad_text_code", "apps": "ad_first_solution",
    "codecontests": "ad_nested_solution", "math": "ad_pair_code", "open_r1_math": "ad_pair_code", "mathqa": "ad_mathqa",
    "gsm8k": "ad_gsm8k", "aqua_rat": "ad_rationale", "strategyqa": "ad_bool", "sciq": "ad_sciq", "stem": "ad_stem",
    "arc_easy": "ad_arc", "arc_challenge": "ad_arc", "nq_open": "ad_first_answer", "natural_questions": "ad_first_answer",
    "hellaswag": "ad_hellaswag", "truthfulqa": "ad_best_answer", "ultrafeedback": "ad_last_assistant",
    "wikiqa": "ad_first_positive", "kjv_bible": "ad_sliding", "bigbench_hard": "ad_pair", "bbh": "ad_pair",
    "owasp": "ad_question_answer",
}


@query
def set_corpus_all(spark, sf_dir):
    """Every adapter's samples; ``seq`` is the dataset's place in the order of training.

    Datasets with one sample per row of a table are adapted in one pass over it, the others one by one.
    """
    if set(ADAPTER_QUERIES) != set(ADAPTERS):
        raise ValueError("an adapter without a raw table")
    parts, shared = [], {}
    for seq, name in enumerate(catalog.training_order(list(ADAPTERS))):
        key = ADAPTER_QUERIES[name]
        if key in ADAPTED and name in SINGLE_ADAPTERS:
            shape, renamed = ADAPTED[key]
            shared.setdefault(SHAPES[shape][0], []).append((name, seq, raw_row(shape, **renamed)))
        else:
            parts.append(labelled(QUERIES[key](spark, sf_dir), name, seq))
    passes = [adapt_beside(table(spark, sf_dir, source), raws) for source, raws in shared.items()]
    return reduce(DataFrame.unionByName, passes + parts)


@query
def corpus_build(spark, sf_dir):
    """Every dataset adapted, split and written; one without an adapter is only reported."""
    shapes = {"alpaca": "v_instruction", "mmlu": "v_mcq", "gsm8k": "v_marked", "open_assistant": "v_thread", "unknown": "v_pair"}
    out = fresh_path(spark, "corpus")
    sources = {name: lambda shape=shape: view(shape)(spark, sf_dir) for name, shape in shapes.items()}
    manifest = corpus.build_corpus(spark, sources, out).select(F.col("name").alias("dataset"), "status")
    counts = metrics.counts(corpus.open_corpus(spark, out), "dataset", "split", "task")
    return manifest.join(counts, "dataset", "left").select(
        "dataset",
        "status",
        F.coalesce("split", F.lit("none")).alias("split"),
        F.coalesce("task", F.lit("none")).alias("task"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )


@query
def corpus_slice(spark, sf_dir):
    """Dialogue prefixes -> samples -> split by conversation -> size and mean context length; only lengths travel."""
    rows = windows.prefix_lengths(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")
    kept = filters.require(rows.withColumn("target", strip("text")), "target").filter("context_chars > 0")
    tagged = sampling.split_hash(kept, "conv_id").withColumn("task", task_of("target"))
    return tagged.groupBy("split", "task").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.countDistinct("conv_id").alias("n_conversations"),
        F.round(F.avg("context_chars"), 6).alias("mean_context_chars"),
    )


# --- tokens ------------------------------------------------------------------------------------------------------


def _vocabulary(spark, sf_dir) -> list[str]:
    return tokens.vocabulary_words(_vocabulary_table(spark, sf_dir))


def _encoded(spark, sf_dir) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return tokens.encode(docs, "text", _vocabulary(spark, sf_dir)).select("doc_id", "tokens")


@query
def tok_encode(spark, sf_dir):
    return _encoded(spark, sf_dir).select("doc_id", F.size("tokens").alias("n_tokens"), joined("tokens").alias("tokens"))


@query
def tok_decode(spark, sf_dir):
    rows = tokens.decode(_encoded(spark, sf_dir), "tokens", _vocabulary(spark, sf_dir))
    return rows.select("doc_id", "text")


@query
def tok_encode_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = cut_lineage(tokens.vocabulary(docs.select("text"), "text", VOCABULARY_SIZE), "vocabulary")
    rows = tokens.encode_join(docs, "doc_id", "text", vocab)
    return rows.select("doc_id", F.size("tokens").alias("n_tokens"), joined("tokens").alias("tokens"))


@query
def tok_decode_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = cut_lineage(tokens.vocabulary(docs.select("text"), "text", VOCABULARY_SIZE), "vocabulary")
    return tokens.decode_join(tokens.encode_join(docs, "doc_id", "text", vocab), "doc_id", "tokens", vocab)


@query
def tok_target_pad(spark, sf_dir):
    return _encoded(spark, sf_dir).select("doc_id", joined(arrays.target_ids("tokens")).alias("target_ids"))


@query
def tok_mask(spark, sf_dir):
    rows = _encoded(spark, sf_dir).withColumn("target_ids", arrays.target_ids("tokens"))
    mask = F.transform(arrays.pad_mask("target_ids"), lambda m: m.cast("int"))
    return rows.select("doc_id", arrays.filled("target_ids").alias("n_filled"), joined(mask).alias("mask"))


@query
def tok_prepend(spark, sf_dir):
    rows = _encoded(spark, sf_dir)
    mask = F.transform(arrays.prepend_mask(arrays.pad_mask("tokens")), lambda m: m.cast("int"))
    return rows.select("doc_id", joined(arrays.prepend("tokens")).alias("tokens"), joined(mask).alias("mask"))


@query
def tok_chunks(spark, sf_dir):
    return tokens.chunk_tokens(_encoded(spark, sf_dir)).withColumn("tokens", joined("tokens"))


@query
def tok_blocks(spark, sf_dir):
    return tokens.token_blocks(_encoded(spark, sf_dir))


@query
def tok_next_pairs(spark, sf_dir):
    rows = tokens.next_token_pairs(_encoded(spark, sf_dir))
    return rows.select("doc_id", joined("inputs").alias("inputs"), joined("labels").alias("labels"))


@query
def bat_padded(spark, sf_dir):
    rows = tokens.padded_batches(_encoded(spark, sf_dir), "doc_id", batch_size=4)
    return rows.withColumn("tokens", joined("tokens"))


@query
def bat_consecutive(spark, sf_dir):
    rows = tokens.consecutive_batches(_encoded(spark, sf_dir), "doc_id", batch_size=4)
    return rows.withColumn("tokens", joined("tokens"))


@query
def bat_samples(spark, sf_dir):
    """Samples to padded batches: contexts padded to the longest of their batch, targets of fixed length."""
    pairs = adapt("bbh", spread(view("v_pair")(spark, sf_dir)))
    rows = corpus.tokenise(pairs, _vocabulary(spark, sf_dir))
    batches = tokens.padded_batches(rows, "source_id", "context_tokens", batch_size=4)
    return batches.select(
        "shard",
        "batch_no",
        "pos",
        "source_id",
        "task",
        joined("context_tokens").alias("context_tokens"),
        joined("target_tokens").alias("target_tokens"),
    )


# --- vectors -----------------------------------------------------------------------------------------------------


@query
def emb_tree(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return cells(vectors.embedding_tree(rows, "label", "vec_id", "embedding", DIMS), "embedding")


@query
def emb_pad_nodes(spark, sf_dir):
    placed = ordinals(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", "pos")
    batched = placed.withColumn("batch_no", F.expr("int(label div 4)"))
    return cells(vectors.pad_vectors(batched, "batch_no", "label", "pos", "embedding", DIMS), "embedding")


@query
def emb_concat(spark, sf_dir):
    return cells(vectors.concat_pairs(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding"), "embedding")


# --- sections ----------------------------------------------------------------------------------------------------


@query
def doc_sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sections.split_sections(docs, "text", r"\n").drop("text")


@query
def doc_fields(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        sections.extract_field(html, r"(?s)<title>(.+?)(?=</title>|\z)").alias("title"),
        sections.extract_field(html, r"(?s)<article>(.+?)(?=</article>|\z)").alias("body"),
        sections.extract_field(html, r"(?s)<blockquote>(.+?)(?=</blockquote>|\z)").alias("quoted"),
    )


@query
def doc_parse(spark, sf_dir):
    return sections.parse_sections(view("v_risk")(spark, sf_dir), "text", 2021)


@query
def doc_qa_pairs(spark, sf_dir):
    parsed = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("source_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("description"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("examples"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("prevention"),
    )
    return sections.qa_pairs(parsed, "title", 2021)


# --- streams -----------------------------------------------------------------------------------------------------


@query
def str_filter_take(spark, sf_dir):
    out = fresh_path(spark, "taken")
    rows = streams.read_table_stream(spark, f"{sf_dir}/documents.parquet", DOCUMENTS_SCHEMA)
    matches = F.lower("lang") == "en"
    streams.stream_take(rows, matches, "doc_id", SAMPLE_SIZE, out, fresh_path(spark, "state")).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "text")


@query
def str_adapt(spark, sf_dir):
    out = fresh_path(spark, "adapted")
    docs = streams.read_table_stream(spark, f"{sf_dir}/documents.parquet", DOCUMENTS_SCHEMA)
    pairs = docs.select(F.col("doc_id").alias("source_id"), F.col("text").alias("input"), F.col("source").alias("target"))
    adapted_rows = streams.adapt_stream(pairs, "bigbench_hard")
    streams.stream_to_table(adapted_rows, out, fresh_path(spark, "state")).awaitTermination()
    return spark.read.parquet(out)


@query
def str_adapt_groups(spark, sf_dir):
    out = fresh_path(spark, "threads")
    schema = "conv_id bigint, turn bigint, role string, text string"
    landed = fresh_path(spark, "landed")  # in files that cut every thread, one for each batch
    spark.read.schema(schema).parquet(f"{sf_dir}/conversations.parquet").repartition(3).write.parquet(landed)
    turns = streams.read_stream(spark, landed, schema, files_per_batch=1)
    messages = turns.selectExpr(*SHAPES["v_thread"][1])
    streams.adapt_group_stream(messages, "open_assistant", out, fresh_path(spark, "state")).awaitTermination()
    samples = adapt("open_assistant", spark.createDataFrame([], messages.schema)).schema
    return groups.read_samples(spark, out, samples).drop("batch")


@query
def str_running_loss(spark, sf_dir):
    out = fresh_path(spark, "losses")
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    events = streams.read_table_stream(spark, f"{sf_dir}/events.parquet", schema)
    cents = events.select(F.col("user_id").alias("run"), F.col("value").cast(CENTS).alias("value"))
    streams.running_loss_stream(cents, "run", "value", out, fresh_path(spark, "state")).awaitTermination()
    return streams.latest_loss(spark, out, "run")
