"""The catalogue of datasets, their order, evaluation splits, caps and published scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from corpusloom.session import local_table

CATALOG_SCHEMA = (
    "seq int, name string, repo string, split string, config string, trust_remote_code boolean, "
    "format string, row_cap int"
)

# Fixed values: (name, repository, split, configuration, trust remote code).
CATALOG = [
    ("code_search_net", "code_search_net", "train", None, True),
    ("human_eval", "openai_humaneval", "test", None, False),
    ("mbpp", "google-research-datasets/mbpp", "train", None, False),
    ("mmlu", "cais/mmlu", "test", "all", False),
    ("open_r1_math", "open-r1/OpenR1-Math-220k", "train", None, True),
    ("sciq", "allenai/sciq", "train", None, False),
    ("gsm8k", "openai/gsm8k", "train", "main", False),
    ("arc_easy", "allenai/ai2_arc", "train", "ARC-Easy", False),
    ("arc_challenge", "allenai/ai2_arc", "train", "ARC-Challenge", False),
    ("stem", "stemdataset/STEM", "train", None, False),
    ("daily_dialog", "daily_dialog", "train", None, True),
    ("personachat", "bavard/personachat_truecased", "train", None, True),
    ("open_assistant", "OpenAssistant/oasst1", "train", None, False),
    ("code_alpaca", "sahil2801/CodeAlpaca-20k", "train", None, False),
    ("alpaca", "tatsu-lab/alpaca", "train", None, False),
    ("dolly", "databricks/databricks-dolly-15k", "train", None, False),
    ("truthfulqa", "truthfulqa/truthful_qa", "validation", "generation", True),
    ("kjv_bible", "JDRJ/kjv-bible", "train", None, False),
    ("hellaswag", "Rowan/hellaswag", "train", None, False),
    ("apps", "codeparrot/apps", "train", None, True),
    ("mathqa", "allenai/math_qa", "train", None, True),
    ("strategyqa", "tau/strategyqa", "train", None, False),
    ("codecontests", "deepmind/code_contests", "train", None, False),
    ("nq_open", "google-research-datasets/nq_open", "train", None, True),
    ("aqua_rat", "deepmind/aqua_rat", "train", None, False),
    ("ultrafeedback", "HuggingFaceH4/ultrafeedback_binarized", "train_sft", None, False),
]

# Rows kept of the large datasets, and the configurations of the one that has several.
ROW_CAPS = {"nq_open": 5_000, "ultrafeedback": 5_000, "aqua_rat": 5_000, "apps": 5_000, "codecontests": 3_000}
MULTI_CONFIG_CAP = 5_000
MULTI_CONFIGS = (
    "boolean_expressions",
    "causal_judgement",
    "date_understanding",
    "logical_deduction_five_objects",
    "object_counting",
    "word_sorting",
)

# Datasets that come as one JSON array; all others are columnar.
JSON_DATASETS = ("strategyqa",)

# The order in which datasets are used.
BENCHMARK_ORDER = (
    "alpaca", "dolly", "open_assistant", "code_alpaca",
    "daily_dialog", "personachat",
    "mmlu",
    "code_search_net", "human_eval", "mbpp", "apps", "codecontests",
    "open_r1_math", "mathqa", "gsm8k", "aqua_rat", "strategyqa",
    "sciq", "stem",
    "arc_easy", "arc_challenge", "nq_open",
    "hellaswag", "truthfulqa", "ultrafeedback",
)

# The split each dataset is evaluated on.
EVALUATION_SPLITS = {
    "sciq": "train",
    "dolly": "train",
    "math": "train",
    "stem": "train",
    "code_search_net": "train",
    "daily_dialog": "train",
    "open_assistant": "train",
    "code_alpaca": "train",
    "alpaca": "train",
    "personachat": "train",
    "mmlu": "test",
    "arc_easy": "test",
    "arc_challenge": "test",
    "gsm8k": "test",
    "human_eval": "test",
    "mbpp": "test",
    "truthfulqa": "validation",
    "kjv_bible": "train",
}

# Published scores per dataset and model.
PUBLISHED_SCORES = {
    "mmlu": {
        "GPT-3.5 Turbo": 70.0,
        "GPT-4": 86.4,
        "GPT-4 Turbo": 86.5,
        "GPT-4o": 88.7,
        "GPT-4.1": 90.2,
        "Claude 3 Opus": 86.8,
        "Claude 3.5 Sonnet": 88.7,
        "Gemini 1.5 Pro": 81.9,
        "Gemini 2.5 Pro": 89.8,
        "Grok 3": 92.7,
    },
    "arc_easy": {
        "GPT-3.5 Turbo": 85.2,
        "GPT-4": 96.3,
        "GPT-4o": 95.0,
        "Claude 3.5 Sonnet": 94.0,
        "Gemini 1.5 Pro": 93.5,
    },
    "arc_challenge": {
        "GPT-3.5 Turbo": 85.2,
        "GPT-4": 96.3,
        "GPT-4o": 94.8,
        "Claude 3.5 Sonnet": 93.0,
        "Gemini 1.5 Pro": 92.0,
    },
    "gsm8k": {
        "GPT-3.5 Turbo": 57.1,
        "GPT-4": 92.0,
        "GPT-4o": 94.0,
        "Claude 3 Opus": 95.0,
        "Claude 3.5 Sonnet": 96.4,
        "Gemini 1.5 Pro": 91.7,
        "Grok 3": 89.3,
    },
    "human_eval": {
        "GPT-3.5 Turbo": 48.1,
        "GPT-4": 67.0,
        "GPT-4o": 90.2,
        "Claude 3 Opus": 84.9,
        "Claude 3.5 Sonnet": 92.0,
        "Gemini 1.5 Pro": 71.9,
        "Grok 3": 86.5,
    },
    "mbpp": {
        "GPT-4": 75.0,
        "GPT-4o": 80.0,
        "Claude 3.5 Sonnet": 78.0,
        "Gemini 1.5 Pro": 76.0,
    },
    "truthfulqa": {
        "GPT-3.5 Turbo": 47.0,
        "GPT-4": 59.0,
        "GPT-4o": 60.0,
        "Claude 3.5 Sonnet": 62.0,
        "Gemini 1.5 Pro": 58.0,
    },
}


def catalog(spark: SparkSession) -> DataFrame:
    rows = [
        (seq, *entry, "json" if entry[0] in JSON_DATASETS else "parquet", ROW_CAPS.get(entry[0]))
        for seq, entry in enumerate(CATALOG)
    ]
    return local_table(spark, rows, CATALOG_SCHEMA)


def name_list(spark: SparkSession, names: Sequence[str], column: str = "name") -> DataFrame:
    return local_table(spark, [(n, i) for i, n in enumerate(names)], f"{column} string, pos int")


def benchmark_order(spark: SparkSession) -> DataFrame:
    return name_list(spark, BENCHMARK_ORDER)


def evaluation_splits(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(EVALUATION_SPLITS.items()), "name string, eval_split string")


def published_scores(spark: SparkSession) -> DataFrame:
    rows = [(d, m, s) for d, scores in PUBLISHED_SCORES.items() for m, s in scores.items()]
    return local_table(spark, rows, "dataset string, model string, score double")


def ordered_subset(df: DataFrame, names: Sequence[str], column: str = "name") -> DataFrame:
    """Rows whose name is listed, in the order of the list."""
    return df.join(name_list(df.sparkSession, names, column), column).orderBy("pos")


def training_order(names: Sequence[str]) -> list[str]:
    """The names in the order they are used: the listed ones first, then the others by name."""
    listed = [n for n in BENCHMARK_ORDER if n in names]
    return listed + sorted(set(names) - set(listed))
