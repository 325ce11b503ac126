from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import filters
from corpusloom.operators.adapters import (
    ADAPTERS,
    SINGLE_ADAPTERS,
    adapt,
    adapt_beside,
    register_adapter,
    row_adapter,
    union_corpus,
)
from tests.conftest import rows

NAMES = (
    "sciq gsm8k mmlu arc_easy arc_challenge math stem code_search_net human_eval mbpp daily_dialog personachat "
    "open_assistant code_alpaca dolly truthfulqa kjv_bible hellaswag bigbench_hard apps mathqa wizardlm strategyqa "
    "codecontests natural_questions aqua_rat ultrafeedback bbh wikiqa open_r1_math nq_open owasp alpaca"
).split()


def run(spark, name, ddl, *data):
    """(source_id, context, target, task) of the adapter over rows numbered from 0."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], f"source_id long, {ddl}")
    return [(r[0], r[2], r[3], r[4]) for r in sorted(adapt(name, df).collect(), key=lambda r: (r[0], r[1]))]


def test_registry_is_complete():
    assert set(NAMES) <= set(ADAPTERS)
    assert len(NAMES) == 33


@pytest.mark.parametrize(
    ("name", "question", "answer", "task"),
    [
        ("bigbench_hard", "input", "target", "chat"),
        ("bbh", "input", "target", "chat"),
        ("truthfulqa", "question", "best_answer", "chat"),
        ("math", "problem", "solution", "code"),
        ("open_r1_math", "problem", "solution", "code"),
        ("code_search_net", "docstring", "code", "code"),
        ("human_eval", "prompt", "canonical_solution", "code"),
        ("mbpp", "text", "code", "code"),
    ],
)
def test_pairs(spark, name, question, answer, task):
    got = run(spark, name, f"{question} string, {answer} string", (" q ", "\ta\n"), ("q", "  "), (None, "a"), ("q", None))
    assert got == [(0, "q", "a", task)]


def test_missing_columns_reject(spark):
    for name in NAMES:
        df = spark.createDataFrame([(1, "x")], "source_id long, other string")
        assert adapt(name, df).count() == 0, name


def test_sciq(spark):
    got = run(spark, "sciq", "support string, question string, correct_answer string",
              (" s ", " q ", " a "), ("", "q", "a"), (None, "q", "a"), ("s", "", "a"), ("s", "q", " "))
    assert got == [(0, "s q", "a", "chat"), (1, "q", "a", "chat"), (2, "q", "a", "chat")]


def test_gsm8k(spark):
    got = run(spark, "gsm8k", "question string, answer string",
              ("q", "w #### 5"), ("q", "w #### 5 #### 6 "), ("q", " all "), ("q", "w #### "), ("q", None))
    assert [(g[0], g[2]) for g in got] == [(0, "5"), (1, "6"), (2, "all")]


def test_mmlu(spark):
    choices = ["a", " b ", ""]
    got = run(spark, "mmlu", "question string, choices array<string>, answer int",
              ("q", choices, 1), ("q", choices, -1), ("q", choices, 3), ("q", choices, 2), ("q", [], 0), ("q", None, 0), ("q", choices, None))
    assert got == [(0, "q", "b", "chat")]


def test_hellaswag(spark):
    endings = ["a", "b"]
    got = run(spark, "hellaswag", "ctx string, endings array<string>, label string",
              ("c", endings, "1"), ("c", endings, ""), ("c", endings, "-1"), ("c", endings, "2"), ("c", endings, "x"), ("c", endings, None))
    assert got == [(0, "c", "b", "chat")]


def test_arc(spark):
    ddl = "question string, choices struct<text:array<string>,label:array<string>>, answerKey string"
    choices = (["x", " y "], ["A", "B"])
    got = run(spark, "arc_challenge", ddl, ("q", choices, "B"), ("q", choices, "C"), ("q", None, "A"), ("q", choices, None))
    assert got == [(0, "q", "y", "chat")]


def test_stem(spark):
    ddl = "pic_choice boolean, problem string, choices array<string>, answer_idx int"
    got = run(spark, "stem", ddl, (False, "p", ["a"], 0), (True, "p", ["a"], 0), (None, "p", ["a"], 0), (False, "p", ["a"], 1), (False, "p", ["a"], -1))
    assert got == [(0, "p", "a", "chat"), (2, "p", "a", "chat")]


def test_daily_dialog(spark):
    got = run(spark, "daily_dialog", "dialog array<string>", ([],), (["a"],), ([" a", "b "],), (["a", " ", "c", "d"],), (None,), (["", "x"],))
    assert got == [
        (2, "a", "b", "chat"),
        (3, "a", "c", "chat"),
        (3, "a   c", "d", "chat"),
    ]


def test_personachat(spark):
    ddl = "utterances array<struct<history:array<string>,candidates:array<string>>>"
    got = run(spark, "personachat", ddl, ([(["h", "i"], ["x", " y "]), ([], ["x"]), (["h"], []), (["h"], ["z"])],), (None,))
    assert got == [(0, "h i", "y", "chat"), (0, "h", "z", "chat")]


def test_kjv(spark):
    verses = [("G", 1, f" v{i} ") for i in range(4)] + [("G", 2, f"w{i}") for i in range(3)] + [("H", 2, f"x{i}") for i in range(5)]
    got = run(spark, "kjv_bible", "Book string, Chapter int, Text string", *verses)
    assert got == [(3, "v0 v1 v2", "v3", "chat"), (10, "x0 x1 x2", "x3", "chat"), (11, "x1 x2 x3", "x4", "chat")]


@pytest.mark.parametrize(("name", "extra", "answer"), [("alpaca", "input", "output"), ("code_alpaca", "input", "output"), ("wizardlm", "context", "response")])
def test_instructions(spark, name, extra, answer):
    got = run(spark, name, f"instruction string, {extra} string, {answer} string",
              (" Decode ", " i ", " o "), ("Say", "", "o"), ("Say", None, "o"), ("", "i", "o"), ("Say", "i", " "), ("PROGRAMMING", None, "o"))
    assert got == [(0, "Decode i", "o", "code"), (1, "Say", "o", "chat"), (2, "Say", "o", "chat"), (5, "PROGRAMMING", "o", "code")]


def test_dolly(spark):
    got = run(spark, "dolly", "instruction string, context string, response string",
              ("ask", " back ", "r"), ("ask", "", "r"), ("", "code", "r"), ("ask code", "b", "r"), ("ask", "b", None))
    assert got == [(0, "back ask", "r", "chat"), (1, "ask", "r", "chat"), (3, "b ask code", "r", "code")]


def test_owasp_takes_both_spellings(spark):
    assert run(spark, "owasp", "question string, answer string", ("q", "a")) == [(0, "q", "a", "chat")]
    assert run(spark, "owasp", "context string, target string", (" q", "a")) == [(0, " q", "a", "chat")]


def test_mathqa(spark):
    ddl = "Problem string, options array<string>, correct string"
    options = ["a ) one", " B ) two ", "z ) no", "b", "b ) three"]
    got = run(spark, "mathqa", ddl, ("p", options, " A "), ("p", options, "b"), ("p", options, "c"), ("p", [], "d"), ("p", ["zz zz"], "e"), ("p", options, ""), ("", options, "a"))
    assert [(g[0], g[2]) for g in got] == [(0, ") one"), (1, ") three"), (3, "d"), (4, "e")]
    assert run(spark, "mathqa", "Problem string, options string, correct string", ("p", "a ) 1 , b ) 2", "B")) == [(0, "p", "b", "chat")]


def test_strategyqa(spark):
    got = run(spark, "strategyqa", "question string, answer boolean", ("q", True), ("q", False), ("q", None))
    assert [(g[0], g[2]) for g in got] == [(0, "True"), (1, "False")]


def test_solutions(spark):
    assert run(spark, "apps", "problem string, solutions array<string>", ("p", [" s ", "t"]), ("p", []), ("p", None)) == [(0, "p", "s", "code")]
    ddl = "description string, solutions struct<solution:array<string>>"
    assert run(spark, "codecontests", ddl, ("p", (["s"],)), ("p", ([],)), ("p", None)) == [(0, "p", "s", "code")]


def test_first_answer(spark):
    assert run(spark, "nq_open", "question string, answer array<string>", ("q", [" a ", "b"]), ("q", []), ("q", None)) == [(0, "q", "a", "chat")]
    assert run(spark, "natural_questions", "question string, answer string", ("q", " a "), ("q", None)) == [(0, "q", "a", "chat")]


def test_aqua_rat(spark):
    got = run(spark, "aqua_rat", "question string, rationale string, correct string", ("q", " r ", "A"), ("q", "", "B"), ("q", None, "C"), ("", "r", "D"))
    assert got == [(0, "q Rationale: r", "A", "chat"), (1, "q", "B", "chat"), (2, "q", "C", "chat")]


def test_ultrafeedback(spark):
    ddl = "prompt string, chosen array<struct<role:string,content:string>>"
    got = run(
        spark, "ultrafeedback", ddl,
        ("p", [("user", "u"), ("assistant", "a"), ("assistant", ""), ("user", "z")]),
        ("some code", [("assistant", "a"), ("assistant", " b ")]),
        ("p", [("assistant", "a"), ("assistant", "  ")]),
        ("p", []),
        ("p", None),
    )
    assert got == [(0, "p", "a", "chat"), (1, "some code", "b", "code")]
    assert run(spark, "ultrafeedback", "prompt string, chosen string", ("p", " c ")) == [(0, "p", "c", "chat")]
    df = spark.createDataFrame([(0, "p", '"text"'), (1, "p", '[{"role":"assistant","content":"x"}]')], "source_id long, prompt string, c string")
    parsed = df.select("source_id", "prompt", F.try_parse_json("c").alias("chosen"))
    assert [r[3] for r in rows(adapt("ultrafeedback", parsed))] == ["text", "x"]


def test_wikiqa(spark):
    ddl = "question string, answers array<string>, labels array<int>"
    got = run(spark, "wikiqa", ddl, ("q", ["a", " b ", "c"], [0, 1, 1]), ("q", ["a"], [0, 1]), ("q", ["a", "b"], [1]), ("q", ["a"], [0]), ("q", [], []))
    assert got == [(0, "q", " b ", "chat"), (2, "q", "a", "chat")]


def test_row_adapter(spark):
    def generate(row):
        for word in (row["words"] or []):
            yield {"context": row["ctx"], "target": word, "task": "chat"}

    register_adapter("by_hand")(row_adapter(generate))
    try:
        got = run(spark, "by_hand", "ctx string, words array<string>", ("c", ["x", "", "y"]), ("c", None))
    finally:
        del ADAPTERS["by_hand"]
    assert got == [(0, "c", "x", "chat"), (0, "c", "y", "chat")]


def test_adapters_run_without_python(spark):
    shapes = {
        "mathqa": "Problem string, options array<string>, correct string",
        "ultrafeedback": "prompt string, chosen array<struct<role:string,content:string>>",
        "daily_dialog": "dialog array<string>",
    }
    for name, ddl in shapes.items():
        df = spark.createDataFrame([], f"source_id long, {ddl}")
        plan = adapt(name, df)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan.replace("PythonRDD", ""), plan


def test_reject_report_adds_up(spark):
    df = spark.createDataFrame([("q", 1), ("", 1), ("q", -1), (None, None), ("q", None)], "q string, i int")
    rules = {"no question": ~filters.has_text("q"), "bad index": F.col("i") < 0}
    got = dict(rows(filters.rejects(df, rules)))
    assert got == {"no question": 2, "bad index": 1, "accepted": 2}


def test_union_counts_add_up(spark):
    df = spark.createDataFrame([(1, "q", "a")], "source_id long, input string, target string")
    part = adapt("bbh", df)
    union = union_corpus([("x", part), ("y", part)])
    assert rows(union.select("dataset", "seq")) == [("x", 0), ("y", 1)]


def test_beside_equals_one_by_one(spark):
    texts, answers = [" q ", "", None, "\t", "Write CODE"], [(0, True), (1, False), (-1, None)]
    cases = [(a, b, [a, b, "z"], k, p) for a in texts for b in texts for k, p in answers]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id long, a string, b string, list array<string>, k int, p boolean")
    fields = {
        "bbh": ["a AS input", "b AS target"],
        "mbpp": ["a AS text", "b AS code"],
        "alpaca": ["a AS instruction", "b AS input", "a AS output"],
        "dolly": ["a AS instruction", "b AS context", "b AS response"],
        "mmlu": ["a AS question", "list AS choices", "k AS answer"],
        "stem": ["a AS problem", "list AS choices", "k AS answer_idx", "p AS pic_choice"],
        "sciq": ["a AS question", "b AS correct_answer"],  # without its support
        "wikiqa": ["a AS question", "list AS answers", "array(k, 1) AS labels"],
        "mathqa": ["a AS Problem", "list AS options", "b AS correct"],
        "owasp": ["a AS context", "b AS target"],
    }
    raws = [(name, seq, ["id AS source_id", *exprs]) for seq, (name, exprs) in enumerate(fields.items())]
    alone = union_corpus([(name, adapt(name, df.selectExpr(*exprs))) for name, _, exprs in raws])
    beside = adapt_beside(df, [(name, seq, F.struct(*map(F.expr, exprs))) for name, seq, exprs in raws])
    assert rows(beside) == rows(alone)
    assert beside.dtypes == alone.dtypes
    assert {r["dataset"] for r in beside.collect()} == set(fields)
    plan = beside._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("struct(dataset, bbh") == 1, plan  # worked out once


def test_beside_keeps_copies_together(spark, tmp_path):
    """Files with a text's samples for eight datasets are not eight times as large."""
    words = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.md5(F.concat_ws("-", "id", i)))
    df = spark.range(2_000, numPartitions=1).select("id", F.array_join(words, " ").alias("text"))
    row = F.struct(F.col("id").alias("source_id"), F.col("text").alias("input"), F.lit("t").alias("target"))
    sizes = []
    for n in (1, 8):
        adapt_beside(df, [("bbh", seq, row) for seq in range(n)]).write.parquet(str(tmp_path / str(n)))
        sizes.append(sum(f.stat().st_size for f in (tmp_path / str(n)).glob("*.parquet")))
    assert sizes[1] < 2 * sizes[0]


def test_own_adapter_replaces_a_single_one(spark):
    before, single = ADAPTERS["bbh"], SINGLE_ADAPTERS["bbh"]
    register_adapter("bbh")(lambda df: before(df).withColumn("target", F.lit("own")))
    try:
        assert "bbh" not in SINGLE_ADAPTERS
    finally:
        ADAPTERS["bbh"], SINGLE_ADAPTERS["bbh"] = before, single
