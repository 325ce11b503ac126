"""Column types: samples, intermediate tables and the raw datasets the adapters read."""

from __future__ import annotations

SAMPLE = (
    "source_id string, sample_no int, context string, target string, task string, dataset string, split string"
)
MESSAGE = "message_id string, parent_id string, role string, text string"

_QA = "question string, answer string"
_MESSAGES = "array<struct<role:string,content:string>>"
_CHOICES = "struct<text:array<string>,label:array<string>>"

# The fields each adapter reads, by dataset.
RAW: dict[str, str] = {
    "sciq": "support string, question string, correct_answer string",
    "gsm8k": _QA,
    "mmlu": "question string, choices array<string>, answer int",
    "arc_easy": f"question string, choices {_CHOICES}, answerKey string",
    "arc_challenge": f"question string, choices {_CHOICES}, answerKey string",
    "math": "problem string, solution string",
    "stem": "pic_choice boolean, problem string, choices array<string>, answer_idx int",
    "code_search_net": "docstring string, code string",
    "human_eval": "prompt string, canonical_solution string",
    "mbpp": "text string, code string",
    "daily_dialog": "dialog array<string>",
    "personachat": "utterances array<struct<history:array<string>,candidates:array<string>>>",
    "open_assistant": MESSAGE,
    "code_alpaca": "instruction string, input string, output string",
    "dolly": "instruction string, context string, response string",
    "truthfulqa": "question string, best_answer string",
    "kjv_bible": "Book string, Chapter int, Text string",
    "hellaswag": "ctx string, endings array<string>, label string",
    "bigbench_hard": "input string, target string",
    "apps": "problem string, solutions array<string>",
    "mathqa": "Problem string, options array<string>, correct string",
    "wizardlm": "instruction string, context string, response string",
    "strategyqa": "qid string, question string, answer boolean, evidence variant",
    "codecontests": "description string, solutions struct<solution:array<string>>",
    "natural_questions": "question string, answer variant",
    "aqua_rat": "question string, rationale string, correct string",
    "ultrafeedback": f"prompt string, chosen {_MESSAGES}",
    "bbh": "input string, target string",
    "wikiqa": "question string, answers array<string>, labels array<int>",
    "open_r1_math": "problem string, solution string",
    "nq_open": "question string, answer array<string>",
    "owasp": _QA,
    "alpaca": "instruction string, input string, output string",
}
