"""Adapters: raw dataset rows -> samples (source_id, sample_no, context, target, task).

An adapter takes the whole raw table and returns 0..n samples per row, as column expressions. A missing column
counts as its default, a null text as empty, and an index outside its list as null; samples without a context or
target are dropped. ``source_id`` names the raw row and is an integer where an adapter depends on row order.

Most datasets have one sample per row. Their adapters only say what its columns are, so those of several datasets can
be taken from one reading of a table that they share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.arrays import first_where, last, last_where, zip_shortest
from corpusloom.functions.text import has_text, join_nonempty, python_bool, strip, task_of
from corpusloom.functions.unions import first_or_self
from corpusloom.operators.threads import thread_targets
from corpusloom.operators.windows import islands, sliding_context

SOURCE_ID = "source_id"

@dataclass(frozen=True)
class Nested:
    """A raw row that is a struct column of a table."""

    column: str
    schema: T.StructType

    @property
    def columns(self) -> list[str]:
        return self.schema.names


Raw = DataFrame | Nested
Sample = tuple[Column, Column, Column | str]  # context, target, task
Adapter = Callable[[DataFrame], DataFrame]
SingleAdapter = Callable[[Raw], Sample]
ADAPTERS: dict[str, Adapter] = {}
SINGLE_ADAPTERS: dict[str, SingleAdapter] = {}


def register_adapter(*names: str) -> Callable[[Adapter], Adapter]:
    """Make ``fn(df) -> samples`` known under the given dataset names."""

    def add(fn: Adapter) -> Adapter:
        for name in names:
            ADAPTERS[name] = fn
            SINGLE_ADAPTERS.pop(name, None)
        return fn

    return add


def register_single_adapter(*names: str) -> Callable[[SingleAdapter], SingleAdapter]:
    """The same for ``fn(raw) -> (context, target, task)`` of the one sample that a raw row has."""

    def add(fn: SingleAdapter) -> SingleAdapter:
        register_adapter(*names)(lambda df: samples(df, *fn(df)))
        SINGLE_ADAPTERS.update(dict.fromkeys(names, fn))
        return fn

    return add


def adapt(name: str, df: DataFrame) -> DataFrame:
    return ADAPTERS[name](df)


def field(raw: Raw, name: str, ddl: str = "string") -> Column:
    """The column, or a null of that type where the table lacks it."""
    if name not in raw.columns:
        return F.lit(None).cast(ddl)
    return F.col(raw.column)[name] if isinstance(raw, Nested) else F.col(name)


def text(raw: Raw, name: str) -> Column:
    return strip(field(raw, name).cast("string"))


def samples(
    df: DataFrame,
    context: Column,
    target: Column,
    task: Column | str,
    sample_no: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    task = F.lit(task) if isinstance(task, str) else task
    number = F.lit(0) if sample_no is None else sample_no
    return df.select(
        *keep,
        SOURCE_ID,
        number.cast("int").alias("sample_no"),
        context.alias("context"),
        target.alias("target"),
        task.alias("task"),
    ).filter(has_text("context") & has_text("target"))


def pair_adapter(context: str, target: str, task: str = "chat") -> SingleAdapter:
    """One text column answers another."""
    return lambda raw: (text(raw, context), text(raw, target), task)


register_single_adapter("bigbench_hard", "bbh")(pair_adapter("input", "target"))
register_single_adapter("truthfulqa")(pair_adapter("question", "best_answer"))
register_single_adapter("math", "open_r1_math")(pair_adapter("problem", "solution", "code"))
register_single_adapter("code_search_net")(pair_adapter("docstring", "code", "code"))
register_single_adapter("human_eval")(pair_adapter("prompt", "canonical_solution", "code"))
register_single_adapter("mbpp")(pair_adapter("text", "code", "code"))


def instruction_adapter(context_field: str = "context", target_field: str = "response") -> SingleAdapter:
    """Instruction, then its input if there is one; the instruction's words decide the task."""

    def adapter(raw: Raw) -> Sample:
        instruction, extra = text(raw, "instruction"), text(raw, context_field)
        context = F.when(extra != "", F.concat_ws(" ", instruction, extra)).otherwise(instruction)
        return F.when(instruction != "", context), text(raw, target_field), task_of(instruction)

    return adapter


register_single_adapter("wizardlm")(instruction_adapter())
register_single_adapter("alpaca", "code_alpaca")(instruction_adapter("input", "output"))


@register_single_adapter("dolly")
def dolly(raw: Raw) -> Sample:
    """Here the background comes before the instruction."""
    instruction = text(raw, "instruction")
    context = F.when(instruction != "", join_nonempty(text(raw, "context"), instruction))
    return context, text(raw, "response"), task_of(instruction)


@register_single_adapter("owasp")
def question_answer(raw: Raw) -> Sample:
    """Both spellings of the generated pairs: question/answer and context/target."""
    question = F.coalesce(field(raw, "question"), field(raw, "context"))
    return question, F.coalesce(field(raw, "answer"), field(raw, "target")), "chat"


@register_single_adapter("sciq")
def sciq(raw: Raw) -> Sample:
    question = text(raw, "question")
    context = F.when(question != "", join_nonempty(text(raw, "support"), question))
    return context, text(raw, "correct_answer"), "chat"


@register_single_adapter("aqua_rat")
def rationale(raw: Raw) -> Sample:
    question, why = text(raw, "question"), text(raw, "rationale")
    context = F.when(why != "", F.concat(question, F.lit(" Rationale: "), why)).otherwise(question)
    return F.when(question != "", context), text(raw, "correct"), "chat"


@register_single_adapter("gsm8k")
def marked_answer(raw: Raw) -> Sample:
    """The answer is what follows the last mark, or all of it without a mark."""
    answer = F.coalesce(field(raw, "answer"), F.lit(""))
    return text(raw, "question"), strip(F.substring_index(answer, "#### ", -1)), "chat"


@register_single_adapter("mmlu")
def indexed_choice(raw: Raw) -> Sample:
    answer = field(raw, "answer", "int").cast("int")
    target = strip(F.get(field(raw, "choices", "array<string>"), answer))
    return text(raw, "question"), target, "chat"


@register_single_adapter("hellaswag")
def labelled_ending(raw: Raw) -> Sample:
    """The index comes as a text."""
    label = field(raw, "label").cast("string").try_cast("int")
    return text(raw, "ctx"), strip(F.get(field(raw, "endings", "array<string>"), label)), "chat"


@register_single_adapter("stem")
def text_choice(raw: Raw) -> Sample:
    """Rows whose choices are pictures are left out."""
    shown = ~F.coalesce(field(raw, "pic_choice", "boolean"), F.lit(False))
    index = field(raw, "answer_idx", "int").cast("int")
    target = strip(F.get(field(raw, "choices", "array<string>"), index))
    return F.when(shown, text(raw, "problem")), target, "chat"


@register_single_adapter("arc_easy", "arc_challenge")
def keyed_choice(raw: Raw) -> Sample:
    """The answer key is looked up among the labels, the choice stands at the same place."""
    choices = field(raw, "choices", "struct<text:array<string>,label:array<string>>")
    place = F.array_position(choices["label"], field(raw, "answerKey")) - 1
    return text(raw, "question"), strip(F.get(choices["text"], place.cast("int"))), "chat"


@register_single_adapter("mathqa")
def lettered_option(raw: Raw) -> Sample:
    """Options like "a ) text": the last one with the wanted letter; without any usable option the letter itself."""
    correct = F.lower(text(raw, "correct"))
    options = field(raw, "options", "array<string>")
    if "options" in raw.columns and not isinstance(raw.schema["options"].dataType, T.ArrayType):
        options = F.lit(None).cast("array<string>")
    parsed = F.filter(F.transform(options, strip), lambda o: (F.length(o) > 2) & F.lower(o).rlike("^[a-e]"))
    wanted = last_where(parsed, lambda o: F.lower(F.substring(o, 1, 1)) == correct)
    found = strip(F.substring(wanted, 3, 1 << 30))
    usable = F.coalesce(F.size(parsed), F.lit(0)) > 0
    target = F.when(correct != "", F.when(usable, found).otherwise(correct))
    return text(raw, "Problem"), target, "chat"


@register_single_adapter("strategyqa")
def yes_no(raw: Raw) -> Sample:
    return text(raw, "question"), strip(python_bool(field(raw, "answer", "boolean"))), "chat"


@register_single_adapter("apps")
def first_solution(raw: Raw) -> Sample:
    solution = strip(F.get(field(raw, "solutions", "array<string>"), F.lit(0)))
    return text(raw, "problem"), solution, "code"


@register_single_adapter("codecontests")
def first_nested_solution(raw: Raw) -> Sample:
    solutions = field(raw, "solutions", "struct<solution:array<string>>")["solution"]
    return text(raw, "description"), strip(F.get(solutions, F.lit(0))), "code"


@register_single_adapter("natural_questions", "nq_open")
def first_answer(raw: Raw) -> Sample:
    """The answer is a list or a text; a field that can be either comes as Variant."""
    answer = field(raw, "answer")
    kind = raw.schema["answer"].dataType if "answer" in raw.columns else T.StringType()
    if isinstance(kind, T.ArrayType):
        answer = F.get(answer, F.lit(0))
    elif isinstance(kind, T.VariantType):
        answer = first_or_self(answer)
    return text(raw, "question"), strip(answer), "chat"


@register_single_adapter("ultrafeedback")
def last_assistant(raw: Raw) -> Sample:
    """The last assistant message that has content; or the field itself where it is a text."""
    prompt = text(raw, "prompt")
    chosen = field(raw, "chosen", "array<struct<role:string,content:string>>")
    kind = raw.schema["chosen"].dataType if "chosen" in raw.columns else T.ArrayType(T.StringType())
    if isinstance(kind, T.VariantType):
        messages = F.try_variant_get(chosen, "$", "array<struct<role:string,content:string>>")
        plain = F.try_variant_get(chosen, "$", "string")
        answer = F.when(F.schema_of_variant(chosen) == "STRING", plain).otherwise(_last_content(messages))
    elif isinstance(kind, T.ArrayType):
        answer = _last_content(chosen)
    else:
        answer = chosen
    return prompt, strip(answer), task_of(prompt)


def _last_content(messages: Column) -> Column:
    return last_where(messages, lambda m: (m["role"] == "assistant") & has_text(m["content"]))["content"]


@register_single_adapter("wikiqa")
def first_positive(raw: Raw) -> Sample:
    """The first answer labelled 1, as it is."""
    zipped = zip_shortest(
        field(raw, "answers", "array<string>"), field(raw, "labels", "array<int>"), ("answer", "label")
    )
    return text(raw, "question"), first_where(zipped, lambda p: p["label"] == 1)["answer"], "chat"


@register_adapter("daily_dialog")
def dialog(df: DataFrame) -> DataFrame:
    """Every beginning of a dialogue, then the utterance after it."""
    rows = df.select(SOURCE_ID, field(df, "dialog", "array<string>").alias("dialog"))
    turns = F.size("dialog")
    later = F.when(turns >= 2, F.sequence(F.lit(1), turns - 1))
    numbered = rows.select(SOURCE_ID, "dialog", F.explode(later).alias("_turn"))
    context = strip(F.array_join(F.slice("dialog", F.lit(1), F.col("_turn")), " ", ""))
    return samples(numbered, context, strip(F.get("dialog", F.col("_turn"))), "chat", F.col("_turn") - 1)


@register_adapter("personachat")
def persona(df: DataFrame) -> DataFrame:
    """Each utterance's history, then its last candidate."""
    utterances = field(df, "utterances", "array<struct<history:array<string>,candidates:array<string>>>")
    numbered = df.select(SOURCE_ID, F.posexplode(utterances).alias("_no", "_u"))
    context = strip(F.array_join("_u.history", " ", ""))
    return samples(numbered, context, strip(last("_u.candidates")), "chat", F.col("_no"))


@register_adapter("kjv_bible")
def verses(df: DataFrame) -> DataFrame:
    """Three verses, then the next one of the same chapter; chapters are runs of rows with equal book and chapter."""
    book, chapter = (field(df, name).alias(name) for name in ("Book", "Chapter"))
    chapters = islands(
        df.select(SOURCE_ID, book, chapter, text(df, "Text").alias("verse")), [], SOURCE_ID, ["Book", "Chapter"]
    )
    windows = sliding_context(chapters, ["island"], SOURCE_ID, "verse")
    return samples(windows, F.col("context"), F.col("verse"), "chat")


@register_adapter("open_assistant")
def threads(df: DataFrame) -> DataFrame:
    """Assistant messages with the texts above them.

    Numbered rows may repeat a message id: the last one stands for it above other messages. Without numbers the
    ids are unique and serve as ``source_id``.
    """
    return thread_samples(df).drop("root_id")


def thread_samples(df: DataFrame) -> DataFrame:
    """Thread samples with the id of their root message."""
    numbered = [SOURCE_ID] if SOURCE_ID in df.columns else []
    fields = [field(df, name).alias(name) for name in ("message_id", "parent_id", "role", "text")]
    answers = thread_targets(df.select(*numbered, *fields), order=SOURCE_ID if numbered else None)
    if not numbered:
        answers = answers.withColumn(SOURCE_ID, F.col("message_id"))
    return samples(answers, F.col("context"), F.col("target"), "chat", keep=["root_id"])


def row_adapter(generate: Callable[[dict], Iterable[dict]]) -> Adapter:
    """An adapter from a Python generator over one row, for shapes that columns cannot express.

    ``generate`` takes a row as a dict and yields dicts with context, target and task. It runs row by row in
    Python workers; prefer column expressions.
    """

    def adapter(df: DataFrame) -> DataFrame:
        @F.udtf(returnType="sample_no int, context string, target string, task string")
        class Rows:
            def eval(self, row) -> Iterator[tuple]:
                for number, sample in enumerate(generate(row.asDict(recursive=True))):
                    yield number, sample.get("context"), sample.get("target"), sample.get("task")

        packed = df.select(SOURCE_ID, F.struct(*df.columns).alias("_row"))
        rows = packed.lateralJoin(Rows(F.col("_row").outer()))
        return samples(rows, F.col("context"), F.col("target"), F.col("task"), F.col("sample_no"))

    return adapter


def adapt_beside(df: DataFrame, raws: Sequence[tuple[str, int, Column]]) -> DataFrame:
    """Samples of datasets that share one raw table, with their dataset's name and place, from one reading of it.

    ``raws`` has each dataset's name, its place and its raw row as a struct of the table's columns. The samples of a row
    stay together: a text that several datasets use is read once and lies in files next to its copies, where their
    compression finds them.
    """
    rows = df.select(*[row.alias(f"_{seq}") for _, seq, row in raws])
    beside = []
    for name, seq, _ in raws:
        raw = Nested(f"_{seq}", rows.schema[f"_{seq}"].dataType)
        context, target, task = SINGLE_ADAPTERS[name](raw)
        beside.append(
            F.struct(
                F.lit(name).alias("dataset"),
                F.lit(seq).alias("seq"),
                field(raw, SOURCE_ID).cast("string").alias(SOURCE_ID),
                F.lit(0).alias("sample_no"),
                context.alias("context"),
                target.alias("target"),
                (F.lit(task) if isinstance(task, str) else task).alias("task"),
            )
        )
    # never empty; the plain inline would filter by the array's size first and work out every sample twice
    several = rows.select(F.inline_outer(F.array(*beside)))
    return several.filter(has_text("context") & has_text("target"))


def labelled(part: DataFrame, name: str, seq: int) -> DataFrame:
    """Samples with their dataset's name and its place in the order of datasets."""
    return part.select(
        F.lit(name).alias("dataset"),
        F.lit(seq).alias("seq"),
        F.col(SOURCE_ID).cast("string").alias(SOURCE_ID),
        "sample_no",
        "context",
        "target",
        "task",
    )


def union_corpus(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """All samples with their dataset's name and its place in the given order."""
    return reduce(DataFrame.unionByName, [labelled(part, name, seq) for seq, (name, part) in enumerate(parts)])
