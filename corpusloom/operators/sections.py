"""Documents cut into sections at their headings, fields of a section, and question-answer pairs from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import has_text, strip


@dataclass(frozen=True)
class Form:
    """How one kind of document is written, as Java regular expressions.

    ``heading`` stands before a title on the same line. ``fields`` are taken from the section, each by the first
    group of its pattern; ``named_fields`` are searched in the whole text: what follows the first marker right behind the
    section's title, up to the second pattern or the end.
    """

    heading: str
    fields: dict[str, str]
    named_fields: dict[str, tuple[str, str]] = field(default_factory=dict)

    @property
    def cut(self) -> str:
        return self.heading + r"\S"

    @property
    def title(self) -> str:
        return f"^{self.heading}" + r"(\S[^\n]*)"


# Headings and markers of the two editions of the security top-ten list.
FORMS = {
    2021: Form(
        heading=r"A\d{2}\s*:\s*2021[ \t]*[-–—][ \t]*",
        fields={
            "description": r"(?s)^[^\n]*\n(.*?)Example Scenario:",
            "examples": r"(?s)Example Scenario:(.+?)(?=Notable Common Weakness\s+Enumerations|\z)",
        },
        named_fields={"prevention": (r"\s*Prevention", r"A\d{2}\s*:\s*2021")},
    ),
    2023: Form(
        heading=r"LLM\d{2}\s*[:–—]?\s*202[0-5]?[ \t]*[-–—]?[ \t]*",
        fields={
            "description": r"(?s)Description(.+?)(?=Types of|Common Examples of|Prevention and Mitigation|\z)",
            "examples": r"(?s)Example Attack Scenarios(.+?)(?=Reference Links|\z)",
            "prevention": r"(?s)Prevention and Mitigation Strategies(.+?)"
            r"(?=Example Attack Scenarios|Reference Links|\z)",
        },
    ),
}

# Question templates per field; the arguments are title and year.
TEMPLATES = {
    "description": "What is %s according to the %d OWASP Top 10?",
    "examples": "What are some examples of %s in the %d OWASP Top 10?",
    "prevention": "How can %s be prevented as per the %d OWASP Top 10?",
}


def section_texts(text: Column, heading: str) -> Column:
    """An array of the text from each heading match to the next one, or the end. Text before the first is dropped."""
    return F.filter(F.split(text, f"(?={heading})"), lambda p: p.rlike(f"^(?:{heading})"))


def split_sections(df: DataFrame, text: str, heading: str) -> DataFrame:
    """One row per section, with the other columns.

    The outer form, because before a plain one Spark puts a filter that cuts every text once more.
    """
    parts = F.posexplode_outer(section_texts(F.col(text), heading)).alias("section_no", "section")
    return df.select("*", parts).filter(F.col("section").isNotNull())


def extract_field(section: Column, pattern: str) -> Column:
    return strip(F.regexp_extract(section, pattern, 1))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however deep in lambdas the body names it."""
    return F.transform(F.array(value), body)[0]


def _marks(text: Column, marker: str) -> Column:
    """Where each match of the marker begins and ends in the text, by the lengths of what lies between: one pass."""
    gaps = F.split(text, marker, -1)
    found = F.regexp_extract_all(text, F.lit(marker), F.lit(0))
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own")))
    kind = "array<struct<begin: int, end: int>>"
    return F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("marks")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + x["own"]).alias("at"),
            F.concat(
                s["marks"],
                F.array(F.struct((s["at"] + x["gap"]).alias("begin"), (s["at"] + x["gap"] + x["own"]).alias("end"))),
            ).alias("marks"),
        ),
        lambda s: s["marks"],
    )


def _behind(text: Column, marks: Column, title: Column, until: str) -> Column:
    """What follows the first mark that stands right behind the title."""
    name = F.replace(title, F.lit(r"\E"), F.lit(""))
    size = F.length(name)
    fits = F.filter(
        marks,
        lambda m: (m["begin"] >= size) & (m["end"] < F.length(text)) & (F.substring(text, m["begin"] - size + 1, size) == name),
    )
    rest = F.substring(text, F.get(fits, F.lit(0))["end"] + 1, F.length(text))
    return strip(F.coalesce(F.regexp_extract(rest, rf"(?s)^(.+?)(?={until}|\z)", 1), F.lit("")))


def parse_sections(df: DataFrame, text: str, year: int) -> DataFrame:
    """One row per section with its title and fields.

    Sections and marks are found in one pass each and stay in the document's row until their fields are cut, so no text
    is copied per section and no pattern is built per row.
    """
    form, whole = FORMS[year], F.col(text)
    named = list(form.named_fields)

    def fields(section: Column, marks: list[Column]) -> Column:
        def of(title: Column) -> Column:
            own = [extract_field(section, pattern).alias(name) for name, pattern in form.fields.items()]
            behind = [_behind(whole, m, title, form.named_fields[n][1]).alias(n) for n, m in zip(named, marks, strict=True)]
            return F.struct(title.alias("title"), *own, *behind)

        return _let(strip(F.regexp_extract(section, form.title, 1)), of)

    def each(marks: list[Column]) -> Column:
        if len(marks) < len(named):
            return _let(_marks(whole, form.named_fields[named[len(marks)]][0]), lambda m: each([*marks, m]))
        return F.transform(section_texts(whole, form.cut), lambda s: fields(s, marks))

    rest = [c for c in df.columns if c != text]
    rows = df.select(*rest, F.posexplode_outer(each([])).alias("section_no", "_s")).filter(F.col("_s").isNotNull())
    return rows.select(*rest, "section_no", "_s.*")


def qa_pairs(df: DataFrame, title: str, year: int, templates: dict[str, str] | None = None) -> DataFrame:
    """Up to one (context, target) pair per field and section, for the fields that have a text."""
    fields = templates or TEMPLATES
    rest = [c for c in df.columns if c != title and c not in fields]
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("field"),
                F.format_string(template, F.col(title), F.lit(year)).alias("context"),
                F.col(name).alias("target"),
            )
            for name, template in fields.items()
        ]
    )
    return (
        df.select(*rest, F.inline(F.filter(pairs, lambda p: has_text(p["target"]))))
        .withColumn("task", F.lit("chat"))
    )
