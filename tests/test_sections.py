from __future__ import annotations

import random
import re

from corpusloom.operators import sections
from tests.conftest import rows

TEXT_2021 = (
    "Overview of all risks\n"
    "6A01:2021 – Broken Locks \nA door was open.\nExample Scenario:\nSomebody came in. "
    "https://example.com/doorNotable Common Weakness \nEnumerations (list)\n34 55%Broken Locks Prevention\n9•Close the door."
    "A02:2021 - Weak Keys\nExample Scenario:\nA key was copied.Notable Common Weakness Enumerations\n"
    "see A04:2021 –\nfor more\nWeak Key Prevention\nUse better keys."
    "A03: 2021 — Lost (Keys)\nExample Scenario: lost"
)

TEXT_2023 = (
    "intro LLM01 is meant\n"
    "LLM01:2025 Bad Input\nDescription\nInput is bad.\nTypes of bad input\n1.\n"
    "Prevention and Mitigation Strategies\nCheck it.\nExample Attack Scenarios\nAn attack.\nReference Links\nx"
    "LLM02:2025 - Leaks\nDescription\nThings leak."
)


def parse(spark, text, year):
    df = spark.createDataFrame([("doc", text)], "doc string, text string")
    return sections.parse_sections(df, "text", year)


def test_2021_form(spark):
    got = rows(parse(spark, TEXT_2021, 2021).select("section_no", "title", "description", "examples", "prevention"))
    assert got == [
        (0, "Broken Locks", "A door was open.", "Somebody came in. https://example.com/door", "9•Close the door."),
        (1, "Weak Keys", "", "A key was copied.", ""),
        (2, "Lost (Keys)", "", "lost", ""),
    ]


def test_2023_form(spark):
    got = rows(parse(spark, TEXT_2023, 2023).select("section_no", "title", "description", "examples", "prevention"))
    assert got == [
        (0, "Bad Input", "Input is bad.", "An attack.", "Check it."),
        (1, "Leaks", "Things leak.", "", ""),
    ]


def test_no_sections(spark):
    for text in ("", None, "no heading"):
        assert parse(spark, text, 2021).count() == 0


def test_qa_pairs(spark):
    parsed = parse(spark, TEXT_2021, 2021)
    got = rows(sections.qa_pairs(parsed, "title", 2021).drop("section_no"))
    assert ("doc", "description", "What is Broken Locks according to the 2021 OWASP Top 10?", "A door was open.", "chat") in got
    assert len(got) == 5


def test_split_keeps_all_text_after_the_first_heading(spark):
    df = spark.createDataFrame([(TEXT_2021,)], "text string")
    heading = sections.FORMS[2021].cut
    parts = [r["section"] for r in sections.split_sections(df, "text", heading).orderBy("section_no").collect()]
    assert "".join(parts) == TEXT_2021[TEXT_2021.index("A01") :]


def test_fields_behind_titles_equal_a_pattern_per_title(spark):
    """Random texts with markers at odd places, against the pattern that searches each title in the whole text."""
    rng = random.Random(8)
    bits = ["A01:2021 - Risk", "A02 : 2021 – Risk two", "A03:2021-Prevention", "\n", " ", "Prevention", "Risk", "Risk two", "x", "\t", "Example Scenario:"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    form = sections.FORMS[2021]
    expected = []
    for doc, text in enumerate(texts):
        parts = [p for p in re.split(f"(?={form.cut})", text) if re.match(form.cut, p)]
        for number, part in enumerate(parts):
            title = re.search("^" + form.heading + r"(\S[^\n]*)", part)
            title = title.group(1).strip() if title else ""
            found = re.search("(?s)" + re.escape(title) + r"\s*Prevention(.+?)(?=A\d{2}\s*:\s*2021|\Z)", text)
            expected.append((doc, number, title, found.group(1).strip() if found else ""))
    parsed = sections.parse_sections(df, "text", 2021).select("doc", "section_no", "title", "prevention")
    assert sorted(map(tuple, parsed.collect())) == sorted(expected)


def test_one_pass_per_document(spark):
    df = spark.createDataFrame([("doc", TEXT_2021)], "doc string, text string")
    plan = sections.parse_sections(df, "text", 2021)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1 and "isnotnull(text" not in plan.split("Generate")[0].replace("_s", "")
    assert len(re.findall(r"split\(text", plan)) == 2  # sections, and what lies between the marks
