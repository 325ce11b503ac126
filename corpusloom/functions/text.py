"""Text columns: all of it stays in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Words that mark an instruction as a coding task.
CODE_WORDS = ("code", "programming")

PREVIEW_LENGTH = 200


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Strip whitespace of any script from both ends; null becomes the empty string."""
    return F.btrim(F.coalesce(as_column(c), F.lit("")), F.lit(WHITESPACE))


def has_text(c: Column | str) -> Column:
    """True where the column holds at least one character (null-safe)."""
    return F.coalesce(as_column(c) != "", F.lit(False))


def task_of(instruction: Column | str) -> Column:
    lowered = F.lower(as_column(instruction))
    found = F.lit(False)
    for word in CODE_WORDS:
        found = found | lowered.contains(word)
    return F.when(found, "code").otherwise("chat")


def norm_answer(c: Column | str) -> Column:
    """Answers are compared stripped and in lower case; null stays null, it means 'not answered'."""
    return F.lower(F.btrim(as_column(c), F.lit(WHITESPACE)))


def preview(c: Column | str, n: int = PREVIEW_LENGTH) -> Column:
    return F.concat(F.substring(F.coalesce(as_column(c), F.lit("")), 1, n), F.lit("..."))


def join_nonempty(first: Column, second: Column) -> Column:
    """``first + " " + second`` where first has text, else second alone."""
    return F.when(first != "", F.concat_ws(" ", first, second)).otherwise(second)


def python_bool(c: Column | str) -> Column:
    """True/False as Python prints them."""
    return F.initcap(as_column(c).cast("string"))


def words(c: Column | str) -> Column:
    """Whitespace tokens of a text; a blank text has none."""
    stripped = strip(c)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, r"\s+"))
