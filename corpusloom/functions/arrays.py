"""Array and vector columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import as_column

# Special token ids.
MARKER_ID = 0
PAD_ID = 1
BEGIN_ID = 2
END_ID = 3
UNKNOWN_ID = 4
FIRST_WORD_ID = 5

TARGET_LENGTH = 512


def first_where(arr: Column | str, predicate: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(as_column(arr), predicate), F.lit(0))


def last_where(arr: Column | str, predicate: Callable[[Column], Column]) -> Column:
    kept = F.filter(as_column(arr), predicate)
    return F.get(kept, F.size(kept) - 1)


def last(arr: Column | str) -> Column:
    arr = as_column(arr)
    return F.get(arr, F.size(arr) - 1)


def zip_shortest(a: Column | str, b: Column | str, names: tuple[str, str]) -> Column:
    """Pairs up to the shorter of two lists, as structs with the given field names."""
    a, b = as_column(a), as_column(b)
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(
        F.slice(a, F.lit(1), n).alias(names[0]),
        F.slice(b, F.lit(1), n).alias(names[1]),
    )


def pad_to(arr: Column | str, length: Column | int, value: Column | int) -> Column:
    arr = as_column(arr)
    length = F.lit(length) if isinstance(length, int) else length
    value = F.lit(value) if isinstance(value, int) else value
    return F.concat(arr, F.array_repeat(value, F.greatest(length - F.size(arr), F.lit(0))))


def target_ids(tokens: Column | str, length: int = TARGET_LENGTH, cut: bool = False) -> Column:
    """Begin mark, body, end mark, padded to ``length``; a longer body stays whole unless ``cut`` asks otherwise.

    With ``cut`` both marks are kept and every result has ``length`` ids.
    """
    body = F.slice(as_column(tokens), 1, length - 2) if cut else as_column(tokens)
    marked = F.concat(F.array(F.lit(BEGIN_ID)), body, F.array(F.lit(END_ID)))
    return pad_to(marked, length, PAD_ID)


def pad_mask(tokens: Column | str, pad_id: int = PAD_ID) -> Column:
    return F.transform(as_column(tokens), lambda t: t != pad_id)


def filled(tokens: Column | str, pad_id: int = PAD_ID) -> Column:
    """Number of tokens that are no padding."""
    return F.size(F.filter(as_column(tokens), lambda t: t != pad_id))


def prepend(tokens: Column | str, token_id: int = MARKER_ID) -> Column:
    return F.concat(F.array(F.lit(token_id)), as_column(tokens))


def prepend_mask(mask: Column | str) -> Column:
    return F.concat(F.array(F.lit(True)), as_column(mask))


def concat_vectors(a: Column | str, b: Column | str) -> Column:
    return F.concat(as_column(a), as_column(b))
