"""Fields that hold a list, a single value or null, carried as Variant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import as_column


def is_list(v: Column | str) -> Column:
    return F.coalesce(F.schema_of_variant(as_column(v)).startswith("ARRAY"), F.lit(False))


def is_missing(v: Column | str) -> Column:
    v = as_column(v)
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def first_or_self(v: Column | str) -> Column:
    """First element of a list, the value itself otherwise, null where there is none."""
    v = as_column(v)
    return F.when(is_missing(v), F.lit(None).cast("string")).otherwise(
        F.when(is_list(v), F.try_variant_get(v, "$[0]", "string")).otherwise(F.try_variant_get(v, "$", "string"))
    )


def printed(v: Column) -> Column:
    """A scalar as Python prints it."""
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(is_missing(v), F.lit("None"))
        .when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(text))
        .otherwise(text)
    )


def list_normalize(v: Column | str) -> Column:
    """List -> list of strings, null -> empty list, scalar -> list of one."""
    v = as_column(v)
    return (
        F.when(is_missing(v), F.array().cast("array<string>"))
        .when(is_list(v), F.transform(F.try_variant_get(v, "$", "array<variant>"), printed))
        .otherwise(F.array(printed(v)))
    )
