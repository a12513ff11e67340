"""Arrays: division by a scalar, rows out of elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: list[str], array_col: str, out: str) -> DataFrame:
    """One row per array element; rows with an empty array vanish.

    The plain ``explode`` lets the optimizer infer a filter on the array's size,
    which is pushed to the scan and computes the whole array a second time.  The
    outer form is not rewritten, so the array is computed once.
    """
    return df.select(*keep, F.explode_outer(array_col).alias(out)).filter(F.col(out).isNotNull())


def inline_rows(df: DataFrame, keep: list[str], array_col: str, first: str) -> DataFrame:
    """As ``explode_rows`` for an array of structs, whose field ``first`` is never null."""
    return df.select(*keep, F.inline_outer(array_col)).filter(F.col(first).isNotNull())


def divide_all(values: Column, divisor: Column) -> Column:
    """Every element divided by one number.

    A divisor named inside a lambda would be computed again for each element; as
    an argument it is computed once per row.
    """
    return F.zip_with(values, F.array_repeat(divisor, F.size(values)), lambda v, d: v / d)
