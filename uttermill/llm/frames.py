"""Small DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..plans.staging import batches_of, batches_up_to  # noqa: F401

NO_ID = (1 << 63) - 1  # stands for a null id: after every other


def named(column: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def row_key(id_col: str, text_col: str) -> list[Column]:
    """(doc, tag): a row's id and the 64-bit hash of its text.

    Rows that repeat an id with another text are thus told apart; rows that repeat
    both share whatever is computed for them.
    """
    text = F.coalesce(named(text_col), F.lit(""))
    return [
        F.coalesce(named(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).alias("tag"),
    ]


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that names of an operator cannot clash with them."""
    return F.struct(*[named(c).alias(c) for c in df.columns]).alias("row")


def with_fields(rows: DataFrame, columns: list[str], **fields: DataType) -> StructType:
    """Schema of some columns of ``rows``, whatever their names, followed by further fields."""
    return StructType([rows.schema[c] for c in columns] + [StructField(n, t) for n, t in fields.items()])


def crc_remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(named(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def bounded_share(rows: DataFrame, key: str, max_rows: int) -> DataFrame:
    """Rows whose hashed key falls into a share that is expected to hold ``max_rows`` of them."""
    share = min(1.0, max_rows / max(1, rows.count()))
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), named(key)), F.lit(1 << 30)) < int(share * (1 << 30)))


def one_row_each(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """One row per combination of ``keys``: that of the text with the least hash.

    Combined on the map side, so an id with any number of rows never gathers in a task.
    """
    first = F.min_by(F.col(text_col), F.struct(F.xxhash64(text_col), F.length(text_col)))
    return rows.groupBy(*keys).agg(first.alias(text_col))
