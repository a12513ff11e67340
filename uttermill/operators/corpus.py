"""Columns, labels, ids and cleaning of a labelled corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import INTENTS, MIN_CLEAN_CHARS
from ..functions import text as tx
from ..functions.scores import label_id
from ..plans.ranking import with_ordinal


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail at once, without a job, when a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    return df


def filter_valid_labels(df: DataFrame, labels=INTENTS, label_col: str = "intent") -> DataFrame:
    return df.filter(F.col(label_col).isin(list(labels)))


def encode_label(df: DataFrame, labels=INTENTS, label_col: str = "intent", out: str = "label") -> DataFrame:
    """Label id by list position; null for an unlisted label."""
    return df.withColumn(out, label_id(list(labels), F.col(label_col)))


def class_counts(df: DataFrame, label_col: str = "intent") -> DataFrame:
    """Rows per class, largest first."""
    return (
        df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label_col)
    )


def assign_base_id(
    df: DataFrame,
    order_col: str = "ord",
    label_col: str = "intent",
    prefix: str = "",
    out: str = "base_id",
    partitions: int | None = None,
) -> DataFrame:
    """Id from the class and the 1-based running count of the class in input order.

    Pass narrow rows, as ``with_ordinal`` stages them.
    """
    return (
        with_ordinal(df, order_col, label_col, "_k", partitions)
        .withColumn(out, F.format_string(f"{prefix}%s_%03d", F.col(label_col), F.col("_k")))
        .drop("_k")
    )


def assign_base_ids(
    df: DataFrame, second: str, prefix: str, order_col: str = "ord", label_col: str = "intent", out: str = "base_id"
) -> DataFrame:
    """As ``assign_base_id`` for two corpora in one pass: rows where ``second`` holds are numbered by
    themselves and get the prefix.  A null class is a class of each corpus."""
    group = F.concat_ws("\u0000", F.col(second).cast("string"), label_col)
    numbered = with_ordinal(df.withColumn("_both", group), order_col, "_both", "_k")
    name = F.format_string("%s%s_%03d", F.when(F.col(second), prefix).otherwise(""), F.col(label_col), F.col("_k"))
    return numbered.withColumn(out, name).drop("_both", "_k")


def assign_fallback_id(
    df: DataFrame,
    order_col: str = "ord",
    label_col: str = "intent",
    out: str = "base_id",
    partitions: int | None = None,
) -> DataFrame:
    """Id from the class and the 0-based position in the whole frame; pass narrow rows."""
    return (
        with_ordinal(df, order_col, None, "_k", partitions)
        .withColumn(out, F.format_string("%s_%03d", F.col(label_col), F.col("_k") - 1))
        .drop("_k")
    )


def with_clean_columns(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add clean_text, emojis and excess_punct_count.

    Each step is its own projection, so shared work runs once per row, and texts
    without emojis or repeated punctuation skip the passes that would change nothing.
    """
    plain, punct = F.col("_plain"), F.col("excess_punct_count")
    return (
        df.withColumn("_text", tx.strip(text_col))
        .withColumn("_emo", F.col("_text").rlike(tx.EMOJI_RUN))
        .withColumn("emojis", F.when(F.col("_emo"), tx.find_emojis(F.col("_text"))).otherwise(""))
        .withColumn("_plain", F.when(F.col("_emo"), tx.blank_emojis(F.col("_text"))).otherwise(F.col("_text")))
        .withColumn("excess_punct_count", F.regexp_count("_plain", F.lit(tx.PUNCT_RUN)))
        .withColumn("_plain", F.when(punct > 0, tx.squeeze_punct(plain)).otherwise(plain))
        .withColumn("clean_text", tx.collapse_spaces(tx.squeeze_elongation(plain)))
        .drop("_text", "_emo", "_plain")
    )


def filter_short(df: DataFrame, min_chars: int = MIN_CLEAN_CHARS, text_col: str = "clean_text") -> DataFrame:
    """Keep texts of at least ``min_chars`` code points.

    A stripped text of that length always has a word, so no word test is needed.
    """
    return df.filter(F.length(text_col) >= min_chars)
