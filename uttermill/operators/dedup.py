"""Keep-first deduplication by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage

KEYS = ("clean_text", "intent")


def content_key(*cols: str | Column) -> Column:
    """32-byte digest of the columns: a small shuffle key.  Null and empty text differ."""
    values = [F.col(c) if isinstance(c, str) else c for c in cols]
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in values]
    return F.unhex(F.sha2(F.concat_ws("\u0000", *parts), 256))


def dedup_first(
    df: DataFrame,
    keys=KEYS,
    order_col: str = "ord",
    key_col: str | None = None,
) -> DataFrame:
    """Keep, for each key, the row with the smallest ``order_col`` (a unique bigint).

    Only (digest, order) pairs are shuffled, combined on the map side, so a text
    with a third of all rows costs one pair per map task.  Keys that occur once
    need no lookup.  The repeated keys are staged, so Spark knows their bytes and
    picks the join; the rows of a hot key are split among tasks, as the lookup has
    one row per key.
    """
    work = df if key_col else df.withColumn("_key", content_key(*keys))
    key = key_col or "_key"
    groups = work.groupBy(key).agg(F.min(order_col).alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = stage(groups.filter("_n > 1").select(key, "_first"), "repeated-keys")
    kept = work.join(repeated, key, "left").filter(F.col("_first").isNull() | (F.col("_first") == F.col(order_col)))
    return kept.select(*df.columns)


def dedup_counts(df: DataFrame, keys=KEYS) -> DataFrame:
    """Rows before, rows kept and rows dropped by ``dedup_first``."""
    return (
        df.groupBy(content_key(*keys).alias("_key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum("n").alias("rows_in"), F.count(F.lit(1)).alias("rows_kept"))
        .withColumn("rows_dropped", F.col("rows_in") - F.col("rows_kept"))
    )


def distinct_base(df: DataFrame, id_col: str = "base_id", order_col: str = "ord", **kw) -> DataFrame:
    """First row of each base id."""
    return dedup_first(df, keys=(id_col,), order_col=order_col, **kw)
