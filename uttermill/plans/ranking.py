"""Row numbers over large groups without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage


def with_ordinal(
    df: DataFrame,
    order: str | list[str | Column],
    class_col: str | None = None,
    out: str = "ordinal",
    partitions: int | None = None,
) -> DataFrame:
    """1-based position of each row by ``order``, per class or overall; null is a class like any other.

    Rows are range-partitioned by class and order and staged with their partition's
    number.  Partitions are counted per class, the counts are summed up to offsets,
    and rows are numbered inside (class, partition), so one class with most of the
    table is still numbered by many tasks.  Pass narrow rows: every column is staged.
    """
    order = order if isinstance(order, list) else [order]
    keyed = df.withColumn("_class", F.col(class_col) if class_col else F.lit(""))
    count = [partitions] if partitions else []
    ranged = keyed.repartitionByRange(*count, "_class", *order).withColumn("_part", F.spark_partition_id())
    ranged = stage(ranged, "ranged")
    before = Window.partitionBy("_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_class", "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            F.col("_class").alias("_c"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
        )
    )
    inside = Window.partitionBy("_class", "_part").orderBy(*order)
    numbered = ranged.withColumn("_rn", F.row_number().over(inside))
    return (
        numbered.join(offsets, F.col("_class").eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p")))
        .withColumn(out, F.col("_rn") + F.col("_offset"))
        .drop("_class", "_part", "_rn", "_offset", "_c", "_p")
    )
