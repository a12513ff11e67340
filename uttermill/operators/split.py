"""Seeded, stratified train/val/test split by base id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SEED, SPLIT_RATIOS
from ..plans.staging import stage

PARTS = 10_000  # ratios are held as whole parts of this, to keep quotas in integers


def check_ratios(ratios) -> None:
    if len(ratios) != 3 or min(ratios) < 0 or abs(sum(ratios) - 1.0) >= 1e-5:
        raise ValueError("split ratios must be three non-negative numbers that sum to 1.0")


def split_key(id_col: str, seed: int) -> Column:
    """Seeded pseudo-random order of the ids, ties broken by the id itself."""
    seeded = F.concat(F.col(id_col), F.lit(f":{seed}"))
    return F.concat(F.md5(seeded.cast("binary")), F.lit(":"), F.col(id_col))


@dataclass
class GroupSplit:
    """Cut keys per class, plus the ids whose rows carry more than one class; both staged."""

    cuts: DataFrame
    mixed: DataFrame
    id_col: str
    class_col: str
    seed: int

    def assign(self, df: DataFrame, out: str = "split") -> DataFrame:
        """Add the split of each row by comparison with the cuts of its class.

        Both lookups have one row per key and known sizes, so Spark picks the joins
        by bytes and splits the rows of a hot id or class among tasks.
        """
        stratum = F.coalesce(F.col("_stratum"), F.col(self.class_col))
        keyed = (
            df.join(self.mixed, self.id_col, "left")
            .withColumn("_class", stratum)
            .withColumn("_key", split_key(self.id_col, self.seed))
        )
        # a missing cut compares as null, so its branch is skipped
        split = F.when(
            F.col("_known"),
            F.when(F.col("_key") <= F.col("_train_cut"), "train")
            .when(F.col("_key") <= F.col("_val_cut"), "val")
            .otherwise("test"),
        )
        return (
            keyed.join(self.cuts, "_class", "left")
            .withColumn(out, split)
            .drop("_stratum", "_class", "_key", "_train_cut", "_val_cut", "_known")
        )


def fit_group_split(
    df: DataFrame,
    id_col: str = "base_id",
    class_col: str = "intent",
    order_col: str = "ord",
    ratios=SPLIT_RATIOS,
    seed: int = SEED,
    digits: int = 4,
) -> GroupSplit:
    """Exact per-class quotas over distinct base ids, without sorting a class.

    The stratum of an id is the class of its first row.  Ids are counted per
    (class, hash prefix); the running counts name the prefix that holds each
    quota boundary; only those prefixes are numbered to find the exact cut key.
    Nothing reaches the driver.
    """
    check_ratios(ratios)
    train, val = (round(r * PARTS) for r in ratios[:2])
    ids = stage(
        df.groupBy(id_col)
        .agg(
            F.min_by(class_col, order_col).alias("_stratum"),
            (F.min(class_col) != F.max(class_col)).alias("_mixed"),
        )
        .withColumn("_key", split_key(id_col, seed))
        .withColumn("_bucket", F.substring("_key", 1, digits)),
        "split-ids",
    )
    ids = ids.filter(F.col("_stratum").isNotNull())
    running = Window.partitionBy("_stratum").orderBy("_bucket")
    hist = (
        ids.groupBy("_stratum", "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_through", F.sum("_n").over(running))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy("_stratum")))
        .withColumn("_train", F.expr(f"(_total * {train} + {PARTS // 2}) div {PARTS}"))
        .withColumn(
            "_val",
            F.expr(f"least(_total, _train + (_total * {val} + {PARTS // 2}) div {PARTS})"),
        )
    )
    bounds = hist.select(
        "_stratum",
        "_bucket",
        (F.col("_through") - F.col("_n")).alias("_before"),
        "_through",
        F.explode(
            F.array(
                F.struct(F.lit("train_cut").alias("cut"), F.col("_train").alias("quota")),
                F.struct(F.lit("val_cut").alias("cut"), F.col("_val").alias("quota")),
            )
        ).alias("_b"),
    ).filter((F.col("_before") < F.col("_b.quota")) & (F.col("_b.quota") <= F.col("_through")))
    # at most two rows per class
    bounds = bounds.select(
        "_stratum", "_bucket", F.col("_b.cut").alias("_cut"), (F.col("_b.quota") - F.col("_before")).alias("_rank")
    )
    numbered = ids.join(bounds, ["_stratum", "_bucket"]).withColumn(
        "_rn", F.row_number().over(Window.partitionBy("_stratum", "_bucket", "_cut").orderBy("_key"))
    )
    found = (
        numbered.filter("_rn = _rank")
        .groupBy("_stratum")
        .pivot("_cut", ["train_cut", "val_cut"])
        .agg(F.first("_key"))
    )
    classes = ids.select("_stratum").distinct()
    cuts = classes.join(found, "_stratum", "left").select(
        F.col("_stratum").alias("_class"),
        F.col("train_cut").alias("_train_cut"),
        F.col("val_cut").alias("_val_cut"),
        F.lit(True).alias("_known"),
    )
    mixed = ids.filter("_mixed").select(id_col, "_stratum")
    return GroupSplit(stage(cuts, "split-cuts"), stage(mixed, "split-mixed"), id_col, class_col, seed)


def stratified_group_split(df: DataFrame, out: str = "split", **kw) -> DataFrame:
    """Add a ``split`` column with exact quotas; no base id crosses a boundary."""
    return fit_group_split(df, **kw).assign(df, out)


def hash_split(
    df: DataFrame, id_col: str = "base_id", ratios=SPLIT_RATIOS, seed: int = SEED, out: str = "split"
) -> DataFrame:
    """Approximate ratios from the hash of the id alone: one narrow projection."""
    check_ratios(ratios)
    point = F.conv(F.substring(split_key(id_col, seed), 1, 8), 16, 10).cast("double") / float(16**8)
    return df.withColumn(
        out,
        F.when(point < ratios[0], "train").when(point < ratios[0] + ratios[1], "val").otherwise("test"),
    )
