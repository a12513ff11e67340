"""Confusion matrix, per-class and overall metrics, balance reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import INTENTS, QUALITY_GATE_F1


def _labels(labels) -> Column:
    return F.explode(F.array(*[F.lit(x) for x in labels]))


def _grid(df: DataFrame, labels, truth: str, pred: str) -> DataFrame:
    """Every (true, predicted) pair of listed labels."""
    one = df.sparkSession.range(1)
    return one.select(_labels(labels).alias(truth)).select(truth, _labels(labels).alias(pred))


def prediction_counts(df: DataFrame, truth: str = "intent", pred: str = "predicted_intent", by=()) -> DataFrame:
    """Rows per (group, true, predicted): the only pass over the predictions."""
    return df.groupBy(*by, truth, pred).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, labels=INTENTS, truth: str = "intent", pred: str = "predicted_intent") -> DataFrame:
    """Counts over the full label grid, zeros kept."""
    return (
        _grid(df, labels, truth, pred)
        .join(prediction_counts(df, truth, pred), [truth, pred], "left")
        .select(truth, pred, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    )


def normalize_confusion(cm: DataFrame, truth: str = "intent", pred: str = "predicted_intent") -> DataFrame:
    """Row shares of a confusion matrix."""
    totals = cm.groupBy(truth).agg(F.sum("n").alias("_row"))
    return cm.join(totals, truth).select(truth, pred, "n", (F.col("n") / (F.col("_row") + 1e-9)).alias("share"))


def _ratio(num: Column, den: Column) -> Column:
    """Quotient with 0 for an empty denominator."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def class_metrics(counts: DataFrame, labels=INTENTS, truth: str = "intent", pred: str = "predicted_intent", by=()) -> DataFrame:
    """Unrounded precision, recall, F1 and support per listed label (and group)."""
    hit = F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col(truth).alias("label"), F.col("n").alias("support"), zero.alias("predicted"), hit.cast("bigint").alias("tp")),
        F.struct(F.col(pred).alias("label"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
        # a row of zeros for every listed label keeps absent classes in the result
        *[F.struct(F.lit(x).alias("label"), zero.alias("support"), zero.alias("predicted"), zero.alias("tp")) for x in labels],
    )
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return (
        counts.select(*by, F.inline(sides))
        .filter(F.col("label").isin(list(labels)))
        .groupBy(*by, "label")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
        .select(
            *by,
            "label",
            _ratio(tp, predicted).alias("precision"),
            _ratio(tp, support).alias("recall"),
            _ratio(2 * tp, support + predicted).alias("f1_score"),
            "support",
            "tp",
        )
    )


def per_class_metrics(df: DataFrame, labels=INTENTS, truth: str = "intent", pred: str = "predicted_intent", by=(), digits: int = 4) -> DataFrame:
    m = class_metrics(prediction_counts(df, truth, pred, by), labels, truth, pred, by)
    return m.select(*by, "label", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1_score")], "support")


def averages(m: DataFrame, by=()) -> DataFrame:
    """Accuracy, macro and support-weighted averages of ``class_metrics`` rows."""
    n = F.sum("support")
    weighted = [
        _ratio(F.sum(F.col(c) * F.col("support")), n).alias(f"weighted_{s}")
        for c, s in (("precision", "precision"), ("recall", "recall"), ("f1_score", "f1"))
    ]
    return m.groupBy(*by).agg(
        _ratio(F.sum("tp"), n).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1_score").alias("macro_f1"),
        *weighted,
        n.alias("dataset_size"),
    )


OVERALL = ["accuracy", "macro_f1", "macro_precision", "macro_recall", "weighted_f1"]


def overall_metrics(df: DataFrame, labels=INTENTS, truth: str = "intent", pred: str = "predicted_intent", by=(), digits: int = 4) -> DataFrame:
    """Accuracy, macro and weighted figures, rounded, one row per group."""
    m = class_metrics(prediction_counts(df, truth, pred, by), labels, truth, pred, by)
    return averages(m, by).select(*by, *[F.round(c, digits).alias(c) for c in OVERALL], "dataset_size")


def classification_report(df: DataFrame, labels=INTENTS, truth: str = "intent", pred: str = "predicted_intent", by=()) -> DataFrame:
    """Class rows plus accuracy, macro avg and weighted avg rows, unrounded."""
    m = class_metrics(prediction_counts(df, truth, pred, by), labels, truth, pred, by)
    a = averages(m, by)
    cols = [*by, "label", "precision", "recall", "f1_score", "support"]
    names = {"precision": "precision", "recall": "recall", "f1_score": "f1"}

    def block(label, prefix):
        return F.struct(
            F.lit(label).alias("label"),
            *[F.col(f"{prefix}_{s}").alias(c) for c, s in names.items()],
            F.col("dataset_size").alias("support"),
        )

    accuracy = F.struct(
        F.lit("accuracy").alias("label"),
        *[F.col("accuracy").alias(c) for c in names],
        F.col("dataset_size").alias("support"),
    )
    rows = F.array(accuracy, block("macro avg", "macro"), block("weighted avg", "weighted"))
    return m.select(*cols).unionByName(a.select(*by, F.inline(rows)).select(*cols))


def class_balance(df: DataFrame, labels=INTENTS, label_col: str = "intent", split_col: str = "split") -> DataFrame:
    """Rows per class and split, in-domain total without OOD, share of train."""
    splits = ["train", "val", "test", "ood"]
    counts = df.groupBy(label_col).pivot(split_col, splits).agg(F.count(F.lit(1)))
    dim = df.sparkSession.range(1).select(_labels(labels).alias(label_col))
    filled = dim.join(counts, label_col, "left").select(
        label_col, *[F.coalesce(s, F.lit(0)).cast("bigint").alias(s) for s in splits]
    )
    # one row per class from here on
    return (
        filled.withColumn("_train", F.sum("train").over(Window.partitionBy()))
        .withColumn("total_in_domain", F.col("train") + F.col("val") + F.col("test"))
        .withColumn("train_pct", F.round(_ratio(F.col("train") * 100.0, F.col("_train")), 1))
        .drop("_train")
    )


def split_summary(df: DataFrame, id_col: str = "base_id", split_col: str = "split") -> DataFrame:
    """Distinct base ids, their share, and samples per split, with a total row.

    Ids are first reduced to one row per (split, id), combined on the map side,
    so an id with very many rows does not concentrate in one task.  The share
    counts in-domain ids only; the OOD split has none.
    """
    per_id = df.groupBy(split_col, id_col).agg(F.count(F.lit(1)).alias("_n"))
    per_split = per_id.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("unique_bases"), F.sum("_n").alias("samples")
    )
    in_domain = F.col(split_col) != "ood"
    # at most one row per split from here on
    total = per_split.agg(
        F.sum(F.when(in_domain, F.col("unique_bases"))).alias("unique_bases"), F.sum("samples").alias("samples")
    ).select(F.lit("total").alias(split_col), "unique_bases", "samples")
    bases = F.max(F.when(F.col(split_col) == "total", F.col("unique_bases"))).over(Window.partitionBy())
    return (
        per_split.unionByName(total)
        .withColumn("_all", bases)
        .withColumn("base_pct", F.when(in_domain, F.round(_ratio(F.col("unique_bases") * 100.0, F.col("_all")), 1)))
        .select(split_col, "unique_bases", "base_pct", "samples")
    )


def quality_gate(overall: DataFrame, shared_ids: DataFrame, bounds=QUALITY_GATE_F1) -> DataFrame:
    """Expectations with value, bounds and outcome.

    ``overall`` has one row with macro_f1; ``shared_ids`` is an overlap report.
    """
    lo, hi = bounds
    f1 = overall.select(F.lit("macro_f1").alias("name"), F.col("macro_f1").cast("double").alias("value"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
    ids = shared_ids.agg(F.sum("n_shared").cast("double").alias("value")).select(
        F.lit("shared_base_ids").alias("name"), "value", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")
    )
    return f1.unionByName(ids).withColumn("passed", F.col("value").between(F.col("lo"), F.col("hi")))
