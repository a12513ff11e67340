"""The metrics document of a benchmark: one JSON object with one entry per model.

Entries that are no objects, or lack the required figure, are notes and are skipped on
reading.  Values are read as VARIANT, so entries may differ in what they hold.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import path_exists

FIGURES = ["accuracy", "macro_f1", "macro_precision", "macro_recall", "weighted_f1"]
OOD_FIGURES = ["accuracy", "macro_f1"]
CLASS_FIGURES = "map<string, struct<precision:double, recall:double, f1_score:double, support:bigint>>"
NUMBERS = [*[f"test_{c}" for c in FIGURES], *[f"ood_{c}" for c in OOD_FIGURES]]
REPORT_SCHEMA = "model string, label string, precision double, recall double, f1_score double, support double"


def _by_label(rows: DataFrame, model_col: str, value: Column, out: str) -> DataFrame:
    """One map from label to value per model; at most one entry per class."""
    less = lambda a, b: F.when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0)
    entries = F.array_sort(F.collect_list(F.struct("label", value.alias("value"))), less)  # variants have no order
    return rows.groupBy(model_col).agg(F.map_from_entries(entries).alias(out))


def model_entries(
    overall: DataFrame, per_class: DataFrame, report: DataFrame, model_col: str = "model", split_col: str = "split"
) -> DataFrame:
    """(model, entry): the JSON object of each model.

    ``overall`` has figures per model and split (test, and ood where there is one),
    ``per_class`` and ``report`` those of the test split by label.
    """
    test = overall.filter(F.col(split_col) == "test").select(model_col, *[F.col(c).alias(f"test_{c}") for c in FIGURES])
    ood = overall.filter(F.col(split_col) == "ood").select(model_col, *[F.col(c).alias(f"ood_{c}") for c in OOD_FIGURES])
    classes = _by_label(per_class, model_col, F.struct("precision", "recall", "f1_score", "support"), "per_class")
    lines = F.struct("precision", "recall", F.col("f1_score").alias("f1-score"), F.col("support").cast("double").alias("support"))
    # one figure stands for the accuracy, an object for every other line
    line = F.when(F.col("label") == "accuracy", F.col("f1_score").cast("variant")).otherwise(F.to_variant_object(lines))
    reports = _by_label(report, model_col, line, "classification_report")
    rows = test.join(classes, model_col, "left").join(reports, model_col, "left").join(ood, model_col, "left")
    fields = [F.col(model_col).alias("model_name"), *[c for c in rows.columns if c != model_col]]
    return rows.select(model_col, F.to_json(F.struct(*fields)).alias("entry"))


def document(entries: DataFrame, notes: dict[str, str] | None = None, model_col: str = "model") -> DataFrame:
    """One row with the whole document: an entry per model, and notes.  It grows with the models only."""
    rows = entries.select(F.col(model_col).alias("k"), "entry")
    if notes:
        rows = rows.union(entries.sparkSession.createDataFrame([(k, json.dumps(v)) for k, v in notes.items()], "k string, entry string"))
    quoted = F.to_json(F.create_map("k", F.lit(0)))  # {"the key":0}
    part = F.concat(F.substring(quoted, F.lit(2), F.length(quoted) - 3), "entry").alias("part")
    every = F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"])
    return rows.select("k", part).agg(F.concat(F.lit("{"), F.array_join(every, ",\n"), F.lit("}")).alias("value"))


def write_document(value: DataFrame, path: str, mode: str = "overwrite") -> None:
    value.coalesce(1).write.mode(mode).text(path)


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """(model, entry) of every entry of the documents of a path; none for what is no JSON object."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "model string").withColumn("entry", F.parse_json(F.lit(None).cast("string")))
    docs = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
    found = docs.lateralJoin(spark.tvf.variant_explode(F.col("doc").outer()))
    return found.filter("key IS NOT NULL").select(F.col("key").alias("model"), F.col("value").alias("entry"))


def read_model_metrics(spark: SparkSession, path: str, required: str = "test_accuracy") -> DataFrame:
    """(model, model_name, figures of both splits, per_class) of every model of a document.

    A path may hold one document or a folder of them; a missing path has no models.
    """
    entries = _entries(spark, path)
    get = lambda name, kind: F.try_variant_get("entry", f"$.{name}", kind).alias(name)
    rows = entries.select("model", get("model_name", "string"), *[get(c, "double") for c in NUMBERS], get("per_class", CLASS_FIGURES))
    return rows.filter(F.col(required).isNotNull())


def read_model_reports(spark: SparkSession, path: str) -> DataFrame:
    """(model, label, precision, recall, f1_score, support) of every model's classification report.

    A line that is one figure has it in all three columns and no support.
    """
    entries = _entries(spark, path)
    reports = entries.select("model", F.try_variant_get("entry", "$.classification_report", "variant").alias("report"))
    lines = reports.lateralJoin(spark.tvf.variant_explode(F.col("report").outer())).filter("key IS NOT NULL")
    one = F.try_variant_get("value", "$", "double")
    get = lambda key: F.try_variant_get("value", f"$['{key}']", "double")
    return lines.select(
        "model", F.col("key").alias("label"), F.coalesce(get("precision"), one).alias("precision"),
        F.coalesce(get("recall"), one).alias("recall"), F.coalesce(get("f1-score"), one).alias("f1_score"), get("support").alias("support"),
    )


def by_split(models: DataFrame, split: str) -> DataFrame:
    """(model, accuracy, macro_f1) of one split, as comparison tables take them; models without it are left out."""
    return models.filter(F.col(f"{split}_accuracy").isNotNull()).select(
        "model", F.col(f"{split}_accuracy").alias("accuracy"), F.col(f"{split}_macro_f1").alias("macro_f1")
    )
