"""Whole jobs from stored tables to stored results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import INTENTS, KEYWORD_DEFAULT, KEYWORDS, SEED, SPLIT_RATIOS, STATUS_BASELINE, STATUS_TUNED, VARIATIONS
from ..operators.augment import with_variation_digests
from ..operators.corpus import class_counts
from ..operators.errors import error_table, misclassified
from ..operators.leakage import assert_no_leakage
from ..operators.metrics import (
    class_balance,
    confusion_matrix,
    normalize_confusion,
    overall_metrics,
    per_class_metrics,
    split_summary,
)
from ..operators.models import LR, RF, SVM, baseline_summary
from ..operators.reports import best_run, comparison_table, metrics_document, rank_runs
from ..sources import files
from .prepare import augmented, plan_splits
from .staging import stage


@dataclass
class PreparationReport:
    raw_counts: DataFrame
    balance: DataFrame
    summary: DataFrame


def prepare_dataset(
    raw: DataFrame,
    ood: DataFrame | None,
    out: str,
    labels=INTENTS,
    ratios=SPLIT_RATIOS,
    seed: int = SEED,
    variations=VARIATIONS,
    csv: bool = False,
) -> PreparationReport:
    """Clean, split, augment train, check for leakage, and write the splits.

    Nothing is written when the check fails.  Rows land in ``out`` partitioned by
    split, as Parquet or CSV.
    """
    # staged once: the check, the written splits and both reports scan the same rows
    planned = plan_splits(raw, ood, labels, ratios, seed, derive=lambda df: with_variation_digests(df, variations))
    rows = stage(augmented(planned, variations), "augmented")
    assert_no_leakage(rows)
    if csv:
        files.write_csv(rows.drop("ord"), out, ["split"])
    else:
        files.write_parquet(rows, out, ["split"])
        rows = raw.sparkSession.read.parquet(out)
    return PreparationReport(class_counts(raw), class_balance(rows, labels), split_summary(rows))


def read_splits(spark: SparkSession, path: str, csv: bool = False) -> DataFrame:
    """The splits written by ``prepare_dataset``, with a unique ``ord``."""
    if not csv:
        return spark.read.parquet(path)
    rows = files.read_csv(spark, path, files.SPLIT_SCHEMA + ", split string")
    # file order carries no meaning, so rows are numbered within the table as read
    return stage(rows.withColumn("ord", F.monotonically_increasing_id()), "splits")


def run_baselines(
    rows: DataFrame, out: str, labels=INTENTS, keywords=KEYWORDS, default: str = KEYWORD_DEFAULT, specs=(LR, SVM, RF)
) -> DataFrame:
    """Fit and score every baseline; store one JSON row per model and split."""
    summary = stage(baseline_summary(rows, labels, keywords, default, specs), "baselines")
    files.write_json(summary, out)
    return summary


@dataclass
class EvaluationReport:
    overall: DataFrame
    confusion: DataFrame
    errors: DataFrame


def evaluate_predictions(scored: DataFrame, out: str, labels=INTENTS) -> EvaluationReport:
    """Metrics per split as JSON, normalised confusion matrix of test, error table as CSV.

    ``scored`` has split (test, ood), intent, predicted_intent, confidence, clean_text.
    """
    scored = stage(scored, "scored")
    by = ("split",)
    overall = overall_metrics(scored, labels, by=by)
    files.write_json(metrics_document(overall, per_class_metrics(scored, labels, by=by), "split"), f"{out}/metrics")
    test = scored.filter("split = 'test'")
    confusion = normalize_confusion(confusion_matrix(test, labels))
    files.write_csv(confusion, f"{out}/confusion")
    errors = error_table(misclassified(test, scored.filter("split = 'ood'")))
    files.write_csv(errors, f"{out}/misclassified")
    return EvaluationReport(overall, confusion, errors)


def compare_models(baselines: DataFrame, tuned: DataFrame, out: str) -> DataFrame:
    """Markdown comparison of baselines and tuned models from their stored metrics.

    Both hold model, split, accuracy and macro_f1.
    """

    def rows(metrics: DataFrame, status: str) -> DataFrame:
        return comparison_table(metrics.filter("split = 'test'"), metrics.filter("split = 'ood'"), status)

    table = rows(baselines, STATUS_BASELINE).unionByName(rows(tuned, STATUS_TUNED))
    files.write_markdown(table.orderBy("status", "model"), out)
    return table


def compare_runs(log: DataFrame, out: str, columns=None) -> DataFrame:
    """Rank the runs of a log, store the ranking as Markdown, return the best run."""
    ranked = rank_runs(log, columns) if columns else rank_runs(log)
    files.write_markdown(ranked, out)
    return best_run(log)

