"""Run log, run ranking, model comparison, Markdown and JSON forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import RUN_COLUMNS, STATUS_BASELINE
from ..plans.ranking import with_ordinal


def append_runs(log: DataFrame | None, new: DataFrame) -> DataFrame:
    """Existing runs followed by new ones; columns missing on a side become null."""
    return new if log is None else log.unionByName(new, allowMissingColumns=True)


def _ranking(log: DataFrame, metric: str, name: str) -> list[Column | str]:
    sort_col = metric if metric in log.columns else log.columns[-1]
    return [F.desc_nulls_last(sort_col), *([name] if name in log.columns else [])]


def rank_runs(log: DataFrame, columns=RUN_COLUMNS, metric: str = "val_macro_f1", name: str = "run_name") -> DataFrame:
    """Runs ranked 1..n by the metric (or the last column), best first."""
    ranked = with_ordinal(log, _ranking(log, metric, name), out="Rank").withColumn("Rank", F.col("Rank").cast("int"))
    return ranked.orderBy("Rank").select(*[c for c in columns if c in ranked.columns])


def best_run(log: DataFrame, defaults: dict | None = None, metric: str = "val_macro_f1", name: str = "run_name") -> DataFrame:
    """The best run; ``defaults`` fill fields that are null or absent."""
    best = log.orderBy(*_ranking(log, metric, name)).limit(1)
    for c, v in (defaults or {}).items():
        best = best.withColumn(c, F.coalesce(c, F.lit(v)) if c in best.columns else F.lit(v))
    return best


def _percent(c: str):
    return F.format_string("%.1f%%", F.round(F.col(c) * 100, 1))


def _figure(c: str):
    return F.format_string("%.4f", F.col(c))


def comparison_table(test: DataFrame, ood: DataFrame, status: Column | str = STATUS_BASELINE, model_col: str = "model") -> DataFrame:
    """One formatted row per model; a model without an OOD result shows N/A.

    ``test`` and ``ood`` hold accuracy and macro_f1 per model; ``status`` is a
    text or an expression on the model.
    """
    left = test.select(model_col, F.col("accuracy").alias("_ta"), F.col("macro_f1").alias("_tf"))
    right = ood.select(model_col, F.col("accuracy").alias("_oa"), F.col("macro_f1").alias("_of"))

    def pick(c, fmt):
        # format_string prints "null", so nulls are kept apart
        return F.when(F.col(c).isNull(), F.lit("N/A")).otherwise(fmt(c))

    return left.join(right, model_col, "left").select(
        model_col,
        pick("_ta", _percent).alias("test_accuracy"),
        pick("_tf", _figure).alias("test_macro_f1"),
        pick("_oa", _percent).alias("ood_accuracy"),
        pick("_of", _figure).alias("ood_macro_f1"),
        (F.lit(status) if isinstance(status, str) else status).alias("status"),
    )


def per_class_lookup(metrics: DataFrame, labels, label_col: str = "label") -> DataFrame:
    """Every listed label with its figures, 0 where the metrics have none."""
    dim = metrics.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias(label_col))
    return dim.join(metrics, label_col, "left").select(
        label_col,
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1_score")],
        F.coalesce("support", F.lit(0)).cast("bigint").alias("support"),
    )


def markdown_lines(df: DataFrame, out: str = "line") -> DataFrame:
    """Each row as a pipe-separated Markdown table row; pipes in cells are escaped, line breaks become ``<br>``."""
    plain = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\r\n|\r|\n", "<br>")
    cells = [plain(f"`{c}`") for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias(out))


def markdown_table(df: DataFrame, out: str = "line", place: str = "place") -> DataFrame:
    """Header, rule and rows of a Markdown table, with their place in it."""
    head = "| " + " | ".join(df.columns) + " |"
    rule = "| " + " | ".join("---" for _ in df.columns) + " |"
    top = df.sparkSession.createDataFrame([(head, -2), (rule, -1)], f"`{out}` string, `{place}` bigint")
    return top.union(markdown_lines(df, out).withColumn(place, F.monotonically_increasing_id()))


def to_markdown(df: DataFrame) -> str:
    """A report as a Markdown table, read line by line."""
    return "\n".join(r[0] for r in markdown_table(df).orderBy("place").toLocalIterator())


def metrics_document(overall: DataFrame, per_class: DataFrame, by: str) -> DataFrame:
    """One nested row per model or split: scalars and a map from class to figures."""
    nested = per_class.groupBy(by).agg(
        F.map_from_entries(
            F.array_sort(
                F.collect_list(F.struct("label", F.struct("precision", "recall", "f1_score", "support")))
            )
        ).alias("per_class")
    )
    return overall.join(nested, by)
