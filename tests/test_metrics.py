import pytest
from pyspark.sql import functions as F

from uttermill.operators import errors, leakage, metrics, reports
from uttermill.constants import ERROR_DEFAULT, ERROR_NEGATION, ERROR_PAIRS, ERROR_SOURCE_OOD, ERROR_SOURCE_TEST, STATUS_BASELINE, STATUS_TUNED

ABC = ["a", "b", "c"]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(list(zip("aabb", "abbb")), "intent string, predicted_intent string")


def test_per_class(pairs):
    got = {r.label: tuple(r)[1:] for r in metrics.per_class_metrics(pairs, ABC).collect()}
    assert got == {"a": (1.0, 0.5, 0.6667, 2), "b": (0.6667, 1.0, 0.8, 2), "c": (0.0, 0.0, 0.0, 0)}


def test_overall(pairs):
    r = metrics.overall_metrics(pairs, ABC).first()
    assert (r.accuracy, r.macro_f1, r.weighted_f1, r.dataset_size) == (0.75, 0.4889, 0.7333, 4)


def test_confusion_keeps_zeros_and_rows_sum_to_one(pairs):
    cm = metrics.confusion_matrix(pairs, ABC)
    cells = {(r.intent, r.predicted_intent): r.n for r in cm.collect()}
    assert len(cells) == 9 and sum(cells.values()) == 4 and cells[("a", "b")] == 1 and cells[("c", "c")] == 0
    share = {(r.intent, r.predicted_intent): r.share for r in metrics.normalize_confusion(cm).collect()}
    assert abs(share[("a", "a")] - 0.5) < 1e-6 and share[("c", "a")] == 0


def test_report_is_unrounded(pairs):
    got = {r.label: r for r in metrics.classification_report(pairs, ABC).collect()}
    assert set(got) == {*ABC, "accuracy", "macro avg", "weighted avg"}
    assert abs(got["b"].precision - 2 / 3) < 1e-12 and got["accuracy"].f1_score == 0.75
    assert got["macro avg"].support == 4


def test_metrics_per_group_keep_absent_classes(spark):
    df = spark.createDataFrame([("x", "a", "a"), ("y", "b", "a")], "split string, intent string, predicted_intent string")
    got = {(r.split, r.label): r.support for r in metrics.per_class_metrics(df, ABC, by=("split",)).collect()}
    assert got == {("x", "a"): 1, ("x", "b"): 0, ("x", "c"): 0, ("y", "a"): 0, ("y", "b"): 1, ("y", "c"): 0}


def test_published_counts(spark):
    """14 wrong of 126 and 26 wrong of 120 give the published accuracies."""
    rows = [("in", "a", "a")] * 112 + [("in", "a", "b")] * 14 + [("ood", "a", "a")] * 94 + [("ood", "a", "b")] * 26
    df = spark.createDataFrame(rows, "split string, intent string, predicted_intent string")
    got = {r.split: r.accuracy for r in metrics.overall_metrics(df, ABC, by=("split",)).collect()}
    assert got == {"in": 0.8889, "ood": 0.7833}


def test_balance_and_summary(spark):
    rows = [("train", "x1", "a")] * 8 + [("train", "x2", "b")] * 8 + [("val", "x3", "a"), ("test", "x4", "b"), ("ood", "o1", "a")]
    df = spark.createDataFrame(rows, "split string, base_id string, intent string")
    got = {r.intent: r.asDict() for r in metrics.class_balance(df, ABC).collect()}
    assert (got["a"]["train"], got["a"]["total_in_domain"], got["a"]["ood"], got["a"]["train_pct"]) == (8, 9, 1, 50.0)
    assert got["c"]["total_in_domain"] == 0
    s = {r.split: (r.unique_bases, r.base_pct, r.samples) for r in metrics.split_summary(df).collect()}
    assert s["train"] == (2, 50.0, 16) and s["ood"] == (1, None, 1) and s["total"] == (4, 100.0, 19)


def test_quality_gate(pairs, spark):
    shared = leakage.overlap_report(
        spark.createDataFrame([("i", "t", "train"), ("i", "u", "test")], "base_id string, clean_text string, split string"),
        kinds=("base_id",),
    )
    got = {r.name: r.passed for r in metrics.quality_gate(metrics.overall_metrics(pairs, ["a", "b"]), shared, (0.7, 0.99)).collect()}
    assert got == {"macro_f1": True, "shared_base_ids": False}


def _pred(spark, rows):
    return spark.createDataFrame(rows, "clean_text string, intent string, predicted_intent string, confidence double")


def test_error_rules_in_order(spark):
    t, p, reason = ERROR_PAIRS[0]
    df = _pred(spark, [("nahi", t, p, 1.0), ("I know", "complaint", "callback_request", 1.0), ("hello", "complaint", "callback_request", 1.0)])
    got = {r.clean_text: r.reason for r in df.select("clean_text", errors.error_reason(F.col("clean_text"), F.col("intent"), F.col("predicted_intent")).alias("reason")).collect()}
    assert got == {"nahi": reason, "I know": ERROR_NEGATION, "hello": ERROR_DEFAULT}


def test_error_table(spark):
    test = _pred(spark, [("x", "a", "b", 0.5), ("y", "a", "a", 0.9)])
    ood = _pred(spark, [("z", "b", "a", 0.8)])
    table = errors.error_table(errors.misclassified(test, ood))
    assert table.columns == errors.ERROR_COLUMNS
    assert [(r.clean_text, r.benchmark_source) for r in table.collect()] == [("z", ERROR_SOURCE_OOD), ("x", ERROR_SOURCE_TEST)]
    top = errors.top_confusions(errors.misclassified(test, ood), 1).collect()
    assert len(top) == 1 and top[0].n == 1


def test_error_table_empty(spark):
    table = errors.error_table(errors.misclassified(_pred(spark, [("y", "a", "a", 0.9)])))
    assert table.count() == 0 and table.columns == errors.ERROR_COLUMNS


def _log(spark):
    return spark.createDataFrame([("r1", 0.5, 0.6), ("r2", 0.7, 0.8), ("r3", 0.7, 0.8)], "run_name string, val_accuracy double, val_macro_f1 double")


def test_rank_and_best_run(spark):
    got = [(r.Rank, r.run_name) for r in reports.rank_runs(_log(spark)).collect()]
    assert got == [(1, "r2"), (2, "r3"), (3, "r1")]
    assert reports.rank_runs(_log(spark)).columns == ["Rank", "run_name", "val_accuracy", "val_macro_f1"]
    best = reports.best_run(_log(spark), {"adapter_dir": "here"}).first()
    assert (best.run_name, best.adapter_dir) == ("r2", "here")
    assert reports.rank_runs(_log(spark).limit(0)).count() == 0


def test_rank_falls_back_to_last_column(spark):
    got = reports.rank_runs(_log(spark).select("run_name", "val_accuracy")).first()
    assert got.run_name == "r2"


def test_comparison_and_markdown(spark):
    test = spark.createDataFrame([("m1", 0.93651, 0.937), ("m2", 0.5, 0.25)], "model string, accuracy double, macro_f1 double")
    ood = test.filter("model = 'm1'")
    status = F.when(F.col("model") == "m2", STATUS_TUNED).otherwise(STATUS_BASELINE)
    table = reports.comparison_table(test, ood, status).orderBy("model")
    text = reports.to_markdown(table).splitlines()
    assert text[2] == "| m1 | 93.7% | 0.9370 | 93.7% | 0.9370 | Baseline |"
    assert text[3] == "| m2 | 50.0% | 0.2500 | N/A | N/A | Fine-Tuned Production Model |"
    many = spark.range(5_000).selectExpr("concat('r', id) AS run", "id AS n")
    assert len(reports.to_markdown(many).splitlines()) == 5_002


def test_append_runs_unions_columns(spark):
    new = spark.createDataFrame([("r4", "x")], "run_name string, note string")
    got = reports.append_runs(_log(spark), new)
    assert got.count() == 4 and set(got.columns) == {"run_name", "val_accuracy", "val_macro_f1", "note"}
    assert reports.append_runs(None, new) is new


def test_class_lookup_defaults(pairs):
    got = {r.label: (r.precision, r.support) for r in reports.per_class_lookup(metrics.per_class_metrics(pairs, ["a", "b"]), ["a", "z"]).collect()}
    assert got == {"a": (1.0, 2), "z": (0.0, 0)}


# decision lists


def test_rule_table_equals_the_fixed_list(spark):
    truth = sorted({t for t, _, _ in ERROR_PAIRS} | {p for _, p, _ in ERROR_PAIRS})
    rows = [(t, p, x) for t in truth for p in truth for x in ("Nahi chahiye", "plain words", None, "NO")]
    df = spark.createDataFrame(rows, "intent string, predicted_intent string, clean_text string")
    both = errors.error_rules(df, errors.rule_table(spark)).withColumn(
        "want", errors.error_reason(F.coalesce("clean_text", F.lit("")), F.col("intent"), F.col("predicted_intent"))
    )
    assert both.count() == len(rows) and both.filter("NOT failure_analysis <=> want").count() == 0


def test_first_rule_that_holds_wins(spark):
    rules = [
        (5, "a", "b", None, "pair"), (3, "a", "b", "Late", "pair and text"), (4, "a", None, None, "true class"),
        (6, None, "b", None, "predicted class"), (1, None, None, "zz", "text"), (4, "a", None, None, "a second of one order"),
    ]
    cases = [("a", "b", "so late", "pair and text"), ("a", "b", "x", "a second of one order"), ("c", "b", "x", "predicted class"), ("a", "c", "", "a second of one order"),
             ("c", "d", "zz", "text"), ("c", "d", None, None), (None, "b", "x", "predicted class"), (None, None, "ZZ", "text"), ("a", "b", "zz late", "text")]
    df = spark.createDataFrame(cases * 2, "intent string, predicted_intent string, clean_text string, want string")
    got = errors.error_rules(df, spark.createDataFrame(rules, errors.RULE_SCHEMA))
    assert got.count() == 2 * len(cases) and got.filter("NOT failure_analysis <=> want").collect() == []
    none = errors.error_rules(df, spark.createDataFrame([], errors.RULE_SCHEMA))
    assert none.filter("failure_analysis IS NULL").count() == 2 * len(cases) and none.columns == [*df.columns, "failure_analysis"]
