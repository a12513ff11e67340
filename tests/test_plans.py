"""What is staged, what is shuffled, and how fits are laid out."""

import pytest
from conftest import SF

from uttermill.operators import models
from uttermill.plans import prepare, registry

TEXTS = {"text", "clean_text", "emojis"}


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["overall_metrics", "confusion_matrix", "metrics_by_split", "class_lookup"])
def test_metrics_move_no_texts(spark, name):
    assert "clean_text" not in physical(registry.QUERIES[name](spark, SF))


def test_leak_ood_reads_digests(spark):
    lines = [x for x in physical(registry.QUERIES["leak_ood"](spark, SF)).splitlines() if "FileScan" in x or "Exchange" in x]
    assert lines and not any("clean_text#" in x or "ReadSchema" in x and "clean_text:" in x for x in lines)


@pytest.mark.parametrize("name", ["stratified_split", "leak_ids", "leak_ood", "overall_metrics", "quality_gate", "class_balance", "split_summary", "prepared_counts"])
def test_narrow_queries_stage_no_texts(spark, name, monkeypatch):
    staged, real = [], prepare.stage
    monkeypatch.setattr(prepare, "stage", lambda df, *a, **k: staged.append(set(df.columns)) or real(df, *a, **k))
    registry.QUERIES[name](spark, SF)
    assert staged and not any(cols & TEXTS for cols in staged)


def test_repeated_order_values_are_refused(spark):
    df = spark.createDataFrame([(1, "some text", "en"), (1, "other text", "de")], "ord long, text string, intent string")
    with pytest.raises(ValueError, match="unique"):
        prepare.plan_splits(df, None, ["en", "de"])


@pytest.fixture(scope="module")
def store(spark):
    return models.FeatureStore(registry.splits(spark, SF), registry.LABELS)


def test_fits_stop_at_their_tolerance(store):
    for spec in (models.LR, models.SVM):
        model = models.fit_model(spec, store.frame(spec.max_features, spec.sublinear).filter("split = 'train'"), store.labels)
        assert models.converged(model)


def test_forest_does_not_depend_on_layout(store):
    spec = models.ModelSpec("forest", lambda n, k: models.random_forest(n, k, trees=12), 500, False)
    frame = store.frame(500, False)
    train, held = frame.filter("split = 'train'"), frame.filter("split <> 'train'")
    got = []
    for df in (train.repartition(1), train.repartition(5, "label"), train.repartition(3)):
        rows = models.with_prediction(models.fit_model(spec, df, store.labels), held, store.labels)
        got.append(sorted((r.ord, r.predicted_intent) for r in rows.select("ord", "predicted_intent").collect()))
    assert got[0] == got[1] == got[2]
