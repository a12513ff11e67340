import random

import pytest

from uttermill.constants import INTENTS, KEYWORD_DEFAULT, KEYWORDS
from uttermill.operators import models
from uttermill.operators.classify import keyword_classify
from uttermill.plans import jobs
from uttermill.sources import files
from pyspark.sql import functions as F

RAW = "ord bigint, text string, intent string"


def corpus(spark, n, start=0, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        c = INTENTS[i % 6]
        rows.append((start + i, " ".join(rng.choices(KEYWORDS[c], k=3)) + f" item {start + i}", c))
    return spark.createDataFrame(rows, RAW)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("job") / "splits")
    report = jobs.prepare_dataset(corpus(spark, 180), corpus(spark, 30, 1000, 2), out)
    return out, report


def test_prepare_writes_splits_and_reports(spark, written):
    out, report = written
    rows = jobs.read_splits(spark, out)
    got = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
    assert got == {"train": 126 * 8, "val": 30, "test": 24, "ood": 30}
    assert report.raw_counts.count() == 6 and report.balance.count() == 6
    assert {r.split for r in report.summary.collect()} == {"train", "val", "test", "ood", "total"}


def test_leakage_stops_the_job(spark, tmp_path):
    raw = corpus(spark, 60)
    with pytest.raises(ValueError, match="CRITICAL LEAKAGE"):
        jobs.prepare_dataset(raw, raw.withColumn("ord", F.col("ord") + 500), str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()


def test_csv_splits(spark, tmp_path):
    out = str(tmp_path / "csv")
    jobs.prepare_dataset(corpus(spark, 60), None, out, csv=True)
    rows = jobs.read_splits(spark, out, csv=True)
    assert rows.select("ord").distinct().count() == rows.count()
    assert rows.filter("emojis is null").count() == 0


def test_baselines_evaluation_and_comparison(spark, written, tmp_path):
    rows = jobs.read_splits(spark, written[0])
    spec = models.ModelSpec("lr", lambda n, k: models.logistic_regression(n, k, max_iter=5), 200)
    base = jobs.run_baselines(rows, str(tmp_path / "base"), specs=[spec])
    stored = spark.read.json(str(tmp_path / "base"))
    assert stored.count() == base.count() == 9

    held = rows.filter("split in ('test', 'ood')")
    scored = keyword_classify(held, KEYWORDS, KEYWORD_DEFAULT).withColumn("confidence", F.lit(0.5))
    report = jobs.evaluate_predictions(scored, str(tmp_path / "eval"))
    docs = files.read_json(spark, str(tmp_path / "eval/metrics"), files.METRICS_SCHEMA, required="accuracy")
    assert {r.split for r in docs.collect()} == {"test", "ood"}
    wrong = files.read_csv(spark, str(tmp_path / "eval/misclassified"), files.ERROR_SCHEMA, ())
    assert wrong.count() == report.errors.count() == scored.filter("intent <> predicted_intent").count()
    assert spark.read.option("header", True).csv(str(tmp_path / "eval/confusion")).count() == 36

    tuned = report.overall.withColumn("model", F.lit("tuned"))
    jobs.compare_models(stored, tuned, str(tmp_path / "table"))
    text = [r[0] for r in spark.read.text(str(tmp_path / "table")).collect()]
    assert text[0].startswith("| model | test_accuracy") and text[-1].startswith("| tuned |") and len(text) == 2 + 4


def test_compare_runs(spark, tmp_path):
    log = spark.createDataFrame([("a", 0.5), ("b", 0.75)], "run_name string, val_macro_f1 double")
    assert jobs.compare_runs(log, str(tmp_path / "runs")).first().run_name == "b"
    assert [r[0] for r in spark.read.text(str(tmp_path / "runs")).collect()][2] == "| 1 | b | 0.75 |"
