import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from uttermill.operators import blocks, epochs, forest, models, newton, reports, sweeps

WORDS = {"a": ["refund", "broken", "late"], "b": ["price", "discount", "offer"], "c": ["call", "later", "busy"]}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = []
    for i in range(150):
        c = "abc"[i % 3]
        split = "train" if i < 90 else ("val" if i < 120 else "test")
        data.append((i, " ".join(rng.choices(WORDS[c] + ["the", "please"], k=6)), c, split))
    return spark.createDataFrame(data, "ord bigint, clean_text string, intent string, split string")


@pytest.fixture(scope="module")
def store(rows):
    return models.FeatureStore(rows, ["a", "b", "c"])


SPECS = [
    models.ModelSpec("lr", lambda n, k: models.logistic_regression(n, k, max_iter=20)),
    models.ModelSpec("svm", lambda n, k: models.linear_svm(n, k, max_iter=10)),
    models.ModelSpec("rf", lambda n, k: models.random_forest(n, k, trees=10, depth=8), 20, False),
]


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: s.name)
def test_models_learn(spec, store):
    overall, per_class = models.evaluate_model(spec, store)
    got = {r.split: r for r in overall.collect()}
    assert set(got) == {"val", "test"} and got["test"].dataset_size == 30
    assert got["test"].macro_f1 > 0.9 and got["val"].accuracy > 0.9
    assert per_class.count() == 6


def test_summary_has_all_classifiers(rows):
    keywords = {k: v[:1] for k, v in WORDS.items()}
    got = {(r.model, r.split): r.accuracy for r in models.baseline_summary(rows, ["a", "b", "c"], keywords, "a", SPECS[:1]).collect()}
    assert {m for m, _ in got} == {"lr", models.NAIVE_BAYES, models.KEYWORD}
    assert got[(models.NAIVE_BAYES, "test")] > 0.9


def test_sweep_logs_one_row_per_setting(rows, spark):
    runs = models.sweep(rows, [{"c": 1.0, "epochs": 5}, {"c": 0.01, "max_features": 10, "epochs": 5}], ["a", "b", "c"])
    log = reports.append_runs(None, models.run_frame(spark, runs))
    ranked = reports.rank_runs(log, columns=models.SWEEP_COLUMNS).collect()
    assert [r.Rank for r in ranked] == [1, 2] and ranked[0].val_macro_f1 >= ranked[1].val_macro_f1
    assert all(r["val_loss"] > 0 for r in runs)


# squared hinge


def dense_squared_hinge(x, y, c):
    """Newton steps on the whole matrix."""
    w = np.zeros(x.shape[1])
    value = lambda v: v @ v / 2 + c * (np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
    for _ in range(200):
        short = np.maximum(0, 1 - y * (x @ w))
        g = w - 2 * c * x.T @ (y * short)
        inside = x[short > 0]
        step, size = np.linalg.solve(np.eye(len(w)) + 2 * c * inside.T @ inside, g), 1.0
        while value(w - size * step) > value(w) and size > 1e-9:
            size /= 2
        w = w - size * step
    return w


@pytest.mark.parametrize("c", [0.1, 1.0, 20.0])
def test_squared_hinge_equals_a_dense_solve(spark, c):
    rng = np.random.default_rng(7)
    n, size, labels = 150, 12, ["a", "b", "c"]
    x = rng.normal(size=(n, size)) * (rng.random((n, size)) < 0.4)
    label = (x[:, :3] + 0.5 * rng.normal(size=(n, 3))).argmax(axis=1)
    rows = [(int(k), np.flatnonzero(v).tolist(), v[v != 0].tolist()) for k, v in zip(label, x)]
    df = spark.createDataFrame(rows, "label int, indices array<int>, weights array<double>").repartition(5)
    model = newton.fit_squared_hinge(df, labels, size, c, tolerance=1e-9)
    whole = np.hstack([x, np.ones((n, 1))])
    want = np.stack([dense_squared_hinge(whole, np.where(label == k, 1.0, -1.0), c) for k in range(3)])
    assert model.converged and np.allclose(model.weights, want, atol=1e-6)
    predicted = model.predict(df.withColumn("truth", F.col("label")))
    margins = whole @ want.T
    agree = {(tuple(r.indices), tuple(r.weights)): r.predicted_intent for r in predicted.collect()}
    assert all(agree[tuple(i), tuple(w)] == labels[m.argmax()] for (_, i, w), m in zip(rows, margins))


def test_squared_hinge_of_one_class_and_of_no_rows(spark):
    df = spark.createDataFrame([(0, [0], [1.0])] * 3 + [(None, [1], [1.0])], "label int, indices array<int>, weights array<double>")
    assert newton.fit_squared_hinge(df, ["a"], 2).converged
    none = newton.fit_squared_hinge(df.limit(0), ["a", "b"], 2)
    assert none.converged and not none.weights.any()


# many settings in one scan


def sparse_rows(spark, n=200, size=20, seed=9):
    rng = np.random.default_rng(seed)
    x = np.abs(rng.normal(size=(n, size))) * (rng.random((n, size)) < 0.3)
    label = (x[:, :3] + 0.3 * rng.normal(size=(n, 3))).argmax(axis=1)
    norm = np.sqrt((x**2).sum(axis=1))
    x = x / np.where(norm > 0, norm, 1)[:, None]
    rows = [(i, int(k), np.flatnonzero(v).tolist(), v[v != 0].tolist()) for i, (k, v) in enumerate(zip(label, x))]
    return x, label, spark.createDataFrame(rows, "ord bigint, label int, indices array<int>, weights array<double>")


def dense_loss_and_gradient(x, label, w, c):
    z = x @ w[:, :-1].T + w[:, -1]
    logs = z - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - z.max(axis=1, keepdims=True)
    miss = np.exp(logs)
    miss[np.arange(len(x)), label] -= 1
    g = np.hstack([miss.T @ x, miss.sum(axis=0)[:, None]]) / len(x)
    g[:, :-1] += w[:, :-1] / (c * len(x))
    return -logs[np.arange(len(x)), label].mean() + (w[:, :-1] ** 2).sum() / (2 * c * len(x)), g


def test_all_settings_reach_their_own_optimum(spark):
    x, label, df = sparse_rows(spark)
    asked = [(0.1, 20, 500), (10.0, 20, 500), (1.0, 7, 500), (1.0, 20, 2)]
    fitted = sweeps.fit_all(df.repartition(4), asked, 3, tolerance=1e-7)
    assert [s.converged for s in fitted] == [True, True, True, False] and fitted[3].iterations == 2
    for s in fitted[:3]:
        part = x[:, : s.size]
        norm = np.sqrt((part**2).sum(axis=1))
        part = part / np.where(norm > 0, norm, 1)[:, None]
        loss, g = dense_loss_and_gradient(part, label, s.weights, s.c)
        assert abs(loss - s.loss) < 1e-9 and np.linalg.norm(g) < 1e-4
    alone = sweeps.fit_all(df.repartition(4), asked[1:2], 3, tolerance=1e-7)[0]
    assert np.allclose(alone.weights, fitted[1].weights, atol=1e-6)
    out = sweeps.predict_all(df, fitted).collect()
    assert len(out) == 4 * len(x)
    z = x @ fitted[1].weights[:, :-1].T + fitted[1].weights[:, -1]
    assert {r.ord: r.prediction for r in out if r.run == 1} == dict(enumerate(z.argmax(axis=1).tolist()))


def test_settings_without_rows(spark):
    _, _, df = sparse_rows(spark, 5)
    assert all(s.converged and not s.weights.any() for s in sweeps.fit_all(df.limit(0), [(1.0, 5, 10)], 2))


# epochs


def test_epochs_see_every_row_in_an_order_of_their_own():
    buckets = list(range(23))
    orders = [epochs.epoch_batches(buckets, e, 5) for e in (1, 2, 1)]
    assert orders[0] == orders[2] != orders[1]
    assert all(sorted(b for batch in o for b in batch) == buckets and max(map(len, o)) == 4 for o in orders)


def test_training_repeats_on_any_layout_and_after_a_cut(spark, tmp_path):
    _, label, df = sparse_rows(spark, 240, 15)
    train, val = df.filter("ord < 180"), df.filter("ord >= 180")
    run = lambda rows, name, n: epochs.train_epochs(rows, val, 15, f"{tmp_path}/{name}", ["a", "b", "c"], n, 40, 0.2)
    whole = run(train.repartition(5), "whole", 4)
    other = run(train.repartition(2, "label"), "other", 4)
    assert np.array_equal(whole.weights, other.weights) and whole.history == other.history
    cut = run(train, "cut", 2)
    taken_up = run(train, "cut", 4)
    assert taken_up.history[:2] == cut.history and taken_up.history == whole.history
    assert np.array_equal(taken_up.weights, whole.weights)
    best = max(r["val_macro_f1"] for r in whole.history)
    assert whole.history[whole.best_epoch - 1]["val_macro_f1"] == best and best > 0.6
    assert all(r["rows_seen"] == 180 for r in whole.history) and whole.history[0]["train_loss"] > whole.history[-1]["train_loss"]


def test_an_epoch_that_was_not_finished_is_trained_again(spark, tmp_path):
    _, _, df = sparse_rows(spark, 60, 8)
    run = lambda: epochs.train_epochs(df, df, 8, str(tmp_path), ["a", "b", "c"], 2, 20)
    first = run()
    (tmp_path / "epoch-2" / "_SUCCESS").unlink()
    assert run().history == first.history


def test_epochs_without_rows(spark, tmp_path):
    _, _, df = sparse_rows(spark, 5, 4)
    none = epochs.train_epochs(df.limit(0), df, 4, str(tmp_path), ["a", "b", "c"], 2)
    assert not none.weights.any() and none.best_epoch == 1


def test_steps_share_jobs_and_files(spark, tmp_path, monkeypatch):
    _, _, df = sparse_rows(spark, 400, 8)
    tracker, jobs = spark.sparkContext.statusTracker(), []
    found = []
    for name, runs in (("one", 64), ("many", 3)):
        monkeypatch.setattr(epochs, "BATCHES_PER_TASK", runs)
        spark.sparkContext.setJobGroup(f"epochs-{name}", name)
        found.append(epochs.train_epochs(df, df, 8, f"{tmp_path}/{name}", ["a", "b", "c"], 2, 10))
        jobs.append(len(tracker.getJobIdsForGroup(f"epochs-{name}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0].history == found[1].history and np.array_equal(found[0].weights, found[1].weights)
    assert jobs[0] < 40 <= jobs[1]
    assert not list((tmp_path / "one" / "buckets").glob("bucket=*"))
    assert found[0].history[-1]["steps"] > 60


# blocks, tasks of a fit


def test_blocks_hold_every_row_and_multiply_as_dense_ones(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 40)
    x, label, df = sparse_rows(spark, 120, 20, 4)
    x[[0, 7, 119]], z = 0, np.linspace(-1, 1, 120)
    rows = [(int(k), np.flatnonzero(v).tolist(), v[v != 0].tolist()) for k, v in zip(label, x)]
    df = spark.createDataFrame(rows, "label int, indices array<int>, weights array<double>").coalesce(1)
    staged = blocks.stage_blocks(df, [lambda b: b, lambda b: b.first(7)])
    assert 10 < staged.count() < 60  # blocks, not rows
    w = np.arange(21.0)
    found, dots, back, short = [], [], np.zeros(21), []
    for batch in staged.toArrow().to_batches():
        for ids, views in blocks.read_blocks(batch, [0, 1]):
            back += views[0].back(z[len(found) : len(found) + len(ids)], 20)
            found += ids.tolist()
            dots += views[0].dot(w).tolist()
            short += views[1].dot(w[:8]).tolist()
    assert found == label.tolist() and np.allclose(dots, x @ w[:-1] + w[-1])
    assert np.allclose(back, np.append(x.T @ z, z.sum()))
    norm = np.sqrt((x[:, :7] ** 2).sum(axis=1))
    assert np.allclose(short, x[:, :7] @ w[:7] / np.where(norm > 0, norm, 1) + w[7])


def test_passes_of_a_fit_read_blocks(spark, monkeypatch):
    _, label, df = sparse_rows(spark, 90, 12)
    read = {"newton": set(), "sweeps": set()}
    for module in (newton, sweeps):
        name = module.__name__.rsplit(".", 1)[1]
        add = module.array_sum
        monkeypatch.setattr(module, "array_sum", lambda rows, *a, add=add, name=name, **k: read[name].update(t for _, t in rows.dtypes) or add(rows, *a, **k))
    assert newton.fit_squared_hinge(df, ["a", "b", "c"], 12).converged
    assert sweeps.fit_all(df, [(1.0, 12, 100)], 3)[0].converged
    assert read == {"newton": {"binary"}, "sweeps": {"binary"}}


def test_tasks_of_a_fit_follow_its_rows():
    assert [models.fit_tasks(n, 20_000) for n in (0, 2_001, 64_000, 155_000, 640_000, 1_900_000)] == [1, 2, 32, 32, 32, 95]
    assert models.fit_tasks(155_000, models.RF.max_rows) == 78


# forest


def forest_block(rng, n, size, classes, trees):
    """Codes of rows as a matrix and as a block in which each tree has each row one to three times."""
    dense = rng.integers(-2, 4, (n, size)) * (rng.random((n, size)) < 0.3)
    row, at = np.nonzero(dense)
    block = {
        "ends": np.append(0, np.cumsum((dense != 0).sum(axis=1))), "at": at, "code": dense[row, at], "label": rng.integers(0, classes, n),
        "row": np.repeat(np.arange(n), trees), "node": np.tile(np.arange(trees), n), "count": rng.integers(1, 4, n * trees),
    }
    return dense, block


def forest_sums(block, tried, size, classes):
    """Sums of a pass over the roots of trees without splits, from two tasks."""
    n = len(tried)
    trees = forest.Trees(np.full(n, -1), np.zeros(n, int), np.full(n, -1))
    run = forest._sums(trees, np.arange(n), tried, size, 2, 6, classes)
    return pa.concat_tables([pa.Table.from_batches(list(run(iter([forest._write(block)])))) for _ in range(2)])


def test_forest_takes_the_best_split(spark):
    rng, size, classes, n_trees = np.random.default_rng(3), 7, 3, 20
    dense, block = forest_block(rng, 60, size, classes, n_trees)
    tried = forest.candidates(rng, n_trees, size, 3)
    sums = forest_sums(block, tried, size, classes)
    found = {}
    for b in (0, 1):
        part = sums.filter(pa.compute.equal(sums.column("bucket"), b))
        cells = forest._best(3, 2, 6, classes)(part).column("found")[0].as_py()
        found |= {b * forest.BUCKET + i: x for i, x in enumerate(np.frombuffer(cells).reshape(forest.BUCKET, -1))}
    for t in range(n_trees):
        weight = 2 * block["count"].reshape(60, n_trees)[:, t]
        square = lambda rows: (np.bincount(block["label"][rows], weight[rows], classes) ** 2).sum() / max(weight[rows].sum(), 1)
        whole = square(np.full(60, True))
        gains = [[square(dense[:, f] <= c) + square(dense[:, f] > c) - whole for c in range(-2, 4)] for f in tried[t]]
        assert np.isclose(found[t][2], np.max(gains)) and np.isclose(gains[int(found[t][0])][int(found[t][1]) + 2], np.max(gains))
        assert found[t][-classes:].tolist() == np.bincount(block["label"], weight, classes).tolist()


def test_forest_exchanges_no_more_than_its_rows_hold():
    """Dense statistics would be 60 numbers for every feature tried at each of 400 nodes."""
    rng, size, n, n_trees = np.random.default_rng(4), 400, 5, 400
    dense, block = forest_block(rng, n, size, 10, n_trees)
    dense[:, 8:] = 0
    row, at = np.nonzero(dense)
    block |= {"ends": np.append(0, np.cumsum((dense != 0).sum(axis=1))), "at": at, "code": dense[row, at]}
    sums = forest_sums(block, forest.candidates(rng, n_trees, size, 20), size, 10)
    assert sum(len(k.as_py()) // 4 for k in sums.column("keys")) <= 2 * n * n_trees * (1 + 8)


def test_forest_sums_of_keys_and_numbers_of_any_size():
    rng = np.random.default_rng(6)
    for most, top in ((5, 12), (1 << 20, 1 << 30), (1 << 45, 1 << 30), (1 << 62, 12)):  # sorted as one, and apart
        keys = [rng.integers(0, most, 400), rng.integers(most - 5, most, 50), np.zeros(0, np.int64)]
        n = [rng.integers(0, 12, 400).astype(np.uint8), rng.integers(0, top, 50), np.zeros(0, np.uint8)]
        want = Counter()
        for k, x in zip(np.concatenate(keys).tolist(), np.concatenate([x.astype(np.int64) for x in n]).tolist()):
            want[k] += x
        found, sums = forest._added(keys, n)
        assert found.tolist() == sorted(want) and sums.tolist() == [want[k] for k in sorted(want)]
    assert [len(x) for x in forest._added([np.zeros(0, np.int64)], [np.zeros(0, np.uint8)])] == [0, 0]


def test_forest_candidates_and_bootstrap():
    rng = np.random.default_rng(5)
    tried = np.sort(forest.candidates(rng, 20_000, 10, 4), axis=1)
    assert (np.diff(tried, axis=1) > 0).all() and np.abs(np.bincount(tried.ravel()) / 20_000 - 0.4).max() < 0.02
    counts = forest.bootstrap(rng.random(5_000), 20, 42)
    assert abs(counts.mean() - 1) < 0.02 and abs((counts == 0).mean() - np.exp(-1)) < 0.01
    assert np.abs(np.corrcoef(counts.T) - np.eye(20)).max() < 0.08


def test_forest_learns_vectors_of_any_kind(spark):
    """A class between two others needs several cuts of a feature with values of both signs; some rows are dense."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    rows = [(float(abs(v[0]) < 0.6), Vectors.dense(v) if i % 2 else Vectors.sparse(3, [0, 1, 2], v)) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (0.0, Vectors.sparse(3, [], []))], StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())])).repartition(3)
    model = models.random_forest(401, 2, trees=25).fit(df)
    found = model.transform(df)
    assert found.filter("prediction = label").count() >= 385
    assert found.filter("abs(aggregate(probability, 0D, (a, p) -> a + p) - 1) > 1e-9").isEmpty()
    for bad in (None, 2.0, 0.5):
        with pytest.raises(Exception, match="labels must be"):
            models.random_forest(1, 2).fit(spark.createDataFrame([(bad, Vectors.dense([1.0]))], df.schema))
    with pytest.raises(ValueError, match="needs rows"):
        models.random_forest(0, 2).fit(df.limit(0))
