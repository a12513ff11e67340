import pytest

from uttermill.constants import INTENTS
from uttermill.operators.leakage import assert_no_leakage, overlap_report
from uttermill.operators.split import check_ratios, fit_group_split, hash_split, stratified_group_split

SCHEMA = "base_id string, intent string, ord bigint"


def frame(spark, n=120):
    return spark.createDataFrame([(f"id_{i:04d}", INTENTS[i % 6], i) for i in range(n)], SCHEMA)


def test_exact_quotas_and_disjoint_ids(spark):
    got = stratified_group_split(frame(spark)).collect()
    assert len(got) == 120 and len({r.base_id for r in got}) == 120
    for intent in INTENTS:
        per = [r.split for r in got if r.intent == intent]
        assert [per.count(s) for s in ("train", "val", "test")] == [14, 3, 3]


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_bucket_width_does_not_change_the_split(spark, digits):
    base = {r.base_id: r.split for r in stratified_group_split(frame(spark)).collect()}
    other = {r.base_id: r.split for r in stratified_group_split(frame(spark), digits=digits).collect()}
    assert base == other


def test_seed_changes_and_reproduces(spark):
    a = {r.base_id: r.split for r in stratified_group_split(frame(spark), seed=1).collect()}
    b = {r.base_id: r.split for r in stratified_group_split(frame(spark).repartition(7), seed=1).collect()}
    c = {r.base_id: r.split for r in stratified_group_split(frame(spark), seed=2).collect()}
    assert a == b and a != c


def test_quotas_of_140(spark):
    got = stratified_group_split(frame(spark, 840)).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 588, "val": 126, "test": 126}


@pytest.mark.parametrize("n", [1, 2, 3])
def test_tiny_classes_are_complete(spark, n):
    df = spark.createDataFrame([(f"i{i}", "a", i) for i in range(n)], SCHEMA)
    assert stratified_group_split(df).filter("split is null").count() == 0


def test_rows_of_an_id_stay_together_despite_mixed_classes(spark):
    rows = [(f"g{i % 40}", "ab"[(i // 40 + i) % 2], i) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    fitted = fit_group_split(df)
    assert fitted.mixed.count() == 40
    got = fitted.assign(df)
    assert got.count() == 400 and got.filter("split is null").count() == 0
    assert got.select("base_id", "split").distinct().count() == 40


def test_many_classes(spark):
    df = spark.range(3000).selectExpr("concat('i', id) AS base_id", "concat('c', id % 300) AS intent", "id AS ord")
    per = stratified_group_split(df).groupBy("intent", "split").count().groupBy("split").agg({"count": "min", "*": "count"})
    assert {r.split: (r[1], r[2]) for r in per.collect()} == {"train": (7, 300), "val": (2, 300), "test": (1, 300)}


def test_unlabelled_rows_get_no_split(spark):
    df = frame(spark, 24).unionByName(spark.createDataFrame([("none", None, 99)], SCHEMA))
    got = stratified_group_split(df)
    assert got.count() == 25 and [r.base_id for r in got.filter("split is null").collect()] == ["none"]


def test_zero_ratio(spark):
    got = stratified_group_split(frame(spark), ratios=(0.8, 0.0, 0.2)).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 96, "test": 24}


@pytest.mark.parametrize("ratios", [(0.7, 0.2, 0.2), (0.5, 0.5), (1.2, -0.1, -0.1)])
def test_bad_ratios(ratios):
    with pytest.raises(ValueError):
        check_ratios(ratios)


def test_hash_split_is_near_its_ratios(spark):
    got = {r.split: r["count"] for r in hash_split(frame(spark, 6000)).groupBy("split").count().collect()}
    assert abs(got["train"] - 4200) < 200 and abs(got["val"] - 900) < 150 and sum(got.values()) == 6000


def leak(spark, *rows):
    return spark.createDataFrame(list(rows), "base_id string, clean_text string, split string")


BASE = [
    ("base_1", "train phrase one", "train"),
    ("base_2", "train phrase two", "train"),
    ("base_3", "val phrase three", "val"),
]


def test_disjoint_splits_pass(spark):
    assert assert_no_leakage(leak(spark, *BASE, ("base_4", "test phrase four", "test"))) is True


@pytest.mark.parametrize(
    "row,shown",
    [
        (("base_1", "different text but same id", "test"), "base_1"),
        (("base_99", "train phrase one", "test"), "train phrase one"),
        (("base_3", "new", "train"), "base_3"),
        (("base_9", "train phrase two", "ood"), "train phrase two"),
    ],
)
def test_overlap_raises(spark, row, shown):
    with pytest.raises(ValueError, match="^CRITICAL LEAKAGE") as e:
        assert_no_leakage(leak(spark, *BASE, row))
    assert shown in str(e.value)


def test_val_is_not_compared_with_ood(spark):
    assert assert_no_leakage(leak(spark, *BASE, ("base_3", "val phrase three", "ood")))


def test_overlap_counts_distinct_values(spark):
    df = leak(spark, *BASE, *[("base_1", f"t{i}", "test") for i in range(50)], ("base_2", "val phrase three", "test"))
    got = {(r.kind, r.left_split, r.right_split): r.n_shared for r in overlap_report(df).collect()}
    assert got[("base_id", "train", "test")] == 2 and got[("clean_text", "val", "test")] == 1
    assert got[("base_id", "train", "val")] == 0
