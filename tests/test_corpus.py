import random

import pytest

from uttermill.constants import INTENTS
from uttermill.operators import corpus
from uttermill.operators.augment import augment
from uttermill.operators.dedup import dedup_counts, dedup_first, distinct_base
from uttermill.plans.prepare import augment_train, plan_splits, prepare_corpus
from uttermill.plans.ranking import with_ordinal

RAW = "ord bigint, text string, intent string"


def test_missing_columns_fail_without_a_job(spark):
    with pytest.raises(ValueError, match="intent"):
        prepare_corpus(spark.createDataFrame([(1, "x")], "ord bigint, text string"))


def test_prepare_keeps_two_of_five(spark):
    df = spark.createDataFrame(
        [
            (0, "Thoda discount de do na", "price_negotiation"),
            (1, "Thoda discount de do na", "price_negotiation"),
            (2, "ok", "positive_confirmation"),
            (3, "Mera order deliver nahi hua", "complaint"),
            (4, "Random text with invalid intent", "unknown_intent_xyz"),
        ],
        RAW,
    )
    got = {r.ord: r for r in prepare_corpus(df).collect()}
    assert sorted(got) == [0, 3]
    assert (got[0].base_id, got[3].base_id) == ("price_negotiation_000", "complaint_003")
    assert (got[0].label, got[3].label) == (2, 0)


def test_base_ids_count_per_class_in_order(spark):
    df = spark.createDataFrame([(3, "c", "a"), (1, "x", "a"), (2, "y", "b")], RAW)
    got = {r.ord: r.base_id for r in corpus.assign_base_id(df, prefix="ood_").collect()}
    assert got == {1: "ood_a_001", 3: "ood_a_002", 2: "ood_b_001"}


def test_base_id_does_not_truncate_large_counts(spark):
    df = spark.range(1200).selectExpr("id AS ord", "'t' AS text", "'a' AS intent")
    ids = {r.base_id for r in corpus.assign_base_id(df).collect()}
    assert "a_1000" in ids and "a_001" in ids and len(ids) == 1200


@pytest.mark.parametrize("partitions", [None, 1, 20])
@pytest.mark.parametrize("class_col", [None, "intent"])
def test_ordinals_equal_brute_force(spark, class_col, partitions):
    rng = random.Random(7)
    orders = rng.sample(range(10**7), 900)
    rows = [(o, "t", "hot" if i % 3 else rng.choice(["a", "b", None])) for i, o in enumerate(orders)]
    df = spark.createDataFrame(rows, RAW).repartition(3)
    got = {r.ord: r.ordinal for r in with_ordinal(df, "ord", class_col, partitions=partitions).collect()}
    count, want = {}, {}
    for o, _, c in sorted(rows, key=lambda r: r[0]):
        k = c if class_col else ""
        count[k] = count.get(k, 0) + 1
        want[o] = count[k]
    assert got == want


def test_encode_label_unknown_is_null(spark):
    df = spark.createDataFrame([(x,) for x in [*INTENTS, "zzz", None]], "intent string")
    got = {r.intent: r.label for r in corpus.encode_label(df).collect()}
    assert [got[x] for x in INTENTS] == list(range(6)) and got["zzz"] is None and got[None] is None


def test_class_counts_sorted(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "intent string")
    assert [tuple(r) for r in corpus.class_counts(df).collect()] == [("b", 2), ("a", 1)]


def test_dedup_tells_null_from_empty(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, None, "a"), (4, "", None)], "ord bigint, clean_text string, intent string")
    assert sorted(r.ord for r in dedup_first(df).collect()) == [1, 2, 4]
    assert tuple(dedup_counts(df).first()) == (4, 3, 1)


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_dedup_keeps_first_with_a_hot_text(spark, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"t{rng.randrange(60)}", rng.choice("ab")) for i in range(600)]
    df = spark.createDataFrame(rows, "ord bigint, clean_text string, intent string").repartition(5)
    first = {}
    for o, t, c in rows:
        first.setdefault((t, c), o)
    kept = dedup_first(df)
    assert kept.columns == df.columns
    got = sorted(r.ord for r in kept.collect())
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted(first.values())
    assert tuple(dedup_counts(df).first()) == (600, len(first), 600 - len(first))


def test_distinct_base(spark):
    df = spark.createDataFrame([("x", 5, "late"), ("x", 2, "early"), ("y", 9, "only")], "base_id string, ord bigint, intent string")
    assert {(r.base_id, r.intent) for r in distinct_base(df).collect()} == {("x", "early"), ("y", "only")}


def _train(spark):
    return spark.createDataFrame(
        [
            (0, "comp_001", "Mera refund kyu nahi aaya", "complaint", "Mera refund kyu nahi aaya", "", 0, 0),
            (1, "price_001", "Thoda discount de do na", "price_negotiation", "Thoda discount de do na", "", 0, 2),
        ],
        "ord bigint, base_id string, text string, intent string, clean_text string, emojis string, excess_punct_count int, label int",
    )


def test_augment_makes_eight_variations(spark):
    rows = augment(_train(spark)).collect()
    assert len(rows) == 16 and {r.base_id for r in rows} == {"comp_001", "price_001"}
    texts = {r.clean_text for r in rows if r.base_id == "comp_001"}
    assert {"Mera refund kyu nahi aaya", "Hey, Mera refund kyu nahi aaya!", "Sunna Mera refund kyu nahi aaya."} <= texts
    assert [r.excess_punct_count for r in rows if r.text.startswith("Sunna")] == [1, 1]


def test_augment_drops_equal_results(spark):
    same = augment(_train(spark), [("", ""), ("", " "), ("Sir ", "")])
    assert same.count() == 4


def test_pipeline_splits_then_augments_train_only(spark):
    main = spark.createDataFrame([(i, f"text number {i}", INTENTS[i % 6]) for i in range(120)], RAW)
    ood = spark.createDataFrame([(1000 + i, f"text number {i}" if i < 3 else f"other text {i}", INTENTS[i % 6]) for i in range(12)], RAW)
    rows = plan_splits(main, ood).rows()
    before = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
    assert before == {"train": 84, "val": 18, "test": 18, "ood": 12}
    after = augment_train(rows)
    assert {r.split: r["count"] for r in after.groupBy("split").count().collect()} == {"train": 672, "val": 18, "test": 18, "ood": 12}
    assert after.select("ord").distinct().count() == after.count()
    assert after.filter("split = 'ood' and base_id not like 'ood\\_%'").count() == 0


def test_ood_is_optional(spark):
    main = spark.createDataFrame([(i, f"text number {i}", INTENTS[i % 6]) for i in range(60)], RAW)
    rows = plan_splits(main).rows()
    assert {r.split for r in rows.select("split").distinct().collect()} == {"train", "val", "test"}
    assert rows.count() == 60
