import random
import re

import pytest

from uttermill.operators import contamination
from uttermill.operators.contamination import decontaminate, ngram_overlap
from uttermill.operators.corpus import with_clean_columns

TABLES = "/root/testdata/sf0.01"


def grams(text, n):
    words = re.findall(r"\w\w+", (text or "").lower())
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_overlap_equals_brute_force(spark):
    docs = [(1, "one two three four five six"), (2, "two three four"), (3, None), (4, ""), (5, "six five one two three"), (6, "two three four two three four")]
    items = [(10, "one two three four"), (11, "four five"), (12, "x y"), (13, None), (14, "two three four"), (15, "six six six six")]
    got = ngram_overlap(
        spark.createDataFrame(docs, "doc_id long, clean_text string").repartition(3),
        spark.createDataFrame(items, "item_id long, clean_text string"),
        n=3,
    )
    want = {}
    for d, t in docs:
        for i, s in items:
            if both := grams(t, 3) & grams(s, 3):
                want[d, i] = (len(both), round(len(both) / len(grams(s, 3)), 6))
    assert {(r.doc_id, r.item_id): (r.n_shared, r["share"]) for r in got.collect()} == want
    rows, held = (spark.createDataFrame(x, f"{i} long, clean_text string") for x, i in ((docs, "doc_id"), (items, "item_id")))
    assert sorted(r.doc_id for r in decontaminate(rows, held, n=3).collect()) == [3, 4]
    assert sorted(r.doc_id for r in decontaminate(rows, held, n=3, min_share=1.01).collect()) == [1, 2, 3, 4, 5, 6]


def test_verbatim_passages_are_found_and_removed(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{TABLES}/benchmark.parquet")
    passages = [r.text for r in items.collect()]
    planted = {r.doc_id for r in docs.collect() if any(p in (r.text or "") for p in passages)}
    left = {r.doc_id for r in decontaminate(with_clean_columns(docs), with_clean_columns(items)).collect()}
    assert len(planted) >= 20 and not planted & left and len(left) > 900


def test_no_items(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, clean_text string")
    none = docs.limit(0).withColumnRenamed("doc_id", "item_id")
    assert ngram_overlap(docs, none).count() == 0 and decontaminate(docs, none).count() == 1
    assert decontaminate(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8, 1.0])
def test_prefix_filter_equals_all_pairs(spark, share):
    rng = random.Random(3)
    common = "the terms of use apply to all of it"
    line = lambda k: " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(k))
    items = [(i, " ".join([line(rng.randrange(0, 9)), common if i % 2 else ""])) for i in range(20)] + [(None, line(6)), (None, line(7)), (3, line(5))]
    docs = [(i, " ".join([line(rng.randrange(0, 12)), common, rng.choice(items)[1]][: rng.randrange(1, 4)])) for i in range(120)]
    docs += [(None, items[0][1]), (None, "clean words only"), (5, items[2][1]), (5, "clean words only"), docs[7]]
    rows, held = (spark.createDataFrame(x, f"{i} long, clean_text string") for x, i in ((docs, "doc_id"), (items, "item_id")))
    bad = lambda t: any(grams(s, 3) and round(len(grams(t, 3) & grams(s, 3)) / len(grams(s, 3)), 6) >= share for _, s in items)
    want = sorted([(i, t) for i, t in docs if not bad(t)], key=repr)
    got = decontaminate(rows.repartition(4), held, share, n=3)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == want


def test_a_common_ngram_makes_no_pairs(spark):
    """A passage that all documents share is among the common half of every item."""
    items = [(i, f"aa{i} bb{i} cc{i} dd{i} ee{i} ff{i} the terms of use apply") for i in range(30)]
    docs = [(i, f"xx{i} yy{i} zz{i} the terms of use apply") for i in range(200)] + [(500, items[4][1])]
    rows, held = (spark.createDataFrame(x, f"{i} long, clean_text string") for x, i in ((docs, "doc_id"), (items, "item_id")))
    made = []
    real = contamination.stage
    contamination.stage = lambda df, name: made.append((name, out := real(df, name))) or out
    try:
        found = contamination.contaminated_rows(rows, held, n=3).collect()
    finally:
        contamination.stage = real
    assert [r.item_id for r in found] == [4]
    assert dict((k, v.count()) for k, v in made)["candidate-pairs"] == 1
    assert ngram_overlap(rows, held, n=3).count() >= 200 * 30
