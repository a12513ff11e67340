import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from uttermill.constants import KEYWORDS
from uttermill.operators import features as ft
from uttermill.operators.classify import fit_naive_bayes, keyword_classify

TEXTS = ["red red blue", "blue green", "red green green yellow", "blue blue blue red"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, clean_text string")


def grams(text):
    w = [x for x in text.lower().split() if len(x) > 1]
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def brute(texts, fit, size, sublinear):
    total = sum((grams(t) for t in fit), Counter())
    vocab = sorted(total, key=lambda t: (-total[t], t))[:size]
    idf = {t: math.log((1 + len(fit)) / (1 + sum(t in grams(x) for x in fit))) + 1 for t in vocab}
    out = {}
    for d, t in enumerate(texts):
        raw = {g: (1 + math.log(n) if sublinear else n) * idf[g] for g, n in grams(t).items() if g in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.update({(d, g): v / norm for g, v in raw.items()})
    return vocab, out


def test_vocabulary_order_and_cap(spark):
    got = [(r.term, r.corpus_tf) for r in ft.vocabulary(docs(spark), 4).collect()]
    total = sum((grams(t) for t in TEXTS), Counter())
    assert got == sorted(total.items(), key=lambda kv: (-kv[1], kv[0]))[:4]


@pytest.mark.parametrize("size", [1, 3, 5, 9, 100])
def test_pruned_vocabulary_is_the_same(spark, size):
    rng = random.Random(size)
    texts = [" ".join(rng.choices(["aa", "bb", "cc", "dd", "ee", "ff", "gg"], [9, 7, 5, 3, 2, 1, 1], k=rng.randrange(0, 9))) for _ in range(60)]
    total = sum((grams(t) for t in texts), Counter())
    pruned = ft.vocabulary(docs(spark, texts), size).collect()
    assert [tuple(r) for r in pruned] == sorted(total.items(), key=lambda kv: (-kv[1], kv[0]))[:size]


@pytest.mark.parametrize("numbered", [1, 2, 4])
@pytest.mark.parametrize("size", [1, 2, 4, 7])
def test_words_that_tie_at_the_bound(spark, size, numbered):
    texts = ["aa zz aa zz", "bb yy", "bb yy", "cc xx", "cc xx aa", "dd", "dd ww ww", "bb", None, "é é éé ßß"]
    total = sum((grams(t) for t in texts if t), Counter())
    want = sorted(total.items(), key=lambda kv: (-kv[1], kv[0].encode()))[:size]
    rows = ft.number_words(ft.stage_words(docs(spark, texts), ["doc_id"]), ["doc_id"], size, numbered=numbered)
    assert [tuple(r) for r in rows.vocabulary().collect()] == want
    vocab = [t for t, _ in want]
    got = {r.doc_id: (r.indices, r.counts) for r in rows.counts(vocab, ["doc_id"]).collect()}
    same = {r.doc_id: (r.indices, r.counts) for r in ft.with_counts(docs(spark, texts), vocab).collect()}
    assert got == same and len(got) == len(texts)


def test_texts_are_cut_into_words_once(spark):
    calls, stage = [], ft.stage
    ft.stage = lambda df, *a: (calls.append(df._jdf.queryExecution().optimizedPlan().toString()), stage(df, *a))[1]
    try:
        model, counts = ft.fit_tfidf_counts(docs(spark), ["doc_id"], 5)
        plan = model.transform(counts)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        ft.stage = stage
    assert sum("regexp_extract_all" in p for p in [*calls, plan]) == 1


def test_rows_with_many_words_are_counted_in_slices(spark, monkeypatch):
    vocab, want = ft.fit_counts(docs(spark), ["doc_id"], 50)
    monkeypatch.setattr(ft, "SLICE", 1)
    assert ft.fit_counts(docs(spark), ["doc_id"], 50)[0] == vocab
    assert sorted(ft.fit_counts(docs(spark), ["doc_id"], 50)[1].collect()) == sorted(want.collect())


def test_vocabulary_of_no_words(spark):
    assert ft.vocabulary(docs(spark, ["", " "]), 5).count() == 0


def test_term_counts_shuffle_nothing(spark):
    plan = ft.term_counts(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_term_counts(spark):
    got = {(r.doc_id, r.term): r.tf for r in ft.term_counts(docs(spark)).collect()}
    assert got == {(d, g): n for d, t in enumerate(TEXTS) for g, n in grams(t).items()}


def test_term_counts_of_repeated_and_null_ids(spark):
    texts = [(1, "red red blue"), (1, "red"), (None, "blue blue"), (None, "blue"), (2, "green"), (3, None), (4, "")]
    found = ft.term_counts(spark.createDataFrame(texts, "doc_id bigint, clean_text string"))
    want = {(1, "red"): 3, (1, "blue"): 1, (1, "red red"): 1, (1, "red blue"): 1, (None, "blue"): 3, (None, "blue blue"): 1, (2, "green"): 1}
    rows = found.collect()
    assert {(r.doc_id, r.term): r.tf for r in rows} == want and len(rows) == len(want)
    assert dict(found.dtypes) == {"doc_id": "bigint", "term": "string", "tf": "bigint"}


@pytest.mark.parametrize("sublinear", [False, True])
@pytest.mark.parametrize("size", [3, 50])
def test_tfidf_equals_brute_force(spark, sublinear, size):
    fit = TEXTS[:3]
    model = ft.fit_tfidf(docs(spark, fit), size, sublinear)
    vocab, want = brute(TEXTS, fit, size, sublinear)
    assert model.vocab == vocab
    got = {(r.doc_id, r.term): r.weight for r in model.long(docs(spark)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_staged_counts_and_smaller_variant(spark):
    vocab = ft.fit_vocabulary(docs(spark), 50)
    counts = ft.stage_counts(docs(spark), vocab, ["doc_id"])
    small = ft.fit_idf(counts, vocab).variant(3, True)
    _, want = brute(TEXTS, TEXTS, 3, True)
    got = {(r.doc_id, r.term): r.weight for r in small.long(counts).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_vectors_hold_the_weights(spark):
    model = ft.fit_tfidf(docs(spark), 5)
    wide = model.transform(docs(spark))
    vec = {r.doc_id: r.features for r in ft.as_vectors(wide, 5, ["doc_id"]).collect()}
    for r in wide.collect():
        assert vec[r.doc_id].size == 5
        assert list(vec[r.doc_id].indices) == r.indices and list(vec[r.doc_id].values) == r.weights


def test_empty_vocabulary_is_an_error(spark):
    with pytest.raises(ValueError):
        ft.fit_tfidf(docs(spark, ["! ?", ""]))


def test_keyword_rules(spark):
    texts = {
        "refund do, kharab hai": "complaint",
        "price kam karo": "price_negotiation",  # kam and kam karo both count
        "call me, kharab": "complaint",  # tie: first class
        "hello": "purchase_inquiry",  # no hit: default
        "CALL LATER": "callback_request",
    }
    df = spark.createDataFrame([(t,) for t in texts], "clean_text string")
    assert {r.clean_text: r.predicted_intent for r in keyword_classify(df).collect()} == texts
    assert sum(map(len, KEYWORDS.values())) == 82


def test_naive_bayes_equals_brute_force(spark):
    rng = random.Random(5)
    words = {"a": ["red", "blue", "sun"], "b": ["cold", "snow", "blue"], "c": ["car", "road", "sun"]}
    rows = [(i, " ".join(rng.choices(words[c] + ["the", "and"], k=6)), c) for i, c in enumerate(rng.choices("aabc", k=60))]
    df = spark.createDataFrame(rows, "doc_id bigint, clean_text string, intent string")
    train, held = df.filter("doc_id < 45"), df.filter("doc_id >= 45")
    model = fit_naive_bayes(train, ft.fit_tfidf(train, 20), ["a", "b", "c"])
    got = {r.doc_id: r.predicted_intent for r in model.predict(held).collect()}

    fit = [t for i, t, _ in rows if i < 45]
    vocab, w = brute([t for _, t, _ in rows], fit, 20, False)
    want = {}
    for d, _, _ in rows[45:]:
        scores = []
        for c in "abc":
            own = [i for i, _, k in rows[:45] if k == c]
            sums = {t: sum(w.get((i, t), 0) for i in own) + 0.5 for t in vocab}
            mass = sum(sums.values())
            scores.append(math.log(len(own) / 45) + sum(w.get((d, t), 0) * math.log(sums[t] / mass) for t in vocab))
        want[d] = "abc"[max(range(3), key=lambda k: scores[k])]
    assert got == want


@pytest.mark.parametrize("sizes", [(1, 1), (1, 2), (1, 4), (2, 3), (3, 3)])
@pytest.mark.parametrize("k", [5, 60, 100_000])
def test_ngram_vocabulary_equals_full_counts(spark, sizes, k):
    rng = random.Random(k)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd"] + [f"w{i}" for i in range(20)]) for _ in range(rng.randrange(0, 15))) for _ in range(80)]
    counts = Counter()
    for t in texts:
        words = t.split()
        counts.update(" ".join(words[i : i + n]) for n in range(sizes[0], sizes[1] + 1) for i in range(len(words) - n + 1))
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "clean_text string")
    assert [tuple(r) for r in ft.ngram_vocabulary(df, sizes, k).orderBy(F.desc("corpus_tf"), "term").collect()] == want
    assert ft.ngram_vocabulary(df.limit(0), sizes, k).count() == 0
