import numpy as np
import pytest
from pyspark.sql import functions as F

from uttermill.constants import ACTIONS, DEFAULT_ACTION, INTENTS, KEYWORDS
from uttermill.operators import scoring
from uttermill.operators.scoring import classify_batches, python_list_scorer, score_batch, text_lists

TEXTS = ["Thoda discount de do na bhai price bohot zyada hai", "Order deliver nahi hua, refund do", " 😀 ", "hello"]


def asked(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def test_response_shape(spark):
    for r in scoring.score_batch(asked(spark)).collect():
        assert r.intent in INTENTS and 0 <= r.confidence <= 1
        assert set(r.all_scores) == set(INTENTS) and abs(sum(r.all_scores.values()) - 1) < 0.05
        assert r.is_uncertain == r.fallback == (r.confidence < 0.60)
        assert r.secondary_confidence <= r.confidence and r.secondary_intent != r.intent


def test_ties_take_the_lowest_id_and_empty_clean_keeps_raw(spark):
    got = {r.id: r for r in scoring.score_batch(asked(spark)).collect()}
    assert (got[3].intent, got[3].secondary_intent, got[3].confidence) == (INTENTS[0], INTENTS[1], 0.1667)
    assert got[2].cleaned_text == "😀"


@pytest.mark.parametrize("threshold,uncertain", [(0.999, 4), (0.0, 0)])
def test_threshold(spark, threshold, uncertain):
    assert scoring.score_batch(asked(spark), threshold=threshold).filter("fallback").count() == uncertain


def test_threshold_compares_rounded_strictly(spark):
    df = spark.createDataFrame([(0.6,), (0.5999,)], "confidence double")
    assert [r.fallback for r in scoring.with_fallback(df, 0.6).orderBy(F.desc("confidence")).collect()] == [False, True]


def test_bad_threshold(spark):
    with pytest.raises(ValueError):
        scoring.score_batch(asked(spark), threshold=1.5)


def test_softmax_of_large_scores(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, 0.0],)], "scores array<double>")
    assert scoring.with_probabilities(df).first().probs == [0.5, 0.5, 0.0]


def test_plug_in_model(spark):
    def make_predict():
        def predict(texts):
            assert len(texts) <= 2
            return np.array([[len(t) % 3 == k for k in range(3)] for t in texts], dtype=float) * 5

        return predict

    got = scoring.score_batch(asked(spark), ["x", "y", "z"], scoring.python_scorer(make_predict, batch_size=2)).collect()
    assert len(got) == 4 and all(r.intent == "xyz"[len(r.cleaned_text) % 3] for r in got)


def test_single_class(spark):
    r = scoring.score_batch(asked(spark), ["only"], scoring.keyword_scorer({"only": ["x"]})).first()
    assert (r.intent, r.confidence, r.secondary_intent, r.secondary_confidence) == ("only", 1.0, None, None)


def test_validation(spark):
    df = asked(spark, ["ok", "", None, "x" * 1001, "x" * 1000, "   "])
    got = [r.reject_reason for r in scoring.validate_requests(df).orderBy("id").collect()]
    assert got == [None, "too_short", "too_short", "too_long", None, "empty_text"]


def test_batch_size(spark):
    assert scoring.check_batch_size(asked(spark)) == 4
    for n in (0, 101):
        with pytest.raises(ValueError):
            scoring.check_batch_size(spark.range(n))


def test_ranking_marks_the_top(spark):
    rows = scoring.score_ranking(scoring.score_batch(asked(spark)), ["id"]).filter("id = 1").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 7)) and [r.is_top for r in rows] == [True] + [False] * 5
    assert rows[0].score >= rows[1].score and "_" not in rows[1].display


def test_routing(spark):
    df = spark.createDataFrame(
        [("complaint", 0.9, False, "not_interested", 0.05), ("other", 0.3, True, "callback_request", 0.256)],
        "intent string, confidence double, fallback boolean, secondary_intent string, secondary_confidence double",
    )
    got = {r.intent: r for r in scoring.route_actions(df).collect()}
    assert got["complaint"].action == ACTIONS["complaint"][0] and got["complaint"].fallback_intent is None
    assert got["other"].action == DEFAULT_ACTION[0] and got["other"].fallback_intent == "callback request (26%)"
    assert "<" not in got["complaint"].action_text and got["complaint"].display_intent == "complaint"


# request lists


def test_batches_equal_single_texts(spark):
    words = [KEYWORDS[x] for x in INTENTS]

    def keyword_model():
        return lambda texts: [[float(sum(w in t.lower() for w in ws)) for ws in words] for t in texts]

    texts = ["Refund kab aayega??", "", "  ", "😀😀", "Thoda discount de do na", "call me   later", "haan done", "x" * 900, "NO\tthanks"]
    lists = [texts, texts[:1], texts[3:5], ["haan"] * 100]
    bad = [None, [], ["a"] * 101, ["ok", None]]
    df = spark.createDataFrame(list(enumerate(lists + bad)), "id int, texts array<string>")
    singles = score_batch(spark.createDataFrame([(t,) for t in {*texts, "haan"}], "text string")).collect()
    names = ["intent", "confidence", "is_uncertain", "fallback", "secondary_intent", "secondary_confidence", "cleaned_text", "all_scores"]
    want = {r.text: tuple(r[c] for c in names) for r in singles}
    for scorer in (None, python_list_scorer(keyword_model, batch_size=4)):
        got = {r.id: r for r in classify_batches(df, scorer=scorer).collect()}
        for k, ts in enumerate(lists):
            assert got[k].total == len(ts) and got[k].reject_reason is None
            assert [tuple(r[c] for c in names) for r in got[k].results] == [want[t] for t in ts]
        assert [(got[k].reject_reason, got[k].results, got[k].total) for k in range(4, 8)] == [
            (reason, None, None) for reason in ("no_texts", "no_texts", "too_many_texts", "null_text")
        ]
    out = classify_batches(df)
    assert out.columns == ["id", "texts", "reject_reason", "results", "total"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_threshold_of_a_list_may_be_its_own(spark):
    df = spark.createDataFrame([(["refund"], 0.0), (["refund"], 1.0)], "texts array<string>, confidence_threshold double")
    assert [r.results[0].fallback for r in classify_batches(df, threshold="confidence_threshold").collect()] == [False, True]
    with pytest.raises(ValueError, match="threshold"):
        classify_batches(df, threshold=1.5)


def test_text_lists_keep_order_and_never_gather_large_requests(spark):
    rows = [(1, 2, "b"), (1, 1, "a"), (1, 3, None), (None, 1, "n"), (2, 1, "x")] + [(3, k, "y") for k in range(7)]
    df = spark.createDataFrame(rows, "id int, turn int, text string")
    got = {r.id: r.texts for r in text_lists(df, "id", ["turn"], limit=5).collect()}
    assert got == {1: ["a", "b", None], None: ["n"], 2: ["x"], 3: [""] * 6}
