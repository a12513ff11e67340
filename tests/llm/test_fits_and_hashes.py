"""Span hashes, samples, gradients and orders against plain versions."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from uttermill.llm import chat_format, frames, grams, kernels, pii, quality_pu, quality_rules
from uttermill.llm.sql import SQL


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def bytes_of(*texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])


@pytest.mark.parametrize("n", [64, 1_024, 2_048, 1 << 16])
def test_words_that_defeat_wrapping_polynomials_hash_apart(n):
    one, two = thue_morse(n)
    data, bounds = bytes_of(one, two, one)
    a, b, c = kernels.SpanHasher(data)(bounds[:-1], bounds[1:]).tolist()
    assert a == c != b


def test_equal_spans_hash_alike_anywhere_and_prefixes_apart():
    data, _ = bytes_of("x" * 999 + "\x00\x00\x00" + "x" * 999)
    h = kernels.SpanHasher(data)
    starts = np.array([0, 5, 1_002, 999, 1_000])
    a, b, c, d, e = h(starts, starts + np.array([7, 7, 7, 1, 2])).tolist()
    assert a == b == c and len({a, d, e}) == 3
    assert len(set(h(np.zeros(900, np.int64), np.arange(900)).tolist())) == 900


def test_statistics_tell_such_lines_words_and_windows_apart():
    one, two = thue_morse(2_048)
    get = lambda t: {k: v.tolist() for k, v in quality_rules.text_statistics(*bytes_of(t)).items()}
    assert get(f"{one}\n{two}")["n_dup_lines"] == [0] and get(f"{one}\n{one}")["n_dup_lines"] == [1]
    assert get(f"{one} x y {two} x y")["n_repeat_words"] == [0] and get(f"{one} x y {one} x y")["n_repeat_words"] == [6]


# grams


def plain_grams(text):
    """Grams and their number by family; a pair of equal words is one gram whatever the word."""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    pairs = ["again" if a == b else (a, b) for a, b in zip(words, words[1:])]
    chars = [text[i : i + 3] for i in range(len(text) - 2)]
    return {"chars": (chars, len(chars)), "words": (words, len(words)), "pairs": (pairs, len(pairs)),
            "repeats": ([p for p in pairs if p == "again"], len(pairs))}


def test_grams_are_of_code_points_words_and_pairs():
    texts = ["", "ab", "abc abc abc", "é日🙂 é日🙂 ß", "x y x y z z", " \n one  two\x0b"]
    data, bounds = bytes_of(*texts)
    families = ("chars", "words", "pairs", "repeats")
    for (index, row, count), family in zip(grams.gram_ids(data, bounds, 40, families), families):
        every = [plain_grams(t)[family] for t in texts]
        assert count.tolist() == [n for _, n in every]
        seen = {}  # the same gram has one index in all texts, another gram another one
        for k, (want, _) in enumerate(every):
            got = index[row == k].tolist()
            assert len(got) == len(want) and all(seen.setdefault(g, i) == i for g, i in zip(want, got))
        assert len(set(seen.values())) == len(seen)


def test_margins_equal_sums_over_grams():
    rng = np.random.default_rng(2)
    texts = ["one two two one", "", "é é é", "x" * 500, "long " * 4_000]
    data, bounds = bytes_of(*texts)
    weights = rng.normal(size=3 << 10)
    want = np.zeros(len(texts))
    for index, row, count in grams.gram_ids(data, bounds, 10):
        for i, r in zip(index.tolist(), row.tolist()):
            want[r] += weights[i] / count[r]
    assert np.allclose(grams.margins(data, bounds, weights, 10), want)


# samples


def hot_docs(spark, n=6_000):
    """A third of all rows under one id."""
    one = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id")
    extra = ", ".join(f"1 AS {c}" for c in ("text_", "v", "y", "fold", "positive"))
    return spark.range(n).select(one, F.concat(F.lit("some text of row "), "id", F.lit(" and more")).alias("text"), F.expr("1 AS v"), F.expr("1 AS y"), F.expr("true AS fold"), F.expr("1 AS positive")).selectExpr("*", extra.split(", ")[0])


def test_samples_are_bounded_in_rows(spark):
    docs = hot_docs(spark)
    ids = docs.select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    for bound in (4, 400):
        chosen = frames.bounded_share(ids, "id", bound).union(ids.filter("id = 7")).distinct()
        found = frames.one_row_each(rows.join(F.broadcast(chosen), "id"), ["id"], "text")
        assert found.count() == chosen.count() and found.filter("id = 7").count() == 1
    again = frames.one_row_each(rows.repartition(9), ["id"], "text")
    assert again.exceptAll(frames.one_row_each(rows, ["id"], "text")).count() == 0


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_fits_with_a_hot_id_and_clashing_columns(spark):
    docs = hot_docs(spark, 1_500)
    labels = labels_of(spark, [(i, int(i % 2)) for i in range(0, 300)] + [(7, 1)])
    assert quality_rules.apply_rules(docs, quality_rules.fit(docs, labels)).count() == docs.count()
    model = quality_pu.fit(docs, labels, rounds=1)
    assert quality_pu.scores(docs, model).count() == docs.count()
    assert quality_pu.keep_good(docs, labels, rounds=0, keep_at=0.0).columns == docs.columns
    assert quality_rules.fit(docs.limit(0), labels) is None


# the risk of positives and unlabelled text


def risk(model, positives, texts):
    z = lambda ts: model.intercept + grams.margins(*bytes_of(*ts), model.weights, quality_pu.BITS, quality_pu.FAMILIES)
    return quality_pu.non_negative_risk(z(positives), z(texts), model.prior)[0]


def some_texts(n=240):
    good = [f"a fine sentence number {i} with some plain words in it" for i in range(n // 2)]
    return good, good + [f"$$$ ### win {i} $$$ ### win now" for i in range(n // 2)]


def test_full_rounds_lower_the_risk_over_all_rows(spark):
    good, every = some_texts()
    frame = lambda ts: spark.createDataFrame([(t,) for t in ts], "text string").repartition(5)
    size = len(quality_pu.FAMILIES) << quality_pu.BITS
    for start in (quality_pu.PuModel(np.zeros(size), 0.0, 0.5), quality_pu.PuModel(np.random.default_rng(3).normal(size=size), 1.0, 0.3)):
        found = quality_pu.risk_and_gradient(start, frame(good), frame(every), len(good), len(every))[0]
        assert np.isclose(found, risk(start, good, every))
        values = [risk(quality_pu.refine(start, frame(good), frame(every), rounds), good, every) for rounds in (0, 2, 5)]
        assert values[0] >= values[1] >= values[2] and values[0] > values[2]
    assert quality_pu.refine(start, frame(good).limit(0), frame(every)) is start


def test_the_gradient_over_all_rows_is_that_of_the_risk():
    good, every = some_texts(20)
    rng = np.random.default_rng(1)
    model = quality_pu.PuModel(rng.normal(size=len(quality_pu.FAMILIES) << quality_pu.BITS), 0.3, 0.4)
    sums = quality_pu._sums_of(model, lambda z: [quality_pu._sigmoid(z)], 1)(pa.RecordBatch.from_pydict({"text": every}))
    loss = lambda m: np.logaddexp(0, m.intercept + grams.margins(*bytes_of(*every), m.weights, quality_pu.BITS, quality_pu.FAMILIES)).sum()
    assert np.isclose(sums[0], loss(model))
    some = np.argsort(-np.abs(sums[2:]))[:5]
    for k in some.tolist():
        moved = model.weights.copy()
        moved[k] += 1e-4
        assert np.isclose((loss(quality_pu.PuModel(moved, 0.3, 0.4)) - loss(model)) / 1e-4, sums[2 + k], rtol=1e-2)
    assert np.isclose((loss(quality_pu.PuModel(model.weights, 0.3 + 1e-5, 0.4)) - loss(model)) / 1e-5, sums[1], rtol=1e-3)


@pytest.mark.parametrize("unlabelled", [0, 3])
def test_few_or_no_unlabelled_documents(spark, unlabelled):
    good, every = some_texts(400)
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    labels = labels_of(spark, [(i, int(i < len(good))) for i in range(len(every) - unlabelled)])
    out = quality_pu.scores(docs, quality_pu.fit(docs, labels)).collect()
    right = sum((r.score >= 0.3) == (r.doc_id < len(good)) for r in out)
    assert right >= 0.97 * len(every)


# personal data


def test_outlines_are_of_whole_words():
    assert pii.shape("a" * 100 + "1") != pii.shape("a" * 100 + ".1")
    assert pii.shape("x" * 500 + "@y" + "2" * 300)[1] == "a@a300#"


# chat


def test_turns_without_numbers_are_spread_and_equal_sql(spark):
    rows = [(None, None, "user", f"text {i % 700}") for i in range(2_000)] + [(None, None, None, None)] * 500
    rows += [(5, None, "user", f"text {k}") for k in range(3)] + [(6, None, "user", "text 0"), (6, None, "user", "text 1")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    con = duckdb.connect()
    con.register("conversations", turns.toArrow())
    want = sorted(con.execute(SQL["op6_chat_format"]).fetchall(), key=repr)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted([tuple(r) for r in chat_format.chat_texts(turns, block_turns=64).collect()], key=repr)
        part = F.xxhash64(F.isnull("role"), "role", "text")
        keys = turns.select(F.coalesce("conv_id", F.lit(frames.NO_ID)).alias("conv"), "turn", "role", "text", part.alias("a"), part.alias("b"))
        hashed = chat_format.rolling_hashes(keys, 64)
        assert hashed.filter(F.col("conv") == frames.NO_ID).select("at").distinct().count() == 2_500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want
