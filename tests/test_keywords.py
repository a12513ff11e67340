"""Keyword tables against a plain search."""

import random
import re

import numpy as np
import pytest

from uttermill.constants import INTENTS, KEYWORD_DEFAULT, KEYWORDS
from uttermill.operators import keywords
from uttermill.operators.classify import keyword_classify

ALPHABET = "abcé日"


def brute(texts, words):
    return sorted({(k, n) for k, t in enumerate(texts) for n, w in enumerate(words) if w in t})


@pytest.mark.parametrize("stretch", [1, 2, 7, 256])
def test_automaton_finds_every_keyword_of_every_row(monkeypatch, stretch):
    monkeypatch.setattr(keywords, "STRETCH", stretch)
    rng = random.Random(stretch)
    some = lambda n: "".join(rng.choice(ALPHABET) for _ in range(n)).encode()
    words = sorted({some(rng.randrange(1, 6)) for _ in range(80)} | {b"a", b"aa", b"aaaa", b"ba"})
    texts = [some(rng.randrange(0, 60)) for _ in range(40)] + [b"", b"a" * 1_000, b"xyz", b"\x00a"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, word = keywords.Automaton.build(words).hits(data, bounds)
    assert list(zip(row.tolist(), word.tolist())) == brute(texts, words)


def test_empty_texts_and_no_hits():
    machine = keywords.Automaton.build([b"abc"])
    for texts in ([], [b""], [b"ab", b"bc"]):
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        assert [len(x) for x in machine.hits(np.frombuffer(b"".join(texts), np.uint8), bounds)] == [0, 0]


def table_of(spark, words):
    return spark.createDataFrame([(c, w) for c, ws in words.items() for w in ws], "intent string, keyword string")


@pytest.mark.parametrize("block_bytes", [keywords.BLOCK_BYTES, 60])
def test_small_table_equals_the_keyword_classifier(spark, block_bytes):
    rng = random.Random(2)
    pool = [w for ws in KEYWORDS.values() for w in ws] + ["hello", "Order", "मत", "x"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 9))).title() for _ in range(200)] + ["", "haan" * 5_000]
    df = spark.createDataFrame(list(enumerate(texts)), "`id.x` int, clean_text string").repartition(3)
    got = keywords.classify_by_table(df, table_of(spark, KEYWORDS), block_bytes=block_bytes)
    want = keyword_classify(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id.x"], r.predicted_intent) for r in got.collect()) == sorted((r["id.x"], r.predicted_intent) for r in want.collect())
    blocks = len(list(keywords.read_blocks(table_of(spark, KEYWORDS), INTENTS, "intent", "keyword", block_bytes)))
    assert (blocks > 5) == (block_bytes == 60) and len(re.findall(r"MapInArrow run", plan)) == blocks


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "zz"), (3, None)], "scores int, text string")
    table = spark.createDataFrame(
        [("a", "aa"), ("a", "aa"), ("b", "aa"), ("b", "bb"), ("c", ""), ("c", None), ("other", "zz"), (None, "zz")], "intent string, keyword string"
    )
    got = keywords.classify_by_table(df, table, ["a", "b", "c"], "c", "text")
    assert sorted((r.text or "", r.scores, r.predicted_intent) for r in got.collect()) == [("", [0, 0, 0], "c"), ("aa bb", [1, 2, 0], "b"), ("zz", [0, 0, 0], "c")]
    none = keywords.classify_by_table(df, table.limit(0), INTENTS, KEYWORD_DEFAULT, "text")
    assert {r.predicted_intent for r in none.collect()} == {KEYWORD_DEFAULT}
    assert keywords.classify_by_table(df.limit(0), table, ["a", "b", "c"], "c", "text").count() == 0
