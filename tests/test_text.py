import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from uttermill.functions import text as tx
from uttermill.operators.corpus import with_clean_columns

CASES = [
    ("plzzzz help meeeeee boooohot discount chahiye", "plzz help mee boohot discount chahiye", "", 0),
    ("Ye product bahut accha hai 👍🙏🔥", "Ye product bahut accha hai", "👍🙏🔥", 0),
    ("Order kyu nahi aaya?????", "Order kyu nahi aaya?", "", 1),
    ("", "", "", 0),
    (None, "", "", 0),
    ("   ", "", "", 0),
    ("a !!  ?? b", "a ! ? b", "", 2),
    ("..😀..", ". .", "😀", 2),
    ("漢字 text", "text", "漢字", 0),
    ("x🤔y", "x🤔y", "", 0),
    ("  wide space 　", "wide space", "", 0),
    ("AAAaaa 1111", "AAaa 11", "", 0),
    ("line\n\n\n\nbreak\t\ttab", "line break tab", "", 0),
    ("a--b__c", "a-b_c", "", 2),
    ("!?!?", "!?!?", "", 0),
]


def rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def test_cleaning_cases(spark):
    got = with_clean_columns(rows(spark, [c[0] for c in CASES])).orderBy("id").collect()
    assert [(r.clean_text, r.emojis, r.excess_punct_count) for r in got] == [c[1:] for c in CASES]


def test_column_functions_agree_with_frame_operator(spark):
    df = with_clean_columns(rows(spark, [c[0] for c in CASES]))
    same = df.select(
        (tx.clean_text("text") == F.col("clean_text")).alias("a"),
        (tx.extract_emojis("text") == F.col("emojis")).alias("b"),
        (tx.excess_punct_count("text") == F.col("excess_punct_count")).alias("c"),
    )
    assert same.filter("not (a and b and c)").count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("ab!?.,- \n\t 😀漢é"), max_size=30), min_size=20, max_size=60))
def test_cleaning_is_idempotent(spark, texts):
    once = with_clean_columns(rows(spark, texts)).select("id", F.col("clean_text").alias("text"))
    twice = with_clean_columns(once)
    assert twice.filter("clean_text <> text or emojis <> '' or excess_punct_count <> 0").count() == 0


def test_words_and_bigrams(spark):
    df = rows(spark, ["A bc, de_f  été 12", "x", ""]).withColumn("w", tx.words("text"))
    got = df.withColumn("b", tx.bigrams(F.col("w"))).orderBy("id").collect()
    assert got[0].w == ["bc", "de_f", "été", "12"]
    assert got[0].b == ["bc de_f", "de_f été", "été 12"]
    assert got[1].w == [] and got[1].b == [] and got[2].b == []


def test_truncate_strip_tags_labels(spark):
    df = spark.createDataFrame([(["a", "b", "c"], "<b>Go</b> now", "call_back_later", 0.61944)], "t array<string>, h string, l string, p double")
    r = df.select(tx.truncate_tokens(F.col("t"), 2).alias("t"), tx.strip_tags("h").alias("h"), tx.pretty_label("l").alias("l"), tx.percent(F.col("p")).alias("p")).first()
    assert (r.t, r.h, r.l, r.p) == (["a", "b"], "Go now", "call back later", "61.9%")


@pytest.mark.parametrize("ranges,merged", [([(5, 9), (1, 4)], [(1, 9)]), ([(1, 2), (4, 5)], [(1, 2), (4, 5)])])
def test_merge_ranges(ranges, merged):
    assert tx.merge_ranges(ranges) == merged
