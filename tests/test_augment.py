import random

import pytest
from pyspark.sql import functions as F

from uttermill.constants import VARIATIONS
from uttermill.functions.text import strip
from uttermill.operators.augment import DIGESTS, augment, expand_variations, with_variation_digests
from uttermill.operators.corpus import with_clean_columns
from uttermill.operators.dedup import content_key

ODD = [*VARIATIONS, ("aa", "a"), ("!", "!!"), ("　x😀", "😀 "), ("  ", "　"), ("..", ".."), ("𝒳𝒳", "bb")]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    chars = ["a", "a", "b", "!", ".", ".", " ", " ", "\n", "😀", "　", "é", "_", "\t", "…", "𝒳", "𝒳"]
    rows = [(i, "".join(rng.choices(chars, k=rng.randrange(26))), rng.choice("xy")) for i in range(400)]
    rows += [(900, None, "x"), (901, " " * 30, "y"), (902, "　" * 30, "y"), (903, "long enough text　", None)]
    return with_clean_columns(spark.createDataFrame(rows, "ord bigint, text string, intent string"))


def cleaned_again(df):
    """Every variation cleaned as a text of its own."""
    text = F.concat(F.col("a.prefix"), F.col("text"), F.col("a.suffix"))
    affixes = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(s).alias("suffix")) for p, s in ODD])
    wide = df.select("*", F.posexplode(affixes).alias("v", "a"))
    wide = wide.withColumn("text", strip(text)).withColumn("ord", F.col("ord") * len(ODD) + F.col("v"))
    return with_clean_columns(wide).select(*df.columns)


def test_variations_are_as_cleaned_again(texts):
    want = {r.ord: r for r in cleaned_again(texts).collect()}
    assert {r.ord: r for r in expand_variations(texts, ODD).collect()} == want
    key = content_key("clean_text", "intent").alias("k")
    keys = {r.ord: r.k for r in cleaned_again(texts).select("ord", key).collect()}
    for df in (texts, texts.drop("clean_text")):
        rows = with_variation_digests(df, ODD).select("ord", DIGESTS).collect()
        assert {r.ord * len(ODD) + k: d for r in rows for k, d in enumerate(r[1])} == keys


def test_more_variations_clean_no_text_again(texts):
    plan = lambda vs: with_variation_digests(texts, vs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(ODD[:3]).count("regexp_replace") == plan(ODD).count("regexp_replace")


def test_rows_meet_their_numbers_before_they_are_expanded(spark, texts):
    kept = spark.createDataFrame([(3,), (4,), (8 * 7 + 1,)], "ord bigint")
    found = augment(texts, kept=kept)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
    assert sorted(r.ord for r in found.collect()) == [3, 4, 57]
