"""Token fertility: tokens per word and per text for several tokenizers."""

from __future__ import annotations

from functools import reduce
from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BACKBONE_COST, DEFAULT_TOKENS_PER_TEXT, DEFAULT_TOKENS_PER_WORD
from ..functions import text as tx
from ..functions.rows import explode_rows
from ..plans.staging import stage

Tokenizer = Callable[[DataFrame], DataFrame]


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct words with their occurrences, combined on the map side.

    Splitting into tokens then costs one call per distinct word.
    """
    return (
        explode_rows(df.select(tx.all_words(text_col).alias("_words")), [], "_words", "word")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def subword_vocabulary(words: DataFrame, max_words: int = 5_000) -> list[str]:
    """The most frequent words; every single character is a piece as well."""
    rows = words.orderBy(F.desc("n"), "word").limit(max_words).collect()
    return [r["word"] for r in rows]


def word_tokenizer(words: DataFrame) -> DataFrame:
    return words.withColumn("tokens", F.array("word"))


def chunk_tokenizer(size: int) -> Tokenizer:
    """Pieces of at most ``size`` characters; 1 gives characters."""
    return lambda words: words.withColumn(
        "tokens", F.regexp_extract_all("word", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    )


def longest_pieces(word: str, pieces: frozenset, longest: int) -> list[str]:
    """Greedy longest match from the left; a character always matches."""
    out, at = [], 0
    while at < len(word):
        end = min(len(word), at + longest)
        while end > at + 1 and word[at:end] not in pieces:
            end -= 1
        out.append(word[at:end])
        at = end
    return out


def subword_tokenizer(vocab: list[str]) -> Tokenizer:
    """Greedy longest match against a bounded vocabulary, in Arrow batches."""
    pieces = frozenset(vocab)
    longest = max(map(len, pieces), default=1)

    @F.pandas_udf("array<string>")
    def split(words: pd.Series) -> pd.Series:
        return words.map(lambda w: longest_pieces(w, pieces, longest))

    return lambda words: words.withColumn("tokens", split("word"))


def token_fertility(words: DataFrame, n_texts: int, tokenizers: dict[str, Tokenizer]) -> DataFrame:
    """Mean tokens per word occurrence and per text, rounded to 2 places."""
    parts = [
        make(words).select(F.lit(name).alias("tokenizer"), "n", F.size("tokens").cast("bigint").alias("k"))
        for name, make in tokenizers.items()
    ]
    total = F.sum(F.col("k") * F.col("n"))
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("tokenizer")
        .agg(
            F.round(total / F.sum("n"), 2).alias("avg_tokens_per_word"),
            F.round(total / F.lit(n_texts), 2).alias("avg_tokens_per_text"),
        )
    )


def with_default_fertility(names: DataFrame, fertility: DataFrame, name_col: str = "name") -> DataFrame:
    """Fertility for every name; names without a tokenizer get fixed defaults."""
    return names.join(fertility, F.col(name_col) == F.col("tokenizer"), "left").select(
        *names.columns,
        F.coalesce("avg_tokens_per_word", F.lit(DEFAULT_TOKENS_PER_WORD)).alias("avg_tokens_per_word"),
        F.coalesce("avg_tokens_per_text", F.lit(DEFAULT_TOKENS_PER_TEXT)).alias("avg_tokens_per_text"),
    )


def fertility_examples(words: DataFrame, tokenizers: dict[str, Tokenizer], k: int = 5) -> DataFrame:
    """The ``k`` most frequent words with their tokens, per tokenizer."""
    top = stage(words.orderBy(F.desc("n"), "word").limit(k), "top-words")
    shown = F.concat(
        F.lit("`"), F.col("word"), F.lit("` -> ['"), F.concat_ws("', '", "tokens"), F.lit("']")
    )
    parts = [
        make(top).select(F.lit(name).alias("tokenizer"), "word", shown.alias("example"))
        for name, make in tokenizers.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def backbone_table(dim: DataFrame, fertility: DataFrame) -> DataFrame:
    """Backbone dimension with fertility, formatted vocabulary and size class."""
    memory, latency = F.lit(BACKBONE_COST[-1][1]), F.lit(BACKBONE_COST[-1][2])
    for size, mem, lat in reversed(BACKBONE_COST[:-1]):
        memory = F.when(F.contains("params", F.lit(size)), mem).otherwise(memory)
        latency = F.when(F.contains("params", F.lit(size)), lat).otherwise(latency)
    return (
        with_default_fertility(dim, fertility)
        .withColumn("vocab", F.format_number("vocab_size", 0))
        .withColumn("memory", memory)
        .withColumn("latency", latency)
        .drop("vocab_size")
    )
