"""Keyword and naive Bayes classifiers as Column expressions and aggregations."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import INTENTS, KEYWORD_DEFAULT, KEYWORDS, NB_ALPHA
from ..functions.rows import inline_rows
from ..functions.scores import argmax, label_at
from .features import TfidfModel, literal_doubles


def keyword_scores(keywords: dict[str, list[str]], lowered: Column) -> Column:
    """Array with, per class, the number of listed keywords that occur in the text."""
    return F.array(
        *[
            reduce(
                lambda a, b: a + b,
                [F.contains(lowered, F.lit(k)).cast("double") for k in words],
                F.lit(0.0),
            )
            for words in keywords.values()
        ]
    )


def with_keyword_scores(
    df: DataFrame, keywords: dict[str, list[str]] = KEYWORDS, text_col: str = "clean_text", out: str = "scores"
) -> DataFrame:
    lowered = df.withColumn("_lower", F.lower(text_col))
    return lowered.withColumn(out, keyword_scores(keywords, F.col("_lower"))).drop("_lower")


def keyword_classify(
    df: DataFrame,
    keywords: dict[str, list[str]] = KEYWORDS,
    default: str = KEYWORD_DEFAULT,
    text_col: str = "clean_text",
    out: str = "predicted_intent",
) -> DataFrame:
    """Class with most keyword hits; ties take the first class, no hit the default."""
    labels = list(keywords)
    scored = with_keyword_scores(df, keywords, text_col, "_scores")
    best = F.when(F.array_max("_scores") == 0, F.lit(default)).otherwise(
        label_at(labels, argmax(F.col("_scores")))
    )
    return scored.withColumn(out, best).drop("_scores")


@dataclass
class NaiveBayesModel:
    """Class log priors and term log likelihoods: classes times vocabulary numbers."""

    tfidf: TfidfModel
    labels: list[str]
    log_prior: list[float]
    log_likelihood: list[list[float]]

    def scores(self, df: DataFrame, text_col: str = "clean_text", out: str = "scores") -> DataFrame:
        """Add the joint log likelihood per class, row by row."""
        wide = self.tfidf.pairs(df, text_col)


        def joint(row: Column, prior: float) -> Column:
            return F.aggregate(
                "pairs",
                F.lit(float(prior)),
                lambda acc, x: acc + x["weights"] * F.element_at(row, x["indices"] + 1),
            )

        per_class = [joint(literal_doubles(row), prior) for row, prior in zip(self.log_likelihood, self.log_prior)]
        return wide.withColumn(out, F.array(*per_class)).drop("pairs")

    def predict(self, df: DataFrame, text_col: str = "clean_text", out: str = "predicted_intent") -> DataFrame:
        scored = self.scores(df, text_col, "_scores")
        return scored.withColumn(out, label_at(self.labels, argmax(F.col("_scores")))).drop("_scores")


def fit_naive_bayes(
    counted: DataFrame,
    tfidf: TfidfModel,
    labels: list[str] = INTENTS,
    alpha: float = NB_ALPHA,
    label_col: str = "intent",
) -> NaiveBayesModel:
    """Multinomial naive Bayes on TF-IDF weights in closed form.

    ``counted`` holds training rows with term counts (or texts).  Weights are
    summed per (class, term) with map-side combine; at most classes times
    vocabulary sums reach the driver.
    """
    size = len(tfidf.vocab)
    counted = counted.filter(F.col(label_col).isin(list(labels)))
    n_class = {r[label_col]: r["n"] for r in counted.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    present = [c for c in labels if n_class.get(c)]
    total = sum(n_class[c] for c in present)
    sums = {c: [0.0] * size for c in present}
    per_term = (
        inline_rows(tfidf.pairs(counted), [label_col], "pairs", "indices")
        .groupBy(label_col, "indices")
        .agg(F.sum("weights").alias("w"))
    )
    for r in per_term.collect():
        sums[r[label_col]][r["indices"]] = r["w"]
    prior, table = [], []
    for c in present:
        mass = math.fsum(sums[c]) + alpha * size
        prior.append(math.log(n_class[c] / total))
        table.append([math.log((w + alpha) / mass) for w in sums[c]])
    return NaiveBayesModel(tfidf, present, prior, table)
