"""Batch scoring with top-2 labels and a confidence fallback; request checks; routing."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..constants import (
    ACTIONS,
    CONFIDENCE_THRESHOLD,
    DEFAULT_ACTION,
    INTENTS,
    KEYWORDS,
    MAX_BATCH_TEXTS,
    MAX_REQUEST_CHARS,
    SCORING_BATCH,
)
from ..functions import text as tx
from ..functions.rows import divide_all
from ..functions.scores import all_scores, label_at, ranked
from .classify import keyword_scores, with_keyword_scores


def check_threshold(threshold: float) -> float:
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("confidence threshold must lie in [0, 1]")
    return threshold


def reject_reason(text: Column, max_chars: int = MAX_REQUEST_CHARS) -> Column:
    """Why a request text is refused; null if it is accepted."""
    return (
        F.when(text.isNull() | (F.length(text) < 1), "too_short")
        .when(F.length(text) > max_chars, "too_long")
        .when(tx.strip(text) == "", "empty_text")
    )


def validate_requests(df: DataFrame, text_col: str = "text", max_chars: int = MAX_REQUEST_CHARS) -> DataFrame:
    """Add ``reject_reason``; valid rows have null there."""
    return df.withColumn("reject_reason", reject_reason(F.col(text_col), max_chars))


def check_batch_size(df: DataFrame, limit: int = MAX_BATCH_TEXTS) -> int:
    """Size of an interactive batch; ValueError unless it has 1 to ``limit`` rows."""
    n = df.limit(limit + 1).count()
    if not 1 <= n <= limit:
        raise ValueError(f"a batch holds 1 to {limit} texts")
    return n


def with_cleaned_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``cleaned_text``: the cleaned text, or the stripped raw text where that is empty."""
    clean = F.col("_clean")
    return (
        df.withColumn("_clean", tx.clean_text(text_col))
        .withColumn("cleaned_text", F.when(clean == "", tx.strip(text_col)).otherwise(clean))
        .drop("_clean")
    )


KeywordTable = dict[str, list[str]]


def keyword_scorer(keywords: KeywordTable = KEYWORDS) -> Callable[[DataFrame], DataFrame]:
    """Scorer adding raw class scores in ``scores`` from keyword hits."""
    return lambda df: with_keyword_scores(df, keywords, "cleaned_text", "scores")


def python_scorer(make_predict: Callable[[], Callable], batch_size: int = SCORING_BATCH) -> Callable[[DataFrame], DataFrame]:
    """Scorer from a plug-in model.

    ``make_predict`` runs once per Python worker, loads the model and returns a
    function from an array of texts to a matrix of raw class scores.  Spark sends
    it Arrow batches of ``batch_size`` texts.
    """
    apply = predict_batch_udf(make_predict, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    return lambda df: df.withColumn("scores", apply("cleaned_text"))


def with_probabilities(df: DataFrame, scores_col: str = "scores", out: str = "probs") -> DataFrame:
    """Softmax of a score array; maximum and sum are taken once per row."""
    top = F.array_repeat(F.array_max(scores_col), F.size(scores_col))
    exps = F.col("_exp")
    return (
        df.withColumn("_exp", F.zip_with(scores_col, top, lambda s, m: F.exp(s - m)))
        .withColumn(out, divide_all(exps, F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)))
        .drop("_exp")
    )


def with_top2(df: DataFrame, labels: list[str], probs_col: str = "probs") -> DataFrame:
    """Best and second label with confidences rounded to 4 places."""
    second = F.size("_ranked") > 1
    return (
        df.withColumn("_ranked", ranked(F.col(probs_col)))
        .withColumn("intent", label_at(labels, F.col("_ranked")[0]["id"]))
        .withColumn("confidence", F.round(F.col("_ranked")[0]["p"], 4))
        .withColumn("secondary_intent", F.when(second, label_at(labels, F.get("_ranked", F.lit(1))["id"])))
        .withColumn("secondary_confidence", F.when(second, F.round(F.get("_ranked", F.lit(1))["p"], 4)))
        .drop("_ranked")
    )


def with_fallback(df: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Flag rows whose rounded confidence is below the threshold."""
    low = F.col("confidence") < check_threshold(threshold)
    return df.withColumn("is_uncertain", low).withColumn("fallback", low)


def score_batch(
    df: DataFrame,
    labels: list[str] = INTENTS,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    threshold: float = CONFIDENCE_THRESHOLD,
    text_col: str = "text",
) -> DataFrame:
    """Clean, score and label every text; works on batch and streaming frames."""
    check_threshold(threshold)
    scorer = scorer or keyword_scorer()
    scored = scorer(with_cleaned_text(df, text_col))
    probs = with_probabilities(scored)
    return (
        with_fallback(with_top2(probs, labels), threshold)
        .withColumn("all_scores", all_scores(labels, F.col("probs")))
        .drop("scores", "probs")
    )


def batch_reject_reason(texts: Column, limit: int = MAX_BATCH_TEXTS) -> Column:
    """Why a request with a list of texts is refused; null if it is accepted."""
    return (
        F.when(texts.isNull() | (F.size(texts) < 1), "no_texts")
        .when(F.size(texts) > limit, "too_many_texts")
        .when(F.exists(texts, lambda t: t.isNull()), "null_text")
    )


def keyword_list_scorer(keywords: KeywordTable = KEYWORDS) -> Callable[[Column], Column]:
    """Scorer from an array of cleaned texts to an array of raw class scores, from keyword hits."""
    return lambda texts: F.transform(texts, lambda t: keyword_scores(keywords, F.lower(t)))


def python_list_scorer(make_predict: Callable[[], Callable], batch_size: int = SCORING_BATCH) -> Callable[[Column], Column]:
    """As ``python_scorer`` for arrays of texts: the model sees the texts of many rows at once."""

    @F.pandas_udf(ArrayType(ArrayType(DoubleType())))
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = make_predict()
        for lists in batches:
            flat = [t for texts in lists if texts is not None for t in texts]
            scores = [row.tolist() for k in range(0, len(flat), batch_size) for row in np.asarray(predict(np.array(flat[k : k + batch_size], object)))]
            rows = iter(scores)
            yield pd.Series([None if texts is None else [next(rows) for _ in texts] for texts in lists], dtype=object)

    return apply


def _results(df: DataFrame, labels: list[str], threshold: Column) -> DataFrame:
    """Add ``results`` from ``_cleaned`` and ``_scores``, item by item; each step is its own projection."""
    df = df.withColumn("_top", F.transform("_scores", lambda s: F.array_repeat(F.array_max(s), F.size(s))))
    df = df.withColumn("_exp", F.zip_with("_scores", "_top", lambda s, m: F.zip_with(s, m, lambda x, y: F.exp(x - y))))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    df = df.withColumn("_probs", F.transform("_exp", lambda e: divide_all(e, total(e))))
    df = df.withColumn("_ranked", F.transform("_probs", ranked))
    second = lambda r: F.when(F.size(r) > 1, label_at(labels, F.get(r, F.lit(1))["id"]))
    df = df.withColumn(
        "_two",
        F.transform(
            "_ranked",
            lambda r: F.struct(
                label_at(labels, r[0]["id"]).alias("intent"),
                F.round(r[0]["p"], 4).alias("confidence"),
                second(r).alias("secondary_intent"),
                F.round(F.get(r, F.lit(1))["p"], 4).alias("secondary_confidence"),
            ),
        ),
    )
    items = F.arrays_zip(F.col("_two"), F.col("_cleaned"), F.col("_probs"))
    low = lambda i: i["_two"]["confidence"] < threshold
    return df.withColumn(
        "results",
        F.transform(
            items,
            lambda i: F.struct(
                i["_two"]["intent"].alias("intent"), i["_two"]["confidence"].alias("confidence"),
                low(i).alias("is_uncertain"), low(i).alias("fallback"),
                i["_two"]["secondary_intent"].alias("secondary_intent"),
                i["_two"]["secondary_confidence"].alias("secondary_confidence"),
                i["_cleaned"].alias("cleaned_text"), all_scores(labels, i["_probs"]).alias("all_scores"),
            ),
        ),
    ).drop("_top", "_exp", "_probs", "_ranked", "_two")


def classify_batches(
    df: DataFrame,
    labels: list[str] = INTENTS,
    scorer: Callable[[Column], Column] | None = None,
    threshold: float | str = CONFIDENCE_THRESHOLD,
    texts_col: str = "texts",
    limit: int = MAX_BATCH_TEXTS,
) -> DataFrame:
    """Add ``results`` (one struct per text, in order), ``total`` and ``reject_reason`` to rows of text lists.

    A list is scored inside its row: it is neither taken apart nor shuffled.  A list that
    is null, empty, longer than ``limit`` or holds a null is rejected as a whole, with
    null results; an empty text is scored like any other.  ``threshold`` is a number or
    the name of a column.
    """
    limit_p = F.col(threshold) if isinstance(threshold, str) else F.lit(check_threshold(threshold))
    scorer = scorer or keyword_list_scorer()
    checked = df.withColumn("reject_reason", batch_reject_reason(F.col(texts_col), limit))
    kept = F.when(F.col("reject_reason").isNull(), F.col(texts_col))
    checked = checked.withColumn("_kept", kept).withColumn("_clean", F.transform("_kept", tx.clean_text))
    plain = F.zip_with("_clean", "_kept", lambda c, t: F.when(c == "", tx.strip(t)).otherwise(c))
    scored = checked.withColumn("_cleaned", plain).withColumn("_scores", scorer(F.col("_cleaned")))
    found = _results(scored, labels, limit_p).withColumn("total", F.size("results").cast("int"))
    found = found.withColumn("total", F.when(F.col("reject_reason").isNull(), F.col("total")))
    return found.drop("_kept", "_clean", "_cleaned", "_scores")


def text_lists(df: DataFrame, id_col: str, order: list[str], text_col: str = "text", limit: int = MAX_BATCH_TEXTS) -> DataFrame:
    """(id, texts): the texts of each request in order, as ``classify_batches`` takes them.

    Requests are counted first, so that one with more than ``limit`` texts, which will be
    rejected, never gathers in a task: it gets ``limit + 1`` empty ones.  A null id is a request.
    """
    rows = df.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.col(text_col).alias("_text"))
    sizes = rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > limit).select(F.col("_id").alias("_large"))
    small = rows.join(large, rows["_id"].eqNullSafe(F.col("_large")), "left_anti")
    keys = [f"_o{k}" for k in range(len(order))]
    lists = small.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct(*keys, "_text"))).alias("_l"))
    lists = lists.select("_id", F.transform("_l", lambda x: x["_text"]).alias("texts"))
    over = large.select(F.col("_large").alias("_id"), F.array_repeat(F.lit(""), limit + 1).alias("texts"))
    return lists.unionByName(over).withColumnRenamed("_id", id_col)


def score_ranking(scored: DataFrame, id_cols: list[str]) -> DataFrame:
    """One row per (request, class), best score first, the predicted class marked."""
    entries = F.transform(
        F.map_entries("all_scores"), lambda e, i: F.struct((-e["value"]).alias("neg"), i.alias("i"), e["key"].alias("label"))
    )
    return scored.select(*id_cols, "intent", F.posexplode(F.array_sort(entries)).alias("_pos", "_e")).select(
        *id_cols,
        (F.col("_pos") + 1).alias("rank"),
        F.col("_e.label").alias("label"),
        tx.pretty_label(F.col("_e.label")).alias("display"),
        (-F.col("_e.neg")).alias("score"),
        (F.col("_e.label") == F.col("intent")).alias("is_top"),
    )


def route_actions(
    scored: DataFrame, actions: dict[str, tuple[str, str]] = ACTIONS, default: tuple[str, str] = DEFAULT_ACTION
) -> DataFrame:
    """Join the next action per class; fallback rows also name the second class."""
    # one row per class: bounded by the class list
    dim = scored.sparkSession.createDataFrame(
        [(k, a, e) for k, (a, e) in actions.items()], "intent string, _action string, _marker string"
    )
    return (
        scored.join(F.broadcast(dim), "intent", "left")
        .withColumn("action", F.coalesce("_action", F.lit(default[0])))
        .withColumn("marker", F.coalesce("_marker", F.lit(default[1])))
        .withColumn("action_text", tx.strip_tags("action"))
        .withColumn("display_intent", tx.pretty_label("intent"))
        .withColumn(
            "fallback_intent",
            F.when(
                F.col("fallback"),
                F.concat(
                    tx.pretty_label("secondary_intent"),
                    F.lit(" ("),
                    F.round(F.col("secondary_confidence") * 100).cast("int").cast("string"),
                    F.lit("%)"),
                ),
            ),
        )
        .drop("_action", "_marker")
    )
