"""Quality classifier learned from trusted positives and unlabelled text.

Method: a linear model over hashed n-gram frequencies minimises the non-negative
unbiased risk ``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))``
with logistic loss; the class prior is estimated from the share of label 1 among the
labelled rows.  Rows of label 0 enter nothing but that share.

The unlabelled text is all training text, without its labels.  The fit begins on a bounded
sample in one task (``max_positives`` labelled rows and ``max_start`` others, one row an id);
from there every round takes risk and gradient of the unlabelled text over all training rows,
summed up task by task in a tree, and those of the positives over their sample, and keeps
a step only if it lowers the risk.  Scoring reads every whole text.

Defined cases: a null text is an empty text and scores by the model's intercept alone.
Several labels of one document are averaged, half or more is 1; null labels do not
count.  Rows with a null id teach nothing, but are scored.  Rows that repeat, or share an id,
each count in the unlabelled text; of the positives of one id the text of the least hash counts.
Without positives or training rows the score of every row is the prior, or 0.5 without
labels, so nothing is rejected for lack of evidence.  An empty table gives an empty result.
A text of any length is handled whole, as a chunk by itself.  Equal scores are treated alike: the
limit itself is kept.  Other columns of any name are carried or not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..plans.combine import array_sum
from ..plans.staging import stage
from .frames import batches_of, bounded_share, crc_remainder, named, one_row_each, packed, with_fields
from .grams import PART_BYTES, descend, gram_ids, margins, margins_of, read_vectors, sparse_rows
from .kernels import chunks
from .quality_rules import labelled_ids

BITS, FAMILIES = 15, ("chars", "repeats")
FOLDS, HELD_OUT = 5, 0  # rows whose crc32 remainder is HELD_OUT teach nothing
MAX_POSITIVES, MAX_START = 2_500, 5_000
KEEP_AT = 0.3
BATCH_ROWS = 1 << 10  # texts that a task receives at once in full rounds
FULL_ROUNDS, BOLD = 4, 256  # rounds over all training rows, and how much longer than safe their first step is
ROUNDS, RATE, DECAY = 80, 12.0, 1e-7


@dataclass
class PuModel:
    weights: np.ndarray
    intercept: float
    prior: float

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        z = self.intercept + margins(data, bounds, self.weights, BITS, FAMILIES)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def non_negative_risk(z_pos: np.ndarray, z_unl: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The risk, and its gradient with respect to the margins of positives and unlabelled rows.

    Where the estimated risk of negatives falls below zero, the step goes against it,
    so that the model stops fitting the sample of positives in the unlabelled rows.
    """
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    positive = prior * np.logaddexp(0, -z_pos).mean()
    negative = np.logaddexp(0, z_unl).mean() - prior * np.logaddexp(0, z_pos).mean()
    n_pos, n_unl = len(z_pos), len(z_unl)
    up = -prior * (1 - sig(z_pos)) / n_pos
    down_pos, down_unl = -prior * sig(z_pos) / n_pos, sig(z_unl) / n_unl
    if negative >= 0:
        return positive + negative, up + down_pos, down_unl
    return positive, -down_pos, -down_unl


def _fit_task(prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, positive, size = read_vectors(batches, "positive")
        if matrix is None or positive.all() or not positive.any():
            return

        def gradient(z: np.ndarray) -> np.ndarray:
            g = np.empty(len(z))
            _, g[positive], g[~positive] = non_negative_risk(z[positive], z[~positive], prior)
            return g

        w, b = descend(matrix, gradient, size, log_odds(prior), ROUNDS, RATE, DECAY)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b])], ["weights", "intercept"])

    return run


def log_odds(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _sums_of(model: PuModel, weigh: Callable[[np.ndarray], list[np.ndarray]], n: int) -> Callable[[pa.RecordBatch], np.ndarray]:
    """For a batch of texts: the loss ``log(1 + exp(margin))``, and for each of ``n`` weightings of the
    margins the sum of weights, and of weights times vectors."""
    size = len(model.weights)

    def of_batch(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(1 + n * (size + 1))
        for _, _, data, bounds in chunks(batch.column("text"), PART_BYTES):
            found = gram_ids(data, bounds, BITS, FAMILIES)
            z = model.intercept + margins_of(found, model.weights, len(bounds) - 1)
            total[0] += np.logaddexp(0, z).sum()
            for w, g in zip(weigh(z), total[1:].reshape(n, size + 1)):
                g[0] += w.sum()
                for index, row, count in found:
                    g[1:] += np.bincount(index, weights=(w / np.maximum(count, 1))[row], minlength=size)
        return total

    return of_batch


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def risk_and_gradient(model: PuModel, positives: DataFrame, texts: DataFrame, n_pos: int, n_all: int) -> tuple[float, np.ndarray]:
    """The risk over all rows, and the direction of descent for (intercept, weights)."""
    size, prior = len(model.weights), model.prior
    pos = array_sum(positives, _sums_of(model, lambda z: [1 - _sigmoid(z), _sigmoid(z)], 2), 1 + 2 * (size + 1)) / n_pos
    every = array_sum(texts, _sums_of(model, lambda z: [_sigmoid(z)], 1), 1 + size + 1) / n_all
    (up, down), down_all = pos[1:].reshape(2, -1), every[1:]
    # log(1 + exp(-z)) = log(1 + exp(z)) - z
    against = pos[0] - model.intercept - (up + down)[1:] @ model.weights
    negative = every[0] - prior * pos[0]
    if negative >= 0:
        return prior * against + negative, down_all - prior * (up + down)
    return prior * against, prior * down - down_all  # the estimate of the negatives' risk is below zero: step against it


def refine(model: PuModel, positives: DataFrame, texts: DataFrame, rounds: int = FULL_ROUNDS) -> PuModel:
    """The model after full rounds over all rows of ``texts``; its risk over them never rises.

    A round is one pass.  Its step begins bold; after a step that does not lower the risk,
    the next one starts from the same point and is shorter.  The shortest one is that which the
    curvature of the risk allows.
    """
    n_pos, n_all = positives.count(), texts.count()
    if not n_pos or not n_all or not rounds:
        return model
    safe = 4 / ((len(FAMILIES) + 1) * (1 + model.prior))  # frequencies of a family have a norm of 1 at most
    best, step = model, safe * BOLD
    least, g = risk_and_gradient(best, positives, texts, n_pos, n_all)
    for _ in range(rounds):
        tried = PuModel(best.weights - step * g[1:], float(best.intercept - step * g[0]), best.prior)
        value, slope = risk_and_gradient(tried, positives, texts, n_pos, n_all)
        if value < least:
            best, least, g = tried, value, slope
        else:
            step = max(step / 16, safe)
    return best


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_positives: int = MAX_POSITIVES,
    max_start: int = MAX_START,
    rounds: int = FULL_ROUNDS,
) -> PuModel:
    """The model of the rows outside the held-out fold."""
    trains = lambda c: crc_remainder(c, FOLDS) != HELD_OUT
    known = stage(labelled_ids(labels, id_col, label_col).filter(trains("id")), "labelled")
    n, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    prior = min(0.97, max(0.03, ones / n)) if n else 0.5
    texts = docs.select(named(id_col).cast("long").alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    texts = texts.filter(trains("id") & F.col("id").isNotNull())
    ids = stage(texts.select("id").distinct(), "training-ids")
    chosen = bounded_share(known.filter("y = 1").select("id"), "id", max_positives).withColumn("positive", F.lit(True))
    chosen = chosen.union(bounded_share(ids, "id", max_start).withColumn("positive", F.lit(False)))
    rows = one_row_each(texts.join(F.broadcast(chosen), "id"), ["id", "positive"], "text")  # bounded by the two parameters
    rows = stage(rows, "pu-rows")
    sample = stage(sparse_rows(rows, "text", ["positive"], BITS, FAMILIES), "pu-sample")
    found = sample.repartition(1).mapInArrow(_fit_task(prior), "weights binary, intercept double").collect()
    if not found:
        return PuModel(np.zeros(len(FAMILIES) << BITS), log_odds(prior), prior)
    start = PuModel(np.frombuffer(found[0].weights, np.float64), found[0].intercept, prior)
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return refine(start, rows.filter("positive").select("text"), texts.select("text"), rounds)


def score(docs: DataFrame, model: PuModel, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row, text, score) per row of ``docs``; ``row`` holds the columns ``carry`` (default: all but the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.score(data, bounds) for _, _, data, bounds in chunks(batch.column("text"), PART_BYTES)]
            p = pa.array(np.concatenate(parts) if parts else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), p], ["row", "text", "score"])

    keep = [c for c in docs.columns if c != text_col] if carry is None else carry
    rows = docs.select(packed(docs.select(*[named(c) for c in keep])), named(text_col).alias("text"))
    return rows.mapInArrow(run, with_fields(rows, ["row", "text"], score=DoubleType()))


def scores(docs: DataFrame, model: PuModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) per row of ``docs``."""
    found = score(docs, model, text_col, [id_col]).select(F.col("row").getField(id_col).alias(id_col), "score")
    return found.select(
        named(id_col),
        (crc_remainder(id_col, FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_AT).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", keep_at: float = KEEP_AT, **options) -> DataFrame:
    """``docs`` without the rows that score below ``keep_at``."""
    good = score(docs, fit(docs, labels, text_col=text_col, **options), text_col).filter(F.col("score") >= keep_at)
    column = lambda c: F.col("text") if c == text_col else F.col("row").getField(c)
    return good.select(*[column(c).alias(c) for c in docs.columns])
