"""Linear machines with squared hinge loss, fitted by a truncated Newton method over partitioned rows.

For each class, against all others, the fit minimises

    |w|^2 / 2 + C * sum over rows of max(0, 1 - y * w.x)^2

where ``x`` ends with a constant 1 for the intercept, which is penalised like any weight.
Every pass over the rows serves all classes that are not done: one pass for loss and
gradient, one for each product of their Hessians with a direction.  Rows are staged as blocks
first, which the passes read.  Tasks add up arrays of their rows; these are added up in a tree, so the driver holds classes times features numbers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import argmax, label_at
from ..plans.combine import array_sum
from ..plans.staging import batches_of
from .blocks import AT_ONCE, read_blocks, stage_blocks
from .features import literal_doubles

TOLERANCE = 1e-4  # of the gradient's norm, as a share of its norm at zero
MAX_STEPS, MAX_INNER = 50, 60


def _sign(label: np.ndarray, c: int) -> np.ndarray:
    return np.where(label == c, 1.0, -1.0)


def _loss_and_gradient(weights: dict[int, np.ndarray], size: int) -> Callable[[pa.RecordBatch], np.ndarray]:
    def of_batch(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((len(weights), size + 1))
        for label, views in read_blocks(batch, [0]):
            rows = views[0]
            for out, (c, w) in zip(total, weights.items()):
                y = _sign(label, c)
                short = np.maximum(0, 1 - y * rows.dot(w))
                out[:-1] += rows.back(-2 * y * short, size - 1)
                out[-1] += (short**2).sum()
        return total.ravel()

    return of_batch


def _curvature(weights: dict[int, np.ndarray], directions: dict[int, np.ndarray], size: int) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Products of the loss's Hessians with a direction for each class: rows inside the margin count."""

    def of_batch(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((len(directions), size))
        for label, views in read_blocks(batch, [0]):
            rows = views[0]
            for out, (c, d) in zip(total, directions.items()):
                inside = _sign(label, c) * rows.dot(weights[c]) < 1
                out += rows.back(2 * inside * rows.dot(d), size - 1)
        return total.ravel()

    return of_batch


@dataclass
class SquaredHingeModel:
    """Weights (class, feature), the intercept last; norms of the gradients, and whether all are below the tolerance."""

    labels: list[str]
    weights: np.ndarray
    gradient_norm: np.ndarray
    converged: bool

    def predict(self, df: DataFrame, out: str = "predicted_intent") -> DataFrame:
        """Class of the largest margin; of equal ones the first."""
        pairs = F.arrays_zip("indices", "weights")

        def margin(w: np.ndarray):
            row = literal_doubles(w.tolist())
            return F.aggregate(pairs, F.lit(float(w[-1])), lambda acc, p: acc + p["weights"] * F.element_at(row, p["indices"] + 1))

        scored = df.withColumn("_margins", F.array(*[margin(w) for w in self.weights]))
        return scored.withColumn(out, label_at(self.labels, argmax(F.col("_margins")))).drop("_margins")


def _directions(
    blocks: DataFrame, weights: dict[int, np.ndarray], gradient: dict[int, np.ndarray], c: float, size: int, parts: int
) -> dict[int, np.ndarray]:
    """Newton directions by conjugate gradients, all classes in step; each as exact as its gradient asks for."""
    steps = {k: np.zeros(size) for k in gradient}
    rest = {k: -g for k, g in gradient.items()}
    along = {k: r.copy() for k, r in rest.items()}
    enough = {k: min(0.1, np.sqrt(np.linalg.norm(g))) * np.linalg.norm(g) for k, g in gradient.items()}
    live = list(gradient)
    for _ in range(MAX_INNER):
        here = {k: along[k] for k in live}
        curved = array_sum(blocks, _curvature({k: weights[k] for k in live}, here, size), size * len(live), parts=parts).reshape(len(live), size)
        for k, h in zip(list(live), curved):
            bent = along[k] + c * h
            norm = rest[k] @ rest[k]
            far = norm / (along[k] @ bent)
            steps[k] += far * along[k]
            rest[k] = rest[k] - far * bent
            along[k] = rest[k] + (rest[k] @ rest[k]) / norm * along[k]
            if np.linalg.norm(rest[k]) <= enough[k]:
                live.remove(k)
        if not live:
            break
    return steps


def fit_squared_hinge(
    train: DataFrame, labels: list[str], n_features: int, c: float = 1.0, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS
) -> SquaredHingeModel:
    """One machine per class from staged rows (indices, weights, label id).

    Steps are halved until the loss falls; halving again costs a pass only for the classes
    that need it.  Rows without a listed label are of no class.
    """
    size, n = n_features + 1, len(labels)
    rows = train.select("indices", "weights", F.coalesce(F.col("label").cast("int"), F.lit(-1)).alias("label"))
    blocks = stage_blocks(rows, [lambda b: b])
    with batches_of(train.sparkSession, AT_ONCE):
        return _fit(blocks, labels, size, n, c, tolerance, max_steps)


def _fit(blocks: DataFrame, labels: list[str], size: int, n: int, c: float, tolerance: float, max_steps: int) -> SquaredHingeModel:
    parts = blocks.rdd.getNumPartitions()

    def evaluate(weights: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        found = array_sum(blocks, _loss_and_gradient(weights, size), (size + 1) * len(weights), parts=parts).reshape(len(weights), size + 1)
        return {k: (w @ w / 2 + c * f[-1], w + c * f[:-1]) for (k, w), f in zip(weights.items(), found)}

    at = {k: np.zeros(size) for k in range(n)}
    now = evaluate(at)
    goal = {k: tolerance * np.linalg.norm(g) for k, (_, g) in now.items()}
    live = [k for k in at if np.linalg.norm(now[k][1]) > goal[k]]
    for _ in range(max_steps):
        if not live:
            break
        steps = _directions(blocks, at, {k: now[k][1] for k in live}, c, size, parts)
        scale = dict.fromkeys(live, 1.0)
        trying = list(live)
        while trying:
            tried = {k: at[k] + scale[k] * steps[k] for k in trying}
            for k, (value, g) in evaluate(tried).items():
                slope = now[k][1] @ steps[k]
                if value <= now[k][0] + 1e-4 * scale[k] * slope or scale[k] < 1e-6:
                    at[k], now[k] = tried[k], (value, g)
                    trying.remove(k)
                else:
                    scale[k] /= 2
        live = [k for k in live if np.linalg.norm(now[k][1]) > goal[k]]
    norms = np.array([np.linalg.norm(now[k][1]) for k in range(n)])
    return SquaredHingeModel(list(labels), np.stack([at[k] for k in range(n)]) if n else np.zeros((0, size)), norms, not live)
