"""Logistic regressions for many settings at once: every pass over the rows serves all that are not done.

Each setting has its own penalty, vocabulary size and limit of iterations.  The settings share
one table of weights for the largest vocabulary: terms of a smaller one come first, and their
weights are brought back to length one as rows are staged in blocks, once per size.  A setting minimises

    mean of -log p(class) + |W|^2 / (2 C n)        (intercepts are not penalised)

by L-BFGS; its iteration needs one pass, or more while its step is halved.  Settings that have
reached their tolerance leave, so the last passes carry only what is still needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.combine import array_sum
from ..plans.staging import batches_of
from .blocks import AT_ONCE, Block, only, read_blocks, stage_blocks

TOLERANCE = 1e-4  # mean change of the loss by iteration, and norm of the gradient, relative to the loss and to the norm at zero
SPAN = 5  # iterations over which the change of the loss is averaged
MEMORY = 8  # steps that L-BFGS remembers


def log_probabilities(rows: Block, w: np.ndarray) -> np.ndarray:
    """(class, row); ``w`` is (class, term), the intercept last."""
    z = np.stack([rows.dot(k) for k in w])
    z -= z.max(axis=0)
    return z - np.log(np.exp(z).sum(axis=0))


def _labels(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("label").to_numpy().astype(np.int64)


@dataclass
class Setting:
    """One run of the sweep and the state of its fit."""

    c: float
    size: int
    limit: int
    weights: np.ndarray
    loss: float = np.inf
    gradient: np.ndarray | None = None
    iterations: int = 0
    converged: bool = False
    done: bool = False
    direction: np.ndarray | None = None
    scale: float = 1.0
    goal: float = 0.0
    steps: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    past: list[float] = field(default_factory=list)

    def trial(self) -> np.ndarray:
        return self.weights if self.direction is None else self.weights + self.scale * self.direction

    def take(self, loss: float, gradient: np.ndarray, tolerance: float) -> None:
        """Accept the trial point, or halve the step; then find the next direction."""
        if self.direction is None:
            self.goal = tolerance * np.linalg.norm(gradient)
        else:
            slope = (self.gradient * self.direction).sum()
            if loss > self.loss + 1e-4 * self.scale * slope and self.scale > 1e-10:
                self.scale /= 2
                return
            moved = self.scale * self.direction
            self.steps = [*self.steps, (moved, gradient - self.gradient)][-MEMORY:]
            self.weights = self.weights + moved
            self.iterations += 1
            self.past = [*self.past, self.loss][-SPAN:]
            small = len(self.past) == SPAN and (self.past[0] - loss) / SPAN <= tolerance * max(abs(loss), 1e-12)
            self.converged = bool(small or np.linalg.norm(gradient) <= self.goal)
        self.loss, self.gradient = loss, gradient
        self.converged = self.converged or not bool(gradient.any())
        self.done = self.converged or self.iterations >= self.limit
        self.direction, self.scale = self._next(), 1.0

    def _next(self) -> np.ndarray:
        """The L-BFGS direction from the remembered steps."""
        q, factors = self.gradient.copy(), []
        kept = [(s, y) for s, y in self.steps if (s * y).sum() > 1e-12]
        for s, y in reversed(kept):
            a = (s * q).sum() / (s * y).sum()
            q -= a * y
            factors.append(a)
        if kept:
            s, y = kept[-1]
            q *= (s * y).sum() / (y * y).sum()
        for (s, y), a in zip(kept, reversed(factors)):
            q += (a - (y * q).sum() / (s * y).sum()) * s
        return -q


def _add(out: np.ndarray, label: np.ndarray, rows: Block, w: np.ndarray) -> None:
    """Add the rows' loss and gradient at ``w`` to ``out``."""
    logs = log_probabilities(rows, w)
    own = label, np.arange(len(label))
    out[0] -= logs[own].sum()
    miss = np.exp(logs)
    miss[own] -= 1
    out[1:] += np.concatenate([rows.back(m, w.shape[1] - 1) for m in miss])


def _length(w: np.ndarray) -> int:
    return 1 + w.size


def _pass(points: list[tuple[int, np.ndarray]]) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Sums of loss and gradient over a batch of rows, for each (size, weights)."""

    def of_batch(batch: pa.RecordBatch) -> np.ndarray:
        label, rows, out = _labels(batch), Block.of(batch), [np.zeros(_length(w)) for _, w in points]
        cut = {size: rows.first(size) for size, _ in points}
        for total, (size, w) in zip(out, points):
            _add(total, label, cut[size], w)
        return np.concatenate(out)

    return of_batch


def _block_pass(points: list[tuple[int, np.ndarray]]) -> Callable[[pa.RecordBatch], np.ndarray]:
    """The same over blocks, for each (view, weights)."""
    asked = sorted({view for view, _ in points})

    def of_batch(batch: pa.RecordBatch) -> np.ndarray:
        out = [np.zeros(_length(w)) for _, w in points]
        for label, views in read_blocks(batch, asked):
            for total, (view, w) in zip(out, points):
                _add(total, label, views[view], w)
        return np.concatenate(out)

    return of_batch


def fit_all(train: DataFrame, settings: list[tuple[float, int, int]], classes: int, tolerance: float = TOLERANCE) -> list[Setting]:
    """The fitted settings (C, vocabulary size, limit of iterations) from staged rows (indices, weights, label id)."""
    rows = train.select("indices", "weights", F.col("label").cast("int").alias("label")).filter("label IS NOT NULL")
    n, sizes = max(1, rows.count()), sorted({size for _, size, _ in settings})
    blocks = stage_blocks(rows, [lambda b, size=size: b.first(size) for size in sizes])
    with batches_of(train.sparkSession, AT_ONCE):
        return _fit(blocks, sizes, n, settings, classes, tolerance)


def _fit(
    blocks: DataFrame, sizes: list[int], n: int, settings: list[tuple[float, int, int]], classes: int, tolerance: float
) -> list[Setting]:
    parts = blocks.rdd.getNumPartitions()
    live = fitted = [Setting(c, size, limit, np.zeros((classes, size + 1))) for c, size, limit in settings]
    while live:
        points = [(sizes.index(s.size), s.trial()) for s in live]
        lengths = [_length(w) for _, w in points]
        rows = only(blocks, sorted({view for view, _ in points}))
        found = np.split(array_sum(rows, _block_pass(points), sum(lengths), parts=parts) / n, np.cumsum(lengths)[:-1])
        for s, (_, w), f in zip(live, points, found):
            penalty = np.hstack([w[:, :-1], np.zeros((classes, 1))]) / (s.c * n)
            loss = f[0] + (penalty * w).sum() / 2
            s.take(float(loss), f[1:].reshape(w.shape) + penalty, tolerance)
        live = [s for s in live if not s.done]
    return fitted


def predict_all(df: DataFrame, settings: list[Setting]) -> DataFrame:
    """(run, ord, label, prediction, loss): class id and loss of every row in every setting, by one pass."""
    models = [(s.size, s.weights) for s in settings]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, rows = _labels(batch), Block.of(batch)
            for k, (size, w) in enumerate(models):
                logs = log_probabilities(rows.first(size), w)
                loss = -logs[label, np.arange(len(label))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(label), k, np.int32)), batch.column("ord"), pa.array(label.astype(np.int32)),
                        pa.array(logs.argmax(axis=0).astype(np.int32)), pa.array(loss),
                    ],
                    ["run", "ord", "label", "prediction", "loss"],
                )

    rows = df.select("ord", "indices", "weights", F.col("label").cast("int").alias("label")).filter("label IS NOT NULL")
    return rows.mapInArrow(run, "run int, ord bigint, label int, prediction int, loss double")
