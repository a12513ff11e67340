"""Quality rules: text statistics with fixed limits, and a calibrated linear model.

Method: logistic regression over hashed word and character n-gram frequencies, fitted on
labelled rows (a bounded sample of ids with one row each, in one task); its margins are turned into probabilities by a sigmoid fitted on rows
left out of the first fit; texts are scored in Arrow batches against a fixed limit.

Defined cases: a null text has no words and fails the word limit.  Several labels of
one document are averaged, half or more is 1; null labels do not count.  With labels
of one class only (or none) there is nothing to fit: the verdict is then the limits'
alone.  Every row has its own result, however often its id repeats; an empty table gives an
empty one.  A text of any length is handled whole, as a chunk by itself.  Columns with any other
names are not read.  Equal probabilities at the limit are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .frames import bounded_share, named, one_row_each
from .grams import PART_BYTES, descend, margins, read_vectors, sparse_rows
from .kernels import WHITE, SpanHasher, chunks, line_spans, mix, per_row, spans

BITS = 15
ROUNDS, RATE, DECAY = 80, 12.0, 1e-7
MIN_WORDS, MAX_REPEAT_PERCENT, KEEP_AT = 50, 50, 0.5
MAX_LABELLED = 2_500  # labelled rows of the fit, in expectation
CALIBRATION_FOLD = 5  # every fifth of them calibrates
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def text_statistics(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words per row."""
    n_rows, inside = len(bounds) - 1, ~WHITE[data]
    starts, ends, doc = spans(inside, bounds)
    points = ((data & 0xC0) != 0x80) & inside
    hasher = SpanHasher(data)
    line_start, line_end, line_row = line_spans(data, bounds)
    solid = np.concatenate([[0], np.cumsum(inside)])
    full = solid[line_end] > solid[line_start]
    key = mix(hasher(line_start[full], line_end[full]) + line_row[full].astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    row = line_row[full]
    dup = np.bincount(row, minlength=n_rows) - np.bincount(row[first], minlength=n_rows)
    word = hasher(starts, ends)
    at = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, np.int64)
    three = mix(mix(mix(word[at]) + word[at + 1]) + word[at + 2]) + doc[at].astype(np.uint64)
    order = np.argsort(mix(three))
    same = three[order][1:] == three[order][:-1]
    often = np.zeros(len(at), bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    covered = np.zeros(len(doc), bool)
    for step in range(3):
        covered[at[often] + step] = True
    return {
        "n_words": np.bincount(doc, minlength=n_rows),
        "word_chars": per_row(points, bounds),
        "n_symbols": per_row(_SYMBOL[data], bounds),
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(doc[covered], minlength=n_rows),
    }


@dataclass
class CalibratedModel:
    """Weights of the n-gram frequencies, and slope and offset of the probability's sigmoid."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        z = self.slope * (self.intercept + margins(data, bounds, self.weights, BITS)) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_sigmoid(margin: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton steps on smoothed targets (a margin that separates all stays finite)."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, offset = 1.0, 0.0
    design = np.stack([margin, np.ones(len(margin))], axis=1)
    loss = lambda a, b: np.logaddexp(0, a * margin + b).sum() - (target * (a * margin + b)).sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -500, 500)))
        gradient = design.T @ (p - target)
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(slope - size * step[0], offset - size * step[1]) > loss(slope, offset):
            size /= 2
        slope, offset = slope - size * step[0], offset - size * step[1]
        if size * np.abs(step).max() < 1e-7:
            break
    return float(slope), float(offset)


def labelled_ids(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, y): one row per labelled document."""
    known = labels.select(named(id_col).cast("long").alias("id"), named(label_col).cast("double").alias("y")).dropna()
    return known.groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
) -> CalibratedModel | None:
    """The model, or None if the labels are not of both classes."""
    known = stage(labelled_ids(labels, id_col, label_col), "labelled")
    chosen = bounded_share(known, "id", max_labelled)  # bounded, hence broadcast
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(CALIBRATION_FOLD)) == 0)
    texts = docs.select(named(id_col).cast("long").alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    rows = one_row_each(texts.join(F.broadcast(chosen), "id"), ["id", "y", "fold"], "text")  # at most as many as ids
    sample = stage(sparse_rows(rows, "text", ["y", "fold"], BITS), "quality-sample")
    columns = "weights binary, intercept double, margins binary, labels binary"
    found = sample.repartition(1).mapInArrow(_fit_task, columns).collect()
    if not found:
        return None
    model = CalibratedModel(np.frombuffer(found[0].weights), found[0].intercept)
    margin, label = np.frombuffer(found[0].margins), np.frombuffer(found[0].labels)
    if len(margin):
        model.slope, model.offset = fit_sigmoid(margin, label)
    return model


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights from the rows outside the calibration fold; margins and labels of the rows inside."""
    parts = {True: [], False: []}
    for batch in batches:
        inside = batch.column("fold")
        parts[True].append(batch.filter(inside))
        parts[False].append(batch.filter(pc.invert(inside)))
    matrix, y, size = read_vectors(parts[False], "y")
    if matrix is None or y.min() == y.max():
        return
    gradient = lambda z: (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(y)
    w, b = descend(matrix, gradient, size, 0.0, ROUNDS, RATE, DECAY)
    left, label, _ = read_vectors(parts[True], "y")
    margin = left.dot(w) + b if left is not None else np.zeros(0)
    values = [pa.array([x.astype(np.float64).tobytes()], pa.binary()) for x in (w, margin, label)]
    yield pa.RecordBatch.from_arrays(
        [values[0], pa.array([float(b)]), values[1], values[2]], ["weights", "intercept", "margins", "labels"]
    )


def apply_rules(
    docs: DataFrame,
    model: CalibratedModel | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    keep_at: float = KEEP_AT,
) -> DataFrame:
    """id, statistics, base_failed, probability (null without a model) and kept, per row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in chunks(batch.column("text"), PART_BYTES):
                s = text_statistics(data, bounds)
                failed = (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > max_repeat_percent * s["n_words"])
                if model is None:
                    p, kept = pa.nulls(b - a, pa.float64()), ~failed
                else:
                    score = model.probability(data, bounds)
                    p, kept = pa.array(score), ~failed & (score >= keep_at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), *[pa.array(s[c], pa.int64()) for c in names],
                     pa.array(failed), p, pa.array(kept)],
                    ["id", *names, "base_failed", "probability", "kept"],
                )

    texts = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    counts = ", ".join(f"{c} long" for c in names)
    found = texts.mapInArrow(run, f"id long, {counts}, base_failed boolean, probability double, kept boolean")
    return found.withColumnRenamed("id", id_col)
