"""Mini-batch training of a logistic regression by epochs, which can be cut off and taken up again.

Rows are dealt into buckets by a hash of their order value and stored once, so batches do not
depend on how the input was laid out.  An epoch takes the buckets in an order of its own, given by
a seeded hash; a batch is a run of buckets, hence every row is seen once an epoch.  One shuffle an
epoch deals the rows out by runs of batches; as every step needs the one before, the runs follow one
another, each a task that reads its own files and hands on the state.  So neither
jobs nor files are many: their number is that of runs, and a task's rows are bounded.  Steps are those of Adam.  After
each epoch the state and the scores on the held-out rows are stored in the run's folder;
a run that finds epochs there goes on after the last whole one, and the best epoch is the result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import INTENTS, SEED
from ..functions.scores import label_at
from ..sources.files import path_exists
from .metrics import overall_metrics
from .sweeps import Setting, _pass, predict_all

BUCKETS_PER_BATCH = 4
BATCHES_PER_TASK = 64  # steps that one task takes, one after the other
STATE = "loss double, steps bigint, weights binary, first binary, second binary"
SCHEMA = (
    "epoch int, rows_seen bigint, train_loss double, val_loss double, val_accuracy double, val_macro_f1 double, "
    "weights binary, first binary, second binary, steps bigint"
)


@dataclass
class EpochRun:
    """The weights (class, term; the intercept last) of the best epoch, and the records of all epochs."""

    weights: np.ndarray
    best_epoch: int
    history: list[dict]


def _buckets(train: DataFrame, path: str, n: int, batch_size: int, seed: int) -> DataFrame:
    """The training rows with their buckets, stored once in the run's folder."""
    count = max(1, math.ceil(BUCKETS_PER_BATCH * n / batch_size))
    if not path_exists(train.sparkSession, f"{path}/buckets/_SUCCESS"):
        rows = train.select("ord", "indices", "weights", F.col("label").cast("int").alias("label")).filter("label IS NOT NULL")
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "ord"), F.lit(count)).cast("int"))
        dealt.write.mode("overwrite").parquet(f"{path}/buckets")
    return train.sparkSession.read.parquet(f"{path}/buckets")


def epoch_batches(buckets: list[int], epoch: int, seed: int, per_batch: int = BUCKETS_PER_BATCH) -> list[list[int]]:
    """The buckets of each batch, in the epoch's order."""
    order = sorted(buckets, key=lambda b: hashlib.md5(f"{seed}:{epoch}:{b}".encode()).hexdigest())
    return [order[k : k + per_batch] for k in range(0, len(order), per_batch)]


def _dealt(rows: DataFrame, batches: list[list[int]], path: str) -> list[DataFrame]:
    """The rows of an epoch by runs of batches, stored in the run's folder in place of those of the epoch before."""
    spark = rows.sparkSession
    places = [(b, k) for k, batch in enumerate(batches) for b in batch]
    numbered = rows.join(F.broadcast(spark.createDataFrame(places, "bucket int, batch int")), "bucket")
    runs = numbered.withColumn("run", F.floor(F.col("batch") / BATCHES_PER_TASK).cast("int"))
    runs.repartition("run").write.mode("overwrite").partitionBy("run").parquet(path)
    count = math.ceil(len(batches) / BATCHES_PER_TASK)
    return [spark.read.schema(numbered.schema).parquet(f"{path}/run={k}") for k in range(count)]


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each batch together, from rows in the order of their batches."""

    def whole(held: list) -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    held, now = [], None
    for part in parts:
        number = part.column("batch").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), part.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            if held and number[start] != now:
                yield whole(held)
                held = []
            now = number[start]
            held.append(part.slice(start, end - start))
    if held:
        yield whole(held)


def _steps(state: list[np.ndarray], loss: float, steps: int, size: int, rate: float, share: float) -> Callable:
    """Adam's steps over a run of batches; returns the state after them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (w, m, v), total, taken = state, loss, steps
        for batch in _batches(parts):
            found = _pass([(size, w)])(batch)
            penalty = np.hstack([w[:, :-1], np.zeros((len(w), 1))]) * share
            g = found[1:].reshape(w.shape) / batch.num_rows + penalty
            total, taken = total + float(found[0]), taken + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**taken)) / (np.sqrt(v / (1 - 0.999**taken)) + 1e-8)
        names = ["loss", "steps", "weights", "first", "second"]
        yield pa.RecordBatch.from_pydict(dict(zip(names, ([x] for x in (total, taken, *(x.tobytes() for x in (w, m, v)))))))

    return run


def _scores(val: DataFrame, weights: np.ndarray, labels: list[str]) -> dict:
    scored = predict_all(val, [Setting(1.0, weights.shape[1] - 1, 0, weights)])
    named = scored.select("loss", *[label_at(labels, F.col(c)).alias(out) for c, out in (("label", "intent"), ("prediction", "predicted_intent"))])
    figures, loss = overall_metrics(named, labels).first(), named.agg(F.avg("loss")).first()[0]
    return {"val_loss": loss, "val_accuracy": figures.accuracy if figures else None, "val_macro_f1": figures.macro_f1 if figures else None}


def train_epochs(
    train: DataFrame,
    val: DataFrame,
    size: int,
    path: str,
    labels: list[str] = INTENTS,
    epochs: int = 4,
    batch_size: int = 512,
    learning_rate: float = 0.05,
    c: float = 1.0,
    seed: int = SEED,
) -> EpochRun:
    """Train on staged rows (ord, indices, weights, label id) with ``size`` terms; ``path`` is the run's folder."""
    spark, shape = train.sparkSession, (len(labels), size + 1)
    n = train.filter("label IS NOT NULL").count()
    rows = _buckets(train, path, n, batch_size, seed) if n else None
    counts = {r.bucket: r["count"] for r in rows.groupBy("bucket").count().collect()} if n else {}  # a few per batch
    state = [np.zeros(shape) for _ in range(3)]  # weights, and Adam's two means
    steps, history = 0, []
    for epoch in range(1, epochs + 1):
        folder = f"{path}/epoch-{epoch}"
        if path_exists(spark, f"{folder}/_SUCCESS"):
            record = spark.read.schema(SCHEMA).parquet(folder).first().asDict()
            state = [np.frombuffer(record[k]).reshape(shape).copy() for k in ("weights", "first", "second")]
            steps = record["steps"]
            history.append(record)
            continue
        loss = 0.0
        runs = _dealt(rows, epoch_batches(sorted(counts), epoch, seed), f"{path}/dealt") if n else []
        for run in runs:
            step = _steps(state, loss, steps, size, learning_rate, 1 / (c * n))
            after = run.coalesce(1).sortWithinPartitions("batch", "bucket", "ord").mapInArrow(step, STATE).first()
            state = [np.frombuffer(after[k]).reshape(shape) for k in ("weights", "first", "second")]
            loss, steps = after.loss, after.steps
        record = {"epoch": epoch, "rows_seen": sum(counts.values()), "train_loss": loss / n if n else None, **_scores(val, state[0], labels)}
        record |= dict(zip(("weights", "first", "second"), (x.tobytes() for x in state))) | {"steps": steps}
        spark.createDataFrame([record], SCHEMA).coalesce(1).write.mode("overwrite").parquet(folder)
        history.append(record)
    best = max(history, key=lambda r: (r["val_macro_f1"] if r["val_macro_f1"] is not None else -1.0, -r["epoch"]))
    return EpochRun(np.frombuffer(best["weights"]).reshape(shape), best["epoch"], [{k: x for k, x in r.items() if not isinstance(x, (bytes, bytearray))} for r in history])
