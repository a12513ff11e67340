"""Sums of large arrays over many tasks, in a tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 32  # arrays that one task adds up
SCHEMA = "part int, v binary"


def _add(table: pa.Table) -> pa.Table:
    """Sum of the arrays of a group, in the order of their parts, so that it repeats exactly."""
    order = np.argsort(table.column("part").to_numpy(), kind="stable")
    total = 0.0
    for k in order.tolist():
        total = total + np.frombuffer(table.column("v")[k].as_py())
    return pa.table({"part": pa.array([table.column("group")[0].as_py()], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})


def array_sum(
    rows: DataFrame, of_batch: Callable[[pa.RecordBatch], np.ndarray], size: int, fan: int = FAN, parts: int | None = None
) -> np.ndarray:
    """Sum over all batches of the arrays of ``size`` doubles that ``of_batch`` makes.

    A task adds up its own batches; groups of ``fan`` tasks' arrays are then added up level
    by level, so that at most ``fan`` arrays come together in a task or reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of_batch(batch)
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    parts = parts or rows.rdd.getNumPartitions()  # callers of many passes count once
    sums = rows.mapInArrow(run, "v binary").select(F.spark_partition_id().alias("part"), "v")
    while parts > fan:
        parts = -(-parts // fan)
        sums = sums.withColumn("group", (F.col("part") / fan).cast("int")).groupBy("group").applyInArrow(_add, SCHEMA)
    total = np.zeros(size)
    for r in sorted(sums.collect(), key=lambda r: r.part):
        total += np.frombuffer(r.v)
    return total
