"""Sparse rows packed into blocks, for fits that pass over the same rows many times.

A block holds the rows of about ``BLOCK`` terms as binary columns.  A pass takes its arrays as they
were written; nothing is converted element by element, and what it works on fits a core's cache.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..plans.staging import stage

BLOCK = 1 << 16  # terms of the rows of a block, one row at least
AT_ONCE = 32  # blocks that a Python worker gets at once
PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}  # weights hardly shrink, and are read often
ARRAYS = (("ends", "<i4"), ("at", "<i4"), ("value", "<f8"))


@dataclass
class Block:
    """Terms of rows: a row's are those from its number in ``ends`` to the next."""

    ends: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def __post_init__(self):
        self.sizes = np.diff(self.ends)
        self.full = np.flatnonzero(self.sizes)
        self.begin = self.ends[self.full]

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Block:
        """The ``indices`` and ``weights`` of a batch of rows."""
        index, weight = batch.column("indices"), batch.column("weights")
        ends = index.offsets.to_numpy()
        return cls(ends - ends[0], index.flatten().to_numpy().astype(np.int64), weight.flatten().to_numpy().astype(np.float64))

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Product of every row with ``w``, whose last number is the intercept."""
        out = np.full(len(self.sizes), w[-1])
        if len(self.full):
            out[self.full] += np.add.reduceat(w.take(self.at) * self.value, self.begin)
        return out

    def back(self, z: np.ndarray, size: int) -> np.ndarray:
        """Sum of the rows, each times its number in ``z``, over ``size`` terms; that of ``z`` comes last."""
        return np.append(np.bincount(self.at, weights=np.repeat(z, self.sizes) * self.value, minlength=size), z.sum())

    def first(self, size: int) -> Block:
        """The first ``size`` terms, each row brought to length one."""
        keep = self.at < size
        ends = np.append(0, np.cumsum(keep))[self.ends]
        cut = Block(ends, self.at[keep], self.value[keep])
        if len(cut.full):
            norm = np.sqrt(np.add.reduceat(cut.value**2, cut.begin))
            cut.value = cut.value / np.repeat(np.where(norm > 0, norm, 1.0), cut.sizes[cut.full])
        return cut


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.list_value_length(batch.column("indices")).to_numpy().astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def stage_blocks(rows: DataFrame, views: list[Callable[[Block], Block]]) -> DataFrame:
    """Blocks of rows (indices, weights, label) as each of ``views`` has them, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                found = [view(Block.of(part)) for view in views]
                cells = {"label": part.column("label").to_numpy().astype("<i4").tobytes()}
                cells |= {f"{c}{k}": getattr(b, c).astype(t).tobytes() for k, b in enumerate(found) for c, t in ARRAYS}
                yield pa.RecordBatch.from_pydict({c: pa.array([x], pa.binary()) for c, x in cells.items()})

    fields = ["label", *(f"{c}{k}" for k in range(len(views)) for c, _ in ARRAYS)]
    packed = rows.select("indices", "weights", "label").mapInArrow(run, ", ".join(f"{c} binary" for c in fields))
    return stage(packed, "blocks", **PLAIN)


def read_blocks(batch: pa.RecordBatch, views: list[int]) -> Iterator[tuple[np.ndarray, dict[int, Block]]]:
    """Label ids and the asked views of every block of a batch."""
    for row in range(batch.num_rows):
        get = lambda c, t: np.frombuffer(batch.column(c)[row].as_buffer(), t)
        yield get("label", "<i4"), {k: Block(*(get(f"{c}{k}", t) for c, t in ARRAYS)) for k in views}


def only(blocks: DataFrame, views: list[int]) -> DataFrame:
    """The columns that a pass over some views reads."""
    return blocks.select("label", *(f"{c}{k}" for k in views for c, _ in ARRAYS))
