"""Hashed n-gram frequencies of texts, for linear models.

Families of grams have index ranges of their own: trigrams of code points, words, pairs of words,
and repeats.  A family's frequencies are counts over its number of grams in the text.
A pair of equal words has one index for all words, as repetition itself is what it
tells; repeats are these pairs alone, over the number of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .frames import named
from .kernels import WHITE, SpanHasher, chunks, mix, spans

ALL = ("chars", "words", "pairs")
PART_BYTES = 1 << 18  # of texts whose grams are held at once
Grams = tuple[np.ndarray, np.ndarray, np.ndarray]  # index and row of every gram, number of grams by row


def gram_ids(data: np.ndarray, bounds: np.ndarray, bits: int, families: tuple[str, ...] = ALL) -> list[Grams]:
    n_rows, shift = len(bounds) - 1, np.uint64(64 - bits)
    found = {}
    if "chars" in families:
        point = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.uint64)
        edges = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
        sizes = np.maximum(np.diff(edges) - 2, 0)
        row = np.repeat(np.arange(n_rows), sizes)
        at = np.arange(len(row)) + np.repeat(edges[:-1] - np.cumsum(sizes) + sizes, sizes)
        three = (point[at] << np.uint64(42)) | (point[at + 1] << np.uint64(21)) | point[at + 2]
        found["chars"] = mix(three) >> shift, row, sizes
    starts, ends, doc = spans(~WHITE[data], bounds)
    word = SpanHasher(data)(starts, ends)
    found["words"] = word >> shift, doc, np.bincount(doc, minlength=n_rows)
    both = np.flatnonzero(doc[1:] == doc[:-1])
    again = word[both] == word[both + 1]
    n_pairs = np.bincount(doc[both], minlength=n_rows)
    pair = mix(word[both] * np.uint64(31) + word[both + 1]) >> shift
    found["pairs"] = np.where(again, np.uint64(0), pair), doc[both], n_pairs
    found["repeats"] = np.zeros(int(again.sum()), np.uint64), doc[both][again], n_pairs
    return [(found[f][0].astype(np.int64) + (k << bits), *found[f][1:]) for k, f in enumerate(families)]


def margins_of(grams: list[Grams], weights: np.ndarray, n_rows: int) -> np.ndarray:
    """Sum of weight times frequency, per row, of the grams that ``gram_ids`` has found."""
    total = np.zeros(n_rows)
    for index, row, count in grams:
        total += np.bincount(row, weights=weights[index], minlength=n_rows) / np.maximum(count, 1)
    return total


def margins(
    data: np.ndarray, bounds: np.ndarray, weights: np.ndarray, bits: int, families: tuple[str, ...] = ALL
) -> np.ndarray:
    """Sum of weight times frequency, per row."""
    return margins_of(gram_ids(data, bounds, bits, families), weights, len(bounds) - 1)


class Matrix:
    """Rows of sparse vectors, also by column, for products in both directions."""

    def __init__(self, index: np.ndarray, value: np.ndarray, offsets: np.ndarray, size: int):
        self.index, self.value, self.offsets = index, value.astype(np.float32), offsets
        order = np.argsort(index, kind="stable")
        self.column_row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[order]
        self.column_value = self.value[order]
        self.column_offsets = np.concatenate([[0], np.cumsum(np.bincount(index, minlength=size))])

    @staticmethod
    def _sums(terms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(terms, dtype=np.float64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return self._sums(weights[self.index] * self.value, self.offsets)

    def back(self, rows: np.ndarray) -> np.ndarray:
        """Sum of the rows' vectors, each times its entry of ``rows``."""
        return self._sums(rows[self.column_row] * self.column_value, self.column_offsets)


def descend(
    matrix: Matrix, gradient_of, size: int, intercept: float, rounds: int, rate: float, decay: float
) -> tuple[np.ndarray, float]:
    """Weights and intercept that lower a loss, given its gradient with respect to the rows' margins.

    Steps use all rows; their size adapts to each weight's usual gradient.  A floor keeps
    rare grams, of which the rows tell little, from moving as far as common ones.
    """
    w, b = np.zeros(size), intercept
    m, s, mb, sb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        g = gradient_of(matrix.dot(w) + b)
        step, step_b = matrix.back(g) + decay * w, g.sum()
        m, s = 0.9 * m + 0.1 * step, 0.99 * s + 0.01 * step * step
        mb, sb = 0.9 * mb + 0.1 * step_b, 0.99 * sb + 0.01 * step_b * step_b
        now, grown, usual = rate * (1 - t / (rounds + 1)), 1 - 0.9**t, 1 - 0.99**t
        spread = np.sqrt(s / usual)
        w = w - now * (m / grown) / (spread + 0.02 * spread.max() + 1e-12)
        b = b - 0.02 * now * (mb / grown) / (np.sqrt(sb / usual) + 1e-12)
    return w, b


def read_vectors(batches: Iterator[pa.RecordBatch], label: str) -> tuple[Matrix | None, np.ndarray, int]:
    """Matrix, labels and vector size of stored rows (``label``, ``v``); no matrix without rows."""
    index, value, lengths, labels, size = [], [], [], [], 0
    for batch in batches:
        v = batch.column("v")
        indices, values = (pc.struct_field(v, k) for k in ("indices", "values"))
        index.append(indices.flatten().to_numpy())
        value.append(values.flatten().to_numpy())
        lengths.append(np.diff(indices.offsets.to_numpy()))
        labels.append(batch.column(label).to_numpy(zero_copy_only=False))
        size = size or (v[0].as_py()["size"] if len(v) else 0)
    if not size:
        return None, np.zeros(0), 0
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
    return Matrix(np.concatenate(index), np.concatenate(value), offsets, size), np.concatenate(labels), size


def sparse_rows(
    docs: DataFrame, text_col: str, keep: list[str], bits: int, families: tuple[str, ...] = ALL
) -> DataFrame:
    """Columns ``keep`` with the sparse vector of a text's frequencies, ``v``, in the form of a stored ML vector."""
    size = len(families) << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in chunks(batch.column("text"), PART_BYTES):
                keys, values = [], []
                for index, row, total in gram_ids(data, bounds, bits, families):
                    key, count = np.unique(row * size + index, return_counts=True)
                    keys.append(key)
                    values.append(count / total[key // size])
                key, value = np.concatenate(keys), np.concatenate(values)
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
                ends = np.cumsum(np.bincount(key // size, minlength=b - a))
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                v = pa.StructArray.from_arrays(
                    [
                        pa.array(np.zeros(b - a, np.int8)),
                        pa.array(np.full(b - a, size, np.int32)),
                        pa.ListArray.from_arrays(offsets, pa.array((key % size).astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(value)),
                    ],
                    ["type", "size", "indices", "values"],
                )
                kept = [batch.column(c).slice(a, b - a) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, v], [*keep, "v"])

    rows = docs.select(*[named(c) for c in keep], named(text_col).alias("text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema)
    return rows.mapInArrow(run, kept + "v struct<type:tinyint,size:int,indices:array<int>,values:array<double>>")
