"""Keyword classification with large keyword tables, by automata over the bytes of the texts.

The table is read in keyword order and cut into blocks of bounded size.  A block becomes an
automaton: states are the beginnings of its keywords, ``goto`` the transitions with the
failure arcs already followed, ``output`` the keywords that end in a state.  Blocks are
broadcast; tasks run them over Arrow batches, all stretches of a batch in step, so one
byte of many texts costs a few vector operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..constants import INTENTS, KEYWORD_DEFAULT
from ..functions.scores import argmax, label_at

BLOCK_BYTES = 1 << 17  # of keywords in an automaton: as many states at most, each with up to 256 transitions of 4 bytes
STRETCH = 256  # bytes of a text that one lane of a batch runs through
BATCH_BYTES = 1 << 21  # of text that a task handles at once


@dataclass
class Automaton:
    """Transitions by state and kind of byte, and the keywords that end in each state."""

    kind: np.ndarray  # kind of each byte; 0 for bytes of no keyword
    goto: np.ndarray  # (state, kind) to state
    begin: np.ndarray  # state's first output; one more than states
    output: np.ndarray  # numbers of keywords
    longest: int

    @classmethod
    def build(cls, words: list[bytes]) -> Automaton:
        """``words`` are distinct and not empty."""
        used = np.zeros(256, bool)
        for w in words:
            used[list(w)] = True
        kind = np.where(used, np.cumsum(used), 0)
        kinds = int(used.sum()) + 1
        rows, ends = [[-1] * kinds], {}
        for number, w in enumerate(words):
            state = 0
            for k in kind[list(w)].tolist():
                if rows[state][k] < 0:
                    rows[state][k] = len(rows)
                    rows.append([-1] * kinds)
                state = rows[state][k]
            ends[state] = number
        goto = np.array(rows, np.int32)
        own = [[ends[s]] if s in ends else [] for s in range(len(rows))]
        fail = np.zeros(len(rows), np.int32)
        level = goto[0][goto[0] >= 0]
        goto[0][goto[0] < 0] = 0
        while len(level):  # states of one depth together; those above are complete
            below = goto[level]
            beyond = goto[fail[level]]
            has = below >= 0
            fail[below[has]] = beyond[has]
            goto[level] = np.where(has, below, beyond)
            level = below[has]
            for s in level.tolist():
                own[s] = own[s] + own[fail[s]]
        begin = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        return cls(kind.astype(np.uint8), goto, begin, np.array([x for xs in own for x in xs], np.int64), max(map(len, words)))

    def hits(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, keyword) of every keyword that a row of bytes holds, each once.

        Rows are cut into stretches that begin as much earlier as the longest keyword
        reaches back, but never before their row, so a keyword across a cut is found.
        """
        n = np.diff(bounds)
        lanes = -(-n // STRETCH)
        row = np.repeat(np.arange(len(n)), lanes)
        at = (np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * STRETCH
        stop = bounds[row] + np.minimum(at + STRETCH, n[row])
        place = bounds[row] + np.maximum(at - (self.longest - 1), 0)
        order = np.argsort(place - stop, kind="stable")  # longest first, so lanes that have ended are the last
        row, place, left = row[order], place[order], (stop - place)[order]
        state = np.zeros(len(row), np.int32)
        kinds, some, found = self.kind[data], np.diff(self.begin) > 0, []
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step, "left"))  # lanes with more than ``step`` bytes
            state[:live] = self.goto[state[:live], kinds[place[:live] + step]]
            hit = np.flatnonzero(some[state[:live]])
            if len(hit):
                found.append(row[hit] * len(self.goto) + state[hit])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, state = np.divmod(np.unique(np.concatenate(found)), len(self.goto))
        times = self.begin[state + 1] - self.begin[state]
        inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        words = self.output[np.repeat(self.begin[state], times) + inside]
        size = max(int(self.output.max()) + 1, 1)
        return np.divmod(np.unique(np.repeat(row, times) * size + words), size)


@dataclass
class Block:
    """An automaton and the classes of its keywords: (keyword, class) pairs, by keyword."""

    automaton: Automaton
    begin: np.ndarray
    classes: np.ndarray

    def counts(self, data: np.ndarray, bounds: np.ndarray, n_classes: int) -> np.ndarray:
        """Distinct keywords per (row, class)."""
        row, word = self.automaton.hits(data, bounds)
        times = self.begin[word + 1] - self.begin[word]
        inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        kinds = self.classes[np.repeat(self.begin[word], times) + inside]
        rows = len(bounds) - 1
        return np.bincount(np.repeat(row, times) * n_classes + kinds, minlength=rows * n_classes).reshape(rows, n_classes)


def read_blocks(table: DataFrame, labels: list[str], label_col: str, word_col: str, block_bytes: int) -> Iterator[Block]:
    """The table's keywords in order, in blocks; one block is held at a time."""
    rows = table.select(F.col(word_col).alias("w"), F.col(label_col).alias("c")).filter(F.col("c").isin(labels) & (F.col("w") != ""))
    rows = rows.groupBy("w").agg(F.sort_array(F.collect_set("c")).alias("c")).orderBy("w")  # a set of listed classes
    number = {c: k for k, c in enumerate(labels)}
    words, classes, size = [], [], 0

    def block() -> Block:
        begin = np.concatenate([[0], np.cumsum([len(c) for c in classes])])
        return Block(Automaton.build(words), begin, np.array([number[c] for cs in classes for c in cs], np.int64))

    for r in rows.toLocalIterator():
        word = r.w.encode()
        if words and size + len(word) > block_bytes:
            yield block()
            words, classes, size = [], [], 0
        words.append(word)
        classes.append(r.c)
        size += len(word)
    if words:
        yield block()


def _text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about ``BATCH_BYTES``."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(ends, ends[row] + BATCH_BYTES, "right")) - 1)
        yield row, end, data[ends[row] : ends[end]], ends[row : end + 1] - ends[row]
        row = end


def with_table_scores(
    df: DataFrame,
    table: DataFrame,
    labels: list[str] = INTENTS,
    text_col: str = "clean_text",
    label_col: str = "intent",
    word_col: str = "keyword",
    out: str = "scores",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add an array with, per class, the number of its keywords that the lower-cased text holds.

    ``table`` has one row per class and keyword; rows that repeat count once, a keyword of
    two classes counts for both, empty and null keywords and classes outside ``labels``
    count for none.  Every block is one pass of a pipeline within the same tasks, so no
    row is shuffled, whatever the size of the table.
    """
    spark, n_classes = df.sparkSession, len(labels)
    rows = df.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns]).alias("row"), F.lower(text_col).alias("text"))
    rows = rows.withColumn("hits", F.array_repeat(F.lit(0).cast("bigint"), n_classes))

    def scan(handle):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, data, bounds in _text_chunks(batch.column("text")):
                    part = batch.slice(a, b - a)
                    before = part.column("hits").flatten().to_numpy().reshape(-1, n_classes)
                    total = before + handle.value.counts(data, bounds, n_classes)
                    ends = pa.array(np.arange(b - a + 1, dtype=np.int32) * n_classes)
                    hits = pa.ListArray.from_arrays(ends, pa.array(total.reshape(-1).astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), hits], ["row", "text", "hits"])

        return run

    schema = StructType([rows.schema["row"], rows.schema["text"], StructField("hits", ArrayType(LongType()))])
    for block in read_blocks(table, list(labels), label_col, word_col, block_bytes):
        rows = rows.mapInArrow(scan(spark.sparkContext.broadcast(block)), schema)
    kept = [F.col("row").getField(c).alias(c) for c in df.columns if c != out]
    return rows.select(*kept, F.col("hits").cast(ArrayType(DoubleType())).alias(out))


def classify_by_table(
    df: DataFrame,
    table: DataFrame,
    labels: list[str] = INTENTS,
    default: str = KEYWORD_DEFAULT,
    text_col: str = "clean_text",
    out: str = "predicted_intent",
    **options,
) -> DataFrame:
    """Add ``scores`` and the class with most keywords; ties take the first class, no hit the default."""
    scored = with_table_scores(df, table, labels, text_col, **options)
    best = F.when(F.array_max("scores") == 0, F.lit(default)).otherwise(label_at(list(labels), argmax(F.col("scores"))))
    return scored.withColumn(out, best)
