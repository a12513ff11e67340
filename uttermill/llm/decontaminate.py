"""Occurrences of benchmark passages in documents, by Wu-Manber search.

Windows of consecutive benchmark words are patterns.  Documents are brought to one
form (lower-case words between single blanks), and cursors move through them: the
block of bytes that ends at a cursor's window selects a shift; a positive shift skips
positions where no pattern can occur, a zero one selects the bucket of the patterns
whose head ends in this block, and these are compared byte by byte.  numpy moves many
cursors at once, each over its own stretch of text; a stretch begins where the
previous one ends, so together they are one scan.

Defined cases: null texts have no words; items without words have no pattern; items
shorter than a window are one pattern.  Items that repeat an id are one item, an item
with a null id hits but is never listed.  Every row of ``docs`` has its own result.  An
empty benchmark hits nothing, an empty table gives an empty result.  A text of any length is
searched whole.  Item ids are listed in the order of their strings, each once.  Other columns,
whatever their names, are carried.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..plans.staging import stage
from .frames import named, packed
from .kernels import LOWER, chunks, spans

WINDOW_WORDS = 10
BLOCK_BYTES = 12  # of the shift table's blocks; shorter if a pattern is shorter
TABLE_BITS = 18
STRETCH = 512  # bytes of text that a cursor scans
MAX_BLOCK_CHARS = 4_000_000  # of benchmark text searched in one pass

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_IS_WORD = np.ones(256, bool)
_IS_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def benchmark_windows(text: str | None, n_words: int = WINDOW_WORDS) -> set[str]:
    """Windows of an item: word runs between single blanks."""
    words = _WORD.findall((text or "").translate(_UPPER))
    return {" ".join(words[i : i + n_words]) for i in range(max(1, len(words) - n_words + 1))} if words else set()


class ShiftTable:
    """Shift table, buckets and patterns of one pattern set.

    Patterns carry a blank at both ends, so that they only occur at word borders.
    """

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.span = min(map(len, patterns))
        self.block = min(BLOCK_BYTES, self.span)
        self.shift = np.full(1 << TABLE_BITS, self.span - self.block + 1, np.int32)
        buckets = defaultdict(list)
        heads = np.frombuffer(b"".join(p[: self.span] for p in patterns) + bytes(8), np.uint8)
        starts = np.arange(len(patterns)) * self.span
        for at in range(self.span - self.block + 1):
            slot = self.slots(heads, starts + at)
            np.minimum.at(self.shift, slot, self.span - self.block - at)
        for i, s in enumerate(self.slots(heads, starts + self.span - self.block).tolist()):
            buckets[s].append(i)
        self.buckets = dict(buckets)

    def slots(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Table slot of the block that begins at each position; ``data`` has 8 bytes to spare."""
        words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        head = words[at]
        if self.block < 8:
            h = head & np.uint64((1 << 8 * self.block) - 1)
        else:
            h = head ^ (words[at + self.block - 8] * np.uint64(0x9E3779B97F4A7C15))
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of all occurrences in the first ``n`` bytes of ``data``."""
        text = data[:n].tobytes()
        last = n - self.span  # the last position where a window fits
        at = np.arange(0, max(0, last + 1), STRETCH)
        stop = np.minimum(at + STRETCH, last + 1)
        found_at, found = [], []
        while len(at):
            slot = self.slots(data, at + self.span - self.block)
            jump = self.shift[slot]
            for p, s in zip(at[jump == 0].tolist(), slot[jump == 0].tolist()):
                for k in self.buckets.get(s, ()):
                    if text.startswith(self.patterns[k], p):
                        found_at.append(p)
                        found.append(k)
            at = at + np.maximum(jump, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        return np.array(found_at, np.int64), np.array(found, np.int64)


def _searcher(groups: list[tuple[ShiftTable, list[list[str]]]]):
    """mapInArrow function: adds the hits of one pattern set to (row, text, spans, items)."""

    def search(column: pa.Array) -> Iterator[tuple[int, list[int], list[str], int]]:
        for a, b, data, bounds in chunks(column):
            low = LOWER[data]
            inside = _IS_WORD[low]
            starts, ends, doc = spans(inside, bounds)
            # " w1 w2 w3 " of every document, one blank between two documents
            keep = inside.copy()
            lengths = ends - starts
            place = np.cumsum(lengths + 1) - lengths  # of each word, after a blank
            n = int(place[-1] + lengths[-1] + 1) if len(place) else 0
            text = np.full(n + 8, 0x20, np.uint8)
            text[np.repeat(place - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))] = low[keep]
            hits, items = defaultdict(list), defaultdict(set)
            for table, owners in groups:
                at, which = table.find(text, n)
                words = np.searchsorted(place, at + 1)
                for word, k in zip(words.tolist(), which.tolist()):
                    row = int(doc[word])
                    n_words = table.patterns[k].count(b" ") - 1
                    if word + n_words <= len(doc) and doc[word + n_words - 1] == row:
                        hits[row] += [word, word + n_words]
                        items[row].update(owners[k])
            count = np.bincount(doc, minlength=b - a)
            first = np.cumsum(count) - count
            for row in range(b - a):
                yield a + row, [x - int(first[row]) for x in hits.get(row, ())], sorted(items.get(row, ())), int(count[row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(search(batch.column("text")))
            before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
            both = [(s + f[1], sorted({*i, *f[2]})) for (s, i), f in zip(before, found)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("text"),
                    pa.array([f[3] for f in found], pa.int64()),
                    pa.array([s for s, _ in both], pa.list_(pa.int32())),
                    pa.array([i for _, i in both], pa.list_(pa.string())),
                ],
                ["row", "text", "n_words", "spans", "items"],
            )

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, max_chars: int) -> Iterator[pd.DataFrame]:
    """The benchmark in blocks of about ``max_chars`` characters (an item is never cut)."""
    items = benchmark.select(
        named(id_col).cast("string").alias("item"), F.coalesce(named(text_col), F.lit("")).alias("text")
    ).filter("text <> ''")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // max_chars)
    if n == 0:
        yield pd.DataFrame({"item": [], "text": []})
    for k in range(n):
        yield items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).toPandas()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window_words: int = WINDOW_WORDS,
    max_block_chars: int = MAX_BLOCK_CHARS,
) -> DataFrame:
    """(row, text, n_words, spans, items) per row of ``docs``; ``row`` holds its columns but the text.

    ``items`` has the ids of items that occur, sorted as text; ``spans`` lists begin and end word of each occurrence.  Documents are not shuffled.
    The benchmark is the query set: it is searched in blocks of bounded size, one pass
    over the documents for each.
    """
    rows = docs.select(
        packed(docs.drop(text_col)),
        named(text_col).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<int>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    searched = False
    for block in _blocks(benchmark, item_id_col, item_text_col, max_block_chars):
        owners = defaultdict(set)
        for item, text in zip(block["item"], block["text"]):
            for window in benchmark_windows(text, window_words):
                owners[f" {window} ".encode()].update([] if item is None else [item])
        # patterns of like length share a table, so that a short item does not shorten every shift
        tables = defaultdict(list)
        for p in owners:
            tables[len(p).bit_length()].append(p)
        groups = [(ShiftTable(ps), [sorted(owners[p]) for p in ps]) for ps in tables.values()]
        rows = stage(rows, "contamination") if searched else rows
        searched = True
        rows = rows.mapInArrow(_searcher(groups), rows.schema)
    return rows


@F.pandas_udf(LongType())
def _n_hit(spans_col: pd.Series) -> pd.Series:
    def count(flat) -> int:
        if not len(flat):
            return 0
        edges = np.zeros(max(flat) + 1, np.int64)
        np.add.at(edges, flat[0::2], 1)
        np.add.at(edges, flat[1::2], -1)
        return int((np.cumsum(edges) > 0).sum())

    return pd.Series([count(np.asarray(x, np.int64)) for x in spans_col], dtype="int64")


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: counts of words, hit words and items, and a digest of the items' ids."""
    text_col = options.get("text_col", "text")
    found = contamination(docs.select(named(id_col), named(text_col)), benchmark, **options)
    hit = F.when(F.size("spans") > 0, _n_hit("spans")).otherwise(F.lit(0)).cast("long")
    return found.select(
        F.col("row").getField(id_col).alias(id_col),
        F.col("n_words"),
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a window of any benchmark item."""
    text_col = options.get("text_col", "text")
    clean = contamination(docs, benchmark, **options).filter(F.size("spans") == 0)
    column = lambda c: F.col("text") if c == text_col else F.col("row").getField(c)
    return clean.select(*[column(c).alias(c) for c in docs.columns])
