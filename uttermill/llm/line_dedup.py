"""Lines that several documents share stay only in the first of them.

Method: digests of line keys are range-partitioned with a secondary sort by document
and position, a stream over each partition finds the lines that are not in their
key's first document, and every document gets a compressed bitmap of kept lines.
Texts are not part of any of these steps.

Defined cases: a null or empty text is one empty line, which stays.  Keys below
``min_chars`` code points always stay.  A null id counts as one document after all
others.  Rows that repeat an id are one document; each gets its own bitmap.  An empty
table gives an empty result.  Of lines of one key in the first document all stay.  A text of any
length is cut into lines whole; a document's bitmap must fit into a row.  Columns other than id and text are carried or ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.staging import stage
from .frames import named, packed, row_key
from .kernels import LOWER, WHITE, chunks, line_spans

MIN_CHARS = 10
_KEYS = "h1 long, h2 long, doc long, tag long, pos int"
_HEADER, _DROPPED, _OPEN, _FIRST = 0, 1, 2, 3


def _line_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc", "tag"))
            for a, b, data, bounds in chunks(batch.column("text")):
                low = LOWER[data]
                starts, ends, row = line_spans(data, bounds)
                first = np.searchsorted(row, np.arange(b - a))
                solid = np.flatnonzero(~WHITE[low])
                lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                some = np.flatnonzero(hi > lo)
                begin, end = solid[lo[some]], solid[hi[some] - 1] + 1
                long = points[end] - points[begin] >= min_chars
                some, begin, end = some[long], begin[long], end[long]
                text = low.tobytes()
                digest = b"".join(xxhash.xxh3_128_digest(text[s:e]) for s, e in zip(begin.tolist(), end.tolist()))
                h = np.frombuffer(digest, np.int64).reshape(-1, 2)
                owner = row[some]
                pos = (some - first[owner]).astype(np.int32)
                n_lines = np.diff(np.append(first, len(row))).astype(np.int32)
                names = ["h1", "h2", "doc", "tag", "pos"]
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, pa.array(doc[a:b]), pa.array(tag[a:b]), pa.array(n_lines)], names
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (h[:, 0].copy(), h[:, 1].copy(), doc[a:b][owner], tag[a:b][owner], pos)], names
                )

    return run


def _stream_firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decide the sorted rows of one partition, but for its first key, which may have begun before it."""

    def rows(kind: int, h1, h2, doc, tag, pos) -> pa.RecordBatch:
        columns = [np.full(len(doc), kind, np.int32), h1, h2, doc, tag, pos]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "h1", "h2", "doc", "tag", "pos"])

    lead = group = None  # (h1, h2, first document)
    for batch in batches:
        h1, h2, doc, tag, pos = (batch.column(k).to_numpy() for k in ("h1", "h2", "doc", "tag", "pos"))
        if not len(doc):
            continue
        if lead is None:
            lead = group = (h1[0], h2[0], doc[0])
        fresh = np.empty(len(doc), bool)
        fresh[0] = (h1[0], h2[0]) != group[:2]
        fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(doc)), -1))
        first = np.where(at < 0, group[2], doc[at])
        is_open = (h1 == lead[0]) & (h2 == lead[1])
        out = ~is_open & (doc != first)
        group = (h1[-1], h2[-1], first[-1])
        yield rows(_DROPPED, h1[out], h2[out], doc[out], tag[out], pos[out])
        yield rows(_OPEN, h1[is_open], h2[is_open], doc[is_open], tag[is_open], pos[is_open])
    if lead is not None:
        ends = [np.array(x, np.int64) for x in zip(lead, group)]
        yield rows(_FIRST, *ends, np.zeros(2, np.int64), np.zeros(2, np.int32))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keeps, dropped = [], []
        for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone").to_pylist()):
            keep = np.ones(n, bool)
            keep[gone] = False
            keeps.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(len(gone))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("tag"), batch.column("n_lines"), pa.array(dropped, pa.int64()),
             pa.array(keeps, pa.binary())],
            ["doc", "tag", "n_lines", "n_dropped", "keep"],
        )


def keep_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """(doc, tag, n_lines, n_dropped, keep) per distinct row; see ``frames.row_key`` for doc and tag.

    ``keep`` is a zlib-compressed bitmap with one bit per line, first line first.  A
    common line has as many rows as occurrences, so the range includes document and
    position and cuts its rows over as many partitions as they need.  What the cut
    hides (whether the first key of a partition began before it) comes from two rows
    per partition, which are broadcast.
    """
    texts = docs.select(*row_key(id_col, text_col), named(text_col).alias("text"))
    lines = stage(texts.mapInArrow(_line_keys(min_chars), _KEYS), "lines")
    order = ["h1", "h2", "doc", "tag", "pos"]
    decided = stage(
        lines.filter("h1 IS NOT NULL")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_stream_firsts, "kind int, " + _KEYS),
        "line-decisions",
    )
    firsts = decided.filter(F.col("kind") == _FIRST).groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    resolved = (
        decided.filter(F.col("kind") == _OPEN)
        .join(F.broadcast(firsts), ["h1", "h2"])
        .filter("doc <> first")
        .select("doc", "tag", "pos")
    )
    dropped = decided.filter(F.col("kind") == _DROPPED).select("doc", "tag", "pos").union(resolved)
    n_lines = F.col("pos").cast("long").alias("n_lines")  # in the row that stands for the text
    facts = lines.filter("h1 IS NULL").select("doc", "tag", n_lines, F.lit(None).cast("int").alias("pos"))
    facts = facts.union(dropped.select("doc", "tag", F.lit(None).cast("long"), "pos"))
    return (
        facts.groupBy("doc", "tag")
        .agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
        .mapInArrow(_pack, "doc long, tag long, n_lines long, n_dropped long, keep binary")
    )


@F.pandas_udf(StringType())
def _kept_lines(texts: pd.Series, keeps: pd.Series) -> pd.Series:
    def kept(text: str, keep: bytes) -> str:
        lines = text.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
        return "\n".join(lines[i] for i in np.flatnonzero(bits).tolist())

    return pd.Series([kept(t, k) for t, k in zip(texts, keeps)], dtype=object)


def apply_keep(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_lines, n_dropped, kept): each row of ``docs`` as a struct, with the text its bitmap leaves."""
    rows = docs.select(packed(docs), *row_key(id_col, text_col))
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    cut = F.when(F.col("n_dropped") > 0, _kept_lines(text, F.col("keep"))).otherwise(text)
    return rows.join(bitmaps, ["doc", "tag"]).select("row", "n_lines", "n_dropped", cut.alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with shared lines removed from all but their first document; nulls stay null."""
    kept = apply_keep(docs, keep_bitmaps(docs, id_col, text_col, **options), id_col, text_col)
    text = F.when(F.col("row")[text_col].isNotNull(), F.col("kept")).alias(text_col)
    return kept.select(*[text if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
