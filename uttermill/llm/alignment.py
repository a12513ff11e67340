"""Alignment of the tokens that two tokenizers make of one text.

Method: both token sequences of a text are given by the byte offsets where tokens end, two
ascending lists whose merge is a path through the grid of A and B tokens.  Diagonals at equal
distances cut the path into pieces of equal work; where the path crosses a diagonal is found by
binary search alone, for all diagonals of a chunk of texts at once.  Each piece is worked out
by itself: an end of either side links the token that ends there with the other side's token
that covers it, and an end of both sides closes a group.  Where one end of such a pair lies in
one piece and the other in the next, the two pieces are stitched: the group closes there, and
the link that both would report is reported once.

Token bytes tile the text, so the stretches between neighbouring ends are the overlaps of all
token pairs, each once.  Counts of linked id pairs over all texts need every text; the links of
a text are therefore staged as distinct id pairs with multiplicities, counted, and met with
the counts in a second pass.  Tasks know the ``max_pairs`` most frequent pairs (two sorted arrays
of that size at most); all others, each of which is in at most 1 / ``max_pairs`` of all
(text, pair) rows, meet their counts in a join.  The result is the same for every bound.

Defined cases: a text that is null or empty, or for which the bytes of the A or B tokens,
joined, are not those of a blank and the text, has no tokens: zeros and an empty string.
Strings of special tokens inside a text are plain text.  Rows that repeat an id or a text are
texts of their own.  Pairs of equal count are both best.  An empty table gives an empty result.
Other columns, whatever their names, are not read.  A text and its tokens must fit into
a task; shorter texts are handled in chunks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from ..plans.staging import stage
from .frames import batches_of, named, packed, with_fields
from .kernels import byte_alphabet, chunks

CHUNK = 1 << 18  # bytes of text that are handled at once
PIECE = 1 << 13  # steps of the merge path in a piece
MAX_PAIRS = 1 << 21
FLUSH = 1 << 21  # id pairs that a task holds for counting
ROWS = 1 << 9  # texts whose pairs are handled at once
BLANK = "▁"


# fixed value: how a byte-level vocabulary cuts a text before merging
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass
class Tokenizers:
    """What both tokenizers need, and the bytes of their entries, as plain values that tasks can receive."""

    a_bytes: list[bytes]  # by id, which is the rank of the entry's merge
    b_model: bytes
    b_bytes: list[bytes]

    @classmethod
    def load(cls, a_file: str, b_file: str) -> Tokenizers:
        """A byte-level vocabulary (A) and a piece model that puts a blank first (B)."""
        import sentencepiece

        with open(a_file, encoding="utf-8") as f:
            whole = json.load(f)
        with open(b_file, "rb") as f:
            b_model = f.read()
        model, cut = whole["model"], whole["pre_tokenizer"]
        if model["type"] != "BPE" or whole["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError("A must be a plain byte-level vocabulary of merges")
        joined = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
        order = [model["vocab"][t] for t in joined]
        if order != sorted(order) or set(model["vocab"].values()) != set(range(len(model["vocab"]))):
            raise ValueError("the ids of A must have no gaps and follow the ranks of its merges")
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        a_bytes = [bytes(byte_of[c] for c in t) for t in sorted(model["vocab"], key=model["vocab"].get)]
        m = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        b_bytes = [bytes([int(p[1:-1], 16)]) if m.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        return cls(a_bytes, b_model, b_bytes)

    def encoders(self):
        """Functions from a text to its ids in A, with the blank before it, and in B."""
        import sentencepiece
        import tiktoken

        a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={t: i for i, t in enumerate(self.a_bytes)}, special_tokens={})
        b = sentencepiece.SentencePieceProcessor(model_proto=self.b_model)
        return lambda text: a.encode_ordinary(" " + text), b.encode


def cut_path(a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and B ends before each diagonal: 0, step, 2 * step, ... and the last one.

    In the merge of both lists an A end comes before an equal B end.
    """
    d = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low, d - low
        mid = (low[open_] + high[open_]) >> 1
        first = a[mid] <= b[d[open_] - 1 - mid]
        low[open_[first]] = mid[first] + 1
        high[open_[~first]] = mid[~first]


def piece_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the ends in one piece: A end's B token, B end's A token, and whether the ends are in both.

    Tokens are counted from the piece's first; one beyond the piece is the next piece's first.
    """
    of_a, of_b = np.searchsorted(b, a), np.searchsorted(a, b)
    both_a = b[np.minimum(of_a, len(b) - 1)] == a if len(b) else np.zeros(len(a), bool)
    both_b = a[np.minimum(of_b, len(a) - 1)] == b if len(a) else np.zeros(len(b), bool)
    return of_a, of_b, both_a, both_b


def align_ends(a: np.ndarray, b: np.ndarray, step: int = PIECE) -> tuple[np.ndarray, ...]:
    """(A token, B token) of every overlap, and for each A and B token whether a group ends with it."""
    i, j = cut_path(a, b, step)
    of_a, of_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
    both_a, both_b = np.empty(len(a), bool), np.empty(len(b), bool)
    for i0, i1, j0, j1 in zip(i.tolist(), i[1:].tolist(), j.tolist(), j[1:].tolist()):
        own_a, own_b, both_a[i0:i1], both_b[j0:j1] = piece_links(a[i0:i1], b[j0:j1])
        of_a[i0:i1], of_b[j0:j1] = own_a + j0, own_b + i0
    inner = np.flatnonzero((i > 0) & (j < len(b)))  # stitch: an A end and the equal B end in neighbouring pieces
    inner = inner[a[i[inner] - 1] == b[j[inner]]]
    both_a[i[inner] - 1] = True
    both_b[j[inner]] = True
    alone = np.flatnonzero(~both_b)  # an end of both sides is reported by its A token
    left = np.concatenate([np.arange(len(a)), of_b[alone]])
    right = np.concatenate([of_a, alone])
    return left, right, both_a, both_b


class Aligner:
    """Aligns the texts of a task."""

    def __init__(self, sides: Tokenizers, step: int = PIECE):
        self.sides, self.step = sides, step
        self.encode_a, self.encode_b = sides.encoders()
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (sides.a_bytes, sides.b_bytes))
        signs = lambda n, sep: np.array([f"{k}{sep}" for k in range(n)], object)
        self.a_signs = signs(len(sides.a_bytes), ","), signs(len(sides.a_bytes), "|")
        self.b_signs = signs(len(sides.b_bytes), ","), signs(len(sides.b_bytes), ";")

    def _tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B; none for texts that their bytes do not give back."""
        a, b = list(map(self.encode_a, texts)), list(map(self.encode_b, texts))
        a_of, b_of = self.sides.a_bytes.__getitem__, self.sides.b_bytes.__getitem__
        for k, text in enumerate(texts):
            want = b" " + text.encode()
            if not text or b"".join(map(a_of, a[k])) != want or b"".join(map(b_of, b[k])) != want:
                a[k], b[k] = [], []
        return a, b

    def align(self, texts: list[str]) -> dict[str, list | np.ndarray]:
        """Per text: counts, groups as a string, and its distinct linked id pairs with their numbers of links."""
        n = len(texts)
        a, b = self._tokens(texts)
        n_a, n_b = (np.array([len(x) for x in t], np.int64) for t in (a, b))
        ids_a, ids_b = (np.array([i for x in t for i in x], np.int64) for t in (a, b))
        del a, b
        left, right, both_a, both_b = align_ends(np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b]), self.step)
        doc_a, doc_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        # a group's A tokens, then its B tokens: each side's tokens move behind the other's groups before theirs
        group_a, group_b = (np.cumsum(x) - x for x in (both_a, both_b))
        before_b = np.concatenate([[0], np.flatnonzero(both_b) + 1])  # B tokens in the groups before each
        upto_a = np.append(np.flatnonzero(both_a) + 1, len(ids_a))  # A tokens up to the end of each
        signs = np.empty(len(ids_a) + len(ids_b), object)
        signs[np.arange(len(ids_a)) + before_b[group_a]] = np.where(both_a, self.a_signs[1][ids_a], self.a_signs[0][ids_a])
        signs[np.arange(len(ids_b)) + upto_a[group_b]] = np.where(both_b, self.b_signs[1][ids_b], self.b_signs[0][ids_b])
        ends = np.cumsum(n_a + n_b).tolist()
        groups = ["".join(signs[s:e].tolist())[:-1] for s, e in zip([0, *ends], ends)]
        doc = doc_a[left]
        width = len(self.b_size)
        pairs, times = np.unique((doc * len(self.a_size) + ids_a[left]) * width + ids_b[right], return_counts=True)
        per_doc = len(self.a_size) * width
        counted = np.bincount(pairs // per_doc, minlength=n)
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc_a[both_a], minlength=n),
            "n_links": np.bincount(doc, minlength=n), "groups": groups,
            "sizes": counted, "pairs": pairs % per_doc, "times": times,
        }


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
PAIRS = ("pairs", "times")


def align(docs: DataFrame, sides: Tokenizers, text_col: str = "text", carry: list[str] | None = None, step: int = PIECE) -> DataFrame:
    """(row, n_a, n_b, n_groups, n_links, groups, pairs, times) per row.

    ``row`` holds the columns ``carry`` (default: all); the two lists are the distinct id
    pairs that the text links, as ``A id * entries of B + B id``, and how often it does.
    """
    keep = docs.columns if carry is None else carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(sides, step)
        for batch in batches:
            for a, b, data, bounds in chunks(batch.column("text"), CHUNK):
                raw, edges = data.tobytes(), bounds.tolist()
                found = aligner.align([raw[s:e].decode() for s, e in zip(edges, edges[1:])])
                offsets = pa.array(np.concatenate([[0], np.cumsum(found["sizes"])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(found[c], t)) for c, t in zip(PAIRS, (pa.int64(), pa.int32()))]
                counts = [pa.array(found[c], pa.int64()) for c in COUNTS]
                columns = [batch.column("row").slice(a, b - a), *counts, pa.array(found["groups"], pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["row", *COUNTS, "groups", *PAIRS])

    rows = docs.select(packed(docs.select(*[named(c) for c in keep])), named(text_col).alias("text"))
    fields = {c: LongType() for c in COUNTS} | {"groups": StringType(), "pairs": ArrayType(LongType()), "times": ArrayType(IntegerType())}
    return rows.mapInArrow(run, with_fields(rows, ["row"], **fields))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of fewer rows; row in the batch, pair and multiplicity of every stored pair."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            pairs, times = (part.column(c) for c in PAIRS)
            row = np.repeat(np.arange(part.num_rows), np.diff(pairs.offsets.to_numpy()))
            yield part, row, pairs.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n) of the rows of a task; what it holds is bounded by ``FLUSH`` pairs."""
    keys, sums, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["pair", "n"])

    def fold() -> tuple[np.ndarray, np.ndarray]:
        fresh, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        both, total = np.concatenate([keys, fresh]), np.concatenate([sums, n])
        order = np.argsort(both, kind="stable")
        both, total = both[order], total[order]
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
        return both[first], np.add.reduceat(total, first) if len(first) else total

    for _, _, pairs, _ in _parts(batches):
        held.append(pairs)
        size += len(pairs)
        if size >= FLUSH // 2:
            (keys, sums), size = fold(), 0
            if len(keys) >= FLUSH // 2:
                yield out()
                keys, sums = keys[:0], sums[:0]
    if held:
        keys, sums = fold()
    yield out()


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): in how many rows each linked id pair is, and whether that is the most of its A id."""
    parts = aligned.select(*PAIRS).mapInArrow(_counted, "pair long, n long")
    counts = stage(parts.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    a = F.expr(f"pair div {width}").alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))  # one row per entry of A's vocabulary at most
    best = (F.col("n") == F.col("most")).alias("best")
    return counts.select("pair", "n", a).join(F.broadcast(most), "a").select("pair", "n", best)


def _sums(n: Column, best: Column, times: Column) -> list[Column]:
    found = {"n_best": F.when(best, times).otherwise(F.lit(0)), "count_sum": times * n}
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name) for name, c in found.items()]


def link_report(
    docs: DataFrame, sides: Tokenizers, id_col: str = "doc_id", text_col: str = "text", max_pairs: int = MAX_PAIRS
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of ``docs``."""
    spark = docs.sparkSession
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise(F.lit("")).alias("groups_sha256")
    number = F.monotonically_increasing_id().alias("at")  # staged, hence fixed
    kept = ["at", "id", *COUNTS, "groups_sha256"]
    with batches_of(spark, ROWS):  # a row holds all pairs of a text
        found = align(docs, sides, text_col, [id_col]).select(number, F.col("row").getField(id_col).alias("id"), *COUNTS, digest, *PAIRS)
        found = stage(found, "aligned")
        counts = stage(pair_counts(found, len(sides.b_bytes)), "pair-counts-best")
    here = counts.orderBy(F.desc("n"), "pair").limit(max_pairs).toPandas().sort_values("pair")  # bounded by the parameter
    known = here["pair"].to_numpy(np.int64), here["n"].to_numpy(np.int64), here["best"].to_numpy(bool)
    shared = spark.sparkContext.broadcast(known)

    def look_up(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are known, and where those are."""
        keys = shared.value[0]
        if not len(keys):
            return np.zeros(len(pairs), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        hit = keys[at] == pairs
        return hit, at[hit]

    def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = shared.value
        for part, row, pairs, times in _parts(batches):
            hit, at = look_up(pairs)
            sums = np.zeros((2, part.num_rows), np.int64)
            np.add.at(sums[0], row[hit], times[hit] * best[at])
            np.add.at(sums[1], row[hit], times[hit] * n[at])
            columns = [*(part.column(c) for c in kept), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, pairs, times in _parts(batches):
            left = ~look_up(pairs)[0]
            columns = [pa.array(part.column("at").to_numpy()[row[left]]), pa.array(pairs[left]), pa.array(times[left])]
            yield pa.RecordBatch.from_arrays(columns, ["at", "pair", "times"])

    with batches_of(spark, ROWS):
        out = found.mapInArrow(priced, with_fields(found, kept, n_best=LongType(), count_sum=LongType()))
        out = stage(out, "priced")
        if counts.count() > len(here):
            rest = stage(found.select("at", *PAIRS).mapInArrow(others, "at long, pair long, times long"), "other-pairs")
            more = rest.join(counts, "pair").groupBy("at").agg(*_sums(F.col("n"), F.col("best"), F.col("times")))
            more = more.select("at", F.col("n_best").alias("_best"), F.col("count_sum").alias("_sum"))
            plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
            out = out.join(more, "at", "left").select(*kept, plus("n_best", "_best"), plus("count_sum", "_sum"))
    return out.select(F.col("id").alias(id_col), *COUNTS, "n_best", "count_sum", "groups_sha256")
