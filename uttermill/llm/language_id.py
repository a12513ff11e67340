"""Language identification by prediction by partial matching.

Method: for each language a byte context tree of orders 0 to 3 gives the code length of
every byte of a text: the longest known context predicts the byte, or pays its escape
and leaves it to the context one byte shorter; below order 0 all bytes are alike.  An
escape has as much weight as the context has distinct successors.  Statistics come from
all training texts and are frozen, so the code length of a byte is a function of it
and the three bytes before it, which numpy looks up for a whole batch at once.

No gram is left out at any size.  Orders 0 and 1 are whole in every task.  Grams of
orders 2 and 3 fall into blocks by the two bytes before the predicted one; a block has
all that the costs of its grams need beyond orders 0 and 1.  Tasks know the blocks with
the most bytes per gram, up to ``MAX_CELLS`` grams times languages; if there are others,
the bytes of texts that fall into them meet their costs in a join.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is
every text if nothing can be learned.  Rows with a null language teach nothing.  Equal
code lengths go to the alphabetically first language.  A text's first byte follows three
blanks.  Every row has its own result, however often it repeats; an empty table gives an empty
one.  A text of any length is read whole, as a chunk by itself.  Other columns, whatever their
names, are ignored.  The distinct languages come to the driver: their number is assumed to be
that of a label set (hundreds), and each is a column of the tables in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .frames import crc_remainder, named
from .kernels import RowIndex, chunks, per_row

ORDER, MAX_CELLS = 3, 1 << 22
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


def _grams(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each byte with the three before it, as one number; the byte is lowest."""
    wide = data.astype(np.uint32)
    out = wide.copy()
    at = np.arange(len(data)) - np.repeat(bounds[:-1], np.diff(bounds))  # distance from the text's begin
    for back in range(1, ORDER + 1):
        before = np.full(len(data), 0x20, np.uint32)
        before[back:] = np.where(at[back:] >= back, wide[: len(data) - back], np.uint32(0x20))
        out |= before << np.uint32(8 * back)
    return out


def _folded(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").cast(pa.large_string()).dictionary_encode()
        code = langs.indices.to_numpy(zero_copy_only=False)
        parts = []
        for a, b, data, bounds in chunks(_folded(batch.column("text"))):
            lang = np.repeat(code[a:b].astype(np.uint64), np.diff(bounds))
            parts.append(np.unique(lang << np.uint64(32) | _grams(data, bounds), return_counts=True))
        if not parts:
            continue
        keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.int64)
        names = langs.dictionary.take(pa.array((keys >> np.uint64(32)).astype(np.int64))).cast(pa.string())
        gram = pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([names, gram, pa.array(n)], ["lang", "gram", "n"])


@dataclass
class ContextTrees:
    """Code lengths in bits, a column per language.

    ``seen[k]``/``cost[k]``: grams of order k that some language knows, and their cost
    in each, escapes included.  ``contexts[k]``/``escape[k]``: contexts of order k that
    some language knows, and what leaving them costs.  ``away``: whether the grams of a
    block are not here but in ``rest`` (block, lang, gram, n), which tasks do not get.
    """

    languages: list[str]
    seen: dict[int, RowIndex]
    cost: dict[int, np.ndarray]
    contexts: dict[int, RowIndex]
    escape: dict[int, np.ndarray]
    away: np.ndarray = field(default_factory=lambda: np.zeros(1 << 16, bool))
    rest: DataFrame | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rest": None}

    def bits(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """(gram, language) code lengths."""
        if order < 0:
            return np.full((len(grams), len(self.languages)), 8.0, np.float32)
        own = grams & np.int64((1 << 8 * (order + 1)) - 1)
        row = self.seen[order](own)
        out = self.cost[order][row]
        rest = np.flatnonzero(row < 0)
        if len(rest):
            context = self.contexts[order](own[rest] >> 8)
            out[rest] = self.escape[order][context] + self.bits(own[rest], order - 1)
        return out


def build_trees(
    counts: dict[int, dict[str, tuple[np.ndarray, np.ndarray]]], languages: list[str], lower: ContextTrees | None = None
) -> ContextTrees:
    """Trees from (grams, counts) by order and language, on top of the orders of ``lower``."""
    trees = ContextTrees(languages, {}, {}, {}, {})
    if lower:
        trees = ContextTrees(languages, dict(lower.seen), dict(lower.cost), dict(lower.contexts), dict(lower.escape))
    for order in sorted(counts):
        grams = np.unique(np.concatenate([counts[order][x][0] for x in languages]))
        contexts = np.unique(grams >> 8)
        # one more row of zeros, which -1 selects: an unknown context costs nothing to leave
        escape = np.zeros((len(contexts) + 1, len(languages)), np.float32)
        own = np.zeros((len(grams), len(languages)))
        for j, x in enumerate(languages):
            g, n = counts[order][x]
            at = np.searchsorted(contexts, g >> 8)
            total = np.bincount(at, weights=n, minlength=len(contexts))
            kinds = np.bincount(at, minlength=len(contexts))
            known = kinds > 0
            escape[:-1, j][known] = -np.log2(kinds[known] / (total[known] + kinds[known]))
            own[np.searchsorted(grams, g), j] = n / (total[at] + kinds[at])
        trees.contexts[order], trees.escape[order] = RowIndex(contexts), escape
        lower = trees.bits(grams, order - 1) + escape[np.searchsorted(contexts, grams >> 8)]
        cost = np.where(own > 0, -np.log2(np.where(own > 0, own, 1)), lower).astype(np.float32)
        trees.seen[order] = RowIndex(grams)
        trees.cost[order] = np.concatenate([cost, np.zeros((1, len(languages)), np.float32)])
    return trees


def _by_order(found: pd.DataFrame, orders: list[int], languages: list[str]) -> dict:
    """(grams, counts) by order and language of rows (lang, gram, n), lang being a number."""
    counts = {}
    for order in orders:
        own = found.assign(gram=found["gram"] & ((1 << 8 * (order + 1)) - 1)).groupby(["lang", "gram"], as_index=False)["n"].sum()
        counts[order] = {
            x: tuple(own.loc[own["lang"] == j, c].to_numpy(np.int64) for c in ("gram", "n")) for j, x in enumerate(languages)
        }
    return counts


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_cells: int = MAX_CELLS
) -> ContextTrees | None:
    """Trees from all rows outside the held-out fold with text and language; None if there are none."""
    rows = docs.filter(crc_remainder(id_col, FOLDS) != HELD_OUT).select(
        named(text_col).alias("text"), named(lang_col).cast("string").alias("lang")
    )
    parts = rows.dropna().mapInArrow(_count_task, "lang string, gram long, n long")
    full = stage(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    languages = sorted(r.lang for r in full.select("lang").distinct().collect())
    if not languages:
        return None
    number = (F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1).cast("int").alias("lang")
    block = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).alias("block")
    full = full.select(block, number, "gram", "n")
    low = full.groupBy("lang", F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("gram")).agg(F.sum("n").alias("n"))
    lower = build_trees(_by_order(low.toPandas(), [0, 1], languages), languages)  # at most 2**16 rows per language
    sizes = full.groupBy("block").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("grams")).toPandas()  # at most 2**16
    sizes = sizes.assign(dense=sizes["n"] / sizes["grams"]).sort_values(["dense", "block"], ascending=[False, True])
    here = (sizes["grams"].cumsum() * len(languages) <= max_cells).to_numpy()
    away = np.zeros(1 << 16, bool)
    away[sizes["block"].to_numpy()[~here]] = True
    known = docs.sparkSession.createDataFrame(sizes.assign(here=here)[["block", "here"]], "block long, here boolean")
    full = full.join(F.broadcast(known), "block")
    own = full.filter("here").select("lang", "gram", "n").toPandas()  # at most max_cells rows
    trees = build_trees(_by_order(own, [2, 3], languages), languages, lower)
    trees.away, trees.rest = away, full.filter("NOT here").drop("here") if away.any() else None
    return trees


def _decided(trees: ContextTrees, total: np.ndarray, known: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of texts with the code lengths ``total``, of which the ``known`` have a letter."""
    best = total.argmin(axis=1)
    share = 1 / np.exp2(-(total - total.min(axis=1, keepdims=True))).sum(axis=1)
    names = [trees.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist())]
    return names, np.where(known, share, 0.0)


def _letters(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.stack([per_row(values[:, j], bounds) for j in range(values.shape[1])], axis=1)


def _with_rest(rows: DataFrame, trees: ContextTrees) -> DataFrame:
    """(id, lang_pred, score) of ``rows`` (id, text), costs of grams that are not in ``trees`` joined from their rest."""
    width = len(trees.languages)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "id", "known", "gram", "times", *(f"c{j}" for j in range(width))]
        for batch in batches:
            row, ids, letters = batch.column("row").to_numpy(), batch.column("id"), _letters(batch.column("text"))
            for a, b, data, bounds in chunks(_folded(batch.column("text"))):
                grams = _grams(data, bounds).astype(np.int64)
                away = trees.away[grams >> 8 & 0xFFFF]
                cost = trees.bits(grams)
                cost[away] = 0
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[a:b]), ids[a:b], pa.array(letters[a:b]), none, none, *map(pa.array, _sums(cost, bounds).T.copy())], names
                )
                at = np.repeat(np.arange(b - a, dtype=np.int64), np.diff(bounds))[away]
                key, times = np.unique(at << 32 | grams[away], return_counts=True)
                empty = [pa.nulls(len(key), t) for t in (pa.int64(), pa.bool_(), *[pa.float64()] * width)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[a:b][key >> 32]), *empty[:2], pa.array(key & 0xFFFFFFFF), pa.array(times.astype(np.int64)), *empty[2:]], names
                )

    def price(learned: pa.Table, asked: pa.Table) -> pa.Table:
        """Costs of the asked grams of one block."""
        block = build_trees(_by_order(learned.to_pandas(), [2, 3], trees.languages), trees.languages, trees)
        grams = asked.column("gram").to_numpy()
        cost = block.bits(grams).astype(np.float64)
        return pa.table([pa.array(grams), *map(pa.array, cost.T.copy())], names=["gram", *(f"c{j}" for j in range(width))])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.stack([batch.column(f"c{j}").to_numpy() for j in range(width)], axis=1)
            names, score = _decided(trees, total, batch.column("known").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    costs = [f"c{j}" for j in range(width)]
    typed = ", ".join(f"{c} double" for c in costs)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    parts = stage(rows.mapInArrow(split, f"row long, id long, known boolean, gram long, times long, {typed}"), "language-parts")
    asked = parts.filter("gram IS NOT NULL").select("row", "gram", "times")
    block = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)).alias("block")
    distinct = asked.select("gram").distinct().select(block, "gram")
    priced = trees.rest.groupBy("block").cogroup(distinct.groupBy("block")).applyInArrow(price, f"gram long, {typed}")
    more = asked.join(stage(priced, "language-costs"), "gram").groupBy("row").agg(*[F.sum(F.col("times") * F.col(c)).alias(f"m{c}") for c in costs])
    whole = parts.filter("gram IS NULL").join(more, "row", "left")
    whole = whole.select("id", "known", *[(F.col(c) + F.coalesce(f"m{c}", F.lit(0.0))).alias(c) for c in costs])
    return whole.mapInArrow(decide, "id long, lang_pred string, score double")


def predict(
    docs: DataFrame, trees: ContextTrees | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, held_out, lang_pred, score) per row; the score is the language's share of the texts' probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            letters = _letters(texts)
            names, scores = [], []
            for a, b, data, bounds in chunks(_folded(texts) if trees else texts):
                if trees is None:
                    names += [UNKNOWN] * (b - a)
                    scores.append(np.zeros(b - a))
                    continue
                total = _sums(trees.bits(_grams(data, bounds).astype(np.int64)), bounds)
                found, share = _decided(trees, total, letters[a:b])
                names += found
                scores.append(share)
            score = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), score], ["id", "lang_pred", "score"])

    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    if trees is not None and trees.rest is not None:
        found = _with_rest(rows, trees)
    else:
        found = rows.mapInArrow(run, "id long, lang_pred string, score double")
    return found.select(
        F.col("id").alias(id_col), (crc_remainder("id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score"
    )
