"""TF-IDF features over word 1- and 2-grams."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StructField, StructType

from ..functions import text as tx
from ..functions.rows import divide_all, explode_rows, inline_rows
from ..plans.staging import stage

MAX_FEATURES = 5_000


def with_ngrams(df: DataFrame, text_col: str = "clean_text", out: str = "ngrams") -> DataFrame:
    """Array of word 1-grams and 2-grams; words are extracted once per row."""
    return (
        df.withColumn("_words", tx.words(text_col))
        .withColumn(out, F.concat(F.col("_words"), tx.bigrams(F.col("_words"))))
        .drop("_words")
    )


def _runs(sorted_terms: Column) -> Column:
    """Array of struct(term, tf) from a sorted array of terms."""
    n = F.size(sorted_terms)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: ~F.get(sorted_terms, i).eqNullSafe(F.get(sorted_terms, i - 1)))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(n))
    return F.zip_with(
        F.slice(ends, F.lit(1), F.size(starts)),
        starts,
        lambda end, start: F.struct(F.get(sorted_terms, start).alias("term"), (end - start).cast("bigint").alias("tf")),
    )


def term_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "clean_text") -> DataFrame:
    """Count of every n-gram in every document.

    A row's n-grams are sorted and counted inside the row; nothing is shuffled.  Ids are counted
    first, by themselves: only the counts of rows whose id others have too are added up.
    """
    repeated = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    repeated = stage(repeated.select(F.col(id_col).alias("_id")), "repeated-ids")

    def counted(rows: DataFrame) -> DataFrame:
        grams = with_ngrams(rows, text_col).withColumn("_sorted", F.sort_array("ngrams"))
        return inline_rows(grams.withColumn("_terms", _runs(F.col("_sorted"))), [id_col], "_terms", "term")

    rows = df.select(id_col, text_col)
    if repeated.isEmpty():
        return counted(rows)
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    added = counted(rows.join(repeated, same, "left_semi")).groupBy(id_col, "term").agg(F.sum("tf").alias("tf"))
    return counted(rows.join(repeated, same, "left_anti")).unionByName(added)


def _top(counts: DataFrame, max_features: int) -> DataFrame:
    return counts.orderBy(F.desc("corpus_tf"), "term").limit(max_features)


def _count(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("corpus_tf"))


def stage_words(df: DataFrame, keep: list[str], text_col: str = "clean_text") -> DataFrame:
    """Words of every text, joined by spaces and staged: they are cut out once."""
    return stage(df.select(*keep, F.array_join(tx.words(text_col), " ").alias("words")), "words")


def _with_arrays(df: DataFrame, keep: list[str], **arrays: DataType) -> StructType:
    return StructType([df.schema[c] for c in keep] + [StructField(n, ArrayType(t)) for n, t in arrays.items()])


SLICE = 1 << 20  # words of the rows that are taken at once, at ``WORD`` bytes each where not yet cut apart
WORD = 8


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of which ``column`` holds about ``SLICE`` words, one row at least."""
    for batch in batches:
        values = batch.column(column)
        sizes = pc.divide(pc.binary_length(values), WORD) if column == "words" else pc.list_value_length(values)
        ends, begin = np.cumsum(sizes.to_numpy().astype(np.int64)), 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + SLICE, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _word_counts(words: DataFrame) -> DataFrame:
    """Occurrences of each word, added up in batches first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "words"):
            found = pc.value_counts(pc.split_pattern(batch.column("words"), " ").flatten())
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["term", "n"])

    found = words.select("words").mapInArrow(count, "term string, n bigint").filter("term <> ''")  # a row without words
    return found.groupBy("term").agg(F.sum("n").alias("corpus_tf"))


def _pair_keys(numbers: pa.ListArray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and number of every word of a batch; row and ``first * n_words + second`` of adjacent numbered ones."""
    row = np.repeat(np.arange(len(numbers)), np.diff(numbers.offsets.to_numpy()))
    word = numbers.flatten().to_numpy().astype(np.int64)
    pair = (row[:-1] == row[1:]) & (word[:-1] >= 0) & (word[1:] >= 0)
    return row, word, row[:-1][pair], word[:-1][pair] * n_words + word[1:][pair]


@dataclass
class Numbered:
    """Rows with ``numbers``, the place of each of their words in ``words``; -1 for any other word.

    ``singles`` are the most frequent words with their counts; ``words`` has every word of every term
    that can be among the ``max_features`` most frequent ones, which no term below ``bound`` is.
    """

    rows: DataFrame
    words: list[str]
    singles: DataFrame
    max_features: int
    bound: int

    def vocabulary(self, fit: str = "true") -> DataFrame:
        """The most frequent words and 2-grams of the rows that ``fit`` holds for, ties by term."""
        n_words = len(self.words)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches, "numbers"):
                keys, n = np.unique(_pair_keys(batch.column("numbers"), n_words)[3], return_counts=True)
                yield pa.RecordBatch.from_pydict({"pair": pa.array(keys, pa.int64()), "n": pa.array(n, pa.int64())})

        pairs = self.rows.filter(fit).select("numbers").mapInArrow(count, "pair bigint, n bigint")
        pairs = pairs.groupBy("pair").agg(F.sum("n").alias("corpus_tf")).filter(F.col("corpus_tf") >= self.bound)
        terms = F.from_json(F.lit(json.dumps(self.words)), "array<string>")
        size = F.lit(max(n_words, 1)).cast("bigint")
        side = lambda i: F.element_at(terms, (i + 1).cast("int"))
        doubles = pairs.select(
            F.concat(side(F.floor(F.col("pair") / size)), F.lit(" "), side(F.col("pair") % size)).alias("term"), "corpus_tf"
        )
        return _top(self.singles.unionByName(doubles), self.max_features)

    def counts(self, vocab: list[str], keep: list[str]) -> DataFrame:
        """Staged ``indices`` and ``counts`` of the terms of ``vocab``, made of numbered words, in every row."""
        n_words, n_terms = len(self.words), max(1, len(vocab))
        number = {w: i for i, w in enumerate(self.words)}
        single, pair_of = np.full(n_words + 1, -1), {}  # the last is for words without a number
        for i, term in enumerate(vocab):
            parts = [number[w] for w in term.split(" ")]
            if len(parts) == 1:
                single[parts[0]] = i
            else:
                pair_of[parts[0] * n_words + parts[1]] = i
        pairs = np.array([*sorted(pair_of), np.iinfo(np.int64).max])
        index = np.array([*(pair_of[k] for k in sorted(pair_of)), -1])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches, "numbers"):
                row, word, pair_row, key = _pair_keys(batch.column("numbers"), n_words)
                at = np.searchsorted(pairs, key)
                term = np.concatenate([single[word], np.where(pairs[at] == key, index[at], -1)])
                row = np.concatenate([row, pair_row])
                found, n = np.unique((row * n_terms + term)[term >= 0], return_counts=True)
                ends = pa.array(np.searchsorted(found, np.arange(batch.num_rows + 1) * n_terms), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in keep),
                        pa.ListArray.from_arrays(ends, pa.array(found % n_terms, pa.int32())),
                        pa.ListArray.from_arrays(ends, pa.array(n.astype(np.float64))),
                    ],
                    [*keep, "indices", "counts"],
                )

        schema = _with_arrays(self.rows, keep, indices=IntegerType(), counts=DoubleType())
        return stage(self.rows.select(*keep, "numbers").mapInArrow(run, schema), "term-counts")


NUMBERED = 4  # words that get a number whatever the ties, in multiples of the vocabulary's size


def number_words(
    words: DataFrame, keep: list[str], max_features: int = MAX_FEATURES, fit: str = "true", numbered: int = NUMBERED
) -> Numbered:
    """Number the words of staged rows that can be part of a frequent term of the rows that ``fit`` holds for.

    Nearly all distinct 2-grams are rare and would only swell the shuffle, so words are
    counted first.  A 2-gram is at most as frequent as its words, and the k-th most
    frequent word bounds the result from below; hence only words that reach this bound
    can be in it.  Any number of words may tie at the bound.  Such words come after the k
    most frequent ones, so they are no first word of a 2-gram in the result (it would come
    after those words too); those without a place among the numbered ones are found as
    second words of 2-grams that are as frequent as the bound.
    """
    learned = words.filter(fit)
    singles = stage(_word_counts(learned), "word-counts")
    top = stage(_top(singles, max_features), "top-words")
    size, bound = top.agg(F.count(F.lit(1)), F.min("corpus_tf")).first()
    bound = bound if size == max_features else 0
    frequent = stage(singles.filter(F.col("corpus_tf") >= bound), "frequent-words")
    known = [r["term"] for r in _top(frequent, numbered * max_features).collect()]
    if frequent.count() > len(known):
        kept = frequent.sparkSession.createDataFrame([(w,) for w in known], "second string")
        rest = frequent.select(F.col("term").alias("second")).join(kept, "second", "left_anti")
        pairs = inline_rows(learned.select(tx.adjacent(F.split("words", " ")).alias("_pairs")), [], "_pairs", "first")
        pairs = pairs.join(top.select(F.col("term").alias("first")), "first", "left_semi")
        pairs = pairs.join(stage(rest, "other-words"), "second", "left_semi")
        ties = pairs.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= bound)
        ties = ties.orderBy(F.concat("first", F.lit(" "), "second")).limit(max_features)
        known += sorted({r["second"] for r in ties.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words = pa.array(known, pa.string())
        for batch in _slices(batches, "words"):
            lists = pc.split_pattern(batch.column("words"), " ")
            number = pa.ListArray.from_arrays(lists.offsets, pc.fill_null(pc.index_in(lists.flatten(), value_set=known_words), -1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), number], [*keep, "numbers"])

    rows = words.select(*keep, "words").mapInArrow(run, _with_arrays(words, keep, numbers=IntegerType()))
    return Numbered(stage(rows, "word-numbers"), known, top, max_features, bound)


def vocabulary(df: DataFrame, max_features: int = MAX_FEATURES, text_col: str = "clean_text") -> DataFrame:
    """The ``max_features`` most frequent n-grams of the corpus, ties by term."""
    return number_words(stage_words(df, [], text_col), [], max_features).vocabulary()


def ngram_vocabulary(
    df: DataFrame, sizes: tuple[int, int] = (1, 2), max_features: int = MAX_FEATURES, text_col: str = "clean_text"
) -> DataFrame:
    """The ``max_features`` most frequent runs of ``sizes[0]`` to ``sizes[1]`` words, ties by term.

    Runs are counted size by size.  A run is at most as frequent as its two runs of one
    word less, so from the second size on only runs are counted of which both parts reach
    the count of the ``max_features``-th most frequent term so far; no run that could
    belong to the result is left out.  A run is not counted if none of its size can reach it.
    """
    least, most = sizes
    if not 1 <= least <= most:
        raise ValueError("sizes must be 1 or more, the smaller first")
    words = df.select(tx.words(text_col).alias("_words"))
    n = F.size("_words")
    run = lambda i, k: F.array_join(F.slice("_words", i, F.lit(k)), " ")

    def whole(k: int):
        return lambda i: run(i, k)

    def halves(k: int):
        return lambda i: F.struct(
            run(i, k - 1).alias("head"), run(i + 1, k - 1).alias("tail"), F.element_at("_words", i + (k - 1)).alias("last")
        )

    found, parts = None, None
    for k in range(least, most + 1):
        places = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        if k == 1:
            rows = explode_rows(words, [], "_words", "term")
        elif parts is None:
            rows = explode_rows(words.select(F.transform(places, whole(k)).alias("_r")), [], "_r", "term")
        else:
            rows = inline_rows(words.select(F.transform(places, halves(k)).alias("_r")), [], "_r", "head")
            for side in ("head", "tail"):
                rows = rows.join(parts.withColumnRenamed("term", side), side, "left_semi")
            rows = rows.select(F.concat("head", F.lit(" "), "last").alias("term"))
        counts = stage(_count(rows), "run-counts")
        found = counts if found is None else found.unionByName(counts)
        top = stage(_top(found, max_features), "top-runs")
        size, bound = top.agg(F.count(F.lit(1)), F.min("corpus_tf")).first()
        bound = bound if size == max_features else 1
        parts = stage(counts.filter(F.col("corpus_tf") >= bound).select("term"), "frequent-runs")
        found = top
    return found


def literal_doubles(values) -> Column:
    """A constant array of doubles."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<double>")


def fit_vocabulary(df: DataFrame, max_features: int = MAX_FEATURES, text_col: str = "clean_text") -> list[str]:
    """Vocabulary terms, most frequent first; at most ``max_features`` strings."""
    return _terms(vocabulary(df, max_features, text_col))


def _terms(found: DataFrame) -> list[str]:
    vocab = [r["term"] for r in found.collect()]
    if not vocab:
        raise ValueError("empty vocabulary: the training texts hold no words")
    return vocab


def fit_counts(
    df: DataFrame, keep: list[str], max_features: int = MAX_FEATURES, text_col: str = "clean_text", fit: str = "true"
) -> tuple[list[str], DataFrame]:
    """Vocabulary of the rows that ``fit`` holds for, and staged counts of its terms in all rows.

    The texts are read once, for their words; what follows reads words and their numbers.
    """
    numbered = number_words(stage_words(df, keep, text_col), keep, max_features, fit)
    vocab = _terms(numbered.vocabulary(fit))
    return vocab, numbered.counts(vocab, keep)


def with_counts(df: DataFrame, vocab: list[str], text_col: str = "clean_text") -> DataFrame:
    """Add ``indices`` and ``counts`` of the vocabulary terms; row by row, no shuffle."""
    counter = CountVectorizerModel.from_vocabulary(vocab, inputCol="_ngrams", outputCol="_tf")
    counted = counter.transform(with_ngrams(df, text_col, "_ngrams")).drop("_ngrams")
    counted = counted.withColumn("_tf", F.unwrap_udt("_tf"))
    return counted.withColumns({"indices": F.col("_tf.indices"), "counts": F.col("_tf.values")}).drop("_tf")


def stage_counts(df: DataFrame, vocab: list[str], keep: list[str], text_col: str = "clean_text") -> DataFrame:
    """Term counts of all rows, staged: fits and predictions then leave the texts alone."""
    return stage(with_counts(df.select(*keep, text_col), vocab, text_col).drop(text_col), "term-counts")


@dataclass
class TfidfModel:
    """Vocabulary and idf of a training corpus; both bounded by ``max_features``."""

    vocab: list[str]
    idf: list[float]
    sublinear: bool = False

    def variant(self, max_features: int, sublinear: bool) -> TfidfModel:
        """The same fit with fewer terms (the most frequent ones) or another tf scale."""
        return TfidfModel(self.vocab[:max_features], self.idf[:max_features], sublinear)

    def transform(self, df: DataFrame, text_col: str = "clean_text") -> DataFrame:
        """Add ``indices`` and L2-normalised ``weights``, from counts where present."""
        counted = df if "counts" in df.columns else with_counts(df, self.vocab, text_col)
        size = len(self.vocab)
        idf = literal_doubles(self.idf)
        scale = (lambda tf: F.log(tf) + 1.0) if self.sublinear else (lambda tf: tf)
        raw = F.col("_raw")
        return (
            # indices ascend, so the terms of a smaller vocabulary come first
            counted.withColumn("indices", F.filter("indices", lambda i: i < size))
            .withColumn(
                "_raw",
                F.zip_with(
                    F.col("indices"),
                    F.slice("counts", F.lit(1), F.size("indices")),
                    lambda i, tf: scale(tf) * F.element_at(idf, i + 1),
                ),
            )
            .withColumn("weights", divide_all(raw, F.sqrt(F.aggregate(raw, F.lit(0.0), lambda acc, w: acc + w * w))))
            .drop("counts", "_raw")
        )

    def pairs(self, df: DataFrame, text_col: str = "clean_text") -> DataFrame:
        """Add ``pairs``, an array of struct(indices, weights)."""
        wide = self.transform(df, text_col)
        return wide.withColumn("pairs", F.arrays_zip("indices", "weights")).drop("indices", "weights")

    def long(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "clean_text") -> DataFrame:
        """One row per (document, term) with its weight."""
        terms = F.from_json(F.lit(json.dumps(self.vocab)), "array<string>")
        return inline_rows(self.pairs(df, text_col), [id_col], "pairs", "indices").select(
            id_col, F.element_at(terms, F.col("indices") + 1).alias("term"), F.col("weights").alias("weight")
        )


def fit_idf(counted: DataFrame, vocab: list[str], sublinear: bool = False) -> TfidfModel:
    """Smoothed idf ``ln((1+n)/(1+df)) + 1``; one count per term reaches the driver."""
    n = counted.count()
    per_term = explode_rows(counted, [], "indices", "i").groupBy("i").agg(F.count(F.lit(1)).alias("df"))
    df = {r["i"]: r["df"] for r in per_term.collect()}
    return TfidfModel(vocab, [math.log((1 + n) / (1 + df.get(i, 0))) + 1 for i in range(len(vocab))], sublinear)


def fit_tfidf(
    df: DataFrame, max_features: int = MAX_FEATURES, sublinear: bool = False, text_col: str = "clean_text"
) -> TfidfModel:
    """Vocabulary by corpus frequency and its idf, from texts."""
    return fit_tfidf_counts(df, [], max_features, sublinear, text_col)[0]


def fit_tfidf_counts(
    df: DataFrame, keep: list[str], max_features: int = MAX_FEATURES, sublinear: bool = False, text_col: str = "clean_text"
) -> tuple[TfidfModel, DataFrame]:
    """As ``fit_tfidf``, with the staged term counts of the rows, which the model transforms without their texts."""
    vocab, counts = fit_counts(df, keep, max_features, text_col)
    return fit_idf(counts, vocab, sublinear), counts


def as_vectors(df: DataFrame, size: int, keep: list[str], name: str = "features") -> DataFrame:
    """Stage ``indices``/``weights`` as an ML vector column ``features``.

    The arrays are written in a vector's stored form and read back as vectors,
    which iterative fits re-read cheaply; no Python runs per row.
    """
    stored = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.col("indices").alias("indices"),
        F.col("weights").alias("values"),
    )
    flat = df.select(*keep, stored.alias("features"))
    schema = StructType(
        [f for f in flat.schema.fields if f.name != "features"] + [StructField("features", VectorUDT())]
    )
    return stage(flat, name, schema)
