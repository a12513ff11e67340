"""Overlap of documents with benchmark items by word n-grams, and removal of contaminated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rows import explode_rows
from ..plans.staging import stage

SHINGLE_WORDS = 8
MIN_SHARE = 0.5  # of an item's n-grams that a contaminated row holds


def with_shingles(df: DataFrame, id_col: str, text_col: str, n: int = SHINGLE_WORDS) -> DataFrame:
    """(id, keys): distinct digests of the runs of ``n`` words; fewer words are one run, none give none."""
    words = F.col("_words")
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))),
        lambda i: F.md5(F.array_join(F.slice(words, i, F.lit(n)), " ").cast("binary")),
    )
    keys = F.when(F.size(words) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))
    return df.select(id_col, tx.words(text_col).alias("_words")).select(id_col, keys.alias("keys"))


def ngram_overlap(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "clean_text",
    n: int = SHINGLE_WORDS,
) -> DataFrame:
    """(id, item, n_shared, share): the pairs of a document and an item that share an n-gram.

    Items are shingled once and staged, so Spark knows their bytes: small ones are
    broadcast and documents are matched where they are read; otherwise digests meet
    by key.  Only digests are joined, and only pairs that share one are counted.
    """
    item_keys = with_shingles(items, item_col, text_col, n)
    item_keys = explode_rows(item_keys.withColumn("_total", F.size("keys")), [item_col, "_total"], "keys", "key")
    item_keys = stage(item_keys.distinct(), "item-shingles")
    doc_keys = explode_rows(with_shingles(docs, id_col, text_col, n), [id_col], "keys", "key")
    pairs = doc_keys.join(item_keys, "key").groupBy(id_col, item_col)
    shared = pairs.agg(F.count_distinct("key").alias("n_shared"), F.max("_total").alias("_total"))
    return shared.select(id_col, item_col, "n_shared", F.round(F.col("n_shared") / F.col("_total"), 6).alias("share"))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with ``_row``, a digest of id and text: rows that share an id, or have none, are told apart."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (id_col, text_col)]
    return df.withColumn("_row", F.unhex(F.md5(F.concat_ws("\u0000", *parts).cast("binary"))))


def contaminated_rows(
    docs: DataFrame,
    items: DataFrame,
    min_share: float = MIN_SHARE,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "clean_text",
    n: int = SHINGLE_WORDS,
) -> DataFrame:
    """(_row, item): the rows that hold ``min_share`` or more of an item's distinct n-grams.

    A set-similarity join with prefix filter.  All n-grams have one order, by the number
    of rows that hold them and then by digest.  A row that holds k of an item's t n-grams
    holds one of its first t - k + 1 in this order, so only these rare ones are joined;
    common n-grams make no pairs.  Every pair found is then counted in full.  Rows are
    reduced at once to the n-grams that any item has; only digests are staged and joined.
    """
    named = _keyed(items, item_col, text_col).withColumnRenamed("_row", "_item")
    item_keys = explode_rows(with_shingles(named, "_item", text_col, n), ["_item"], "keys", "key").distinct()
    item_keys = stage(item_keys, "item-shingles")
    ids = named.select("_item", item_col).distinct()
    totals = item_keys.groupBy("_item").agg(F.count(F.lit(1)).alias("_total"))
    totals = stage(totals.join(ids, "_item"), "item-sizes")
    known = stage(item_keys.select("key").distinct(), "item-keys")
    held = with_shingles(_keyed(docs, id_col, text_col), "_row", text_col, n)
    held = explode_rows(held, ["_row"], "keys", "key").join(known, "key", "left_semi")
    held = stage(held.distinct(), "held-shingles")  # of rows that repeat, one
    frequency = held.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"))
    order = F.row_number().over(Window.partitionBy("_item").orderBy(F.coalesce("_rows", F.lit(0)), "key"))
    # shares are rounded to 6 places, hence the margin
    least = F.greatest(F.lit(1), F.ceil((F.lit(min_share) - 1e-6) * F.col("_total")))
    prefix = item_keys.join(frequency, "key", "left").withColumn("_at", order).join(totals.drop(item_col), "_item")
    prefix = prefix.filter(F.col("_at") <= F.col("_total") - least + 1).select("_item", "key")
    pairs = stage(held.join(prefix, "key").select("_row", "_item").distinct(), "candidate-pairs")
    shared = pairs.join(item_keys, "_item").join(held, ["_row", "key"]).groupBy("_row", "_item")
    shared = shared.agg(F.count(F.lit(1)).alias("_shared")).join(totals, "_item")
    return shared.filter(F.round(F.col("_shared") / F.col("_total"), 6) >= min_share).select("_row", item_col)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    min_share: float = MIN_SHARE,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "clean_text",
    n: int = SHINGLE_WORDS,
) -> DataFrame:
    """Rows of ``docs`` that hold less than ``min_share`` of every item's n-grams, whatever their id."""
    found = contaminated_rows(docs, items, min_share, id_col, item_col, text_col, n).select("_row").distinct()
    return _keyed(docs, id_col, text_col).join(stage(found, "contaminated"), "_row", "left_anti").select(*docs.columns)
