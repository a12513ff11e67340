"""Affix variations of training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EMOJI_RANGES, VARIATIONS, WHITESPACE_RANGES
from ..functions import text as tx
from ..functions.text import clean_text, strip
from ..plans.staging import stage
from .corpus import with_clean_columns
from .dedup import KEYS, content_key, dedup_first

EDGE = 2  # characters at an end of a cleaned text that an affix can change: its runs are no longer
SHORT = 8  # cleaned texts with fewer characters are cleaned again with each affix
BLANK = "^[" + (tx.char_class(EMOJI_RANGES) + tx.char_class(WHITESPACE_RANGES)).replace("[", "").replace("]", "") + "]$"
PARTS = ["_long", "_base", "_middle", "_heads", "_tails", "_whole"]


def _each(variations, value) -> Column:
    """Array of ``value(prefix, suffix)`` of every variation: one expression, however many there are."""
    affixes = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(s).alias("suffix")) for p, s in variations])
    return F.transform(affixes, lambda a: value(a["prefix"], a["suffix"]))


def _with_parts(df: DataFrame, variations) -> DataFrame:
    """Add what the cleaned texts of all variations are made of; ``df`` has ``_base``, the cleaned text.

    Cleaning maps every run of equal characters by itself, so an affix changes a cleaned text at
    its ends only: variations share ``_middle`` and differ in ``_heads`` and ``_tails``.  A text that
    began or ended with white space or an emoji has a space there.  Texts too short to have a
    middle, and null, are cleaned whole.
    """
    squeezed = lambda c: F.regexp_replace(tx.squeeze_elongation(tx.squeeze_punct(tx.blank_emojis(c))), tx.SPACE_RUN, " ")
    space = lambda c: F.when(c.rlike(BLANK), " ").otherwise("")
    text, is_long = F.col("text"), F.col("_long")
    body = F.concat(space(F.left(text, F.lit(1))), F.col("_base"), space(F.right(text, F.lit(1))))
    heads = _each(variations, lambda p, s: F.ltrim(squeezed(F.concat(p, F.col("_start")))))
    tails = _each(variations, lambda p, s: F.rtrim(squeezed(F.concat(F.col("_end"), s))))
    whole = _each(variations, lambda p, s: clean_text(F.concat(p, text, s)))
    return (
        df.withColumn("_long", F.coalesce(F.length("_base") >= SHORT, F.lit(False)) & text.isNotNull())
        .withColumn("_body", F.when(is_long, body))
        .withColumn("_middle", F.substring("_body", F.lit(EDGE + 1), F.length("_body") - 2 * EDGE))
        .withColumn("_start", F.left("_body", F.lit(EDGE)))
        .withColumn("_end", F.right("_body", F.lit(EDGE)))
        .withColumn("_heads", F.when(is_long, heads))
        .withColumn("_tails", F.when(is_long, tails))
        .withColumn("_whole", F.when(~is_long, whole))
        .drop("_body", "_start", "_end")
    )


def _cleaned(position) -> Column:
    """Cleaned text of the variation at a 1-based position, from the parts."""
    at = lambda c: F.element_at(c, position)
    return F.when(F.col("_long"), F.concat(at("_heads"), F.col("_middle"), at("_tails"))).otherwise(at("_whole"))


def _excess(variations) -> Column:
    """Array of the runs of punctuation of every variation: those of the text, and what affixes change at its ends."""
    count = lambda c: F.regexp_count(tx.blank_emojis(c), F.lit(tx.PUNCT_RUN))
    first, last = F.left("text", F.lit(EDGE)), F.right("text", F.lit(EDGE))
    inner = F.col("excess_punct_count") - count(first) - count(last)
    long = _each(variations, lambda p, s: inner + count(F.concat(p, first)) + count(F.concat(last, s)))
    whole = _each(variations, lambda p, s: tx.excess_punct_count(F.concat(p, F.col("text"), s)))
    return F.when(F.col("_long"), long).otherwise(whole)


def expand_variations(df: DataFrame, variations=VARIATIONS, order_col: str = "ord", only: str | None = None) -> DataFrame:
    """One row per (row, variation), with the columns that cleaning its raw text gives.

    The order value becomes ``order * number of variations + variation``.  ``only`` names a
    column with the numbers of the variations to make.  A text is cleaned once for all its
    variations; columns that the reader does not ask for are not built.
    """
    columns = [c for c in df.columns if c != only]
    parts = with_clean_columns(df).withColumnRenamed("clean_text", "_base")
    parts = _with_parts(parts, variations).withColumn("_excess", _excess(variations))
    parts = parts.withColumn("_pictured", F.col("text").rlike(tx.EMOJI_RUN))
    numbers = F.col(only) if only else F.array(*[F.lit(k) for k in range(len(variations))])
    wide = parts.select("*", F.explode_outer(numbers).alias("_v")).filter(F.col("_v").isNotNull())
    at = lambda values: F.element_at(F.array(*values), F.col("_v") + 1)
    affixes = [at([F.lit(x) for x in part]) for part in zip(*variations)]
    # a text without emojis has those of its affixes
    plain = at([tx.find_emojis(strip(F.lit(f"{p}x{s}"))) for p, s in variations])
    wide = wide.withColumn("text", strip(F.concat(affixes[0], F.col("text"), affixes[1])))
    found = {
        "clean_text": _cleaned(F.col("_v") + 1),
        "emojis": F.when(F.col("_long") & ~F.col("_pictured"), plain).otherwise(tx.find_emojis(F.col("text"))),
        "excess_punct_count": F.element_at("_excess", F.col("_v") + 1),
        order_col: F.col(order_col) * len(variations) + F.col("_v"),
    }
    return wide.withColumns(found).select(*columns)


DIGESTS = "_variants"


def with_variation_digests(df: DataFrame, variations=VARIATIONS) -> DataFrame:
    """Add the content digest of every variation of a row, in order.

    Depends on its row alone, so it can be part of the cleaning pass, whose ``clean_text`` it
    takes; a digest is that of the variation's cleaned text and class.
    """
    base = F.col("clean_text") if "clean_text" in df.columns else clean_text("text")
    parts = _with_parts(df.withColumn("_base", base), variations)
    digests = [content_key(_cleaned(F.lit(k)), "intent") for k in range(1, len(variations) + 1)]
    return parts.withColumn(DIGESTS, F.array(*digests)).drop(*PARTS)


def kept_variations(df: DataFrame, variations=VARIATIONS, order_col: str = "ord") -> DataFrame:
    """One row per variation that stays, without texts; ``df`` has the digests of its variations.

    Only digests and narrow columns are staged and deduplicated.
    """
    own = [c for c in df.columns if c not in (DIGESTS, order_col)]
    rows = df.select(F.col(order_col).alias("_o"), *own, F.posexplode(DIGESTS).alias("_v", "_key"))
    rows = rows.withColumn(order_col, F.col("_o") * len(variations) + F.col("_v")).drop("_o", "_v")
    return dedup_first(stage(rows, "augmented-keys"), order_col=order_col, key_col="_key").drop("_key")


def augment(df: DataFrame, variations=VARIATIONS, order_col: str = "ord", kept: DataFrame | None = None) -> DataFrame:
    """All variations of the given rows, deduplicated on cleaned text and class.

    The texts of variations are built for the reader, and only for those that stay; ``kept``
    names these where they are known.  Rows meet the numbers of their variations
    before they are expanded, so a text is moved once, not once per variation.
    """
    if kept is None:
        wide = expand_variations(df, variations, order_col).withColumn("_key", content_key(*KEYS))
        keys = stage(wide.select(order_col, "_key"), "augmented-keys")
        kept = stage(dedup_first(keys, order_col=order_col, key_col="_key").select(order_col), "augmented-kept")
    number = F.pmod(F.col(order_col), F.lit(len(variations)))
    row = F.expr(f"(`{order_col}` - pmod(`{order_col}`, {len(variations)})) div {len(variations)}")
    stays = kept.groupBy(row.alias(order_col)).agg(F.collect_set(number.cast("int")).alias("_stays"))
    return expand_variations(df.join(stays, order_col), variations, order_col, only="_stays").select(*df.columns)
