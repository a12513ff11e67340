"""From raw corpus to labelled, cleaned, deduplicated and split rows.

Texts are cleaned once.  Ids, deduplication and the split are worked out on a
manifest: narrow rows of order value, class, id and content digest.  What a consumer
derives from a text alone (a predicted class, say) is computed in the cleaning pass
and travels in the manifest.  Only consumers of texts stage them; their rows meet the
manifest in one join on the unique order value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import INTENTS, MIN_CLEAN_CHARS, SEED, SPLIT_RATIOS, VARIATIONS
from ..operators.augment import DIGESTS, augment, kept_variations
from ..operators.corpus import (
    assign_base_id,
    assign_fallback_id,
    encode_label,
    filter_valid_labels,
    require_columns,
    with_clean_columns,
)
from ..operators.dedup import content_key, dedup_first
from ..operators.split import fit_group_split
from .staging import stage

TEXTS = ["text", "clean_text", "emojis"]
PROCESSED = ["ord", "base_id", "text", "intent", "clean_text", "emojis", "excess_punct_count", "label"]


RowColumns = Callable[[DataFrame], DataFrame]


def clean_stage(
    df: DataFrame,
    labels=INTENTS,
    name: str = "clean",
    group_col: str = "intent",
    texts: bool = True,
    derive: RowColumns | None = None,
) -> DataFrame:
    """Rows with a valid label, cleaned and staged with length and content digests.

    Equal texts count as duplicates within ``group_col``; ``_text_key`` is the digest
    of the cleaned text alone.  Without ``texts`` only narrow columns are staged.
    ``derive`` adds columns that depend on their row alone.
    """
    require_columns(df, "text", "intent", "ord")
    cleaned = encode_label(with_clean_columns(filter_valid_labels(df, labels)), labels)
    extra = [c for c in ("base_id", group_col) if c in df.columns and c != "intent"]
    wide = cleaned.select(*[c for c in PROCESSED if c != "base_id"], *extra)
    wide = wide.withColumns(
        {
            "_chars": F.length("clean_text"),
            "_key": content_key("clean_text", group_col),
            "_text_key": content_key("clean_text"),
        }
    )
    wide = derive(wide) if derive else wide
    return stage(wide if texts else wide.drop(*TEXTS), name)


def kept_ids(cleaned: DataFrame, group_col: str = "intent", by_position: bool = False) -> DataFrame:
    """Manifest of the rows to keep: ord, intent and base_id.

    Ids number each group, or all rows ``by_position``, unless the rows bring
    their own.  Short texts keep their number, and then leave with the duplicates.
    """
    own = ["base_id"] if "base_id" in cleaned.columns else []
    manifest = cleaned.drop(*TEXTS)
    if not own:
        manifest = assign_fallback_id(manifest) if by_position else assign_base_id(manifest, label_col=group_col)
    long_enough = manifest.filter(F.col("_chars") >= MIN_CLEAN_CHARS)
    return dedup_first(long_enough, key_col="_key").drop("_chars", "_key")


def attach(cleaned: DataFrame, manifest: DataFrame) -> DataFrame:
    """Wide rows of a manifest; its ``split`` column, if any, is kept."""
    extra = [c for c in manifest.columns if c == "split"]
    wide = cleaned.select(*[c for c in PROCESSED if c != "base_id"])
    return wide.join(manifest.select("ord", "base_id", *extra), "ord").select(*PROCESSED, *extra)


def prepare_corpus(df: DataFrame, labels=INTENTS) -> DataFrame:
    """Valid labels, ids, cleaning, label ids, length filter, keep-first dedup."""
    cleaned = clean_stage(df, labels)
    return attach(cleaned, stage(kept_ids(cleaned, by_position=True), "kept"))


def corpus_manifest(df: DataFrame, labels=INTENTS, derive: RowColumns | None = None) -> DataFrame:
    """The rows that ``prepare_corpus`` keeps, without texts but with derived columns."""
    return kept_ids(clean_stage(df, labels, texts=False, derive=derive), by_position=True)


@dataclass
class Prepared:
    """Cleaned rows, and the manifest of those kept: ord, intent, base_id, split, derived columns."""

    cleaned: DataFrame
    manifest: DataFrame

    def rows(self) -> DataFrame:
        """Processed rows with a ``split`` column: train, val, test and, if given, ood."""
        return attach(self.cleaned, self.manifest)


def plan_splits(
    in_domain: DataFrame,
    ood: DataFrame | None = None,
    labels=INTENTS,
    ratios=SPLIT_RATIOS,
    seed: int = SEED,
    texts: bool = True,
    derive: RowColumns | None = None,
) -> Prepared:
    """Clean both corpora in one pass and split the in-domain one.

    Ids and duplicates are worked out per corpus and class; OOD ids start with
    ``ood_``.  ``ord`` must be unique over both corpora, which is checked.  See
    ``clean_stage`` for ``texts`` and ``derive``.
    """
    group = F.col("intent")
    frames = [in_domain.withColumn("_group", group)]
    if ood is not None:
        frames.append(ood.withColumn("_group", F.concat(F.lit("ood_"), group)))
    cleaned = clean_stage(reduce(DataFrame.unionByName, frames), labels, "clean", "_group", texts, derive)
    kept = stage(kept_ids(cleaned, "_group"), "kept")
    if not kept.groupBy("ord").count().filter("count > 1").isEmpty():
        raise ValueError("ord must be unique over all rows")
    is_main = F.col("_group") == F.col("intent")
    fitted = fit_group_split(kept.filter(is_main), ratios=ratios, seed=seed)
    split = fitted.assign(kept).withColumn("split", F.when(is_main, F.col("split")).otherwise("ood"))
    return Prepared(cleaned, stage(split.drop("_group"), "split"))


def augmented_manifest(manifest: DataFrame, variations=VARIATIONS) -> DataFrame:
    """(ord, base_id, intent, split) of ``augmented``, from a manifest with the digests of variations."""
    cols = ["ord", "base_id", "intent", "split"]
    train = kept_variations(manifest.filter("split = 'train'").select(*cols, DIGESTS), variations).select(*cols)
    rest = manifest.filter("split <> 'train'").withColumn("ord", F.col("ord") * len(variations))
    return train.unionByName(rest.select(*cols))


def augmented(prepared: Prepared, variations=VARIATIONS) -> DataFrame:
    """Wide rows in which those of train are replaced by their variations; other splits stay as they are.

    ``prepared`` has the digests of variations in its manifest, so which ones stay is known before any
    text is moved.  The order of every row is scaled alike, so it stays unique.
    """
    rows, narrow = prepared.rows(), prepared.manifest
    kept = kept_variations(narrow.filter("split = 'train'").select("ord", DIGESTS), variations).select("ord")
    train = augment(rows.filter("split = 'train'"), variations, kept=stage(kept, "augmented-kept"))
    rest = rows.filter("split <> 'train'").withColumn("ord", F.col("ord") * len(variations))
    return train.unionByName(rest)


def augment_train(rows: DataFrame, variations=VARIATIONS) -> DataFrame:
    """As ``augmented``, for wide rows that come without a manifest."""
    train = augment(rows.filter("split = 'train'"), variations)
    rest = rows.filter("split <> 'train'").withColumn("ord", F.col("ord") * len(variations))
    return train.unionByName(rest)
