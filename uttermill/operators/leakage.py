"""Overlap of ids and texts between splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import content_key

PAIRS = [("train", "test"), ("train", "val"), ("val", "test")]
OOD_PAIRS = [("train", "ood")]
KINDS = ("base_id", "clean_text")
DIGESTS = {"clean_text": "_text_key"}


def overlap_keys(df: DataFrame, split_col: str = "split", kinds=KINDS, splits=("train", "val", "test", "ood")) -> DataFrame:
    """(kind, key, mask): in which splits each distinct value occurs, as bits.

    A kind is a column; where ``df`` has its digest already (``_text_key`` for
    clean_text), no text is read.

    One shuffle of digests serves all pairs and kinds; bits are combined on the
    map side, so a value with very many rows stays cheap.
    """
    bit = reduce(
        lambda acc, i: acc.when(F.col(split_col) == splits[i], F.lit(1 << i)),
        range(1, len(splits)),
        F.when(F.col(split_col) == splits[0], F.lit(1)),
    )
    key_of = lambda k: F.col(DIGESTS[k]) if DIGESTS.get(k) in df.columns else content_key(k)
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), key_of(k).alias("key")) for k in kinds]))
    return (
        df.select(bit.alias("_bit"), keys.alias("_k"))
        .filter(F.col("_bit").isNotNull())
        .groupBy(F.col("_k.kind").alias("kind"), F.col("_k.key").alias("key"))
        .agg(F.bit_or("_bit").alias("mask"))
    )


def overlap_report(
    df: DataFrame, split_col: str = "split", kinds=KINDS, pairs=tuple(PAIRS), splits=("train", "val", "test", "ood")
) -> DataFrame:
    """Number of distinct shared values per kind and pair of splits."""
    code = {s: 1 << i for i, s in enumerate(splits)}
    sums = [
        F.sum((F.col("mask").bitwiseAND(code[a] | code[b]) == (code[a] | code[b])).cast("bigint")).alias(f"n{i}")
        for i, (a, b) in enumerate(pairs)
    ]
    per_kind = overlap_keys(df, split_col, kinds, splits).groupBy("kind").agg(*sums)
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), F.col(f"n{i}").alias("n_shared"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return per_kind.select("kind", F.inline(rows))


def assert_no_leakage(df: DataFrame, split_col: str = "split", sample: int = 5) -> bool:
    """Raise ValueError on the first overlapping pair: ids first, then texts, then OOD.

    Validation and test are not compared with the OOD split.
    """
    splits = ("train", "val", "test", "ood")
    report = overlap_report(df, split_col, KINDS, tuple(PAIRS + OOD_PAIRS), splits)
    found = {(r["kind"], r["left_split"], r["right_split"]): r["n_shared"] for r in report.collect()}
    checks = [(k, *p) for k in KINDS for p in PAIRS] + [(k, *p) for k in KINDS for p in OOD_PAIRS]
    for kind, a, b in checks:
        n = found.get((kind, a, b), 0)
        if n:
            both = sum(1 << splits.index(s) for s in (a, b))
            shared = overlap_keys(df, split_col, (kind,), splits).filter(F.col("mask").bitwiseAND(both) == both)
            some = shared.select("key").limit(sample)  # distinct digests; a text is read for these few only
            rows = df.select(kind).join(F.broadcast(some), content_key(kind) == F.col("key"), "left_semi")
            shown = [r[0] for r in rows.groupBy(kind).count().select(kind).collect()]
            raise ValueError(f"CRITICAL LEAKAGE: {a} and {b} share {n} {kind} value(s), such as {shown}")
    return True
