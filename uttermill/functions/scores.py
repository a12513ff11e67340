"""Score arrays and labels as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(scores: Column) -> Column:
    """0-based position of the largest value; ties take the lowest position."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def label_at(labels: list[str], position: Column) -> Column:
    """Label for a 0-based position."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), position + 1)


def label_id(labels: list[str], c: Column) -> Column:
    """0-based id of a label; null for a label that is not listed."""
    pos = F.array_position(F.array(*[F.lit(x) for x in labels]), c)
    return F.when(pos > 0, (pos - 1).cast("int"))


def ranked(probs: Column) -> Column:
    """Array of struct(p, id), best first; equal values in id order."""
    pairs = F.transform(probs, lambda p, i: F.struct((-p).alias("neg"), i.alias("id")))
    return F.transform(
        F.array_sort(pairs), lambda s: F.struct((-s["neg"]).alias("p"), s["id"].alias("id"))
    )


def all_scores(labels: list[str], probs: Column, digits: int = 4) -> Column:
    """Map from label to rounded probability."""
    return F.map_from_arrays(
        F.array(*[F.lit(x) for x in labels]), F.transform(probs, lambda p: F.round(p, digits))
    )
