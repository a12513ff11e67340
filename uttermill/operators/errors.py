"""Wrong predictions: table, diagnosis, counts."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (
    ERROR_COLUMNS,
    ERROR_DEFAULT,
    ERROR_NEGATION,
    ERROR_PAIRS,
    ERROR_SOURCE_OOD,
    ERROR_SOURCE_TEST,
    NEGATIONS,
)


def error_reason(
    text: Column, truth: Column, pred: Column, pairs=ERROR_PAIRS, negations=NEGATIONS,
    negation=ERROR_NEGATION, default=ERROR_DEFAULT,
) -> Column:
    """First matching rule: (true, predicted) pairs, then negation substrings, then the default."""
    rules = [((truth == t) & (pred == p), reason) for t, p, reason in pairs]
    lowered = F.lower(text)
    if negations:
        rules.append((reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(n)) for n in negations]), negation))
    out = F.lit(default)
    for test, reason in reversed(rules):
        out = F.when(test, reason).otherwise(out)
    return out


def with_is_correct(df: DataFrame) -> DataFrame:
    return df.withColumn("is_correct", F.col("intent") == F.col("predicted_intent"))


def misclassified(test: DataFrame, ood: DataFrame | None = None, **rules) -> DataFrame:
    """Wrong rows of both splits with provenance and diagnosis (unsorted)."""

    def wrong(df: DataFrame, source: str) -> DataFrame:
        return with_is_correct(df).filter(~F.col("is_correct")).withColumn("benchmark_source", F.lit(source))

    rows = wrong(test, ERROR_SOURCE_TEST)
    if ood is not None:
        rows = rows.unionByName(wrong(ood, ERROR_SOURCE_OOD), allowMissingColumns=True)
    return rows.withColumn(
        "failure_analysis",
        error_reason(F.col("clean_text"), F.col("intent"), F.col("predicted_intent"), **rules),
    )


def error_table(errors: DataFrame, id_col: str | None = None, columns=ERROR_COLUMNS) -> DataFrame:
    """The columns of the report that exist, most confident errors first."""
    ordered = errors.orderBy(F.desc("confidence"), *([id_col] if id_col else ["clean_text"]))
    return ordered.select(*[c for c in columns if c in errors.columns])


def top_confusions(errors: DataFrame, k: int = 10, by=("benchmark_source", "intent", "predicted_intent")) -> DataFrame:
    """The ``k`` most frequent groups of errors."""
    return errors.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by).limit(k)


RULE_SCHEMA = "ord int, intent string, predicted_intent string, contains string, reason string"


def rule_table(
    spark: SparkSession, pairs=ERROR_PAIRS, negations=NEGATIONS, negation: str = ERROR_NEGATION, default: str | None = ERROR_DEFAULT
) -> DataFrame:
    """The fixed decision list as a table: a null condition holds for every row."""
    rows = [(t, p, None, reason) for t, p, reason in pairs] + [(None, None, n, negation) for n in negations]
    rows += [(None, None, None, default)] if default is not None else []
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], RULE_SCHEMA)


def error_rules(
    df: DataFrame, rules: DataFrame, text_col: str = "clean_text", out: str = "failure_analysis",
    truth: str = "intent", pred: str = "predicted_intent",
) -> DataFrame:
    """Add the reason of the first rule, by ``ord``, whose conditions all hold; null if none does.

    A rule may ask for the true class, the predicted class and a part of the lower-cased
    text.  Rules are gathered to one row per combination of classes, so rows meet at most
    one row for each kind of rule by equi-joins and are never multiplied; then the rules
    that a row has met are tried in order.  Rules of one ``ord`` are tried by reason.
    """
    rules = rules.select(
        F.col("ord").cast("int").alias("ord"), F.col("intent").alias("_t"), F.col("predicted_intent").alias("_p"),
        F.lower("contains").alias("contains"), "reason",
    )
    work, column = df, {"_t": truth, "_p": pred}
    kinds = {"_both": ["_t", "_p"], "_true": ["_t"], "_pred": ["_p"]}
    for name, keys in kinds.items():
        own = [F.col(k).isNotNull() == F.lit(k in keys) for k in column]
        side = rules.filter(own[0] & own[1]).groupBy(*[F.col(k).alias(column[k]) for k in keys])
        side = side.agg(F.sort_array(F.collect_list(F.struct("ord", "reason", "contains"))).alias(name))
        work = work.join(side, [column[k] for k in keys], "left")
    free = rules.filter("_t IS NULL AND _p IS NULL").select("ord", "reason", "contains").orderBy("ord", "reason").collect()  # as long as the list
    always = F.from_json(F.lit(json.dumps([r.asDict() for r in free])), "array<struct<ord:int,reason:string,contains:string>>")
    none = F.array().cast("array<struct<ord:int,reason:string,contains:string>>")
    met = F.concat(*[F.coalesce(F.col(c), none) for c in kinds], always)
    lowered = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    work = work.withColumn("_lower", lowered).withColumn("_met", met)
    held = F.filter("_met", lambda r: r["contains"].isNull() | F.contains(F.col("_lower"), r["contains"]))
    first = F.array_min(F.transform(held, lambda r: F.struct(r["ord"].alias("ord"), r["reason"].alias("reason"))))
    return work.withColumn(out, first["reason"]).select(*df.columns, out)
