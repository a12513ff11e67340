"""Binding of the supplied tables to the utterance model (text, intent, ord)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LANG_OOD_SOURCES
from ..plans.staging import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a labelled corpus: the language is the class, doc_id the order."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"), "text", F.col("lang").alias("intent"), "source"
    )
    return spread(docs, "ord")


def out_of_domain_row() -> Column:
    return F.coalesce(F.col("source").isin(LANG_OOD_SOURCES), F.lit(False))


def in_domain(df: DataFrame) -> DataFrame:
    """Rows of all other sources; an unknown source is in-domain."""
    return df.filter(~out_of_domain_row())


def out_of_domain(df: DataFrame) -> DataFrame:
    return df.filter(out_of_domain_row())


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as texts to score."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return spread(turns, "conv_id")
