"""Registered queries of this subpackage: each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import (
    alignment,
    centroids,
    chat_format,
    decontaminate,
    language_id,
    language_model,
    line_dedup,
    pair_index,
    pieces,
    pii,
    quality_pu,
    quality_rules,
    simhash,
)

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WORD_MODEL = "/opt/tokenizers/word_bpe_49k.json"
BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_keep(docs, line_dedup.keep_bitmaps(docs))
    return kept.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = PIECE_MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, pieces.Vocabulary.load(model_file), carry=["doc_id"])


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.lm_scores(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_texts(table(spark, sf_dir, "conversations"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op9_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_pu.scores(docs, quality_pu.fit(docs, table(spark, sf_dir, "labels")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op11_word_bpe(spark: SparkSession, sf_dir: str, model_file: str = WORD_MODEL) -> DataFrame:
    docs, vocabulary = table(spark, sf_dir, "documents"), pair_index.WordVocabulary.load(model_file)
    return pair_index.encode(docs, vocabulary, carry=["doc_id"], as_bytes=True, decoded="decoded").select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str, a_file: str = BYTE_MODEL, b_file: str = PIECE_MODEL) -> DataFrame:
    docs, sides = table(spark, sf_dir, "documents"), alignment.Tokenizers.load(a_file, b_file)
    return alignment.link_report(docs, sides)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_line_dedup,
        op3_sentencepiece,
        op4_language_model,
        op5_decontaminate,
        op6_chat_format,
        op7_language_id,
        op8_simhash,
        op9_quality_pu,
        op10_pii,
        op11_word_bpe,
        op12_centroids,
        op13_alignment,
    )
}
