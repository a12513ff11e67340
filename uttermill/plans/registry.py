"""Registered queries: every operator bound to the supplied tables, whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (
    LANG_ACTIONS,
    LANG_DEFAULT,
    LANG_ERROR_PAIRS,
    LANG_KEYWORDS,
    LANG_LABELS,
    MAX_TOKENS,
    STATUS_BASELINE,
    STATUS_TUNED,
)
from ..functions import text as tx
from ..operators import contamination, corpus, errors, features, fertility, leakage, metrics, models, reports, scoring, split
from ..operators.augment import augment, with_variation_digests
from ..operators.classify import fit_naive_bayes, keyword_classify, with_keyword_scores
from ..operators.dedup import dedup_counts as count_duplicates
from ..operators.dedup import distinct_base as first_of_base
from ..sources import files
from ..sources.tables import in_domain, out_of_domain, out_of_domain_row, requests, table, utterances
from ..streaming.scoring import read_table_stream, route_stream, score_stream
from .oracles import CORPUS_TOKENIZERS, KS, SCORED_COLUMNS
from .prepare import Prepared, augmented, augmented_manifest, corpus_manifest, plan_splits, prepare_corpus
from .staging import spread, stage, staging_path

LABELS = LANG_LABELS
ROUTE_DEFAULT = ("<b>Route</b> to the general desk", "??")
QUERIES: dict = {}


def query(fn):
    """Register a query under its function name."""
    QUERIES[fn.__name__] = fn
    return fn


# --- shared frames ----------------------------------------------------------------


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*cols), "doc_id")


def planned(spark: SparkSession, sf_dir: str, **options) -> Prepared:
    docs = utterances(spark, sf_dir)
    return plan_splits(in_domain(docs), out_of_domain(docs), LABELS, **options)


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir).rows()


def manifest(spark: SparkSession, sf_dir: str, derive=None) -> DataFrame:
    """ord, intent, base_id, split and derived columns of every kept row; no text is staged."""
    return planned(spark, sf_dir, texts=False, derive=derive).manifest


def classified(df: DataFrame, k: int | None = None, out: str = "predicted_intent") -> DataFrame:
    words = {x: LANG_KEYWORDS[x][:k] for x in LABELS}
    return keyword_classify(df, words, LANG_DEFAULT, out=out)


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``flagship`` without texts: classes are predicted in the cleaning pass."""
    return corpus_manifest(utterances(spark, sf_dir), LABELS, derive=classified)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: labels, cleaning, length filter, dedup, keyword class."""
    return classified(prepare_corpus(utterances(spark, sf_dir), LABELS))


def scored(df: DataFrame) -> DataFrame:
    """Add keyword class and softmax confidence."""
    rows = scoring.with_probabilities(with_keyword_scores(classified(df), LANG_KEYWORDS))
    return rows.withColumn("confidence", F.round(F.array_max("probs"), 4)).drop("scores", "probs")


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split rows with class and confidence, without texts."""
    return manifest(spark, sf_dir, scored)


def with_variants(df: DataFrame) -> DataFrame:
    """Add the prediction of every keyword list length."""
    return reduce(lambda rows, k: classified(rows, k, f"_p{k}"), KS, df)


def keyword_variants(rows: DataFrame) -> DataFrame:
    """One row per (row with variants, keyword list length) with its prediction."""
    runs = F.array(*[F.struct(F.lit(f"keywords_{k}").alias("model"), F.col(f"_p{k}").alias("predicted_intent")) for k in KS])
    return rows.select("split", "intent", F.inline(runs))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the keyword classifier, scored on the val split."""
    variants = keyword_variants(manifest(spark, sf_dir, with_variants).filter("split = 'val'"))
    return metrics.overall_metrics(variants, LABELS, by=("model",)).select(
        F.col("model").alias("run_name"),
        F.substring("model", -1, 1).cast("int").alias("epochs"),
        F.col("accuracy").alias("val_accuracy"),
        F.col("macro_f1").alias("val_macro_f1"),
    )


def scored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_batch(requests(spark, sf_dir), LABELS, scoring.keyword_scorer(LANG_KEYWORDS))


# --- sources, labels, ids ----------------------------------------------------------


@query
def scan_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars", F.length("text").alias("text_chars")
    )


@query
def class_counts(spark, sf_dir):
    return corpus.class_counts(table(spark, sf_dir, "documents").withColumnRenamed("lang", "intent"))


@query
def filter_valid_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("lang").alias("intent"))
    return corpus.filter_valid_labels(docs, LABELS[:3])


@query
def encode_label(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("lang").alias("intent"))
    return corpus.encode_label(docs, LABELS[:3])


@query
def assign_base_id(spark, sf_dir):
    """Both corpora numbered in one pass, the classes of the out-of-domain one by themselves."""
    docs = utterances(spark, sf_dir).drop("text").select("ord", "intent", out_of_domain_row().alias("is_ood"))
    return corpus.assign_base_ids(docs, "is_ood", "ood_").select("ord", "intent", "base_id")


@query
def assign_fallback_id(spark, sf_dir):
    docs = corpus.filter_valid_labels(utterances(spark, sf_dir).drop("text"), LABELS[:3])
    return corpus.assign_fallback_id(docs).select("ord", "intent", "base_id")


@query
def split_sink_roundtrip(spark, sf_dir):
    """Processed splits written as CSV, partitioned by split, and read back."""
    path = staging_path(spark, "splits-csv")
    rows = splits(spark, sf_dir).drop("ord")
    files.write_csv(rows, path, partition_by=["split"])
    back = files.read_csv(spark, path, files.SPLIT_SCHEMA + ", split string")
    return back.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length("clean_text")).alias("clean_chars"),
        F.sum(F.length("text")).alias("text_chars"),
        F.sum("excess_punct_count").alias("excess_puncts"),
        F.sum("label").alias("label_sum"),
        F.count("emojis").alias("emoji_cells"),
    )


# --- cleaning ----------------------------------------------------------------------


@query
def extract_emojis(spark, sf_dir):
    """Cleaning of documents in which commas and full stops carry emojis."""
    text = F.replace(F.replace("text", F.lit(","), F.lit(" 😀🙏,")), F.lit(". "), F.lit(" 漢字🤔.. "))
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("text", text)
    return corpus.with_clean_columns(docs).select("doc_id", "emojis", "excess_punct_count", "clean_text")


@query
def punct_excess(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", tx.excess_punct_count("text").alias("excess_punct_count"))


@query
def clean_text(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    return corpus.with_clean_columns(docs).select("doc_id", "clean_text", "emojis", "excess_punct_count")


@query
def clean_pages(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return corpus.with_clean_columns(pages, "html").select("page_id", "clean_text", "excess_punct_count")


@query
def strip_tags(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    return pages.select("page_id", tx.strip_tags("html").alias("stripped"))


@query
def filter_short(spark, sf_dir):
    docs = stage(corpus.with_clean_columns(documents(spark, sf_dir, "doc_id", "text")), "clean")
    return corpus.filter_short(docs).select("doc_id", F.length("clean_text").alias("clean_chars"))


@query
def ngrams(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("words", tx.words("text"))
    grams = docs.withColumn("grams", F.concat("words", tx.bigrams(F.col("words"))))
    return grams.select(
        "doc_id",
        F.size("words").alias("n_words"),
        F.size("grams").alias("n_ngrams"),
        F.md5(F.array_join("grams", "|").cast("binary")).alias("digest"),
    )


@query
def truncate_tokens(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("words", tx.words("text"))
    kept = tx.truncate_tokens(F.col("words"), MAX_TOKENS)
    return docs.select("doc_id", F.size("words").alias("n_tokens"), F.array_join(kept, " ").alias("kept"))


# --- dedup, split, augment ---------------------------------------------------------


@query
def dedup_first(spark, sf_dir):
    return prepare_corpus(utterances(spark, sf_dir), LABELS).select("ord", "intent", "label", "clean_text")


@query
def dedup_counts(spark, sf_dir):
    return count_duplicates(corpus.with_clean_columns(utterances(spark, sf_dir)))


@query
def distinct_base(spark, sf_dir):
    train = splits(spark, sf_dir).filter("split = 'train'")
    return first_of_base(augment(train)).select("ord", "base_id", "intent")


@query
def stratified_split(spark, sf_dir):
    return manifest(spark, sf_dir).filter("split <> 'ood'").select("base_id", "intent", "split")


def _turns(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").cast("string").alias("base_id"), "conv_id", "turn", "role", F.col("turn").alias("ord")
    )


@query
def split_rows(spark, sf_dir):
    """Whole conversations kept together; the class is the role of the first turn."""
    return split.stratified_group_split(_turns(spark, sf_dir), class_col="role").select("conv_id", "turn", "role", "split")


@query
def binary_split(spark, sf_dir):
    """Labelled documents split by their quality class."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("intent"))
    docs = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id")
    docs = docs.select("doc_id", "intent", F.concat(F.lit("doc_"), "doc_id").alias("base_id"), F.col("doc_id").alias("ord"))
    return split.stratified_group_split(docs).select("doc_id", "intent", "split")


@query
def hash_split(spark, sf_dir):
    return split.hash_split(_turns(spark, sf_dir)).select("conv_id", "turn", "split")


@query
def augment_train(spark, sf_dir):
    train = augmented(planned(spark, sf_dir, derive=with_variation_digests)).filter("split = 'train'")
    return train.select(
        "ord",
        "base_id",
        "intent",
        "label",
        F.md5(F.col("clean_text").cast("binary")).alias("clean_digest"),
        F.md5(F.col("text").cast("binary")).alias("text_digest"),
        "excess_punct_count",
    )


@query
def prepared_counts(spark, sf_dir):
    rows = augmented_manifest(manifest(spark, sf_dir, with_variation_digests))
    per_id = rows.groupBy("split", "base_id").agg(F.count(F.lit(1)).alias("k"))
    return per_id.groupBy("split").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_bases"))


# --- leakage -----------------------------------------------------------------------


@query
def leak_ids(spark, sf_dir):
    return leakage.overlap_report(manifest(spark, sf_dir), kinds=("base_id",))


@query
def leak_texts(spark, sf_dir):
    """Text overlap of a split made by document, without deduplication first."""
    docs = utterances(spark, sf_dir).withColumn("base_id", F.concat(F.lit("doc_"), "ord"))
    docs = stage(corpus.with_clean_columns(docs).select("ord", "base_id", "intent", "clean_text"), "clean")
    return leakage.overlap_report(split.stratified_group_split(docs), kinds=("clean_text",))


@query
def leak_ood(spark, sf_dir):
    return leakage.overlap_report(manifest(spark, sf_dir), pairs=tuple(leakage.OOD_PAIRS))


@query
def leak_benchmark(spark, sf_dir):
    """Exact cleaned-text overlap of documents with the benchmark items."""
    docs = corpus.with_clean_columns(documents(spark, sf_dir, "doc_id", "text"))
    items = corpus.with_clean_columns(table(spark, sf_dir, "benchmark"))
    rows = docs.select("clean_text", F.lit("train").alias("split")).unionByName(
        items.select("clean_text", F.lit("test").alias("split"))
    )
    return leakage.overlap_report(rows, kinds=("clean_text",), pairs=(("train", "test"),))


def _shared_ngrams(spark, sf_dir) -> DataFrame:
    docs = corpus.with_clean_columns(documents(spark, sf_dir, "doc_id", "text"))
    return contamination.ngram_overlap(docs, corpus.with_clean_columns(table(spark, sf_dir, "benchmark")))


@query
def leak_ngrams(spark, sf_dir):
    """Share of each benchmark item's word n-grams that a document holds."""
    return _shared_ngrams(spark, sf_dir)


@query
def decontaminate(spark, sf_dir):
    """Documents that do not hold half of a benchmark item's n-grams."""
    docs = corpus.with_clean_columns(documents(spark, sf_dir, "doc_id", "lang", "n_chars", "text"))
    items = corpus.with_clean_columns(table(spark, sf_dir, "benchmark"))
    return contamination.decontaminate(docs, items).select("doc_id", "lang", "n_chars")


# --- features ----------------------------------------------------------------------


@query
def term_counts(spark, sf_dir):
    return features.term_counts(documents(spark, sf_dir, "doc_id", "text"), text_col="text")


@query
def vocab_topk(spark, sf_dir):
    return features.vocabulary(documents(spark, sf_dir, "doc_id", "text"), text_col="text")


def _tfidf(spark, sf_dir, sublinear):
    docs = documents(spark, sf_dir, "doc_id", "text")
    model, counts = features.fit_tfidf_counts(docs, ["doc_id"], sublinear=sublinear, text_col="text")
    return model.long(counts).withColumn("weight", F.round("weight", 6))


@query
def tfidf(spark, sf_dir):
    return _tfidf(spark, sf_dir, False)


@query
def tfidf_sublinear(spark, sf_dir):
    return _tfidf(spark, sf_dir, True)


@query
def tfidf_vectors(spark, sf_dir):
    """Entries of the staged model vectors."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    model, counts = features.fit_tfidf_counts(docs, ["doc_id"], sublinear=True, text_col="text")
    vectors = features.as_vectors(model.transform(counts), len(model.vocab), ["doc_id"])
    parts = vectors.select("doc_id", F.unwrap_udt("features").alias("v"))
    return parts.select("doc_id", F.explode(F.arrays_zip("v.indices", "v.values")).alias("e")).select(
        "doc_id", F.col("e.indices").alias("term_index"), F.round("e.values", 6).alias("weight")
    )


# --- classifiers -------------------------------------------------------------------


@query
def keyword_classify_(spark, sf_dir):
    return predicted(spark, sf_dir).select("ord", "intent", "predicted_intent")


QUERIES["keyword_classify"] = QUERIES.pop("keyword_classify_")


@query
def nb_predict(spark, sf_dir):
    store = models.FeatureStore(splits(spark, sf_dir), LABELS)
    model = fit_naive_bayes(store.train_counts, store.tfidf, LABELS)
    return model.predict(store.held_out_counts).select("ord", "split", "intent", "predicted_intent")


FLOOR = 0.9  # accuracy that a fitted model reaches on every split it has not seen
LOW_FLOOR = 0.75  # the same with word lists among the models; still over the commonest class


def _good(floor: float):
    return F.col("accuracy") >= floor


def _fit(spec):
    """Every held-out row with checks of the fit: a listed class, convergence, quality of its split."""

    def run(spark, sf_dir):
        store = models.FeatureStore(splits(spark, sf_dir), LABELS)
        rows = stage(models.fit_predict(spec, store).select("ord", "split", "intent", "predicted_intent", "converged"), "predicted")
        quality = metrics.overall_metrics(rows, LABELS, by=("split",)).select("split", _good(FLOOR).alias("accurate"))
        listed = F.col("predicted_intent").isin(LABELS).alias("listed")
        return rows.join(quality, "split").select("ord", "split", "intent", listed, "converged", "accurate")

    return run


QUERIES["fit_lr"] = _fit(models.LR)
QUERIES["fit_svm"] = _fit(models.SVM)
QUERIES["fit_rf"] = _fit(models.RF)


@query
def fit_predict_eval(spark, sf_dir):
    store = models.FeatureStore(splits(spark, sf_dir), LABELS)
    return models.evaluate_model(models.LR, store)[0].select("model", "split", "dataset_size", _good(FLOOR).alias("accurate"))


@query
def baseline_summary(spark, sf_dir):
    summary = models.baseline_summary(splits(spark, sf_dir), LABELS, LANG_KEYWORDS, LANG_DEFAULT)
    return summary.select("model", "split", "dataset_size", _good(LOW_FLOOR).alias("accurate"))


@query
def sweep_runs(spark, sf_dir):
    grid = [{"c": c, "max_features": m, "epochs": 1000} for c in (0.1, 1.0) for m in (1000, 5000)]
    runs = models.sweep(splits(spark, sf_dir), grid, LABELS)
    ranked = reports.rank_runs(models.run_frame(spark, runs), columns=[*models.SWEEP_COLUMNS, "converged"])
    good = F.lit(max(r["val_accuracy"] for r in runs) >= FLOOR).alias("accurate")  # of the best setting
    return ranked.select("c", "max_features", "epochs", F.col("Rank").between(1, len(grid)).alias("ranked"), "converged", good)


# --- metrics and reports -----------------------------------------------------------


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(predicted(spark, sf_dir), LABELS)


@query
def confusion_norm(spark, sf_dir):
    cm = metrics.confusion_matrix(predicted(spark, sf_dir), LABELS)
    return metrics.normalize_confusion(cm).withColumn("share", F.round("share", 6))


@query
def per_class_metrics(spark, sf_dir):
    return metrics.per_class_metrics(predicted(spark, sf_dir), LABELS)


@query
def overall_metrics(spark, sf_dir):
    return metrics.overall_metrics(predicted(spark, sf_dir), LABELS)


@query
def classification_report(spark, sf_dir):
    report = metrics.classification_report(predicted(spark, sf_dir), LABELS)
    return report.select("label", *[F.round(c, 10).alias(c) for c in ("precision", "recall", "f1_score")], "support")


@query
def metrics_by_split(spark, sf_dir):
    return metrics.overall_metrics(evaluated(spark, sf_dir).filter("split <> 'train'"), LABELS, by=("split",))


@query
def class_balance(spark, sf_dir):
    return metrics.class_balance(augmented_manifest(manifest(spark, sf_dir, with_variation_digests)), LABELS)


@query
def split_summary(spark, sf_dir):
    return metrics.split_summary(augmented_manifest(manifest(spark, sf_dir, with_variation_digests)))


@query
def quality_gate(spark, sf_dir):
    rows = manifest(spark, sf_dir, classified)
    overall = metrics.overall_metrics(rows.filter("split = 'test'"), LABELS)
    return metrics.quality_gate(overall, leakage.overlap_report(rows, kinds=("base_id",)))


def _errors(spark, sf_dir) -> DataFrame:
    found = planned(spark, sf_dir, derive=scored)
    wrong = found.manifest.filter("intent <> predicted_intent")
    # texts are fetched for the wrong rows only
    rows = found.cleaned.select("ord", "clean_text").join(wrong, "ord")
    return errors.misclassified(
        rows.filter("split = 'test'"), rows.filter("split = 'ood'"), pairs=LANG_ERROR_PAIRS
    )


@query
def misclassified(spark, sf_dir):
    return errors.error_table(_errors(spark, sf_dir), "ord", ["ord", *errors.ERROR_COLUMNS])


@query
def error_reason(spark, sf_dir):
    scored = stage(flagship(spark, sf_dir).select("ord", "intent", "predicted_intent", "clean_text"), "predicted")
    wrong = scored.filter("intent <> predicted_intent")
    reason = errors.error_reason(F.col("clean_text"), F.col("intent"), F.col("predicted_intent"), pairs=LANG_ERROR_PAIRS)
    return wrong.select("ord", reason.alias("failure_analysis"))


@query
def top_confusions(spark, sf_dir):
    return errors.top_confusions(_errors(spark, sf_dir), 10)


@query
def comparison_table(spark, sf_dir):
    """Markdown rows of keyword variants."""
    rows = manifest(spark, sf_dir, with_variants).filter("split IN ('test', 'ood')")
    m = metrics.overall_metrics(keyword_variants(rows), LABELS, by=("split", "model"))
    m = stage(m, "variant-metrics")
    ood = m.filter("split = 'ood'")
    status = F.when(F.col("model") == "keywords_4", STATUS_TUNED).otherwise(STATUS_BASELINE)
    return reports.markdown_lines(reports.comparison_table(m.filter("split = 'test'"), ood, status))


@query
def class_lookup(spark, sf_dir):
    held = manifest(spark, sf_dir, classified).filter("split = 'test'")
    return reports.per_class_lookup(metrics.per_class_metrics(held, LABELS), [*LABELS, "it"])


@query
def metrics_json(spark, sf_dir):
    """Nested metrics per split, written as JSON and read back."""
    rows = evaluated(spark, sf_dir)
    doc = reports.metrics_document(
        metrics.overall_metrics(rows, LABELS, by=("split",)), metrics.per_class_metrics(rows, LABELS, by=("split",)), "split"
    )
    path = staging_path(spark, "metrics-json")
    files.write_json(doc, path)
    back = files.read_json(spark, path, files.METRICS_SCHEMA, required="accuracy")
    return back.select("split", "accuracy", "macro_f1", "dataset_size", F.explode("per_class").alias("label", "m")).select(
        "split", "accuracy", "macro_f1", "dataset_size", "label", "m.*"
    )


@query
def append_run_log(spark, sf_dir):
    """Batches of runs with different columns and types, appended to one log; one is appended again."""
    runs = stage(run_log(spark, sf_dir), "runs")
    path = staging_path(spark, "run-log")
    files.append_log(runs.filter("epochs <= 2"), path)
    files.append_log(runs.filter("epochs = 3").drop("epochs").withColumn("note", F.lit("appended")), path)
    halves = runs.filter("epochs > 3").withColumn("epochs", F.col("epochs") + F.lit(0.5))
    for _ in range(2):
        files.append_log(halves, path, token="halves")
    files.append_log(runs.filter("epochs < 3"), path, key="run_name")
    return files.read_log(spark, path).select("run_name", "epochs", "val_accuracy", "val_macro_f1", "note")


@query
def rank_runs(spark, sf_dir):
    return reports.rank_runs(run_log(spark, sf_dir))


@query
def best_run(spark, sf_dir):
    return reports.best_run(run_log(spark, sf_dir), {"adapter_dir": "adapter"})


# --- scoring -----------------------------------------------------------------------


@query
def validate_requests(spark, sf_dir):
    return scoring.validate_requests(requests(spark, sf_dir)).select("conv_id", "turn", "reject_reason")


@query
def softmax(spark, sf_dir):
    rows = scoring.with_cleaned_text(requests(spark, sf_dir))
    probs = scoring.with_probabilities(scoring.keyword_scorer(LANG_KEYWORDS)(rows))
    return probs.select("conv_id", "turn", *[F.round(F.col("probs")[i], 6).alias(f"p_{x}") for i, x in enumerate(LABELS)])


@query
def top2(spark, sf_dir):
    return scored_requests(spark, sf_dir).select(
        "conv_id", "turn", "intent", "confidence", "secondary_intent", "secondary_confidence"
    )


@query
def fallback_flag(spark, sf_dir):
    return scored_requests(spark, sf_dir).select("conv_id", "turn", "confidence", "is_uncertain", "fallback")


@query
def all_scores(spark, sf_dir):
    return scored_requests(spark, sf_dir).select(
        "conv_id", "turn", *[F.col("all_scores")[x].alias(f"score_{x}") for x in LABELS]
    )


@query
def score_batch(spark, sf_dir):
    return scored_requests(spark, sf_dir).select(*SCORED_COLUMNS.split(", "))


def _keyword_model():
    """A plug-in model: keyword hits counted in Python."""
    import numpy as np

    words = [LANG_KEYWORDS[x] for x in LABELS]

    def predict(texts):
        return np.array([[sum(w in t.lower() for w in ws) for ws in words] for t in texts], dtype="float64")

    return predict


@query
def score_plugin(spark, sf_dir):
    """Batch scoring with a model that runs in Python workers."""
    scorer = scoring.python_scorer(_keyword_model)
    return scoring.score_batch(requests(spark, sf_dir), LABELS, scorer).select(*SCORED_COLUMNS.split(", "))


@query
def score_ranking(spark, sf_dir):
    return scoring.score_ranking(scored_requests(spark, sf_dir), ["conv_id", "turn"])


@query
def route_actions(spark, sf_dir):
    return scoring.route_actions(scored_requests(spark, sf_dir), LANG_ACTIONS, ROUTE_DEFAULT).select(
        "conv_id", "turn", "intent", "display_intent", "action", "action_text", "marker", "fallback_intent"
    )


# --- fertility ---------------------------------------------------------------------


def _words(spark, sf_dir) -> DataFrame:
    return stage(fertility.word_counts(documents(spark, sf_dir, "doc_id", "text")), "words")


def _tokenizers(words: DataFrame) -> dict:
    vocab = fertility.subword_vocabulary(words)
    return {
        "word": fertility.word_tokenizer,
        "char": fertility.chunk_tokenizer(1),
        "chunk3": fertility.chunk_tokenizer(3),
        "subword": fertility.subword_tokenizer(vocab),
    }


def _fertility(spark, sf_dir) -> DataFrame:
    words = _words(spark, sf_dir)
    return fertility.token_fertility(words, table(spark, sf_dir, "documents").count(), _tokenizers(words))


@query
def token_fertility(spark, sf_dir):
    return _fertility(spark, sf_dir)


@query
def subword_tokens(spark, sf_dir):
    words = _words(spark, sf_dir)
    return _tokenizers(words)["subword"](words).select(
        "word", "n", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").alias("n_tokens")
    )


@query
def fertility_examples(spark, sf_dir):
    toks = {"char": fertility.chunk_tokenizer(1), "chunk3": fertility.chunk_tokenizer(3)}
    return fertility.fertility_examples(_words(spark, sf_dir), toks)


@query
def backbone_table(spark, sf_dir):
    from ..constants import BACKBONES

    dim = spark.createDataFrame(
        [*BACKBONES, *CORPUS_TOKENIZERS],
        "name string, label string, org string, type string, vocab_size int, params string",
    )
    return fertility.backbone_table(dim, _fertility(spark, sf_dir))


# --- streams -----------------------------------------------------------------------


def _stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "conversations").schema
    return read_table_stream(spark, f"{sf_dir}/conversations.parquet", schema).select("conv_id", "turn", "text")


@query
def stream_score(spark, sf_dir):
    path, checkpoint = staging_path(spark, "stream-out"), staging_path(spark, "stream-checkpoint")
    options = {"labels": LABELS, "scorer": scoring.keyword_scorer(LANG_KEYWORDS)}
    q = score_stream(_stream(spark, sf_dir), path, checkpoint, **options)
    q.awaitTermination()
    # the sink of a stream that brought nothing has no file to take the columns from
    schema = scoring.score_batch(requests(spark, sf_dir), **options).schema
    return files.read_parquet(spark, path, schema).select(*SCORED_COLUMNS.split(", "))


@query
def stream_reject(spark, sf_dir):
    ok, bad = staging_path(spark, "stream-valid"), staging_path(spark, "stream-rejected")
    options = {"labels": LABELS, "scorer": scoring.keyword_scorer(LANG_KEYWORDS)}
    q = route_stream(_stream(spark, sf_dir), ok, bad, staging_path(spark, "stream-checkpoint"), **options)
    q.awaitTermination()
    asked = requests(spark, sf_dir)
    scored, checked = scoring.score_batch(asked, **options).schema, scoring.validate_requests(asked).schema
    accepted = files.read_parquet(spark, ok, scored).select(
        "conv_id", "turn", F.lit("accepted").alias("outcome"), "intent", "confidence"
    )
    rejected = files.read_parquet(spark, bad, checked).select("conv_id", "turn", F.col("reject_reason").alias("outcome"))
    return accepted.unionByName(rejected, allowMissingColumns=True)
