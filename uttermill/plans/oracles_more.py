"""SQL equal to the queries of ``registry_more``."""

from __future__ import annotations

from ..constants import LANG_DEFAULT, LANG_OOD_SOURCES, MAX_BATCH_TEXTS
from ..functions.text import ANY_WORD
from .oracles import KS, LABELS, OOD_IN, RANKED, SPLITS, _variants, metric_ctes, ngram_ctes, q, with_
from .oracles import oracle_sql as first_oracles

FIGURES = ["accuracy", "macro_f1", "macro_precision", "weighted_f1"]


def _rounded(columns: list[str], prefix: str, source: str) -> str:
    return ", ".join(f"round({source}.{c}, 4) AS {prefix}{c}" for c in columns)


def oracle_sql() -> dict[str, str]:
    first, second = map(q, LANG_OOD_SOURCES)
    return {
        "scan_rejects": f"SELECT doc_id, CASE WHEN source = {first} THEN 'cells' WHEN source = {second} THEN 'n_chars' ELSE 'read' END AS outcome, "
        f"CASE WHEN coalesce(source NOT IN {OOD_IN}, TRUE) THEN lang END AS lang, CASE WHEN coalesce(source NOT IN {OOD_IN}, TRUE) THEN n_chars END AS n_chars, "
        f"CASE WHEN coalesce(source NOT IN {OOD_IN}, TRUE) THEN length(text)::INTEGER END AS text_chars FROM documents",
        "metrics_document": with_(
            *SPLITS,
            *_variants("rows_", KS),
            "test_rows AS (SELECT * FROM variants WHERE split = 'test')",
            "ood_rows AS (SELECT * FROM variants WHERE split = 'ood')",
            *metric_ctes("test_rows", "m", "model"),
            *metric_ctes("ood_rows", "o", "model")[1:],
            "report AS (SELECT model, label, f1_score, support FROM m UNION ALL SELECT model, 'accuracy', accuracy, NULL FROM m_a "
            "UNION ALL SELECT model, 'macro avg', macro_f1, dataset_size FROM m_a UNION ALL SELECT model, 'weighted avg', weighted_f1, dataset_size FROM m_a)",
            f"wide AS (SELECT m.model, m.label, {_rounded(FIGURES, 'test_', 'm_a')}, {_rounded(FIGURES[:2], 'ood_', 'o_a')}, "
            f"{_rounded(['precision', 'recall', 'f1_score'], '', 'm')}, m.support FROM m JOIN m_a USING (model) LEFT JOIN o_a USING (model))",
            select="SELECT r.model, r.label, round(r.f1_score, 10) AS report_f1, r.support::BIGINT AS report_support, "
            "wide.* EXCLUDE (model, label) FROM report r LEFT JOIN wide ON r.model = wide.model AND r.label = wide.label",
        ),
        "classify_batches": with_(
            *RANKED,
            "sized AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM flagged)",
            f"reasons AS (SELECT conv_id, CASE WHEN n > {MAX_BATCH_TEXTS} THEN 'too_many_texts' WHEN count(*) FILTER (text IS NULL) > 0 THEN 'null_text' END AS reject_reason, "
            "n::INTEGER AS total, md5(string_agg(concat_ws('|', intent, round(confidence * 10000)::INTEGER::VARCHAR, fallback::VARCHAR, secondary_intent, cleaned_text), "
            "chr(10) ORDER BY turn, text)) AS results FROM sized GROUP BY conv_id, n)",
            select="SELECT conv_id, reject_reason, CASE WHEN reject_reason IS NULL THEN total END AS total, CASE WHEN reject_reason IS NULL THEN results END AS results FROM reasons",
        ),
        "train_epochs": with_(
            *SPLITS,
            "n AS (SELECT count(*) AS rows_seen FROM rows_ WHERE split = 'train')",
            select="SELECT e.epoch::INTEGER AS epoch, rows_seen, TRUE AS best_kept, TRUE AS taken_up, TRUE AS accurate FROM n, unnest([1, 2, 3, 4]) AS e(epoch)",
        ),
        "svm_squared_hinge": first_oracles()["fit_svm"],
        "error_rules": first_oracles()["error_reason"],
        "keyword_table": with_(
            f"docs AS (SELECT doc_id, lang AS intent, lower(coalesce(text, '')) AS t FROM documents WHERE lang IN ({', '.join(map(q, LABELS))}))",
            f"words AS (SELECT intent, unnest(regexp_extract_all(t, {q(ANY_WORD)})) AS keyword FROM docs)",
            "counts AS (SELECT intent, keyword, count(*) AS n FROM words GROUP BY ALL)",
            "keys AS (SELECT intent AS c, keyword FROM counts QUALIFY row_number() OVER (PARTITION BY intent ORDER BY n DESC, keyword) <= 2500)",
            "hits AS (SELECT doc_id, " + ", ".join(f"count(*) FILTER (c = {q(x)})::BIGINT AS hits_{x}" for x in LABELS)
            + " FROM docs JOIN keys ON contains(t, keyword) GROUP BY doc_id)",
            "whole AS (SELECT doc_id, intent, " + ", ".join(f"coalesce(hits_{x}, 0) AS hits_{x}" for x in LABELS) + " FROM docs LEFT JOIN hits USING (doc_id))",
            select="SELECT *, CASE greatest(" + ", ".join(f"hits_{x}" for x in LABELS) + f") WHEN 0 THEN {q(LANG_DEFAULT)} "
            + " ".join(f"WHEN hits_{x} THEN {q(x)}" for x in LABELS) + " END AS predicted_intent FROM whole",
        ),
        "vocab_ngrams": with_(
            f"{ngram_ctes('documents', 'grams', 'doc_id', 'text')[0]}",
            "runs AS (" + " UNION ALL ".join(f"SELECT unnest([array_to_string(w[i:i+{k - 1}], ' ') for i in range(1, len(w) - {k - 2})]) AS term FROM grams_w" for k in (1, 2, 3, 4)) + ")",
            select="SELECT term, count(*) AS corpus_tf FROM runs GROUP BY term ORDER BY corpus_tf DESC, term LIMIT 5000",
        ),
    }
