"""SQL text equal to the registered queries, for an independent engine.

Each statement reads the same tables.  Cleaning is spelled out without
back-references, which the SQL engine's regular expressions do not have.
"""

from __future__ import annotations

from ..constants import (
    BACKBONE_COST,
    BACKBONES,
    CONFIDENCE_THRESHOLD,
    ERROR_DEFAULT,
    ERROR_NEGATION,
    ERROR_SOURCE_OOD,
    ERROR_SOURCE_TEST,
    LANG_ACTIONS,
    LANG_DEFAULT,
    LANG_ERROR_PAIRS,
    LANG_KEYWORDS,
    LANG_LABELS,
    LANG_OOD_SOURCES,
    MAX_REQUEST_CHARS,
    MAX_TOKENS,
    NB_ALPHA,
    NEGATIONS,
    PUNCTUATION,
    SEED,
    STATUS_BASELINE,
    STATUS_TUNED,
    VARIATIONS,
)
from ..functions.text import ANY_WORD, EMOJI_RUN, SPACE_RUN, TAG, WORD
from ..operators.contamination import MIN_SHARE, SHINGLE_WORDS
from ..operators.models import KEYWORD, LR, NAIVE_BAYES, RF, SVM

LABELS = LANG_LABELS
FIT_MODELS = [LR.name, SVM.name, RF.name, NAIVE_BAYES, KEYWORD]


def q(s) -> str:
    """SQL string literal."""
    return "'" + str(s).replace("'", "''") + "'"


def with_(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + select


def values(rows, cols: str, name: str) -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else ("NULL" if v is None else str(v)) for v in r) + ")" for r in rows)
    return f"{name}({cols}) AS (VALUES {body})"


# --- cleaning -------------------------------------------------------------------

def strip_sql(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), {q('^' + SPACE_RUN + '|' + SPACE_RUN + '$')}, '', 'g')"


def _run(ch: str) -> str:
    return ("\\" + ch if ch in "?.-" else ch) + "{2,}"


RUNS = "|".join(_run(ch) for ch in PUNCTUATION)


def _squeeze(c: str) -> str:
    for ch in PUNCTUATION:
        c = f"regexp_replace({c}, {q(_run(ch))}, {q(ch)}, 'g')"
    return c


def clean_ctes(src: str, out: str, text: str = "text") -> list[str]:
    """CTEs adding clean_text, emojis and excess_punct_count to every row of ``src``."""
    return [
        f"{out}_1 AS (SELECT *, {strip_sql(text)} AS _t FROM {src})",
        f"{out}_2 AS (SELECT *, regexp_replace(_t, {q(EMOJI_RUN)}, ' ', 'g') AS _x, "
        f"array_to_string(regexp_extract_all(_t, {q(EMOJI_RUN)}), '') AS emojis FROM {out}_1)",
        f"{out}_3 AS (SELECT *, len(regexp_extract_all(_x, {q(RUNS)}))::INTEGER AS excess_punct_count, "
        f"regexp_extract_all({_squeeze('_x')}, '(?s).') AS _l FROM {out}_2)",
        f"{out} AS (SELECT * EXCLUDE (_t, _x, _l), trim(regexp_replace(array_to_string("
        f"[ch for ch, i in _l if i < 3 or ch <> _l[i-1] or ch <> _l[i-2]], ''), {q(SPACE_RUN)}, ' ', 'g')) AS clean_text "
        f"FROM {out}_3)",
    ]


# --- corpus, dedup, split --------------------------------------------------------

RAW = "raw AS (SELECT doc_id AS ord, text, lang AS intent, source FROM documents)"
OOD_IN = "(" + ", ".join(q(s) for s in LANG_OOD_SOURCES) + ")"
VALID = "intent IN (" + ", ".join(q(x) for x in LABELS) + ")"
LABEL_ID = "CASE intent " + " ".join(f"WHEN {q(x)} THEN {i}" for i, x in enumerate(LABELS)) + " END::INTEGER"
BASED = (
    "based AS (SELECT *, coalesce(source IN " + OOD_IN + ", FALSE) AS is_ood, "
    "CASE WHEN coalesce(source IN " + OOD_IN + ", FALSE) THEN 'ood_' ELSE '' END || printf('%s_%03d', intent, "
    "row_number() OVER (PARTITION BY coalesce(source IN " + OOD_IN + ", FALSE), intent ORDER BY ord)) AS base_id FROM raw)"
)

DEDUP_ALL = [
    RAW,
    *clean_ctes("raw", "cleaned"),
    f"kept AS (SELECT *, {LABEL_ID} AS label FROM cleaned WHERE {VALID} AND length(clean_text) >= 3 "
    "QUALIFY row_number() OVER (PARTITION BY clean_text, intent ORDER BY ord) = 1)",
]

PREPARED = [
    RAW,
    BASED,
    *clean_ctes("based", "cleaned"),
    f"kept AS (SELECT *, {LABEL_ID} AS label FROM cleaned WHERE {VALID} AND length(clean_text) >= 3 "
    "QUALIFY row_number() OVER (PARTITION BY is_ood, clean_text, intent ORDER BY ord) = 1)",
]


def quota_split(src: str, out: str, id_col: str, class_col: str) -> list[str]:
    """Split per distinct id of ``src``: exact quotas per class in seeded md5 order."""
    return [
        f"{out}_r AS (SELECT {id_col}, {class_col}, row_number() OVER (PARTITION BY {class_col} "
        f"ORDER BY md5({id_col} || ':{SEED}'), {id_col}) AS rn, count(*) OVER (PARTITION BY {class_col}) AS n FROM {src})",
        f"{out}_q AS (SELECT *, (n * 7000 + 5000) // 10000 AS q1, (n * 1500 + 5000) // 10000 AS q2 FROM {out}_r)",
        f"{out} AS (SELECT {id_col}, {class_col}, CASE WHEN rn <= q1 THEN 'train' WHEN rn <= least(n, q1 + q2) THEN 'val' "
        f"ELSE 'test' END AS split FROM {out}_q)",
    ]


SPLITS = [
    *PREPARED,
    "bases AS (SELECT base_id, intent FROM kept WHERE NOT is_ood)",
    *quota_split("bases", "assigned", "base_id", "intent"),
    "rows_ AS (SELECT k.*, CASE WHEN k.is_ood THEN 'ood' ELSE a.split END AS split FROM kept k "
    "LEFT JOIN assigned a ON k.base_id = a.base_id)",
]



def shingle_ctes(src: str, out: str, key: str) -> list[str]:
    """Distinct runs of words per row of ``src``."""
    run = f"array_to_string(w[i:i+{SHINGLE_WORDS - 1}], ' ')"
    return [
        f"{out}_w AS (SELECT {key}, regexp_extract_all(lower(clean_text), {q(WORD)}) AS w FROM {src})",
        f"{out}_i AS (SELECT {key}, w, unnest(range(1, greatest(len(w) - {SHINGLE_WORDS - 1}, 1) + 1)) AS i FROM {out}_w WHERE len(w) > 0)",
        f"{out} AS (SELECT DISTINCT {key}, {run} AS gram FROM {out}_i)",
    ]


SHARED_NGRAMS = [
    *clean_ctes("documents", "d"),
    *clean_ctes("benchmark", "b"),
    *shingle_ctes("d", "dg", "doc_id"),
    *shingle_ctes("b", "bg", "item_id"),
    "totals AS (SELECT item_id, count(*) AS total FROM bg GROUP BY item_id)",
    "shared AS (SELECT doc_id, item_id, count(*) AS n_shared, round(count(*) / any_value(total), 6) AS share "
    "FROM dg JOIN bg USING (gram) JOIN totals USING (item_id) GROUP BY doc_id, item_id)",
]

N_VAR = len(VARIATIONS)
AUGMENTED = [
    *SPLITS,
    values([(i, p, s) for i, (p, s) in enumerate(VARIATIONS)], "v, prefix, suffix", "variations"),
    "wide AS (SELECT r.ord * " + str(N_VAR) + " + v AS ord, base_id, intent, label, "
    + strip_sql("prefix || text || suffix") + " AS text FROM rows_ r, variations WHERE split = 'train')",
    *clean_ctes("wide", "wide_clean"),
    "augmented AS (SELECT * FROM wide_clean QUALIFY row_number() OVER (PARTITION BY clean_text, intent ORDER BY ord) = 1)",
]

# --- keyword classifier ----------------------------------------------------------

def hits(c: str, words) -> str:
    return "(" + " + ".join(f"contains(lower({c}), {q(w)})::INTEGER" for w in words) + ")"


def keyword_ctes(src: str, out: str, text: str = "clean_text", k: int | None = None, col: str = "predicted_intent", extra: str = "") -> list[str]:
    score = {x: hits(text, LANG_KEYWORDS[x][:k]) for x in LABELS}
    cols = ", ".join(f"{score[x]} AS s_{x}" for x in LABELS)
    best = "greatest(" + ", ".join(f"s_{x}" for x in LABELS) + ")"
    case = f"CASE WHEN {best} = 0 THEN {q(LANG_DEFAULT)} " + " ".join(f"WHEN s_{x} = {best} THEN {q(x)}" for x in LABELS) + " END"
    return [
        f"{out}_s AS (SELECT *, {cols} FROM {src})",
        f"{out} AS (SELECT *, {case} AS {col}{extra} FROM {out}_s)",
    ]


def softmax_ctes(src: str, out: str) -> list[str]:
    """Probabilities p_<label> from the scores s_<label>."""
    best = "greatest(" + ", ".join(f"s_{x}" for x in LABELS) + ")"
    return [
        f"{out}_e AS (SELECT *, " + ", ".join(f"exp(s_{x}::DOUBLE - {best}) AS e_{x}" for x in LABELS) + f" FROM {src})",
        f"{out} AS (SELECT *, " + ", ".join(f"e_{x} / (" + " + ".join(f"e_{y}" for y in LABELS) + f") AS p_{x}" for x in LABELS) + f" FROM {out}_e)",
    ]


FLAGSHIP = [*DEDUP_ALL, *keyword_ctes("kept", "predicted")]

# --- metrics ---------------------------------------------------------------------

GRID = values([(x,) for x in LABELS], "label", "labels")


def metric_ctes(src: str, out: str, by: str = "") -> list[str]:
    """Unrounded class metrics ``out`` and averages ``out_a`` from predictions, per group."""
    b = f"{by}, " if by else ""
    on = f" AND g.{by} = x.{by}" if by else ""
    groups = f"(SELECT DISTINCT {by} FROM {src})" if by else "(SELECT 1 AS one)"
    bsel = f"g.{by} AS {by}, " if by else ""
    f1 = "CASE WHEN support + predicted = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (support + predicted) END"
    grp = f"GROUP BY {by}" if by else ""
    return [
        GRID,
        f"{out}_c AS (SELECT {bsel}labels.label, "
        f"(SELECT count(*) FROM {src} x WHERE x.intent = labels.label{on}) AS support, "
        f"(SELECT count(*) FROM {src} x WHERE x.predicted_intent = labels.label{on}) AS predicted, "
        f"(SELECT count(*) FROM {src} x WHERE x.predicted_intent = labels.label AND x.intent = labels.label{on}) AS tp "
        f"FROM {groups} g, labels)",
        f"{out} AS (SELECT {b}label, CASE WHEN predicted = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / predicted END AS \"precision\", "
        f"CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / support END AS recall, {f1} AS f1_score, support, tp FROM {out}_c)",
        f"{out}_a AS (SELECT {b}sum(tp)::DOUBLE / sum(support) AS accuracy, avg(f1_score) AS macro_f1, "
        f"avg(\"precision\") AS macro_precision, avg(recall) AS macro_recall, "
        f"sum(\"precision\" * support)::DOUBLE / sum(support) AS weighted_precision, "
        f"sum(recall * support)::DOUBLE / sum(support) AS weighted_recall, "
        f"sum(f1_score * support)::DOUBLE / sum(support) AS weighted_f1, sum(support)::BIGINT AS dataset_size FROM {out} {grp})",
    ]


OVERALL = (
    "round(accuracy, 4) AS accuracy, round(macro_f1, 4) AS macro_f1, round(macro_precision, 4) AS macro_precision, "
    "round(macro_recall, 4) AS macro_recall, round(weighted_f1, 4) AS weighted_f1, dataset_size"
)
EVALUATED = [*SPLITS, *keyword_ctes("rows_", "predicted"), *softmax_ctes("predicted", "scored")]


def _variants(src: str, ks) -> list[str]:
    """Predictions of keyword lists cut to their first k entries, one row per (row, k)."""
    ctes = []
    for k in ks:
        ctes += keyword_ctes(src, f"v{k}", k=k)
    union = " UNION ALL ".join(f"SELECT split, intent, predicted_intent, 'keywords_{k}' AS model FROM v{k}" for k in ks)
    return [*ctes, f"variants AS ({union})"]


KS = (1, 2, 3, 4)
RUNS_SQL = [
    *SPLITS,
    *_variants("rows_", KS),
    "val_rows AS (SELECT * FROM variants WHERE split = 'val')",
    *metric_ctes("val_rows", "m", "model"),
    "runs AS (SELECT model AS run_name, right(model, 1)::INTEGER AS epochs, round(accuracy, 4) AS val_accuracy, "
    "round(macro_f1, 4) AS val_macro_f1 FROM m_a)",
]

# --- text features ---------------------------------------------------------------

def ngram_ctes(src: str, out: str, id_col: str, text: str, extra: str = "") -> list[str]:
    """(id, extra, term) rows of 1- and 2-grams."""
    return [
        f"{out}_w AS (SELECT {id_col}{extra}, regexp_extract_all(lower({text}), {q(WORD)}) AS w FROM {src})",
        f"{out}_l AS (SELECT *, list_concat(w, [w[i] || ' ' || w[i+1] for i in range(1, len(w))]) AS grams FROM {out}_w)",
        f"{out} AS (SELECT {id_col}{extra}, unnest(grams) AS term FROM {out}_l)",
    ]


def tfidf_ctes(sublinear: bool = False) -> list[str]:
    tf = "(1 + ln(tf))" if sublinear else "tf"
    return [
        *ngram_ctes("documents", "grams", "doc_id", "text"),
        "counts AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL)",
        "vocab AS (SELECT term, sum(tf) AS corpus_tf, count(*) AS df FROM counts GROUP BY term ORDER BY corpus_tf DESC, term LIMIT 5000)",
        "size_ AS (SELECT count(*) AS n FROM documents)",
        f"raw_w AS (SELECT doc_id, c.term, {tf} * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM counts c JOIN vocab USING (term), size_)",
        "weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw_w)",
    ]


def nb_ctes() -> list[str]:
    return [
        *SPLITS,
        *ngram_ctes("rows_", "grams", "ord", "clean_text", ", intent, split"),
        "counts AS (SELECT ord, intent, split, term, count(*) AS tf FROM grams GROUP BY ALL)",
        "vocab AS (SELECT term, sum(tf) AS corpus_tf, count(*) AS df FROM counts WHERE split = 'train' GROUP BY term "
        "ORDER BY corpus_tf DESC, term LIMIT 5000)",
        "n_train AS (SELECT count(*) AS n FROM rows_ WHERE split = 'train')",
        "raw_w AS (SELECT ord, intent, split, c.term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w "
        "FROM counts c JOIN vocab USING (term), n_train)",
        "weights AS (SELECT ord, intent, split, term, w / sqrt(sum(w * w) OVER (PARTITION BY ord)) AS w FROM raw_w)",
        "classes AS (SELECT intent AS c, ln(count(*)::DOUBLE / (SELECT n FROM n_train)) AS prior FROM rows_ WHERE split = 'train' GROUP BY intent)",
        "sums AS (SELECT intent AS c, term, sum(w) AS s FROM weights WHERE split = 'train' GROUP BY ALL)",
        f"mass AS (SELECT c, sum(s) + {NB_ALPHA} * (SELECT count(*) FROM vocab) AS m FROM sums GROUP BY c)",
        f"model AS (SELECT classes.c, vocab.term, ln((coalesce(s, 0) + {NB_ALPHA}) / m) AS ll FROM classes JOIN mass USING (c) "
        "CROSS JOIN vocab LEFT JOIN sums ON sums.c = classes.c AND sums.term = vocab.term)",
        "held AS (SELECT ord, intent, split FROM rows_ WHERE split <> 'train')",
        "joint AS (SELECT held.ord, classes.c, prior + coalesce((SELECT sum(w * ll) FROM weights JOIN model USING (term) "
        "WHERE weights.ord = held.ord AND model.c = classes.c), 0) AS score FROM held, classes)",
        "best AS (SELECT ord, c FROM joint QUALIFY row_number() OVER (PARTITION BY ord ORDER BY score DESC, CASE c "
        + " ".join(f"WHEN {q(x)} THEN {i}" for i, x in enumerate(LABELS))
        + " END) = 1)",
    ]


# --- scoring ---------------------------------------------------------------------

REQUESTS = [
    "turns AS (SELECT conv_id, turn, text FROM conversations)",
    *clean_ctes("turns", "turns_clean"),
    f"asked AS (SELECT *, CASE WHEN clean_text = '' THEN {strip_sql('text')} ELSE clean_text END AS cleaned_text FROM turns_clean)",
    *keyword_ctes("asked", "hit", text="cleaned_text", col="_unused"),
    *softmax_ctes("hit", "probs"),
]
RANKED = [
    *REQUESTS,
    "long AS (SELECT conv_id, turn, cleaned_text, text, unnest([" + ", ".join(q(x) for x in LABELS) + "]) AS label, unnest(["
    + ", ".join(f"p_{x}" for x in LABELS) + "]) AS p, unnest([" + ", ".join(str(i) for i in range(len(LABELS))) + "]) AS id FROM probs)",
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY p DESC, id) AS rn FROM long)",
    "top2 AS (SELECT conv_id, turn, any_value(cleaned_text) AS cleaned_text, any_value(text) AS text, max(label) FILTER (rn = 1) AS intent, "
    "round(max(p) FILTER (rn = 1), 4) AS confidence, max(label) FILTER (rn = 2) AS secondary_intent, "
    "round(max(p) FILTER (rn = 2), 4) AS secondary_confidence FROM ranked GROUP BY conv_id, turn)",
    f"flagged AS (SELECT *, confidence < {CONFIDENCE_THRESHOLD} AS is_uncertain, confidence < {CONFIDENCE_THRESHOLD} AS fallback FROM top2)",
]
REASON = (
    f"CASE WHEN text IS NULL OR length(text) < 1 THEN 'too_short' WHEN length(text) > {MAX_REQUEST_CHARS} THEN 'too_long' "
    f"WHEN {strip_sql('text')} = '' THEN 'empty_text' END"
)
SCORED_COLUMNS = "conv_id, turn, cleaned_text, intent, confidence, is_uncertain, fallback, secondary_intent, secondary_confidence"

# --- fertility -------------------------------------------------------------------

def word_ctes() -> list[str]:
    return [
        f"occ AS (SELECT unnest(regexp_extract_all(lower(text), {q(ANY_WORD)})) AS word FROM documents)",
        "words AS (SELECT word, count(*) AS n FROM occ GROUP BY word)",
        "vocab AS (SELECT word FROM words ORDER BY n DESC, word LIMIT 5000)",
        "longest AS (SELECT max(length(word)) AS l FROM vocab)",
        # greedy longest match from the left, one step per piece; a character always matches
        "steps AS (SELECT word, 0 AS step, 1 AS at, '' AS piece FROM words UNION ALL "
        "SELECT s.word, s.step + 1, (s.at + p.len)::INTEGER, substr(s.word, s.at, p.len) FROM steps s, LATERAL ("
        "SELECT max(g.len)::INTEGER AS len FROM range(1, least((SELECT l FROM longest), length(s.word) - s.at + 1) + 1) g(len) "
        "WHERE g.len = 1 OR EXISTS (SELECT 1 FROM vocab v WHERE v.word = substr(s.word, s.at, g.len))) p WHERE s.at <= length(s.word))",
    ]


def _fertility(name: str) -> str:
    return (
        f"SELECT {q(name)} AS tokenizer, round(sum(k_{name} * n)::DOUBLE / sum(n), 2) AS avg_tokens_per_word, "
        f"round(sum(k_{name} * n)::DOUBLE / (SELECT count(*) FROM documents), 2) AS avg_tokens_per_text FROM sizes"
    )


FERTILITY = [
    *word_ctes(),
    "sizes AS (SELECT w.word, w.n, 1 AS k_word, length(w.word) AS k_char, ceil(length(w.word) / 3.0)::BIGINT AS k_chunk3, "
    "s.k AS k_subword FROM words w JOIN (SELECT word, max(step) AS k FROM steps GROUP BY word) s USING (word))",
    "fertility AS (" + " UNION ALL ".join(_fertility(x) for x in ("word", "char", "chunk3", "subword")) + ")",
]

CORPUS_TOKENIZERS = [
    ("word", "Corpus words", "corpus", "Whole word", 0, "0M"),
    ("subword", "Corpus subwords", "corpus", "Greedy longest match", 5000, "0M"),
]


def _cost(i: int) -> str:
    cases = " ".join(f"WHEN contains(params, {q(c[0])}) THEN {q(c[i])}" for c in BACKBONE_COST[:-1])
    return f"CASE {cases} ELSE {q(BACKBONE_COST[-1][i])} END"


def overlap_sql(src: str, col: str, pairs) -> str:
    parts = [
        f"SELECT {q(col)} AS kind, {q(a)} AS left_split, {q(b)} AS right_split, (SELECT count(*) FROM ("
        f"SELECT DISTINCT {col} FROM {src} WHERE split = {q(a)} INTERSECT SELECT DISTINCT {col} FROM {src} WHERE split = {q(b)})) AS n_shared"
        for a, b in pairs
    ]
    return " UNION ALL ".join(parts)


THREE = [("train", "test"), ("train", "val"), ("val", "test")]
# split of raw rows by document, before any deduplication
RAW_SPLIT = [
    RAW,
    *clean_ctes("raw", "cleaned"),
    "ided AS (SELECT *, 'doc_' || ord AS base_id FROM cleaned)",
    *quota_split("ided", "assigned", "base_id", "intent"),
    "rows_ AS (SELECT i.*, a.split FROM ided i JOIN assigned a ON i.base_id = a.base_id)",
]
STACK_NO = "(" + " OR ".join(f"contains(lower(clean_text), {q(n)})" for n in NEGATIONS) + ")"
REASON_CASE = (
    "CASE "
    + " ".join(f"WHEN intent = {q(t)} AND predicted_intent = {q(p)} THEN {q(r)}" for t, p, r in LANG_ERROR_PAIRS)
    + f" WHEN {STACK_NO} THEN {q(ERROR_NEGATION)} ELSE {q(ERROR_DEFAULT)} END"
)
ERRORS = [
    *EVALUATED,
    "errors AS (SELECT ord, clean_text, intent, predicted_intent, round(greatest(" + ", ".join(f"p_{x}" for x in LABELS)
    + f"), 4) AS confidence, CASE split WHEN 'ood' THEN {q(ERROR_SOURCE_OOD)} ELSE {q(ERROR_SOURCE_TEST)} END AS benchmark_source, "
    + REASON_CASE + " AS failure_analysis FROM scored WHERE split IN ('test', 'ood') AND intent <> predicted_intent)",
]


def oracle_sql() -> dict[str, str]:
    out = {
        # sources, labels, ids
        "scan_documents": "SELECT doc_id, lang, source, n_chars, length(text)::INTEGER AS text_chars FROM documents",
        "class_counts": "SELECT lang AS intent, count(*) AS n FROM documents GROUP BY lang",
        "filter_valid_labels": "SELECT doc_id AS ord, lang AS intent FROM documents WHERE lang IN ('en', 'de', 'fr')",
        "encode_label": "SELECT doc_id AS ord, lang AS intent, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 END::INTEGER AS label FROM documents",
        "assign_base_id": with_(RAW, BASED, select="SELECT ord, intent, base_id FROM based"),
        "assign_fallback_id": with_(RAW, select="SELECT ord, intent, printf('%s_%03d', intent, row_number() OVER (ORDER BY ord) - 1) AS base_id FROM raw WHERE intent IN ('en', 'de', 'fr')"),
        "split_sink_roundtrip": with_(*SPLITS, select="SELECT split, count(*) AS n, sum(length(clean_text))::BIGINT AS clean_chars, sum(length(text))::BIGINT AS text_chars, sum(excess_punct_count)::BIGINT AS excess_puncts, sum(label)::BIGINT AS label_sum, count(emojis) AS emoji_cells FROM rows_ GROUP BY split"),
        # cleaning
        "extract_emojis": with_(
            "deco AS (SELECT doc_id, replace(replace(text, ',', ' 😀🙏,'), '. ', ' 漢字🤔.. ') AS text FROM documents)",
            *clean_ctes("deco", "c"),
            select="SELECT doc_id, emojis, excess_punct_count, clean_text FROM c",
        ),
        "punct_excess": with_(*clean_ctes("documents", "c"), select="SELECT doc_id, excess_punct_count FROM c"),
        "clean_text": with_(*clean_ctes("documents", "c"), select="SELECT doc_id, clean_text, emojis, excess_punct_count FROM c"),
        "clean_pages": with_(*clean_ctes("pages", "c", "html"), select="SELECT page_id, clean_text, excess_punct_count FROM c"),
        "strip_tags": f"SELECT page_id, regexp_replace(html, {q(TAG)}, '', 'g') AS stripped FROM pages",
        "filter_short": with_(*clean_ctes("documents", "c"), select="SELECT doc_id, length(clean_text)::INTEGER AS clean_chars FROM c WHERE length(clean_text) >= 3"),
        "ngrams": with_(
            *ngram_ctes("documents", "g", "doc_id", "text")[:2],
            select="SELECT doc_id, len(w)::INTEGER AS n_words, len(grams)::INTEGER AS n_ngrams, md5(array_to_string(grams, '|')) AS digest FROM g_l",
        ),
        "truncate_tokens": f"SELECT doc_id, len(w)::INTEGER AS n_tokens, array_to_string(w[1:{MAX_TOKENS}], ' ') AS kept FROM (SELECT doc_id, regexp_extract_all(lower(text), {q(WORD)}) AS w FROM documents)",
        # dedup, split, augment
        "dedup_first": with_(*DEDUP_ALL, select="SELECT ord, intent, label, clean_text FROM kept"),
        "dedup_counts": with_(RAW, *clean_ctes("raw", "c"), select="SELECT count(*) AS rows_in, count(DISTINCT (clean_text, intent)) AS rows_kept, count(*) - count(DISTINCT (clean_text, intent)) AS rows_dropped FROM c"),
        "distinct_base": with_(*AUGMENTED, select="SELECT ord, base_id, intent FROM augmented QUALIFY row_number() OVER (PARTITION BY base_id ORDER BY ord) = 1"),
        "stratified_split": with_(*SPLITS, select="SELECT base_id, intent, split FROM rows_ WHERE NOT is_ood"),
        "split_rows": with_(
            "turns AS (SELECT conv_id::VARCHAR AS base_id, conv_id, turn, role FROM conversations)",
            "firsts AS (SELECT base_id, role FROM turns QUALIFY row_number() OVER (PARTITION BY base_id ORDER BY turn) = 1)",
            *quota_split("firsts", "assigned", "base_id", "role"),
            select="SELECT t.conv_id, t.turn, t.role, a.split FROM turns t JOIN assigned a USING (base_id)",
        ),
        "binary_split": with_(
            "labelled AS (SELECT doc_id, quality::VARCHAR AS intent, 'doc_' || doc_id AS base_id FROM documents JOIN labels USING (doc_id))",
            *quota_split("labelled", "assigned", "base_id", "intent"),
            select="SELECT l.doc_id, l.intent, a.split FROM labelled l JOIN assigned a USING (base_id)",
        ),
        "hash_split": with_(
            f"h AS (SELECT conv_id, turn, ('0x' || substr(md5(conv_id::VARCHAR || ':{SEED}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM conversations)",
            select="SELECT conv_id, turn, CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split FROM h",
        ),
        "augment_train": with_(*AUGMENTED, select="SELECT ord, base_id, intent, label, md5(clean_text) AS clean_digest, md5(text) AS text_digest, excess_punct_count FROM augmented"),
        "prepared_counts": with_(
            *AUGMENTED,
            "all_rows AS (SELECT 'train' AS split, base_id FROM augmented UNION ALL SELECT split, base_id FROM rows_ WHERE split <> 'train')",
            select="SELECT split, count(*) AS n, count(DISTINCT base_id) AS n_bases FROM all_rows GROUP BY split",
        ),
        # leakage
        "leak_ids": with_(*SPLITS, select=overlap_sql("rows_", "base_id", THREE)),
        "leak_texts": with_(*RAW_SPLIT, select=overlap_sql("rows_", "clean_text", THREE)),
        "leak_ood": with_(*SPLITS, select=overlap_sql("rows_", "base_id", [("train", "ood")]) + " UNION ALL " + overlap_sql("rows_", "clean_text", [("train", "ood")])),
        "leak_benchmark": with_(
            *clean_ctes("documents", "d"),
            *clean_ctes("benchmark", "b"),
            "rows_ AS (SELECT clean_text, 'train' AS split FROM d UNION ALL SELECT clean_text, 'test' AS split FROM b)",
            select=overlap_sql("rows_", "clean_text", [("train", "test")]),
        ),
        "leak_ngrams": with_(*SHARED_NGRAMS, select="SELECT doc_id, item_id, n_shared, share FROM shared"),
        "decontaminate": with_(
            *SHARED_NGRAMS,
            select=f"SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM shared WHERE share >= {MIN_SHARE})",
        ),
        # features
        "term_counts": with_(*ngram_ctes("documents", "g", "doc_id", "text"), select="SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL"),
        "vocab_topk": with_(*tfidf_ctes()[:5], select="SELECT term, corpus_tf::BIGINT AS corpus_tf FROM vocab"),
        "tfidf": with_(*tfidf_ctes(), select="SELECT doc_id, term, round(weight, 6) AS weight FROM weights"),
        "tfidf_sublinear": with_(*tfidf_ctes(True), select="SELECT doc_id, term, round(weight, 6) AS weight FROM weights"),
        "tfidf_vectors": with_(
            *tfidf_ctes(True),
            "places AS (SELECT term, (row_number() OVER (ORDER BY corpus_tf DESC, term) - 1)::INTEGER AS term_index FROM vocab)",
            select="SELECT doc_id, term_index, round(weight, 6) AS weight FROM weights JOIN places USING (term)",
        ),
        # classifiers and metrics
        "keyword_classify": with_(*FLAGSHIP, select="SELECT ord, intent, predicted_intent FROM predicted"),
        "nb_predict": with_(*nb_ctes(), select="SELECT held.ord, held.split, held.intent, best.c AS predicted_intent FROM held JOIN best USING (ord)"),
        "confusion_matrix": with_(*FLAGSHIP, GRID, select="SELECT a.label AS intent, b.label AS predicted_intent, (SELECT count(*) FROM predicted p WHERE p.intent = a.label AND p.predicted_intent = b.label) AS n FROM labels a, labels b"),
        "confusion_norm": with_(
            *FLAGSHIP,
            GRID,
            "cm AS (SELECT a.label AS intent, b.label AS predicted_intent, (SELECT count(*) FROM predicted p WHERE p.intent = a.label AND p.predicted_intent = b.label) AS n FROM labels a, labels b)",
            select="SELECT intent, predicted_intent, n, round(n / (sum(n) OVER (PARTITION BY intent) + 1e-9::DOUBLE), 6) AS share FROM cm",
        ),
        "per_class_metrics": with_(*FLAGSHIP, *metric_ctes("predicted", "m"), select="SELECT label, round(\"precision\", 4) AS \"precision\", round(recall, 4) AS recall, round(f1_score, 4) AS f1_score, support FROM m"),
        "overall_metrics": with_(*FLAGSHIP, *metric_ctes("predicted", "m"), select=f"SELECT {OVERALL} FROM m_a"),
        "classification_report": with_(
            *FLAGSHIP,
            *metric_ctes("predicted", "m"),
            "report AS (SELECT label, \"precision\", recall, f1_score, support FROM m UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, dataset_size FROM m_a "
            "UNION ALL SELECT 'macro avg', macro_precision, macro_recall, macro_f1, dataset_size FROM m_a "
            "UNION ALL SELECT 'weighted avg', weighted_precision, weighted_recall, weighted_f1, dataset_size FROM m_a)",
            select="SELECT label, round(\"precision\", 10) AS \"precision\", round(recall, 10) AS recall, round(f1_score, 10) AS f1_score, support FROM report",
        ),
        "metrics_by_split": with_(*EVALUATED, "held AS (SELECT * FROM scored WHERE split <> 'train')", *metric_ctes("held", "m", "split"), select=f"SELECT split, {OVERALL} FROM m_a"),
        "metrics_json": with_(
            *EVALUATED,
            *metric_ctes("scored", "m", "split"),
            select="SELECT m.split, round(accuracy, 4) AS accuracy, round(macro_f1, 4) AS macro_f1, dataset_size, label, round(\"precision\", 4) AS \"precision\", "
            "round(recall, 4) AS recall, round(f1_score, 4) AS f1_score, support FROM m JOIN m_a USING (split)",
        ),
        "class_balance": with_(
            *AUGMENTED,
            GRID,
            "all_rows AS (SELECT 'train' AS split, intent FROM augmented UNION ALL SELECT split, intent FROM rows_ WHERE split <> 'train')",
            "b AS (SELECT label AS intent, " + ", ".join(f"(SELECT count(*) FROM all_rows r WHERE r.intent = label AND r.split = {q(s)}) AS {s}" for s in ("train", "val", "test", "ood")) + " FROM labels)",
            select="SELECT intent, train, val, test, ood, train + val + test AS total_in_domain, round(train * 100.0::DOUBLE / (SELECT sum(train) FROM b), 1) AS train_pct FROM b",
        ),
        "split_summary": with_(
            *AUGMENTED,
            "all_rows AS (SELECT 'train' AS split, base_id FROM augmented UNION ALL SELECT split, base_id FROM rows_ WHERE split <> 'train')",
            "s AS (SELECT split, count(DISTINCT base_id) AS unique_bases, count(*) AS samples FROM all_rows GROUP BY split)",
            "t AS (SELECT 'total' AS split, sum(unique_bases) FILTER (split <> 'ood')::BIGINT AS unique_bases, sum(samples)::BIGINT AS samples FROM s)",
            select="SELECT split, unique_bases, CASE WHEN split <> 'ood' THEN round(unique_bases * 100.0::DOUBLE / (SELECT unique_bases FROM t), 1) END AS base_pct, samples FROM (SELECT * FROM s UNION ALL SELECT * FROM t)",
        ),
        "quality_gate": with_(
            *EVALUATED,
            "held AS (SELECT * FROM scored WHERE split = 'test')",
            *metric_ctes("held", "m"),
            "shared AS (" + overlap_sql("rows_", "base_id", THREE) + ")",
            "gate AS (SELECT 'macro_f1' AS name, round(macro_f1, 4) AS value, 0.75::DOUBLE AS lo, 0.99::DOUBLE AS hi FROM m_a UNION ALL SELECT 'shared_base_ids', sum(n_shared)::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM shared)",
            select="SELECT *, value BETWEEN lo AND hi AS passed FROM gate",
        ),
        "misclassified": with_(*ERRORS, select="SELECT ord, clean_text, intent, predicted_intent, confidence, benchmark_source, failure_analysis FROM errors"),
        "error_reason": with_(
            *FLAGSHIP,
            "wrong AS (SELECT * FROM predicted WHERE intent <> predicted_intent)",
            select=f"SELECT ord, {REASON_CASE} AS failure_analysis FROM wrong",
        ),
        "top_confusions": with_(*ERRORS, select="SELECT benchmark_source, intent, predicted_intent, count(*) AS n FROM errors GROUP BY ALL ORDER BY n DESC, benchmark_source, intent, predicted_intent LIMIT 10"),
        "comparison_table": with_(
            *SPLITS,
            *_variants("rows_", KS),
            "held AS (SELECT * FROM variants WHERE split IN ('test', 'ood'))",
            "keyed AS (SELECT model || '/' || split AS key, * FROM held)",
            *metric_ctes("keyed", "m", "key"),
            "t AS (SELECT split_part(key, '/', 1) AS model, round(accuracy, 4) AS accuracy, round(macro_f1, 4) AS macro_f1 FROM m_a WHERE key LIKE '%/test')",
            "o AS (SELECT split_part(key, '/', 1) AS model, round(accuracy, 4) AS accuracy, round(macro_f1, 4) AS macro_f1 FROM m_a WHERE key LIKE '%/ood')",
            "table_ AS (SELECT t.model, printf('%.1f%%', round(t.accuracy * 100, 1)) AS test_accuracy, printf('%.4f', t.macro_f1) AS test_macro_f1, "
            "coalesce(printf('%.1f%%', round(o.accuracy * 100, 1)), 'N/A') AS ood_accuracy, coalesce(printf('%.4f', o.macro_f1), 'N/A') AS ood_macro_f1, "
            f"CASE t.model WHEN 'keywords_4' THEN {q(STATUS_TUNED)} ELSE {q(STATUS_BASELINE)} END AS status FROM t LEFT JOIN o USING (model))",
            select="SELECT '| ' || concat_ws(' | ', model, test_accuracy, test_macro_f1, ood_accuracy, ood_macro_f1, status) || ' |' AS line FROM table_",
        ),
        "class_lookup": with_(
            *EVALUATED,
            "held AS (SELECT * FROM scored WHERE split = 'test')",
            *metric_ctes("held", "m"),
            "wide_labels(label) AS (SELECT label FROM labels UNION ALL VALUES ('it'))",
            select="SELECT w.label, coalesce(round(\"precision\", 4), 0) AS \"precision\", coalesce(round(recall, 4), 0) AS recall, coalesce(round(f1_score, 4), 0) AS f1_score, coalesce(support, 0)::BIGINT AS support FROM wide_labels w LEFT JOIN m USING (label)",
        ),
        # fits: the rows and runs that SQL can name; the checks of every fit must hold
        **{name: with_(*SPLITS, select="SELECT ord, split, intent, TRUE AS listed, TRUE AS converged, TRUE AS accurate FROM rows_ WHERE split <> 'train'") for name in ("fit_lr", "fit_svm", "fit_rf")},
        "fit_predict_eval": with_(*SPLITS, select=f"SELECT {q(FIT_MODELS[0])} AS model, split, count(*) AS dataset_size, TRUE AS accurate FROM rows_ WHERE split <> 'train' GROUP BY split"),
        "baseline_summary": with_(
            *SPLITS,
            values([(m,) for m in FIT_MODELS], "model", "models"),
            select="SELECT model, split, count(*) AS dataset_size, TRUE AS accurate FROM rows_, models WHERE split <> 'train' GROUP BY model, split",
        ),
        "sweep_runs": "SELECT c::DOUBLE AS c, max_features::INTEGER AS max_features, 1000::INTEGER AS epochs, TRUE AS ranked, TRUE AS converged, TRUE AS accurate "
        "FROM (VALUES (0.1), (1.0)) a(c), (VALUES (1000), (5000)) b(max_features)",
        # runs
        "append_run_log": with_(
            *RUNS_SQL,
            select="SELECT run_name, CASE WHEN epochs <= 2 THEN epochs::DOUBLE WHEN epochs > 3 THEN epochs + 0.5 END AS epochs, val_accuracy, val_macro_f1, CASE WHEN epochs = 3 THEN 'appended' END AS note FROM runs",
        ),
        "rank_runs": with_(*RUNS_SQL, select="SELECT row_number() OVER (ORDER BY val_macro_f1 DESC, run_name)::INTEGER AS \"Rank\", run_name, epochs, val_accuracy, val_macro_f1 FROM runs"),
        "best_run": with_(*RUNS_SQL, select="SELECT run_name, epochs, val_accuracy, val_macro_f1, 'adapter' AS adapter_dir FROM runs ORDER BY val_macro_f1 DESC, run_name LIMIT 1"),
        # scoring
        "validate_requests": with_(f"r AS (SELECT conv_id, turn, {REASON} AS reject_reason FROM conversations)", select="SELECT * FROM r"),
        "softmax": with_(*REQUESTS, select="SELECT conv_id, turn, " + ", ".join(f"round(p_{x}, 6) AS p_{x}" for x in LABELS) + " FROM probs"),
        "top2": with_(*RANKED, select="SELECT conv_id, turn, intent, confidence, secondary_intent, secondary_confidence FROM top2"),
        "fallback_flag": with_(*RANKED, select="SELECT conv_id, turn, confidence, is_uncertain, fallback FROM flagged"),
        "all_scores": with_(*REQUESTS, select="SELECT conv_id, turn, " + ", ".join(f"round(p_{x}, 4) AS score_{x}" for x in LABELS) + " FROM probs"),
        "score_batch": with_(*RANKED, select=f"SELECT {SCORED_COLUMNS} FROM flagged"),
        "score_ranking": with_(
            *RANKED,
            "shown AS (SELECT r.conv_id, r.turn, label, replace(label, '_', ' ') AS display, round(p, 4) AS score, id, t.intent FROM ranked r JOIN top2 t USING (conv_id, turn))",
            select="SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, id)::INTEGER AS rank, label, display, score, label = intent AS is_top FROM shown",
        ),
        "route_actions": with_(
            *RANKED,
            values([(k, a, e) for k, (a, e) in LANG_ACTIONS.items()], "intent, action, marker", "actions"),
            "routed AS (SELECT f.*, coalesce(a.action, '<b>Route</b> to the general desk') AS action, coalesce(a.marker, '??') AS marker FROM flagged f LEFT JOIN actions a USING (intent))",
            select="SELECT conv_id, turn, intent, replace(intent, '_', ' ') AS display_intent, action, regexp_replace(action, '<[^>]*>', '', 'g') AS action_text, marker, "
            "CASE WHEN fallback THEN replace(secondary_intent, '_', ' ') || ' (' || round(secondary_confidence * 100)::INTEGER || '%)' END AS fallback_intent FROM routed",
        ),
        "score_plugin": with_(*RANKED, select=f"SELECT {SCORED_COLUMNS} FROM flagged"),
        "stream_score": with_(*RANKED, select=f"SELECT {SCORED_COLUMNS} FROM flagged"),
        "stream_reject": with_(
            *RANKED,
            f"checked AS (SELECT *, {REASON} AS reject_reason FROM flagged)",
            select="SELECT conv_id, turn, coalesce(reject_reason, 'accepted') AS outcome, CASE WHEN reject_reason IS NULL THEN intent END AS intent, CASE WHEN reject_reason IS NULL THEN confidence END AS confidence FROM checked",
        ),
        # fertility
        "token_fertility": with_(*FERTILITY, select="SELECT * FROM fertility", recursive=True),
        "subword_tokens": with_(
            *word_ctes(),
            "pieces AS (SELECT word, string_agg(piece, ' ' ORDER BY step) AS tokens, count(*)::INTEGER AS n_tokens FROM steps WHERE step > 0 GROUP BY word)",
            select="SELECT w.word, w.n, p.tokens, p.n_tokens FROM words w JOIN pieces p USING (word)",
            recursive=True,
        ),
        "fertility_examples": with_(
            *word_ctes()[:3],
            "top_ AS (SELECT word FROM words ORDER BY n DESC, word LIMIT 5)",
            select="SELECT 'char' AS tokenizer, word, '`' || word || '` -> [''' || array_to_string(regexp_extract_all(word, '(?s).'), ''', ''') || ''']' AS example FROM top_ "
            "UNION ALL SELECT 'chunk3', word, '`' || word || '` -> [''' || array_to_string(regexp_extract_all(word, '(?s).{1,3}'), ''', ''') || ''']' FROM top_",
        ),
        "backbone_table": with_(
            *FERTILITY,
            values([*BACKBONES, *CORPUS_TOKENIZERS], "name, label, org, type, vocab_size, params", "dim"),
            select="SELECT name, label, org, type, params, coalesce(avg_tokens_per_word, 2.5) AS avg_tokens_per_word, coalesce(avg_tokens_per_text, 16.0) AS avg_tokens_per_text, "
            f"format('{{:,}}', vocab_size) AS vocab, {_cost(1)} AS memory, {_cost(2)} AS latency FROM dim LEFT JOIN fertility ON name = tokenizer",
            recursive=True,
        ),
    }
    return out
