"""SQL (DuckDB) for the queries that SQL can express."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.line, k.pos, s.key IS NULL OR s.first_doc = k.doc_id AS stays
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP5 = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k,
         array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM windows),
grams AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)
), hits AS (
  SELECT doc_id, i, g.k, item_id FROM grams g JOIN windows USING (k, win)
), per_word AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), per_item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN per_word USING (doc_id) LEFT JOIN per_item USING (doc_id)
"""

OP6 = r"""
WITH c AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS LAST, role, text) AS turns
  FROM conversations GROUP BY conv_id
), prefixes AS (
  SELECT DISTINCT list_slice(turns, 1, k) AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM c)
), ends AS (
  SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns
)
SELECT conv_id, CAST(len(e.turns) AS BIGINT) AS n_turns, n_copies,
       array_to_string(list_transform(e.turns, lambda x: '<|im_start|>' ||
         regexp_replace(coalesce(x.r, 'unknown'), '<\|(im_start|im_end)\|>', '<\1>', 'g') || chr(10) ||
         regexp_replace(coalesce(x.t, ''), '<\|(im_start|im_end)\|>', '<\1>', 'g') || '<|im_end|>' || chr(10)), '') AS chat
FROM ends e ANTI JOIN prefixes p ON e.turns = p.turns
"""


def _rounds(n: int) -> str:
    """Assignments and centroids of ``n`` rounds, and the last assignment ``a<n>``."""
    parts = []
    for k in range(n + 1):
        parts.append(f"""a{k} AS MATERIALIZED (
  SELECT v.rid, any_value(v.vec_id) AS vec_id, min([CAST(list_sum(list_transform(list_zip(v.x, c.x),
         lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), c.c]) AS best
  FROM v, c{k} c GROUP BY v.rid
)""")
        if k < n:
            parts.append(f"""s{k} AS (
  SELECT c, j, sum(y) AS s, count(*) AS n
  FROM (SELECT a.best[2] AS c, unnest(v.x) AS y, generate_subscripts(v.x, 1) AS j FROM a{k} a JOIN v USING (rid)) GROUP BY c, j
), c{k + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(any_value(m.x), any_value(c.x)) AS x FROM c{k} c LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x FROM s{k} GROUP BY c) m ON m.c = c.c
  GROUP BY c.c
)""")
    return ", ".join(parts)


OP12 = rf"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16
), {_rounds(3)}
SELECT a.vec_id, CAST(a.best[2] AS INTEGER) AS cluster, a.best[1] AS distance,
       CAST(sum(a.best[1]) OVER (PARTITION BY a.best[2]) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a3 a JOIN c3 c ON c.c = a.best[2]
"""

SQL = {"op2_line_dedup": OP2, "op5_decontaminate": OP5, "op6_chat_format": OP6, "op12_centroids": OP12}
