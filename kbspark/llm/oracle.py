"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from kbspark.llm import secrets


def _spans(kind: str, place: int, pattern: str, group: int, least: int) -> str:
    """Rows (doc_id, kind, place, s, e, secret): matches and the gaps between them give the positions."""
    p = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, source, '{kind}' AS kind, {place} AS place, s, s + length(m) AS e, secret FROM (
      SELECT doc_id, source, m[i] AS m, regexp_extract(m[i], '{p}', {group}) AS secret,
             list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s
      FROM (SELECT doc_id, source, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT doc_id, coalesce(source, '') AS source, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g
        FROM documents WHERE regexp_matches(text, '{p}'))))
    WHERE length(secret) >= {least}"""


_OP1 = f"""
WITH spans AS ({" UNION ALL ".join(_spans(k, i, p, g, n) for i, (k, p, g, n) in enumerate(secrets.KINDS))}),
owners AS (SELECT secret, count(DISTINCT split_part(source, '/', 1)) AS n_owners, count(DISTINCT source) AS n_repositories FROM spans GROUP BY secret),
judged AS (SELECT spans.*, n_owners, n_repositories,
    CASE WHEN n_owners >= 3 THEN 'copied'
         WHEN len(list_distinct(string_split(secret, ''))) >= 8 AND regexp_matches(secret, '[0-9]') AND regexp_matches(secret, '[A-Za-z]') THEN 'live'
         ELSE 'plain' END AS verdict
    FROM spans JOIN owners USING (secret)),
told AS (SELECT doc_id,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < 3), '') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans,
    count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'copied') AS n_copied, max(n_owners) AS most_owners, max(n_repositories) AS most_repositories
    FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
    coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM documents d LEFT JOIN told USING (doc_id)
"""

#: On pages whose article holds headings, paragraphs, line breaks and bold text, and four named references.
_OP2 = r"""
SELECT page_id, url, text, length(text) AS n_chars FROM (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(coalesce(regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1), ''), '</?b>', '', 'g'),
      '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM pages)
"""

_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (((('0x' || h[5 * (i // 4) + 1 : 5 * (i // 4) + 5])::BIGINT) >> (15 - 5 * (i % 4))) & 31)]), 'string_agg', '') AS payload_digest,
    max(page_id) OVER (PARTITION BY h) AS response FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> response THEN response END AS refers_to FROM b
"""

_OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, n, hash(g) AS g FROM (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s)),
l AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS p, y.n AS q, count(*) AS k FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) WHERE 100 * k >= 75 * (p + q - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""

_OP8 = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

_OP12 = """WITH RECURSIVE e AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
  reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
  least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
  n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e LEFT JOIN n USING (vec_id) JOIN least USING (vec_id)"""

_TERMS = r"""list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"""
_OP13 = f"""WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
  size AS (SELECT doc_id, len(t) AS n FROM d WHERE len(t) > 0),
  total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM size),
  tf AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS w FROM d) GROUP BY ALL),
  weight AS (SELECT w, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, total GROUP BY w, docs),
  m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM size, total),
  q AS (SELECT item_id, w, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS w FROM benchmark) GROUP BY ALL),
  s AS (SELECT item_id, doc_id, sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN tf USING (w) JOIN weight USING (w) JOIN m USING (doc_id) GROUP BY ALL HAVING score > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s QUALIFY rank <= 20"""

ORACLE_SQL = {"op1_secrets": _OP1, "op2_html": _OP2, "op3_warc": _OP3, "op7_near_duplicates": _OP7, "op8_top_k": _OP8, "op12_vector_near_duplicates": _OP12, "op13_ranked_search": _OP13}
