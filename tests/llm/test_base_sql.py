"""The columns of op6 and op9 that the contract fixes, against DuckDB SQL on the smallest given tables."""

import os

import duckdb
import pytest

from kbspark.llm import queries
from tests.test_queries import DATA, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables aren't here")


def spans(place: int, kind: str, pattern: str, fits: str) -> str:
    return f"""SELECT doc_id, {place} AS place, '{kind}' AS kind, s, s + length(x) AS e FROM (
      SELECT doc_id, m[i] AS x, list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0) AS s
      FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM documents WHERE regexp_matches(text, '{pattern}')))) WHERE {fits}"""


DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(0, length({DIGITS})), lambda i: list_transform([{DIGITS}[length({DIGITS}) - i]::INT * (1 + i % 2)], lambda v: CASE WHEN v > 9 THEN v - 9 ELSE v END)[1])) % 10 = 0"
OP6 = f"""WITH s AS ({spans(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true")}
  UNION ALL {spans(1, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR right('000' || p, 3)::INT > 255)) = 0")}
  UNION ALL {spans(2, "card", r"[0-9]([\x20-]?[0-9])+", f"length({DIGITS}) BETWEEN 16 AND 19 AND {LUHN}")}
  UNION ALL {spans(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 8 AND 15")}),
  a AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY place, s) AS told, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone"))} FROM s GROUP BY 1)
  SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(told, '')) AS base_sha256 FROM documents LEFT JOIN a USING (doc_id)"""

OP9 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
  tri AS (SELECT doc_id, i, w[i:i+2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
  twice AS (SELECT doc_id, i FROM tri JOIN (SELECT doc_id, k FROM tri GROUP BY ALL HAVING count(*) > 1) USING (doc_id, k)),
  r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(3) AS u(j) GROUP BY 1),
  s AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id))
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s"""


@pytest.mark.parametrize("name,sql", [("op6_pii", OP6), ("op9_quality_rules", OP9)])
def test_base_columns(spark, name, sql):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = c.execute(sql).df()
    got = queries.QUERIES[name](spark, DATA).select(*want.columns).toPandas()
    assert rows(got) == rows(want)
