"""Registered queries: each operator over whole tables, with the same in SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators import beliefs as B
from kbspark.operators import citations as C
from kbspark.operators import discovery as D
from kbspark.operators import events as E
from kbspark.operators import filters as P
from kbspark.operators import ingest as I
from kbspark.operators import pages as G
from kbspark.operators import quality as Q
from kbspark.operators import search as S
from kbspark.plans import model as M
from kbspark.sources.tables import read_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

QUERY = "which worthless report is the most pathetic clown"
TERMS = ("worthless", "report", "most", "pathetic", "clown")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = M.sql(sql)
        return f

    return add


def seconds(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as whole seconds, so that results compare across engines."""
    return df.withColumns({c: F.unix_timestamp(c) for c in columns})


# Search ------------------------------------------------------------------------------------------------------------

_WORDS = f"list_filter(string_split_regex(translate(lower(title || ' ' || content), '{T.MARKED}', '{T.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_TERMS = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
_POSTS = f"SELECT doc_id, workspace, dl, term, count(*) AS tf FROM (SELECT doc_id, workspace, len(w) AS dl, unnest(w) AS term FROM (SELECT doc_id, workspace, {_WORDS} AS w FROM m_documents)) GROUP BY ALL"
_BM25 = f"""posts AS ({_POSTS}), n AS (SELECT count(*) AS n, avg(len({_WORDS})) AS avgdl FROM m_documents),
  df AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
  weights AS (SELECT doc_id, term, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM posts JOIN df USING (term), n)"""
_SUPPORT = "SELECT workspace, path, count(*) AS beliefs FROM m_beliefs WHERE superseded_at IS NULL GROUP BY ALL"
_SCORED = f"""normal AS (SELECT *, CASE WHEN max(bm25) OVER q > min(bm25) OVER q THEN (bm25 - min(bm25) OVER q) / (max(bm25) OVER q - min(bm25) OVER q) ELSE 1.0 END AS relevance FROM top WINDOW q AS (PARTITION BY query_id)),
  scored AS (SELECT t.*, coalesce(beliefs, 0) AS beliefs, 0.55 * relevance + 0.30 * CASE WHEN updated_at >= {M.NOW_SQL} THEN 1 ELSE exp(-(epoch({M.NOW_SQL}) - epoch(updated_at)) / 3600 * ln(2) / 168) END + 0.15 * least(1, ln(1 + coalesce(beliefs, 0)) / ln(6)) AS score
    FROM normal t LEFT JOIN ({_SUPPORT}) USING (workspace, path))"""


@register("t2_hybrid_search", f"""WITH {_BM25}, hits AS (SELECT doc_id, sum(w) AS bm25 FROM weights WHERE term IN {tuple(TERMS)} GROUP BY 1),
  top AS (SELECT 0 AS query_id, h.bm25, d.* FROM hits h JOIN m_documents d USING (doc_id) ORDER BY round(bm25, 9) DESC, path LIMIT 30), {_SCORED}
  SELECT doc_id, path, beliefs, round(bm25, 6) AS bm25, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, path LIMIT 10""")
def t2(spark, d):
    hits = S.hybrid_search(M.documents(spark, d), M.beliefs(spark, d), QUERY, M.now())
    return hits.select("doc_id", "path", "beliefs", F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"))


@register("t1_bm25", f"WITH {_BM25} SELECT doc_id, round(sum(w), 6) AS bm25 FROM weights WHERE term IN {tuple(TERMS)} GROUP BY 1")
def t1(spark, d):
    return S.bm25(M.documents(spark, d), QUERY, keep=("doc_id",)).select("doc_id", F.round("bm25", 6).alias("bm25"))


_QTERMS = r"SELECT query_id, unnest(list_distinct(list_filter(list_transform(string_split_regex(regexp_replace(query, '[^a-zA-Z0-9\s-]', ' ', 'g'), '\s+'), lambda x: lower(x)), lambda x: length(x) > 1 AND NOT list_contains(" + str(list(T.QUERY_STOP_WORDS)) + ", x)))) AS term FROM m_searches"


@register("t3_hybrid_search_batch", f"""WITH {_BM25}, terms AS ({_QTERMS}), ranked AS (SELECT query_id, doc_id, sum(w) AS bm25 FROM weights JOIN terms USING (term) GROUP BY ALL),
  top AS (SELECT query_id, bm25, d.* FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS r FROM ranked) JOIN m_documents d USING (doc_id) WHERE r <= 30), {_SCORED}
  SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS rank FROM scored) WHERE rank <= 10""")
def t3(spark, d):
    hits = S.hybrid_search_batch(M.documents(spark, d), M.beliefs(spark, d), M.searches(spark, d), M.now())
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


_BWORDS = f"list_filter(string_split_regex(translate(lower(concat_ws(' ', statement, topic, subject, predicate, object)), '{T.MARKED}', '{T.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@register("t4_search_beliefs", f"""WITH b AS (SELECT belief_id, {_BWORDS} AS w FROM m_beliefs WHERE superseded_at IS NULL), n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM b),
  tf AS (SELECT belief_id, len(w) AS dl, t AS term, len(list_filter(w, lambda x: x = t)) AS tf FROM b, unnest({_TERMS}) AS u(t)), df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY 1)
  SELECT belief_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25 FROM tf JOIN df USING (term), n WHERE tf > 0 GROUP BY 1""")
def t4(spark, d):
    current = M.beliefs(spark, d).where("superseded_at IS NULL")
    return S.bm25(current, QUERY, S.BELIEF_COLUMNS, keep=("belief_id",)).select("belief_id", F.round("bm25", 6).alias("bm25"))


@register("t5_snippets", f"""WITH m AS (SELECT doc_id, content, list_min(list_filter(list_transform({_TERMS}, lambda t: instr(lower(content), t)), lambda p: p > 0)) AS pos FROM m_documents WHERE list_has_any({_WORDS}, {_TERMS})),
  c AS (SELECT doc_id, content, coalesce(pos, 1) AS pos, greatest(1, coalesce(pos, 1) - 100) AS s FROM m)
  SELECT doc_id, CASE WHEN s > 1 THEN '...' ELSE '' END || substr(content, s, pos + 200 - s) || CASE WHEN pos + 199 < length(content) THEN '...' ELSE '' END AS snippet FROM c""")
def t5(spark, d):
    docs = S.bag(M.documents(spark, d)).where(P.any_term(F.col("words"), QUERY))
    return S.snippets(docs, QUERY).select("doc_id", "snippet")


@register("t6_multi_keyword", f"""WITH {_BM25}, terms AS ({_QTERMS}), ranked AS (SELECT query_id, doc_id, sum(w) AS bm25 FROM weights JOIN terms USING (term) GROUP BY ALL),
  hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS rank FROM ranked) WHERE rank <= 10),
  seen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY query_id, rank) AS r FROM hits) WHERE r = 1 ORDER BY query_id, rank LIMIT 50)
  SELECT query_id, rank, doc_id, path, left(content, 3000) AS context FROM seen JOIN m_documents USING (doc_id)""")
def t6(spark, d):
    return S.multi_keyword_search(M.documents(spark, d), M.searches(spark, d), 10, 50).withColumn("rank", F.col("rank").cast("long"))


@register("t2_hybrid_search_workspace", f"""WITH {_BM25}, hits AS (SELECT doc_id, sum(w) AS bm25 FROM weights WHERE term IN {tuple(TERMS)} GROUP BY 1),
  top AS (SELECT 0 AS query_id, h.bm25, d.* FROM hits h JOIN m_documents d USING (doc_id) WHERE workspace = 'en' ORDER BY round(bm25, 9) DESC, path LIMIT 30), {_SCORED}
  SELECT doc_id, path, beliefs, round(bm25, 6) AS bm25, round(score, 6) AS score FROM scored ORDER BY round(score, 9) DESC, path LIMIT 10""")
def t2_workspace(spark, d):
    hits = S.hybrid_search(M.documents(spark, d), M.beliefs(spark, d), QUERY, M.now(), workspace="en")
    return hits.select("doc_id", "path", "beliefs", F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"))


@register("t6_multi_keyword_beliefs", f"""WITH {_BM25}, terms AS ({_QTERMS}), ranked AS (SELECT query_id, doc_id, sum(w) AS bm25 FROM weights JOIN terms USING (term) GROUP BY ALL),
  hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS rank FROM ranked) WHERE rank <= 10),
  seen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY query_id, rank) AS r FROM hits) WHERE r = 1 ORDER BY query_id, rank LIMIT 50),
  b AS (SELECT belief_id, {_BWORDS} AS ws FROM m_beliefs WHERE superseded_at IS NULL), bn AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM b),
  btf AS (SELECT belief_id, dl, term, count(*) AS tf FROM (SELECT belief_id, len(ws) AS dl, unnest(ws) AS term FROM b) WHERE term IN (SELECT term FROM terms) GROUP BY ALL), bdf AS (SELECT term, count(*) AS df FROM btf GROUP BY 1),
  bw AS (SELECT belief_id, term, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM btf JOIN bdf USING (term), bn),
  bhits AS (SELECT * FROM (SELECT query_id, belief_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(w), 9) DESC, belief_id) AS rank FROM bw JOIN terms USING (term) GROUP BY query_id, belief_id) WHERE rank <= 10 ORDER BY query_id, rank LIMIT 50)
  SELECT 'document' AS kind, query_id, rank, doc_id::VARCHAR AS id, path, left(content, 3000) AS context FROM seen JOIN m_documents USING (doc_id)
  UNION ALL SELECT 'belief', query_id, rank, belief_id, path, statement FROM bhits JOIN m_beliefs USING (belief_id)""")
def t6_beliefs(spark, d):
    return S.multi_keyword_context(M.documents(spark, d), M.beliefs(spark, d), M.searches(spark, d), 10, 50).withColumn("rank", F.col("rank").cast("long"))


@register("j5_match_documents", f"SELECT doc_id FROM m_documents WHERE list_has_any({_WORDS}, {_TERMS})")
def j5(spark, d):
    return S.bag(M.documents(spark, d)).where(P.any_term(F.col("words"), QUERY)).select("doc_id")


@register("j6_belief_support", f"SELECT doc_id, coalesce(beliefs, 0) AS beliefs FROM m_documents LEFT JOIN ({_SUPPORT}) USING (workspace, path)")
def j6(spark, d):
    return S.support(M.documents(spark, d), M.beliefs(spark, d)).select("doc_id", "beliefs")


@register("a21_corpus_stats", f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM ({_POSTS}) GROUP BY 1")
def a21(spark, d):
    return S.corpus_stats(S.postings(M.documents(spark, d)))


@register("a22_top_terms", f"""WITH posts AS ({_POSTS}), df AS (SELECT term, count(*) AS df FROM posts GROUP BY 1), n AS (SELECT count(DISTINCT doc_id) AS n FROM posts),
  s AS (SELECT doc_id, term, tf * ln(n / df) AS tfidf FROM posts JOIN df USING (term), n)
  SELECT doc_id, term, round(tfidf, 6) AS tfidf, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(tfidf, 9) DESC, term) AS rank FROM s) WHERE rank <= 20""")
def a22(spark, d):
    return S.top_terms(S.postings(M.documents(spark, d))).select("doc_id", "term", F.round("tfidf", 6).alias("tfidf"), F.col("rank").cast("long").alias("rank"))


@register("w7_normalized", f"""WITH {_BM25}, hits AS (SELECT workspace, doc_id, sum(w) AS bm25 FROM weights JOIN m_documents USING (doc_id) WHERE term IN {tuple(TERMS)} GROUP BY ALL)
  SELECT doc_id, round(CASE WHEN max(bm25) OVER q > min(bm25) OVER q THEN (bm25 - min(bm25) OVER q) / (max(bm25) OVER q - min(bm25) OVER q) ELSE 1.0 END, 6) AS relevance FROM hits WINDOW q AS (PARTITION BY workspace)""")
def w7(spark, d):
    return S.normalized(S.bm25(M.documents(spark, d), QUERY), ["workspace"]).select("doc_id", F.round("relevance", 6).alias("relevance"))


@register("a24_index_integrity", f"WITH i AS (SELECT workspace, count(DISTINCT doc_id) AS indexed FROM ({_POSTS}) GROUP BY 1), c AS (SELECT workspace, count(*) AS docs FROM m_documents GROUP BY 1) SELECT workspace, docs, coalesce(indexed, 0) AS indexed, CASE WHEN docs = coalesce(indexed, 0) THEN 'ok' ELSE 'row_count_mismatch' END AS status FROM c LEFT JOIN i USING (workspace)")
def a24(spark, d):
    docs = M.documents(spark, d)
    return Q.index_integrity(docs, S.postings(docs))


# Filters -----------------------------------------------------------------------------------------------------------

_EVENT = "event_id, workspace, source_type, event_type, title, floor(epoch(occurred_at))::BIGINT AS occurred_at"


def _events(df):
    return seconds(df, "occurred_at").select("event_id", "workspace", "source_type", "event_type", "title", "occurred_at")


@register("p1_query_events", f"SELECT {_EVENT} FROM m_events e WHERE workspace = 'ws1' AND event_type = 'purchase' AND e.occurred_at >= TIMESTAMP '2024-01-03' AND e.occurred_at < TIMESTAMP '2024-01-21' ORDER BY e.occurred_at DESC, event_id LIMIT 50")
def p1(spark, d):
    return _events(P.query_events(M.events(spark, d), workspace="ws1", event_type="purchase", since="2024-01-03", until="2024-01-20"))


@register("p1_query_events_text", f"SELECT {_EVENT} FROM m_events e WHERE list_has_any(string_split(lower(title), ' '), ['purchase', '42']) ORDER BY e.occurred_at DESC, event_id LIMIT 50")
def p1_text(spark, d):
    return _events(P.query_events(M.events(spark, d), query="a purchase of 42"))


_BELIEF = "belief_id, workspace, topic, statement, subject, predicate, object, epoch(asserted_at)::BIGINT AS asserted_at"


def _beliefs(df):
    return seconds(df, "asserted_at").select("belief_id", "workspace", "topic", "statement", "subject", "predicate", "object", "asserted_at")


@register("p2_list_beliefs", f"SELECT {_BELIEF} FROM m_beliefs b WHERE workspace = 'en' AND topic = 'src3' AND superseded_at IS NULL AND b.asserted_at >= TIMESTAMP '2024-01-05' ORDER BY b.asserted_at DESC, belief_id LIMIT 50")
def p2(spark, d):
    return _beliefs(P.list_beliefs(M.beliefs(spark, d), workspace="en", topic="src3", since="2024-01-05"))


@register("p3_related_beliefs", f"SELECT {_BELIEF} FROM m_beliefs WHERE superseded_at IS NULL AND (subject = 'the' OR object = 'the.')")
def p3(spark, d):
    return _beliefs(P.related_beliefs(M.beliefs(spark, d), "the", "the."))


@register("p4_beliefs_by_topic", f"SELECT {_BELIEF} FROM m_beliefs WHERE superseded_at IS NULL AND topic ILIKE '%SRC1%'")
def p4(spark, d):
    return _beliefs(P.beliefs_by_topic_like(M.beliefs(spark, d), "SRC1"))


@register("p5_list_subscriptions", "SELECT item_id, title, epoch(published_at)::BIGINT AS published_at FROM m_items WHERE workspace = 'ws2' AND status = 'pending' ORDER BY m_items.published_at DESC, item_id LIMIT 50")
def p5(spark, d):
    return seconds(P.list_subscriptions(M.items(spark, d), workspace="ws2", status="pending"), "published_at").select("item_id", "title", "published_at")


@register("p6_list_sources", "SELECT * FROM m_sources WHERE enabled")
def p6(spark, d):
    return P.list_sources(M.sources(spark, d), enabled_only=True)


@register("p6_list_jobs", "SELECT run_id, status, epoch(started_at)::BIGINT AS started_at FROM m_runs r WHERE workspace = 'ws0' AND status = 'rejected' ORDER BY r.started_at DESC, run_id LIMIT 50")
def p6_jobs(spark, d):
    return seconds(P.list_jobs(M.runs(spark, d), workspace="ws0", status="rejected"), "started_at").select("run_id", "status", "started_at")


@register("p7_glob_documents", "SELECT workspace, path, length(content) AS size, length(content) // 4 AS tokens FROM m_documents WHERE path GLOB 'wiki/src1*/*5.md'")
def p7(spark, d):
    return P.glob_documents(M.documents(spark, d), "wiki/src1*/*5.md")


@register("p8_grep", r"""WITH l AS (SELECT path, i AS line_no, l[i] AS line FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, string_split(content, chr(10)) AS l FROM m_documents)))
  SELECT path, line_no, CASE WHEN length(line) <= 120 THEN line ELSE substr(line, greatest(1, length(string_split_regex(line, '(?i)token|worthless')[1]) + 1 - 60), 120) END AS snippet FROM l WHERE regexp_matches(line, '(?i)token|worthless')""")
def p8(spark, d):
    return P.grep(M.documents(spark, d), "token|worthless", ignore_case=True, limit=None)


@register("p9_grep_counts", "SELECT path, len(m) AS matches, m[1] AS first FROM (SELECT path, regexp_extract_all(content, '[a-z]*tion[a-z]*') AS m FROM m_documents) WHERE len(m) > 0")
def p9(spark, d):
    return P.grep_counts(M.documents(spark, d), "[a-z]*tion[a-z]*")


def _log(spark, d):
    """Operation logs made of each document's first lines: every line with an even number is an entry's header."""
    docs = M.documents(spark, d)
    made = F.transform(F.split("content", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("## [2024-01-0"), (i % 7 + 1).cast("string"), F.lit("] "), F.when(i % 2 == 0, "ingest").otherwise("lint"), F.lit(" | "), F.substring(x, 1, 20))).otherwise(F.concat(F.lit("- "), F.substring(x, 1, 20))))
    return docs.select("path", F.array_join(made, "\n").alias("content"))


@register("p10_operation_log", r"""WITH l AS (SELECT path, i - 1 AS i, l[i] AS x FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, string_split(content, chr(10)) AS l FROM m_documents))),
  h AS (SELECT path, i // 3 + 1 AS entry, '2024-01-0' || (i % 7 + 1) AS date, CASE WHEN i % 2 = 0 THEN 'ingest' ELSE 'lint' END AS op, left(x, 20) AS title FROM l WHERE i % 3 = 0),
  t AS (SELECT path, i // 3 + 1 AS entry, string_agg(left(x, 20), '|' ORDER BY i) AS details FROM l WHERE i % 3 <> 0 GROUP BY ALL)
  SELECT path, entry, date, op, title, coalesce(details, '') AS details FROM h LEFT JOIN t USING (path, entry) WHERE op = 'ingest' AND date >= '2024-01-03'""")
def p10(spark, d):
    return P.parse_operation_log(_log(spark, d), op="ingest", since="2024-01-03").withColumn("details", F.array_join("details", "|"))


@register("p11_retag", "SELECT belief_id, CASE WHEN predicate = 'is' AND object IN ('type', 'function') THEN 'code' ELSE 'manual' END AS source_kind FROM (SELECT belief_id, CASE predicate WHEN 'is' THEN 'is' ELSE predicate END AS predicate, CASE length(statement) % 3 WHEN 0 THEN 'type' WHEN 1 THEN 'function' ELSE object END AS object FROM m_beliefs)")
def p11(spark, d):
    rows = M.beliefs(spark, d).withColumns({"predicate": F.when(F.col("predicate") == "is", "is_a").otherwise(F.col("predicate")), "object": F.when(F.length("statement") % 3 == 0, "type").when(F.length("statement") % 3 == 1, "function").otherwise(F.col("object")), "source_kind": F.lit("manual")})
    return P.retag_code_beliefs(rows).select("belief_id", "source_kind")


@register("p12_validate", "SELECT run_id, 'status' AS reason FROM m_runs WHERE status NOT IN ('pending', 'verifying', 'committed', 'rejected', 'abandoned') UNION ALL SELECT o_orderkey AS run_id, 'status' AS reason FROM orders WHERE o_orderstatus NOT IN ('pending')")
def p12(spark, d):
    good, bad = P.validate(M.runs(spark, d), "runs")
    raw = M.given(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))
    return bad.select("run_id", "reason").unionByName(P.validate(raw, "runs")[1].select("run_id", "reason"))


@register("p13_paywalled", "SELECT doc_id FROM m_documents WHERE contains(lower(content), 'subscribe to read') OR contains(lower(content), 'unlock this post') OR doc_id % 7 = 0")
def p13(spark, d):
    docs = M.documents(spark, d)
    marked = docs.withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("\nSubscribe TO read"))).otherwise(F.col("content")))
    return P.paywalled(marked).select("doc_id")


@register("p14_commit_log", f"SELECT {_EVENT} FROM m_events e WHERE regexp_matches(title, '^(error|view) [1-3]') ORDER BY e.occurred_at DESC, event_id LIMIT 50")
def p14(spark, d):
    return _events(P.commit_log(M.events(spark, d), grep="^(error|view) [1-3]"))


@register("p15_anchor_status", "SELECT belief_id, workspace, CASE WHEN len(footnote_ids) > 0 THEN 'has citations' ELSE 'No footnote citations' END AS status FROM m_beliefs WHERE superseded_at IS NULL")
def p15(spark, d):
    return P.anchor_status(M.beliefs(spark, d))


# Aggregates --------------------------------------------------------------------------------------------------------


@register("a1_capability_row", "SELECT (SELECT count(*) FROM m_documents WHERE layer = 'wiki') AS pages, (SELECT count(*) FROM m_beliefs WHERE superseded_at IS NULL) AS beliefs, (SELECT count(DISTINCT topic) FROM m_beliefs WHERE superseded_at IS NULL) AS topics, count(*) FILTER (status = 'committed') AS committed, round(count(*) FILTER (status = 'committed') / count(*) FILTER (status IN ('committed', 'rejected')), 4) AS verified_rate FROM m_runs")
def a1(spark, d):
    return Q.capability_row(M.documents(spark, d), M.beliefs(spark, d), M.runs(spark, d))


@register("a2_percentiles", "SELECT workspace, round(quantile_cont(usd, 0.5), 6) AS p50, round(quantile_cont(usd, 0.95), 6) AS p95 FROM m_runs GROUP BY 1")
def a2(spark, d):
    out = Q.percentile_linear(M.runs(spark, d), "usd", ["workspace"])
    return out.select("workspace", *(F.round(c, 6).alias(c) for c in ("p50", "p95")))


@register("a3_workspace_stats", "WITH a AS (SELECT workspace, count(*) FILTER (layer = 'raw') AS raw_docs, count(*) FILTER (layer = 'wiki') AS wiki_docs, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics FROM m_documents GROUP BY 1), b AS (SELECT workspace, count(*) FILTER (superseded_at IS NULL) AS current_beliefs, count(*) FILTER (superseded_at IS NOT NULL) AS superseded_beliefs FROM m_beliefs GROUP BY 1) SELECT workspace, coalesce(raw_docs, 0) AS raw_docs, coalesce(wiki_docs, 0) AS wiki_docs, topics, coalesce(current_beliefs, 0) AS current_beliefs, coalesce(superseded_beliefs, 0) AS superseded_beliefs FROM a FULL JOIN b USING (workspace)")
def a3(spark, d):
    return Q.workspace_stats(M.documents(spark, d), M.beliefs(spark, d))


@register("a4_topic_density", "SELECT workspace, topic, count(*) AS n FROM m_beliefs WHERE superseded_at IS NULL GROUP BY ALL")
def a4(spark, d):
    return Q.topic_density(M.beliefs(spark, d))


@register("a5_belief_counts", "SELECT workspace, path, count(*) AS n FROM m_beliefs WHERE superseded_at IS NULL GROUP BY ALL")
def a5(spark, d):
    return Q.belief_counts(M.beliefs(spark, d))


_METRICS = {
    "M1": "SELECT workspace, 'M1' AS metric, CASE WHEN count(*) FILTER (superseded_at IS NULL) > 0 THEN count(*) FILTER (superseded_at IS NULL AND len(footnote_ids) > 0) / count(*) FILTER (superseded_at IS NULL) ELSE 1.0 END AS score, 0.8 AS least FROM m_beliefs GROUP BY 1",
    "M2": "SELECT workspace, 'M2' AS metric, CASE WHEN count(*) FILTER (layer = 'raw') > 0 THEN least(1.0, count(*) FILTER (layer = 'wiki') / count(*) FILTER (layer = 'raw')) ELSE 1.0 END AS score, 0.5 AS least FROM m_documents GROUP BY 1",
    "M3": "SELECT workspace, 'M3' AS metric, CASE WHEN count(*) FILTER (status IN ('committed', 'rejected')) > 0 THEN count(*) FILTER (status = 'committed') / count(*) FILTER (status IN ('committed', 'rejected')) ELSE 1.0 END AS score, 0.7 AS least FROM m_runs GROUP BY 1",
    "M4": "SELECT workspace, 'M4' AS metric, greatest(0.0, 1 - sum(usd) / 50) AS score, 1e-12 AS least FROM m_runs GROUP BY 1",
    "M5": "SELECT workspace, 'M5' AS metric, CASE WHEN sum(n * (n - 1)) > 0 THEN sum(k * (k - 1)) / sum(n * (n - 1)) ELSE 1.0 END AS score, 0.6 AS least FROM (SELECT workspace, topic, count(*) AS n, count(subject) AS k FROM m_beliefs WHERE superseded_at IS NULL GROUP BY ALL) GROUP BY 1",
}


def _tables(spark, d):
    return {"beliefs": M.beliefs(spark, d), "documents": M.documents(spark, d), "runs": M.runs(spark, d)}


def _metric(name):
    def run(spark, d):
        return Q.METRICS[name](_tables(spark, d)).withColumn("score", F.round("score", 6))

    return run


for _i, (_m, _sql) in enumerate(_METRICS.items()):
    register(f"a{6 + _i}_metric_{_m.lower()}", f"SELECT workspace, metric, round(score, 6) AS score, score >= least AS passed FROM ({_sql})")(_metric(_m))


@register("a6_metric_m1_sample", "WITH b AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY sha256('s1' || belief_id), belief_id) AS r FROM m_beliefs WHERE superseded_at IS NULL) SELECT w.workspace, 'M1' AS metric, round(CASE WHEN count(belief_id) > 0 THEN count(*) FILTER (len(footnote_ids) > 0) / count(belief_id) ELSE 1.0 END, 6) AS score, CASE WHEN count(belief_id) > 0 THEN count(*) FILTER (len(footnote_ids) > 0) / count(belief_id) ELSE 1.0 END >= 0.8 AS passed FROM (SELECT DISTINCT workspace FROM m_beliefs) w LEFT JOIN b ON b.workspace = w.workspace AND r <= 50 GROUP BY 1")
def a6_sample(spark, d):
    return Q.citation_fidelity(M.beliefs(spark, d), 50, "s1").withColumn("score", F.round("score", 6))


@register("a11_metrics_report", "SELECT workspace, metric, round(score, 6) AS score, score >= least AS passed FROM (" + " UNION ALL ".join(_METRICS.values()) + ")")
def a11(spark, d):
    return Q.metrics_report(_tables(spark, d)).withColumn("score", F.round("score", 6))


@register("a11_synthesis_gate", "WITH l AS (SELECT workspace, arg_max(passed, month) FILTER (metric = 'M1') AS m1, arg_max(passed, month) FILTER (metric = 'M2') AS m2 FROM m_eval_runs GROUP BY 1) SELECT workspace, coalesce(m1, false) AND coalesce(m2, false) AS open, concat_ws(', ', CASE WHEN m1 IS NULL THEN 'M1 missing' WHEN NOT m1 THEN 'M1 failed' END, CASE WHEN m2 IS NULL THEN 'M2 missing' WHEN NOT m2 THEN 'M2 failed' END) AS reasons FROM l")
def a11_gate(spark, d):
    return Q.synthesis_gate(M.eval_runs(spark, d))


_NOPOS = "SELECT * REPLACE (regexp_replace(path, '/[0-9]*([0-9])\\.md$', '/\\1.md') AS path) FROM m_beliefs WHERE superseded_at IS NULL"


@register("a12_dedup_beliefs", f"WITH b AS ({_NOPOS}), r AS (SELECT belief_id, first_value(belief_id) OVER (PARTITION BY workspace, path, statement, coalesce(subject, ''), coalesce(predicate, ''), coalesce(object, '') ORDER BY asserted_at, belief_id) AS kept FROM b) SELECT belief_id, kept AS superseded_by, 'dedup_cleanup' AS reason FROM r WHERE belief_id <> kept")
def a12(spark, d):
    return Q.dedup_beliefs(M.beliefs(spark, d).withColumn("path", F.regexp_replace("path", r"/[0-9]*([0-9])\.md$", "/$1.md")))


@register("a13_events_by_type", "SELECT source_type, event_type, count(*) AS n FROM m_events WHERE ingested_at >= TIMESTAMP '2024-01-10' GROUP BY ALL")
def a13(spark, d):
    return Q.events_by_type(M.events(spark, d), "2024-01-10")


@register("a14_event_rollup", "SELECT source_type, event_type, day, grouping(source_type, event_type, day) AS level, count(*) AS n FROM (SELECT *, strftime(occurred_at, '%Y-%m-%d') AS day FROM m_events) GROUP BY CUBE (source_type, event_type, day)")
def a14(spark, d):
    return Q.event_rollup(M.events(spark, d))


_STATUS = r"""WITH paths AS (SELECT workspace, path, content FROM m_documents), named AS (SELECT workspace, string_split(path, '/')[-1] AS name, min(path) AS path FROM paths WHERE path LIKE 'raw/%' GROUP BY ALL),
  r AS (SELECT f.*, coalesce(e.path, n.path) AS source_path FROM m_footnotes f LEFT JOIN paths e ON f.workspace = e.workspace AND f.source_file = e.path LEFT JOIN named n ON f.workspace = n.workspace AND string_split(f.source_file, '/')[-1] = n.name),
  findings AS (SELECT r.* EXCLUDE (stored_hash), CASE WHEN quote IS NULL OR regexp_replace(quote, '^\s+|\s+$', '', 'g') = '' THEN 'no_quote_provided' WHEN source_path IS NULL THEN 'source_missing' WHEN NOT contains(content, quote) THEN 'quote_not_found' WHEN stored_hash <> sha256(regexp_replace(quote, '^\s+|\s+$', '', 'g')) THEN 'hash_mismatch' ELSE 'verified' END AS status,
    instr(content, quote) - 1 AS pos FROM r LEFT JOIN paths p ON r.workspace = p.workspace AND r.source_path = p.path)"""


def _findings(spark, d):
    return C.verify_citations(M.footnotes(spark, d), M.documents(spark, d))


@register("j7_verify_citations", _STATUS + " SELECT page_path, footnote_id, source_file, source_path, status, CASE WHEN status IN ('verified', 'hash_mismatch') THEN pos END AS \"offset\" FROM findings")
def j7(spark, d):
    return _findings(spark, d).select("page_path", "footnote_id", "source_file", "source_path", "status", "offset")


@register("a15_verify_pages", _STATUS + r""", per AS (SELECT workspace, page_path AS path, string_agg('[^' || footnote_id || '] ' || source_file || ': ' || status, '; ' ORDER BY '[^' || footnote_id || '] ' || source_file || ': ' || status) FILTER (status IN ('hash_mismatch', 'source_missing', 'quote_not_found')) AS bad FROM findings GROUP BY ALL),
  v AS (SELECT p.workspace, p.path, concat_ws('; ', CASE WHEN per.path IS NULL AND string_split(p.path, '/')[-1] NOT IN ('overview.md', 'index.md', 'log.md') THEN 'no footnotes' END, bad, CASE WHEN contains(content, '::: disputed') AND NOT (contains(content, 'Updated ') AND contains(content, ' per ')) THEN 'undated dispute' END) AS reasons FROM m_pages p LEFT JOIN per USING (workspace, path))
  SELECT workspace, path, CASE WHEN reasons = '' THEN 'commit' ELSE 'reject' END AS verdict, reasons FROM v""")
def a15(spark, d):
    return Q.verify_pages(M.pages(spark, d), _findings(spark, d))


@register("a16_directory_sizes", "SELECT dir1, dir2, grouping(dir1, dir2) AS level, count(*) AS files, sum(size)::BIGINT AS size, (sum(size) // 4)::BIGINT AS tokens FROM (SELECT string_split(path, '/')[1] AS dir1, string_split(path, '/')[2] AS dir2, length(content) AS size FROM m_documents) GROUP BY ROLLUP (dir1, dir2)")
def a16(spark, d):
    return Q.directory_sizes(M.documents(spark, d))


def _calls(spark, d):
    li = M.given(spark, d, "lineitem")
    q = F.col("l_quantity").cast("long")
    return li.select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_linenumber") % 2 == 0, "verifier").otherwise("writer").alias("role"), (q * 1000).alias("tokens_in"), (q * 100).alias("tokens_out"), (q * 10).alias("cache_read"), q.alias("cache_write"))


@register("a17_llm_usage", "WITH c AS (SELECT l_orderkey AS run_id, CASE WHEN l_linenumber % 2 = 0 THEN 'verifier' ELSE 'writer' END AS role, l_quantity::BIGINT AS q FROM lineitem), s AS (SELECT run_id, role, sum(q * 1000)::BIGINT AS tokens_in, sum(q * 100)::BIGINT AS tokens_out, sum(q * 10)::BIGINT AS cache_read, sum(q)::BIGINT AS cache_write FROM c GROUP BY ALL), u AS (SELECT *, (tokens_in * 5.0 + tokens_out * 25.0 + cache_read * 0.5 + cache_write * 6.25) / 1e6 AS usd FROM s) SELECT run_id, role, tokens_in, tokens_out, cache_read, cache_write, round(usd, 6) AS usd, sum(usd) OVER (PARTITION BY run_id) > 1 AS over_budget FROM u")
def a17(spark, d):
    return Q.llm_usage(_calls(spark, d), 1.0).withColumn("usd", F.round("usd", 6))


@register("a18_capture_sessions", "SELECT session_id, count(*) AS n, string_agg('**' || role || '**: ' || content, chr(10) || chr(10) ORDER BY seq, role, content) AS content, sha256(string_agg('**' || role || '**: ' || content, chr(10) || chr(10) ORDER BY seq, role, content)) AS content_hash FROM m_messages GROUP BY 1")
def a18(spark, d):
    return Q.capture_sessions(M.messages(spark, d))


@register("a19_topic_index", "SELECT workspace, topic, count(*) AS pages, string_agg(title, ' | ' ORDER BY r) FILTER (r <= 5) AS titles, greatest(count(*) - 5, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY workspace, topic ORDER BY title, path) AS r FROM m_documents) GROUP BY ALL")
def a19(spark, d):
    return Q.topic_index(M.documents(spark, d))


@register("a20_journal_months", "SELECT workspace, strftime(updated_at, '%Y-%m') AS month, count(*) AS n FROM m_documents GROUP BY ALL")
def a20(spark, d):
    return Q.journal_months(M.documents(spark, d))


@register("a22_cascade_coverage", f"""WITH posts AS ({_POSTS}), df AS (SELECT term, count(*) AS df FROM posts GROUP BY 1), n AS (SELECT count(DISTINCT doc_id) AS n FROM posts),
  s AS (SELECT doc_id, workspace, term, tf * ln(n / df) AS tfidf FROM posts JOIN df USING (term), n),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(tfidf, 9) DESC, term) AS rank FROM s) WHERE rank <= 20),
  w AS (SELECT DISTINCT posts.workspace, path, title, term FROM posts JOIN m_documents USING (doc_id) WHERE layer = 'wiki'),
  m AS (SELECT DISTINCT k.workspace, k.doc_id, w.path, w.title FROM k JOIN w USING (workspace, term)),
  per AS (SELECT m.workspace, m.doc_id, count(*) AS matches, count(*) FILTER (m.title = d.title) AS covered FROM m JOIN m_documents d USING (doc_id) GROUP BY ALL)
  SELECT workspace, doc_id, coalesce(matches, 0) AS matches, coalesce(covered, 0) AS covered, round(CASE WHEN matches > 0 THEN covered / matches ELSE 1 END, 6) AS score FROM (SELECT DISTINCT workspace, doc_id FROM k) LEFT JOIN per USING (workspace, doc_id)""")
def a22_coverage(spark, d):
    docs = M.documents(spark, d)
    terms = S.top_terms(S.postings(docs)).join(docs.select("doc_id", "workspace"), "doc_id")
    # An ingest touched the wiki pages of its own title.
    return D.cascade_coverage(terms, docs, docs.select("workspace", "doc_id", "title"), "title").withColumn("score", F.round("score", 6))


@register("a23_gold_query_score", "WITH e AS (SELECT conv_id AS query_id, list_distinct(string_split(min(text), ' ')) AS a, list_distinct(string_split(max(text), ' ')) AS b, list_distinct(string_split(min(text), ' ')[1:3]) AS c FROM conversations GROUP BY 1) SELECT query_id, round((len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))) * (len(list_intersect(c, b)) / len(list_distinct(list_concat(c, b)))), 6) AS score FROM e")
def a23(spark, d):
    m = M.messages(spark, d).groupBy("session_id").agg(F.array_distinct(F.split(F.min("content"), " ")).alias("a"), F.array_distinct(F.split(F.max("content"), " ")).alias("b"), F.array_distinct(F.slice(F.split(F.min("content"), " "), 1, 3)).alias("c"))
    pairs = m.select(F.col("session_id").alias("query_id"), F.col("a").alias("expected_topics"), F.col("b").alias("actual_topics"), F.col("c").alias("expected_citations"), F.col("b").alias("actual_citations"))
    return Q.gold_query_score(pairs).withColumn("score", F.round("score", 6))


@register("a25_sync_report", "SELECT run_id, count(*) AS attempted, count(*) FILTER (errors = 0) AS succeeded, sum(items)::BIGINT AS items, sum(errors)::BIGINT AS errors, count(*) FILTER (errors > 0 AND items = 0) AS failed, CASE WHEN sum(errors) = 0 THEN 'pass' ELSE 'partial' END AS verdict FROM m_source_runs GROUP BY 1")
def a25(spark, d):
    return Q.sync_report(M.source_runs(spark, d))


@register("a26_duplicate_documents", "SELECT workspace, content_hash, count(*) AS n, min(path) AS first_path FROM m_documents GROUP BY ALL HAVING count(*) > 1")
def a26(spark, d):
    return Q.duplicate_documents(M.documents(spark, d))


# Windows -----------------------------------------------------------------------------------------------------------


@register("w1_latest_per_key", "SELECT source_id, source_run_id, started_s FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_s DESC, source_run_id) AS r FROM m_source_runs) WHERE r = 1")
def w1(spark, d):
    return Q.latest_per_key(M.source_runs(spark, d), ["source_id"], [F.desc("started_s"), F.col("source_run_id")]).select("source_id", "source_run_id", "started_s")


@register("w2_assign_slugs", r"""WITH b AS (SELECT workspace, topic, path, coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64), '-+$', ''), ''), 'untitled') AS base FROM m_documents),
  f AS (SELECT *, row_number() OVER (PARTITION BY workspace, topic, base ORDER BY path) AS n FROM b)
  SELECT path, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM f""")
def w2(spark, d):
    return G.assign_slugs(M.documents(spark, d)).select("path", "slug")


@register("w3_read_batch", "SELECT workspace, path, before, substr(content, 1, (120000 - before)::BIGINT) AS content FROM (SELECT workspace, path, content, coalesce(sum(length(content)) OVER (PARTITION BY workspace ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM m_documents WHERE regexp_matches(path, '^wiki/')) WHERE before < 120000")
def w3(spark, d):
    return G.read_batch(M.documents(spark, d), "^wiki/")


@register("w4_first_raw_by_title", "SELECT workspace, title, min(path) AS raw_path FROM m_documents WHERE layer = 'raw' GROUP BY ALL")
def w4(spark, d):
    return G.first_raw_by_title(M.documents(spark, d))


_LINES = "SELECT workspace, topic, path, i - 1 AS line_no, l[i] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, string_split(content, chr(10)) AS l FROM m_pages))"


@register("w5_section_of_line", f"SELECT path, line_no, line, last_value(CASE WHEN regexp_matches(line, '^#{{1,6}} ') THEN regexp_extract(line, '^#{{1,6}} (.*)$', 1) END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM ({_LINES})")
def w5(spark, d):
    return G.section_of_line(M.pages(spark, d))


@register("w6_dedupe_footnotes", f"WITH l AS (SELECT path, line_no, line, lag(line) OVER (PARTITION BY path ORDER BY line_no) AS before FROM (SELECT path, unnest([line_no * 2, line_no * 2 + 1]) AS line_no, unnest([line, CASE WHEN line LIKE '[^%' THEN line END]) AS line FROM ({_LINES})) WHERE line IS NOT NULL) SELECT path, string_agg(line, chr(10) ORDER BY line_no) AS content FROM l WHERE NOT (line LIKE '[^%' AND coalesce(line = before, false)) GROUP BY 1")
def w6(spark, d):
    twice = F.flatten(F.transform(F.split("content", "\n"), lambda x: F.when(x.startswith("[^"), F.array(x, x)).otherwise(F.array(x))))
    return G.dedupe_consecutive_footnotes(M.pages(spark, d).withColumn("content", F.array_join(twice, "\n"))).select("path", "content")


@register("w8_eval_history", "SELECT workspace, metric, month, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY month DESC, metric) AS rank FROM m_eval_runs) WHERE rank <= 20")
def w8(spark, d):
    out = Q.recent_per_key(M.eval_runs(spark, d), ["workspace"], [F.desc("month"), F.col("metric")], 20)
    return out.select("workspace", "metric", "month", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("w8_eval_trend", "SELECT workspace, metric, month, coalesce(round(before - score, 9) > 0.05, false) AS regressed FROM (SELECT *, lag(score) OVER (PARTITION BY workspace, metric ORDER BY month) AS before FROM m_eval_runs)")
def w8_trend(spark, d):
    return Q.eval_trend(M.eval_runs(spark, d)).select("workspace", "metric", "month", "regressed")


@register("w9_recent_per_workspace", "SELECT workspace, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY updated_at DESC, path) AS rank FROM m_documents) WHERE rank <= 10")
def w9(spark, d):
    out = Q.recent_per_key(M.documents(spark, d), ["workspace"], [F.desc("updated_at"), F.col("path")], 10)
    return out.select("workspace", "path", F.col("rank").cast("long").alias("rank"))


# Joins -------------------------------------------------------------------------------------------------------------

#: A later state of the documents: one in five is edited, one in seven is moved, the others are as they were.
_LATER = "SELECT doc_id, workspace, CASE WHEN doc_id % 7 = 0 THEN 'new/' || path ELSE path END AS path, CASE WHEN doc_id % 5 = 0 THEN content || chr(10) || 'edited ' || doc_id ELSE content END AS content FROM m_documents"


def _later(spark, d):
    docs = M.documents(spark, d)
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("\nedited "), F.col("doc_id").cast("string"))).otherwise(F.col("content"))
    path = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("new/"), "path")).otherwise(F.col("path"))
    return docs.withColumns({"content": text, "path": path}).withColumn("content_hash", F.sha2("content", 256))


@register("j1_classify_changes", f"WITH n AS ({_LATER}) SELECT doc_id, CASE WHEN (workspace, sha256(content)) IN (SELECT workspace, content_hash FROM m_documents) THEN 'unchanged' WHEN (workspace, path) IN (SELECT workspace, path FROM m_documents) THEN 'changed' ELSE 'new' END AS change FROM n")
def j1(spark, d):
    return I.classify_changes(M.documents(spark, d), _later(spark, d)).select("doc_id", "change")


@register("j2_diff_lines")
def j2(spark, d):
    old = M.documents(spark, d).select("doc_id", F.col("content").alias("old"))
    pairs = old.join(_later(spark, d).select("doc_id", F.col("content").alias("new")), "doc_id")
    return I.diff_lines(pairs).select("doc_id", "added", "removed")


@register("j2_changed_line_counts", f"WITH p AS (SELECT o.doc_id, list_distinct(string_split(o.content, chr(10))) AS a, list_distinct(string_split(n.content, chr(10))) AS b FROM m_documents o JOIN ({_LATER}) n USING (doc_id)) SELECT doc_id, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS added, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS removed FROM p")
def j2_counts(spark, d):
    old = M.documents(spark, d).select("doc_id", F.col("content").alias("old"))
    pairs = old.join(_later(spark, d).select("doc_id", F.col("content").alias("new")), "doc_id")
    return I.changed_line_counts(pairs).select("doc_id", "added", "removed")


@register("j3_new_items", "WITH b AS (SELECT * FROM m_items UNION ALL SELECT * REPLACE (item_id + 1000000000 AS item_id) FROM m_items), seen AS (SELECT * FROM m_items WHERE status <> 'pending'), r AS (SELECT *, row_number() OVER (PARTITION BY workspace, external_id, content_hash ORDER BY item_id) AS r FROM b WHERE external_id IS NOT NULL) SELECT item_id FROM r WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.workspace = r.workspace AND s.external_id = r.external_id AND s.content_hash = r.content_hash) UNION ALL SELECT item_id FROM b WHERE external_id IS NULL")
def j3(spark, d):
    items = M.items(spark, d)
    batch = items.unionByName(items.withColumn("item_id", F.col("item_id") + 1000000000))
    return I.new_items(batch, items.where("status <> 'pending'"), ["item_id"]).select("item_id")


@register("j4_changed_files", f"SELECT path, sha256(content) AS content_hash FROM ({_LATER}) n WHERE (path, sha256(content)) NOT IN (SELECT path, content_hash FROM m_documents)")
def j4(spark, d):
    return I.changed_files(_later(spark, d).select("path", "content_hash"), M.documents(spark, d))


@register("j8_quote_search", "WITH q AS (SELECT item_id AS quote_id, array_to_string(string_split(text, ' ')[2:2 + item_id % 13], ' ') AS quote FROM benchmark) SELECT quote_id, doc_id, instr(content, quote) - 1 AS \"offset\" FROM q JOIN m_documents ON contains(content, quote)")
def j8(spark, d):
    quotes = M.given(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.array_join(F.slice(F.split("text", " "), F.lit(2), (F.col("item_id") % 13 + 1).cast("int")), " ").alias("quote"))
    return C.quote_search(quotes, M.documents(spark, d))


@register("j9_follow", _STATUS + " SELECT page_path, footnote_id, page_hint, left(p.content, 8000) AS text FROM r LEFT JOIN paths p ON r.workspace = p.workspace AND r.source_path = p.path")
def j9(spark, d):
    return C.follow(M.footnotes(spark, d), M.documents(spark, d)).select("page_path", "footnote_id", "page_hint", "text")


@register("j10_orphaned_beliefs", "SELECT belief_id FROM m_beliefs b WHERE superseded_at IS NULL AND NOT EXISTS (SELECT 1 FROM m_documents p WHERE layer = 'wiki' AND p.workspace = b.workspace AND p.path = b.path)")
def j10(spark, d):
    return C.orphaned_beliefs(M.beliefs(spark, d), M.documents(spark, d).where("layer = 'wiki'")).select("belief_id")


@register("j11_missing_sources", _STATUS + " SELECT page_path, footnote_id, source_file FROM r WHERE source_path IS NULL")
def j11(spark, d):
    return C.missing_sources(M.footnotes(spark, d), M.documents(spark, d)).select("page_path", "footnote_id", "source_file")


@register("j12_belief_neighbors", "WITH h AS (SELECT belief_id FROM m_beliefs) SELECT belief_id, 'successor' AS relation, superseded_by AS other_id FROM m_beliefs WHERE superseded_by IS NOT NULL AND belief_id IN (SELECT * FROM h) UNION ALL SELECT superseded_by, 'predecessor', belief_id FROM m_beliefs WHERE superseded_by IN (SELECT * FROM h)")
def j12(spark, d):
    rows = M.beliefs(spark, d)
    return B.neighbors(rows, rows)


@register("j13_supersession_chains", "WITH b AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY workspace, subject, predicate ORDER BY asserted_at, belief_id) AS r, last_value(belief_id) OVER (PARTITION BY workspace, subject, predicate ORDER BY asserted_at, belief_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id FROM m_beliefs WINDOW w AS (PARTITION BY workspace, subject, predicate)) SELECT belief_id, CASE WHEN subject IS NULL THEN belief_id ELSE last_id END AS last_id, CASE WHEN subject IS NULL THEN 0 ELSE n - r END AS steps FROM b")
def j13(spark, d):
    return B.supersession_chains(M.beliefs(spark, d))


@register("j14_beliefs_as_of", "SELECT belief_id FROM m_beliefs WHERE asserted_at < TIMESTAMP '2024-01-15' AND (superseded_at IS NULL OR superseded_at >= TIMESTAMP '2024-01-15')")
def j14(spark, d):
    return B.as_of(M.beliefs(spark, d), F.lit("2024-01-15").cast("timestamp")).select("belief_id")


@register("j14_beliefs_as_of_points", "WITH p AS (SELECT i AS point_id, TIMESTAMP '2024-01-01' + to_days(i::INT) AS at FROM range(0, 31) t(i)), w AS (SELECT DISTINCT workspace FROM m_beliefs) SELECT point_id, w.workspace, count(b.belief_id) AS n FROM p CROSS JOIN w LEFT JOIN m_beliefs b ON b.workspace = w.workspace AND b.asserted_at < p.at AND (b.superseded_at IS NULL OR b.superseded_at >= p.at) AND (b.superseded_at IS NULL OR b.superseded_at > b.asserted_at) GROUP BY ALL")
def j14_points(spark, d):
    points = spark.range(31).select(F.col("id").alias("point_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * M.DAY).alias("at"))
    return B.as_of_points(M.beliefs(spark, d), points).withColumn("n", F.col("n").cast("long"))


# Points every three days up to a month after the clock, and beliefs some of which were superseded before they were asserted.
@register("j14_beliefs_as_of_each", "WITH p AS (SELECT i AS point_id, TIMESTAMP '2024-01-01' + to_days((3 * i)::INT) AS at FROM range(0, 20) t(i)), b AS (SELECT workspace, belief_id, asserted_at, CASE WHEN ascii(right(belief_id, 1)) % 5 = 0 THEN asserted_at - to_hours(1) ELSE superseded_at END AS superseded_at FROM m_beliefs) SELECT point_id, workspace, belief_id FROM p JOIN b ON asserted_at < p.at AND (superseded_at IS NULL OR superseded_at >= p.at) AND (superseded_at IS NULL OR superseded_at > asserted_at)")
def j14_each(spark, d):
    points = spark.range(20).select(F.col("id").alias("point_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3 * M.DAY).alias("at"))
    turned = F.when(F.ascii(F.right("belief_id", F.lit(1))) % 5 == 0, F.col("asserted_at") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("superseded_at"))
    return B.as_of_each(M.beliefs(spark, d).withColumn("superseded_at", turned), points, days=1)


_INCOMING = "SELECT workspace, path, CASE WHEN length(statement) % 3 = 0 THEN statement || ' again' ELSE statement END AS statement, subject, predicate, object FROM m_beliefs"


@register("j15_merge_beliefs", f"WITH i AS (SELECT DISTINCT * FROM ({_INCOMING})), o AS (SELECT workspace, path, statement, subject, predicate, object, min(belief_id) AS belief_id FROM m_beliefs WHERE superseded_at IS NULL AND (workspace, path) IN (SELECT workspace, path FROM i) GROUP BY ALL) SELECT coalesce(o.workspace, i.workspace) AS workspace, coalesce(o.path, i.path) AS path, coalesce(o.statement, i.statement) AS statement, belief_id, CASE WHEN i.path IS NULL THEN 'supersede' WHEN belief_id IS NULL THEN 'insert' ELSE 'keep' END AS action FROM o FULL JOIN i ON o.workspace = i.workspace AND o.path = i.path AND o.statement = i.statement AND o.subject IS NOT DISTINCT FROM i.subject AND o.predicate IS NOT DISTINCT FROM i.predicate AND o.object IS NOT DISTINCT FROM i.object")
def j15(spark, d):
    rows = M.beliefs(spark, d)
    incoming = rows.withColumn("statement", F.when(F.length("statement") % 3 == 0, F.concat("statement", F.lit(" again"))).otherwise(F.col("statement")))
    return B.merge_beliefs(rows.where("superseded_at IS NULL"), incoming)


_TITLED = "SELECT * REPLACE (left(regexp_extract(title, '^[^ ]+ [^ ]+'), 40) AS title) FROM m_documents"


_EDGED = r"chr(1) || regexp_replace(lower({}), '([^\p{{L}}\p{{N}}_])', chr(1) || '\1' || chr(1), 'g') || chr(1)"


@register("j16_cross_refs", rf"""WITH p AS (SELECT *, {_EDGED.format("content")} AS edged FROM ({_TITLED})), w AS (SELECT DISTINCT workspace, path, unnest(string_split_regex(lower(content), '[^\p{{L}}\p{{N}}]+')) AS word FROM p), t AS (SELECT workspace, path, doc_id, title, {_EDGED.format("title")} AS edged, list_filter(string_split_regex(lower(title), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS ws FROM p WHERE length(title) >= 4),
  c AS (SELECT t.workspace, w.path AS from_path, t.path AS to_path, title, edged, doc_id AS to_id FROM t JOIN w ON w.workspace = t.workspace AND w.word = t.ws[-1] AND w.path <> t.path)
  SELECT c.workspace, from_path, to_path, c.title FROM c JOIN p ON p.workspace = c.workspace AND p.path = from_path WHERE contains(p.edged, c.edged) AND NOT contains(p.content, to_path) AND NOT (contains(p.content, '## See Also') AND contains(p.content, string_split(to_path, '/')[-1]))""")
def j16(spark, d):
    pages = M.documents(spark, d).withColumn("title", F.substring(F.regexp_extract("title", "^[^ ]+ [^ ]+", 0), 1, 40))
    return D.cross_refs(pages, pages)


_TW = f"list_distinct(list_filter(list_transform(regexp_extract_all(title, '[a-zA-Z]{{3,}}'), lambda x: lower(x)), lambda x: NOT list_contains({list(T.TITLE_STOP_WORDS)}, x)))"
# Titles' words with dashes are phrases; their runs of words are added to the postings.
_TITLE_TERMS = r"list_distinct(list_filter(list_transform(list_filter(string_split_regex(regexp_replace(title, '[^a-zA-Z0-9\s-]', ' ', 'g'), '\s+'), lambda x: length(x) > 1 AND NOT list_contains(" + str(list(T.QUERY_STOP_WORDS)) + r", lower(x))), lambda x: trim(regexp_replace(lower(x), '-+', ' ', 'g'))), lambda x: x <> ''))"
_CANDIDATES = f"""qt AS (SELECT workspace, doc_id AS query_id, unnest({_TITLE_TERMS}) AS term FROM m_documents),
  ph AS (SELECT DISTINCT term, string_split(term, ' ') AS parts FROM qt WHERE contains(term, ' ')),
  dw AS (SELECT doc_id, workspace, {_WORDS} AS ws FROM m_documents),
  posts AS ({_POSTS} UNION ALL SELECT doc_id, workspace, dl, term, count(*) AS tf FROM (SELECT doc_id, workspace, len(ws) AS dl, term, ws, parts, unnest(range(1, len(ws) - len(parts) + 2)) AS i FROM dw, ph WHERE list_contains(ws, parts[1]) AND contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || term || ' ')) WHERE ws[i : i + len(parts) - 1] = parts GROUP BY ALL),
  n AS (SELECT count(*) AS n, avg(len({_WORDS})) AS avgdl FROM m_documents), df AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
  weights AS (SELECT doc_id, workspace, term, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM posts JOIN df USING (term), n WHERE term IN (SELECT term FROM qt)),
  ranked AS (SELECT query_id, doc_id, sum(w) AS bm25 FROM weights JOIN qt USING (workspace, term) GROUP BY ALL),
  top AS (SELECT query_id, bm25, d.* FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS r FROM ranked) JOIN m_documents d USING (doc_id) WHERE r <= 15), {_SCORED},
  h AS (SELECT query_id AS doc_id, path, layer, 0.8 * score AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS r FROM scored) WHERE r <= 5),
  v AS (SELECT h.doc_id, h.path, h.score, 2 AS reason FROM h JOIN m_documents d ON d.doc_id = h.doc_id WHERE h.layer = 'wiki' AND d.path <> h.path),
  w AS (SELECT doc_id, workspace, path, layer, {_TW} AS w FROM m_documents), a AS (SELECT doc_id, workspace, path, len(w) AS n, unnest(w) AS word FROM w), b AS (SELECT workspace, path, len(w) AS n, unnest(w) AS word FROM w WHERE layer = 'wiki'),
  t AS (SELECT a.doc_id, b.path, 0.6 + 0.4 * count(*) / least(a.n, b.n) AS score, 1 AS reason FROM a JOIN b USING (workspace, word) WHERE a.path <> b.path GROUP BY a.doc_id, b.path, a.n, b.n HAVING count(*) / least(a.n, b.n) >= 0.3),
  s AS (SELECT workspace, path, subject, row_number() OVER (PARTITION BY workspace, subject ORDER BY asserted_at DESC, belief_id) AS r FROM m_beliefs WHERE superseded_at IS NULL AND subject IS NOT NULL),
  y AS (SELECT DISTINCT workspace, path, subject FROM s WHERE r <= 5 AND path LIKE 'wiki/%'),
  u AS (SELECT DISTINCT d.doc_id, y.path, 0.5 AS score, 3 AS reason FROM m_documents d JOIN s x ON x.workspace = d.workspace AND x.path = d.path JOIN y ON y.workspace = x.workspace AND y.subject = x.subject AND y.path <> x.path),
  c AS (SELECT doc_id, path, arg_min(score, reason) AS score, min(reason) AS reason FROM (SELECT * FROM t UNION ALL SELECT * FROM v UNION ALL SELECT * FROM u) GROUP BY ALL),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, path) AS rank FROM c) WHERE rank <= 5)"""


def _candidates(spark, d):
    docs = M.documents(spark, d)
    return docs, D.candidate_pages(docs, docs, M.beliefs(spark, d), M.now())


@register("j17_candidate_pages", f"WITH {_CANDIDATES} SELECT doc_id, path, round(score, 6) AS score, reason, rank FROM k")
def j17(spark, d):
    return _candidates(spark, d)[1].withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("long")})


@register("t8_plan_cascade", f"WITH {_CANDIDATES}, g AS (SELECT doc_id, list(path ORDER BY rank) AS p, max(score) AS best FROM k WHERE score >= 0.4 GROUP BY 1) SELECT doc_id, CASE WHEN best >= 0.85 THEN 'merge' ELSE 'new_page' END AS action, CASE WHEN best >= 0.85 THEN p[1] END AS target, coalesce(array_to_string(CASE WHEN best >= 0.85 THEN p[2:6] ELSE p[1:5] END, ','), '') AS cross_refs FROM m_documents LEFT JOIN g USING (doc_id)")
def t8(spark, d):
    docs, found = _candidates(spark, d)
    return D.plan_cascade(docs, found)


@register("j18_auto_ingest_queue", "SELECT item_id, epoch(published_at)::BIGINT AS published_at FROM m_items WHERE status = 'pending' AND source_id IN ('s1', 's3', 's5', 's7', 's9')")
def j18(spark, d):
    config = M.items(spark, d).select("source_id").distinct().withColumn("config", F.concat(F.lit('{"auto_ingest": '), F.when(F.substring("source_id", 2, 9).cast("int") % 2 == 1, "true").otherwise("false"), F.lit("}")))
    return seconds(I.auto_ingest_queue(M.items(spark, d), config), "published_at").select("item_id", "published_at")


_SINCE = 904608000  # 1998-09-01


@register("j19_source_sync_summary", f"SELECT s.source_id, name, count(r.source_id) AS runs, coalesce(sum(items), 0)::BIGINT AS items, coalesce(sum(errors), 0)::BIGINT AS errors FROM m_sources s LEFT JOIN m_source_runs r ON s.source_id = r.source_id AND started_s >= {_SINCE} GROUP BY ALL")
def j19(spark, d):
    return E.source_sync_summary(M.sources(spark, d), M.source_runs(spark, d), _SINCE)


@register("j20_recent_errors", f"SELECT source_run_id, name, started_s, errors FROM m_source_runs JOIN m_sources USING (source_id) WHERE started_s >= {_SINCE} AND errors > 0 ORDER BY started_s DESC, source_run_id LIMIT 10")
def j20(spark, d):
    return E.recent_errors(M.sources(spark, d), M.source_runs(spark, d), _SINCE)


@register("j20_slowest_runs", "SELECT source_run_id, name, ended_s - started_s AS seconds FROM m_source_runs JOIN m_sources USING (source_id) ORDER BY seconds DESC, source_run_id LIMIT 10")
def j20_slowest(spark, d):
    return E.slowest_runs(M.sources(spark, d), M.source_runs(spark, d), 0)


@register("j21_journal", f"SELECT w.workspace, w.path, w.title, strftime(w.updated_at, '%Y-%m') AS month, raw_path, coalesce(beliefs, 0) AS beliefs FROM m_documents w LEFT JOIN (SELECT workspace, title, min(path) AS raw_path FROM m_documents WHERE layer = 'raw' GROUP BY ALL) r ON w.workspace = r.workspace AND w.title = r.title LEFT JOIN ({_SUPPORT}) s ON s.workspace = w.workspace AND s.path = w.path WHERE layer = 'wiki'")
def j21(spark, d):
    return G.journal(M.documents(spark, d), M.beliefs(spark, d))


@register("j22_rewrite_links", "SELECT workspace, path, content || chr(10) || '[it](' || CASE WHEN doc_id % 3 = 0 THEN 'topic/' || path ELSE path END || ') and [other](raw/none/' || doc_id || '.md) end' AS content FROM m_documents")
def j22(spark, d):
    docs = M.documents(spark, d)
    linked = docs.withColumn("content", F.concat("content", F.lit("\n[it]("), "path", F.lit(") and [other](raw/none/"), F.col("doc_id").cast("string"), F.lit(".md) end")))
    slugs = docs.where("doc_id % 3 = 0").select("workspace", F.col("path").alias("old"), F.concat(F.lit("topic/"), "path").alias("new"))
    return G.rewrite_links(linked, slugs)


@register("j23_requeue_captures", "WITH c AS (SELECT session_id, sha256(string_agg('**' || role || '**: ' || content, chr(10) || chr(10) ORDER BY seq, role, content)) AS h FROM m_messages GROUP BY 1) SELECT session_id, CASE WHEN session_id % 3 = 0 OR session_id % 4 = 0 OR session_id % 5 = 0 THEN 'queue' ELSE 'skip' END AS action FROM c")
def j23(spark, d):
    now = Q.capture_sessions(M.messages(spark, d))
    queue = now.where("session_id % 3 > 0").select("session_id", F.when(F.col("session_id") % 4 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("session_id") % 5 == 0, "failed").otherwise("done").alias("status"))
    return I.requeue_captures(queue, now)


@register("j24_footnote_coverage", "WITH c AS (SELECT DISTINCT workspace, path, unnest(footnote_ids) AS footnote_id FROM m_beliefs), f AS (SELECT DISTINCT workspace, page_path AS path, footnote_id FROM m_footnotes) SELECT *, 'no belief' AS gap FROM (SELECT * FROM f EXCEPT SELECT * FROM c) UNION ALL SELECT *, 'no footnote' AS gap FROM (SELECT * FROM c EXCEPT SELECT * FROM f)")
def j24(spark, d):
    return B.footnote_coverage(M.beliefs(spark, d), M.footnotes(spark, d))


@register("j25_apply_supersessions", f"WITH p AS (SELECT belief_id, 'revised ' || belief_id AS statement FROM m_beliefs WHERE superseded_at IS NULL) SELECT b.belief_id, b.statement, CASE WHEN p.belief_id IS NOT NULL THEN epoch({M.NOW_SQL}) ELSE epoch(superseded_at) END::BIGINT AS superseded_at, CASE WHEN p.belief_id IS NOT NULL THEN b.belief_id || '-r' ELSE superseded_by END AS superseded_by FROM m_beliefs b LEFT JOIN p USING (belief_id) UNION ALL SELECT belief_id || '-r', statement, NULL, NULL FROM p")
def j25(spark, d):
    rows = M.beliefs(spark, d)
    pairs = rows.where("superseded_at IS NULL").select("belief_id", F.concat(F.lit("revised "), "belief_id").alias("statement"), F.lit("better").alias("reason"))
    return seconds(B.apply_supersessions(rows, pairs, M.now())[0], "superseded_at").select("belief_id", "statement", "superseded_at", "superseded_by")


@register("j26_supersede_documents", f"SELECT belief_id, CASE WHEN superseded_at IS NULL THEN epoch({M.NOW_SQL}) ELSE epoch(superseded_at) END::BIGINT AS superseded_at, CASE WHEN superseded_at IS NULL THEN 'gone' END AS reason FROM m_beliefs")
def j26(spark, d):
    rows = M.beliefs(spark, d)
    return seconds(B.supersede_documents(rows, M.documents(spark, d), M.now(), "gone"), "superseded_at").select("belief_id", "superseded_at", "reason")


@register("j27_new_notes", r"SELECT doc_id FROM m_documents n WHERE (workspace, sha256(regexp_replace(content, '^\s+|\s+$', '', 'g'))) NOT IN (SELECT workspace, sha256(regexp_replace(content, '^\s+|\s+$', '', 'g')) FROM m_documents WHERE layer = 'wiki')")
def j27(spark, d):
    docs = M.documents(spark, d)
    known = docs.where("layer = 'wiki'").select("workspace", F.concat(F.lit('{"body_hash": "'), T.quote_hash(F.col("content")), F.lit('"}')).alias("metadata"))
    return I.new_notes(docs.select("doc_id", "workspace", F.concat(F.lit("\n "), "content").alias("body")), known).select("doc_id")


# Sets --------------------------------------------------------------------------------------------------------------

_DIGEST = f"""WITH e AS (SELECT workspace, 'event' AS kind, row_number() OVER (PARTITION BY workspace ORDER BY occurred_at DESC, event_id) AS rank, floor(epoch(occurred_at))::BIGINT AS at_s, title FROM m_events WHERE epoch(occurred_at) >= epoch({M.NOW_SQL}) - 604800 AND occurred_at <= {M.NOW_SQL}),
  b AS (SELECT workspace, 'belief' AS kind, row_number() OVER (PARTITION BY workspace ORDER BY asserted_at DESC, belief_id) AS rank, epoch(asserted_at)::BIGINT AS at_s, statement AS title FROM m_beliefs WHERE superseded_at IS NULL AND asserted_at >= {M.NOW_SQL} - INTERVAL 7 DAY AND asserted_at <= {M.NOW_SQL}),
  i AS (SELECT workspace, 'item' AS kind, row_number() OVER (PARTITION BY workspace ORDER BY published_at DESC, item_id) AS rank, epoch(published_at)::BIGINT AS at_s, title FROM m_items WHERE published_at >= {M.NOW_SQL} - INTERVAL 7 DAY AND published_at <= {M.NOW_SQL}),
  x AS (SELECT * FROM e WHERE rank <= 100 UNION ALL SELECT * FROM b WHERE rank <= 50 UNION ALL SELECT * FROM i WHERE rank <= 50)"""


def _digest(spark, d):
    return E.digest_items(M.events(spark, d), M.beliefs(spark, d), M.items(spark, d), M.now())


@register("u1_digest_items", _DIGEST + " SELECT * FROM x")
def u1(spark, d):
    return _digest(spark, d).withColumn("rank", F.col("rank").cast("long"))


@register("u2_digest_text", _DIGEST + " SELECT workspace, kind, string_agg('- ' || strftime(make_timestamp(at_s * 1000000), '%Y-%m-%d') || ' ' || title, chr(10) ORDER BY rank) AS text FROM x WHERE rank <= CASE kind WHEN 'event' THEN 20 ELSE 15 END GROUP BY ALL")
def u2(spark, d):
    return E.digest_text(_digest(spark, d))


@register("u3_graph_nodes", "SELECT belief_id AS id, 'belief' AS kind, left(statement, 80) AS label FROM m_beliefs WHERE superseded_at IS NULL UNION ALL SELECT DISTINCT 'topic:' || topic, 'topic', topic FROM m_beliefs WHERE superseded_at IS NULL")
def u3(spark, d):
    return B.graph(M.beliefs(spark, d))[0]


@register("u3_graph_edges", "SELECT belief_id AS src, 'topic:' || topic AS dst, 'in_topic' AS kind FROM m_beliefs UNION ALL SELECT superseded_by, belief_id, 'supersedes' FROM m_beliefs WHERE superseded_by IS NOT NULL")
def u3_edges(spark, d):
    return B.graph(M.beliefs(spark, d), include_superseded=True)[1]


@register("u4_lint", _STATUS + rf""" SELECT workspace, path, 'warning' AS severity, 'nearly empty' AS issue FROM m_pages WHERE length(content) < 400 UNION ALL SELECT workspace, path, 'info', 'no citations' FROM m_pages WHERE (workspace, path) NOT IN (SELECT workspace, page_path FROM m_footnotes)
  UNION ALL SELECT workspace, page_path, 'error', 'missing source' FROM findings WHERE status = 'source_missing' UNION ALL SELECT workspace, page_path, 'error', 'drifted quote' FROM findings WHERE status IN ('quote_not_found', 'hash_mismatch')
  UNION ALL SELECT b.workspace, b.path, 'warning', 'orphan belief' FROM m_beliefs b WHERE superseded_at IS NULL AND (workspace, path) NOT IN (SELECT workspace, path FROM m_pages)""")
def u4(spark, d):
    return C.lint(M.pages(spark, d), _findings(spark, d), M.beliefs(spark, d), least=400)


@register("u6_snapshot_diff", f"WITH o AS (SELECT path, content_hash AS h FROM m_documents), n AS (SELECT path, sha256(content) AS h FROM ({_LATER})) SELECT *, 'added' AS side FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT *, 'kept' FROM (SELECT * FROM o INTERSECT SELECT * FROM n)")
def u6(spark, d):
    pick = lambda df: df.select("path", F.col("content_hash").alias("h"))
    return I.snapshot_diff(pick(M.documents(spark, d)), pick(_later(spark, d)))


# Sources, sinks, extraction ----------------------------------------------------------------------------------------


_FILE = "CASE doc_id % 5 WHEN 0 THEN 'Docs/a/' WHEN 1 THEN 'README' WHEN 2 THEN 'src/docs/' WHEN 3 THEN '' ELSE 'lib/x/' END || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.py' END"


@register("s2_docs_scope", f"SELECT path FROM (SELECT {_FILE} AS path FROM documents) WHERE starts_with(path, 'Docs/') OR starts_with(path, 'README') OR NOT contains(path, '/') AND path LIKE '%.md'")
def s2(spark, d):
    return I.docs_scope(M.given(spark, d, "documents").select(F.expr(_FILE).alias("path")))


_TYPED = {
    "documents": "doc_id long, text string, lang string, source string",
    "pages": "page_id long, url string, html string",
    "events": "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
    "conversations": "conv_id long, turn long, role string, text string",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
}
_FIRSTS = {name: [c.split()[0] for c in ddl.split(", ")] for name, ddl in _TYPED.items()}


@register("s3_read_tables", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, " + " + ".join(f"count({c})" for c in columns) + f" AS filled, sum({columns[0]})::BIGINT AS ids FROM {n}" for n, columns in _FIRSTS.items()))
def s3(spark, d):
    tables = read_tables(spark, d, _TYPED, ".parquet")
    told = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n"), sum((F.count(c) for c in t.columns), F.lit(0)).alias("filled"), F.sum(t.columns[0]).alias("ids")) for n, t in tables.items()]
    return reduce(DataFrame.unionByName, told)


@register("s12_upsert_documents", f"WITH n AS (SELECT doc_id, workspace, path, sha256(content) AS content_hash, TIMESTAMP '2024-01-20' AS updated_at, 1 AS o FROM ({_LATER})), x AS (SELECT doc_id, workspace, path, content_hash, updated_at, 0 AS o FROM m_documents UNION ALL SELECT * FROM n) SELECT path, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY workspace, path ORDER BY updated_at DESC, o DESC) AS r FROM x) WHERE r = 1")
def s12(spark, d):
    later = _later(spark, d).withColumn("updated_at", F.lit("2024-01-20").cast("timestamp"))
    return I.upsert_documents(M.documents(spark, d), later).select("path", "content_hash")


@register("s14_maps_of_content", "SELECT workspace, topic, '# ' || topic || chr(10) || chr(10) || string_agg('- [' || title || '](' || path || ')', chr(10) ORDER BY title, path) AS content FROM m_documents WHERE layer = 'wiki' GROUP BY workspace, topic")
def s14(spark, d):
    return G.maps_of_content(M.documents(spark, d))


@register("s14_export_pages", "SELECT workspace, topic, path, '---' || chr(10) || 'title: ' || title || chr(10) || 'aliases: []' || chr(10) || 'tags: [' || topic || ']' || chr(10) || '---' || chr(10) || chr(10) || content AS content FROM m_documents WHERE layer = 'wiki'")
def s14_pages(spark, d):
    return G.export_pages(M.documents(spark, d))


@register("s15_url_sources", r"SELECT 'raw/web/' || page_id || '.md' AS path, regexp_extract('Source: ' || url || chr(10) || html, '(https?://[^\s)>""]+)', 1) AS url, epoch(TIMESTAMP '2024-01-01' + to_seconds(page_id)) ::BIGINT AS updated_at FROM pages WHERE page_id % 2 = 0".replace('""', '"'))
def s15(spark, d):
    p = M.given(spark, d, "pages")
    docs = p.select(F.concat(F.when(F.col("page_id") % 2 == 0, "raw/web/").otherwise("raw/x/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("Source: "), "url", F.lit("\n"), "html").alias("content"), F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")).alias("updated_at"))
    return seconds(I.url_sources(docs), "updated_at")


@register("t7_rank_artifacts", r"""WITH u AS (SELECT DISTINCT regexp_replace(regexp_extract_all('see ' || url || ').', '(https?://[^\s<>"'')\]]+)')[1], '[.,;:!?)}\]''"]+$', '') AS url FROM pages UNION SELECT DISTINCT 'https://arxiv.org/abs/2401.' || (10000 + page_id) FROM pages UNION SELECT DISTINCT 'https://github.com/o' || page_id || '/repo' FROM pages),
  h AS (SELECT url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS domain FROM u WHERE length(url) >= 20)
  SELECT url, CASE WHEN domain = 'arxiv.org' THEN 'paper' WHEN domain = 'github.com' THEN 'repo' WHEN url LIKE '%.pdf' THEN 'pdf' ELSE 'page' END AS kind, CASE WHEN domain = 'arxiv.org' THEN 95 WHEN domain = 'github.com' THEN 83 ELSE 30 END AS priority, domain FROM h WHERE NOT contains(url, '/api/') AND NOT contains(url, '/docs/')""")
def t7(spark, d):
    n = F.col("page_id").cast("string")
    text = F.concat(F.lit("see "), "url", F.lit("). and https://arxiv.org/pdf/2401."), (F.col("page_id") + 10000).cast("string"), F.lit("v2, https://github.com/o"), n, F.lit("/repo."))
    return E.rank_artifacts(M.given(spark, d, "pages").select(text.alias("content")))


_PLINES = r"""WITH l AS (SELECT workspace, topic, path, pos, line, regexp_matches(line, '^#{1,6}\s+\S') AS head FROM (SELECT workspace, topic, path, i - 1 AS pos, l[i] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, string_split(content, chr(10)) AS l FROM m_pages)))),
  s AS (SELECT *, last_value(CASE WHEN head THEN regexp_replace(regexp_extract(line, '^#{1,6}\s+(.+)$', 1), '^\s+|\s+$', '', 'g') END IGNORE NULLS) OVER (PARTITION BY workspace, path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM l),
  x AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(line, '\[\^(\d+)\]', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS whole, list_sort(list_distinct(regexp_extract_all(line, '\[\^(\d+)\]', 1))) AS ids FROM s WHERE NOT head AND regexp_matches(line, '\[\^(\d+)\]') AND NOT starts_with(line, '[^')),
  e AS (SELECT workspace, topic, path, pos, left(whole, 500) AS statement, whole, regexp_replace(regexp_replace(regexp_replace(lower(section), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '^-+|-+$', '', 'g') AS section, array_to_string(ids, ',') AS footnote_ids FROM x WHERE length(whole) >= 10)"""


@register("x1_extract_beliefs", _PLINES + f", b AS (SELECT * REPLACE (whole AS statement) FROM e) SELECT path, pos, left(statement, 500) AS statement, section, footnote_ids, {M._spo_sql(1, 100)} AS subject, {M._spo_sql(2, 100)} AS predicate, {M._spo_sql(3, 200)} AS object FROM b")
def x1(spark, d):
    return B.extract_beliefs(M.pages(spark, d)).select("path", "pos", "statement", "section", F.array_join("footnote_ids", ",").alias("footnote_ids"), "subject", "predicate", "object")


@register("x2_rebuild_beliefs", _PLINES + " SELECT workspace, path, statement FROM m_beliefs WHERE path LIKE 'wiki/%' UNION ALL SELECT workspace, path, statement FROM e WHERE (workspace, path) NOT IN (SELECT workspace, path FROM m_beliefs WHERE path LIKE 'wiki/%')")
def x2(spark, d):
    return B.rebuild_beliefs(M.pages(spark, d), M.beliefs(spark, d).where("path LIKE 'wiki/%'")).select("workspace", "path", "statement")


def _sources(spark, d):
    """Source files made of the documents: each text as a comment, and a Python or Rust declaration named after it."""
    i = F.col("doc_id").cast("string")
    lines = F.split(F.regexp_replace("content", r"[\r\f\x0b\x00\x85\u2028\u2029]", " "), "\n")
    comment = lambda mark: F.array_join(F.transform(lines, lambda x: F.concat(F.lit(mark), x)), "\n")
    py = F.concat(comment("# "), F.lit("\nimport os\nclass A"), i, F.lit(":\n    def inner(self): pass\ndef f"), i, F.lit("(): pass\n"), F.when(F.col("doc_id") % 10 == 0, "def broken(:\n").otherwise(""))
    rs = F.concat(comment("// "), F.lit("\nuse std::fmt;\npub struct A"), i, F.lit(" {}\nfn f"), i, F.lit("() {}\n"))
    even = F.col("doc_id") % 2 == 0
    return M.documents(spark, d).select("workspace", F.concat(F.lit("src/"), i, F.when(even, ".py").otherwise(".rs")).alias("path"), F.when(even, py).otherwise(rs).alias("content"))


_STRUCT = "SELECT 'src/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.rs' END AS path, CASE WHEN doc_id % 2 = 0 THEN 'python' ELSE 'rust' END AS language, CASE WHEN doc_id % 10 > 0 THEN 'A' || doc_id END AS types, CASE WHEN doc_id % 10 > 0 THEN 'f' || doc_id END AS functions, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 'os' ELSE 'std::fmt' END AS imports FROM m_documents"


@register("x3_code_structure", _STRUCT)
def x3(spark, d):
    return E.code_structure(_sources(spark, d)).select("path", "language", *(F.array_join(c, ",").alias(c) for c in ("types", "functions", "imports")))


@register("x4_code_beliefs", f"WITH s AS ({_STRUCT}) SELECT path, 'Defines type ' || types AS statement, types AS subject, 'is_a' AS predicate, 'type' AS object FROM s WHERE types IS NOT NULL UNION ALL SELECT path, 'Defines function ' || functions, functions, 'is_a', 'function' FROM s WHERE functions IS NOT NULL UNION ALL SELECT path, 'Module depends on ' || imports, 'Module', 'depends_on', imports FROM s WHERE imports IS NOT NULL")
def x4(spark, d):
    return E.code_beliefs(E.code_structure(_sources(spark, d)), "code").select("path", "statement", "subject", "predicate", "object")


@register("x5_ingest_pages")
def x5(spark, d):
    return I.ingest_pages(M.pages(spark, d))


@register("x5_ingest_code", f"""WITH s AS ({_STRUCT}), t AS (SELECT 'src/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.rs' END AS path, workspace FROM m_documents WHERE doc_id % 10 > 0),
  n AS (SELECT workspace, path, regexp_extract(path, '[^/]+$') AS name, language, types, functions, imports FROM t JOIN s USING (path))
  SELECT workspace, path, name || ' (' || language || ')' AS title, '# ' || name || ' (' || language || ')' || chr(10) || chr(10) || '> Source: ' || path || chr(10) || chr(10) || '### Imports' || chr(10) || chr(10) || '`' || imports || '`' || chr(10) || chr(10) || '### Types' || chr(10) || chr(10) || '- `' || types || '`' || chr(10) || chr(10) || '### Functions' || chr(10) || chr(10) || '- `' || functions || '` [^1]' || chr(10) || chr(10) || '[^1]: ' || path || ' — "' || name || '"' AS page FROM n""")
def x5_code(spark, d):
    pages = I.ingest_pages(_sources(spark, d))
    return pages.where("title LIKE '% (python)' OR title LIKE '% (rust)'")


@register("r9_sweep_stale", f"SELECT run_id, CASE WHEN status = 'pending' AND started_at < {M.NOW_SQL} - INTERVAL 1 DAY THEN 'abandoned' ELSE status END AS status FROM m_runs")
def r9(spark, d):
    from kbspark.streaming.jobs import sweep_stale

    return sweep_stale(M.runs(spark, d), M.now(), 86400).select("run_id", "status")


# Functions ---------------------------------------------------------------------------------------------------------


@register("f1_tokenize", f"SELECT doc_id, len({_WORDS}) AS n, array_to_string({_WORDS}, ' ') AS words FROM m_documents")
def f1(spark, d):
    return S.bag(M.documents(spark, d)).select("doc_id", F.size("words").cast("long").alias("n"), F.array_join("words", " ").alias("words"))


@register("f2_query_terms", f"SELECT query_id, string_agg(term, ' ' ORDER BY term) AS terms FROM ({_QTERMS}) GROUP BY 1")
def f2(spark, d):
    return M.searches(spark, d).select("query_id", F.array_join(F.array_sort(T.query_terms(F.col("query"))), " ").alias("terms"))


@register("f3_footnotes", "SELECT page_path, footnote_id, source_file, page_hint, quote FROM m_footnotes")
def f3(spark, d):
    return M.footnotes(spark, d).select("page_path", "footnote_id", "source_file", "page_hint", "quote")


@register("f4_hashes", r"SELECT doc_id, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS quote_hash, sha256(text) AS content_hash FROM documents")
def f4(spark, d):
    return M.given(spark, d, "documents").select("doc_id", T.quote_hash(F.col("text")).alias("quote_hash"), T.content_hash(F.col("text")).alias("content_hash"))


@register("f6_title", r"""WITH h AS (SELECT path, i, regexp_replace(regexp_replace(x, '^#+', ''), '^\s+|\s+$', '', 'g') AS h FROM (SELECT path, i, regexp_replace(l[i], '^\s+|\s+$', '', 'g') AS x FROM (SELECT path, l, unnest(range(1, least(len(l), 50) + 1)) AS i FROM (SELECT path, string_split(regexp_replace(content, '^\s+|\s+$', '', 'g'), chr(10)) AS l FROM m_pages))) WHERE starts_with(x, '# ') AND length(x) > 3),
  k AS (SELECT * FROM h WHERE h <> '' AND NOT starts_with(h, '-') AND NOT starts_with(h, '[')), b AS (SELECT path, arg_min(h, i) FILTER (starts_with(lower(h), 'title:')) AS named, arg_max(h, length(h) * 100 - i) AS longest FROM k GROUP BY 1)
  SELECT path, coalesce(regexp_replace(substr(named, 7), '^\s+|\s+$', '', 'g'), longest) AS title FROM m_pages LEFT JOIN b USING (path)""")
def f6(spark, d):
    return M.pages(spark, d).select("path", T.title(F.col("content")).alias("title"))


@register("f7_body")
def f7(spark, d):
    return M.pages(spark, d).select("path", I.body_of(F.col("content")).alias("body"))


@register("f8_quote", r"""WITH l AS (SELECT path, i, regexp_replace(l[i], '^\s+|\s+$', '', 'g') AS x FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, string_split(regexp_replace(content, '^\s+|\s+$', '', 'g'), chr(10)) AS l FROM m_pages))), f AS (SELECT path, arg_min(x, i) AS x FROM l WHERE length(x) > 30 AND x[1] NOT IN ('#', '>', '[') GROUP BY 1)
  SELECT path, CASE WHEN length(x) <= 100 THEN x WHEN instr(substr(x, 61), '.') > 0 THEN left(x, 60 + instr(substr(x, 61), '.')) ELSE left(x, 100) END AS quote FROM m_pages LEFT JOIN f USING (path)""")
def f8(spark, d):
    return M.pages(spark, d).select("path", T.representative_quote(F.col("content")).alias("quote"))


@register("f9_preview", r"""WITH l AS (SELECT path, list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS r FROM m_pages),
  h AS (SELECT path, r, coalesce(list_position(list_transform(r, lambda x: starts_with(x, '# ')), true), 0) AS h1 FROM l),
  p AS (SELECT path, CASE WHEN h1 > 0 THEN replace(string_split(regexp_replace(array_to_string(list_filter(r[h1 + 1:], lambda x: NOT (starts_with(x, '>') OR starts_with(x, '#'))), chr(10)), '^\s+|\s+$', '', 'g'), chr(10) || chr(10))[1], chr(10), ' ') ELSE '' END AS t FROM h)
  SELECT path, left(t, 240) || CASE WHEN length(t) > 240 THEN '…' ELSE '' END AS preview FROM p""")
def f9(spark, d):
    return M.pages(spark, d).select("path", G.preview(F.col("content")).alias("preview"))


@register("f10_slugs", r"SELECT doc_id, coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64), '-+$', ''), ''), 'untitled') AS slug, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') AS word_slug FROM m_documents")
def f10(spark, d):
    t = F.col("title")
    return M.documents(spark, d).select("doc_id", T.slug(t).alias("slug"), T.word_slug(t).alias("word_slug"))


@register("f11_html_title", "SELECT item_id, title FROM m_items")
def f11(spark, d):
    return M.items(spark, d).select("item_id", "title")


@register("f12_html_main_text")
def f12(spark, d):
    from kbspark.functions.html import main_markdown

    return M.given(spark, d, "pages").select("page_id", main_markdown(F.col("html")).alias("markdown"))


@register("f13_strip_chrome", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<img[^>]+(?:width|height)\s*=\s*[""'']?1[""'']?[^>]*>', '', 'g'), '(?is)<[^>]*(?:unsubscribe|manage.preferences|opt.out)[^>]*>.*?</[^>]+>', '', 'g'), '(?is)<[^>]*(?:view.in.browser|view.online|read.online)[^>]*>.*?</[^>]+>', '', 'g') || 'click' AS html FROM (SELECT page_id, html || CASE WHEN page_id % 2 = 0 THEN '<a href="unsubscribe">x</a>' ELSE '<img width="1">' END AS html FROM pages)""".replace('""', '"'))
def f13(spark, d):
    html = F.concat("html", F.when(F.col("page_id") % 2 == 0, '<a href="unsubscribe">x</a>').otherwise('<img width="1">'), F.lit("[click](javascript:go)"))
    return M.given(spark, d, "pages").select("page_id", T.strip_dangerous_links(T.strip_email_chrome(html)).alias("html"))


def _redact_sql(column: str) -> str:
    for p, keep in (*T.SECRET_PATTERNS, (r'(token = ")[0-9a-f]{40}', True)):
        quoted = p.replace("'", "''")
        column = f"regexp_replace({column}, '{quoted}', '{chr(92) + '1' if keep else ''}{T.REDACTED}', 'g')"
    return column


@register("f14_redact", f"SELECT doc_id, {_redact_sql('text')} AS text FROM documents")
def f14(spark, d):
    return M.given(spark, d, "documents").select("doc_id", T.redact(F.col("text"), ((r'(token = ")[0-9a-f]{40}', True),)).alias("text"))


@register("f15_source_kind", "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'conversation' WHEN doc_id % 6 = 1 THEN 'paper' WHEN doc_id % 6 = 2 THEN 'code' WHEN doc_id % 6 = 3 THEN 'paper' WHEN doc_id % 6 = 4 THEN 'web' ELSE 'manual' END AS kind, doc_id % 6 = 0 AS ai FROM documents")
def f15(spark, d):
    names = ["raw/conversations/x.md", "raw/web/arxiv.org-1.md", "src/Main.PY", "x.pdf", "raw/web/page.html", "notes/a.txt"]
    path = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 6 + 1).cast("int"))
    return M.given(spark, d, "documents").select("doc_id", T.source_kind(path).alias("kind"), T.ai_authored(path).alias("ai"))


_KIND = r"""CASE WHEN contains(p, 'conversations/') THEN 'conversation' WHEN contains(p, 'arxiv.org') OR contains(p, 'openreview.net') OR contains(p, 'proceedings.') OR contains(p, 'semanticscholar.org') THEN 'paper'
  WHEN regexp_matches(p, '[^/]\.(py|ts|js|rs|go|tf|yml|yaml)$') THEN 'code' WHEN regexp_matches(p, '[^/]\.pdf$') THEN 'paper' WHEN contains(p, 'raw/web/') THEN 'web' WHEN regexp_matches(p, '[^/]\.(md|txt|rst)$') THEN 'manual' ELSE 'unknown' END"""


# Paths of the documents, and of the pages under the addresses that they came from.
@register("f15_source_kind_paths", f"SELECT path, {_KIND} AS kind FROM (SELECT path, lower(path) AS p FROM (SELECT path FROM m_documents UNION ALL SELECT CASE WHEN page_id % 2 = 0 THEN 'raw/web/' ELSE '' END || url FROM pages))")
def f15_paths(spark, d):
    pages = M.given(spark, d, "pages").select(F.concat(F.when(F.col("page_id") % 2 == 0, "raw/web/").otherwise(""), "url").alias("path"))
    return M.documents(spark, d).select("path").unionByName(pages).select("path", T.source_kind(F.col("path")).alias("kind"))


@register("f16_topics", "SELECT path, string_split(path, '/')[2] AS topic, 'repo' || CASE WHEN string_split(path, '/')[1] IN ('src') THEN '' ELSE '/' || string_split(path, '/')[1] END AS repo_topic FROM m_documents")
def f16(spark, d):
    p = F.col("path")
    return M.documents(spark, d).select("path", T.topic_of_file(p).alias("topic"), T.topic_in_repository(p, F.lit("repo-1a2b")).alias("repo_topic"))


@register("f17_spo", "SELECT belief_id, subject, predicate, object FROM m_beliefs")
def f17(spark, d):
    return M.beliefs(spark, d).select("belief_id", "subject", "predicate", "object")


@register("f18_scores", f"SELECT doc_id, round(exp(-(epoch({M.NOW_SQL}) - epoch(updated_at)) / 3600 * ln(2) / 168), 6) AS recency, round(least(1, ln(1 + doc_id % 9) / ln(6)), 6) AS support FROM m_documents")
def f18(spark, d):
    return M.documents(spark, d).select("doc_id", F.round(T.recency(F.col("updated_at"), M.now()), 6).alias("recency"), F.round(T.belief_score(F.col("doc_id") % 9), 6).alias("support"))


@register("f20_title_overlap", f"WITH w AS (SELECT doc_id, {_TW} AS w, {_TW.replace('title', 'content')} AS v FROM m_documents) SELECT doc_id, round(CASE WHEN least(len(w), len(v)) > 0 THEN len(list_intersect(w, v)) / least(len(w), len(v)) ELSE 0 END, 6) AS overlap FROM w")
def f20(spark, d):
    return M.documents(spark, d).select("doc_id", F.round(T.title_overlap(F.col("title"), F.col("content")), 6).alias("overlap"))


@register("f22_urls", r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'v' || page_id WHEN page_id % 3 = 1 THEN 'w' || page_id END AS video, coalesce(nullif(left(regexp_replace(lower(replace(host, 'www.', '') || '-' || replace(regexp_replace(path, '^/+|/+$', '', 'g'), '/', '-')), '[^a-z0-9-]', '', 'g'), 80), ''), 'page') AS slug FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)""")
def f22(spark, d):
    n = F.col("page_id").cast("string")
    video = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.youtube.com/watch?a=1&v=v"), n)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://youtu.be/w"), n, F.lit("/x"))).otherwise(F.col("url"))
    return M.given(spark, d, "pages").select("page_id", T.youtube_id(video).alias("video"), T.url_slug(F.col("url")).alias("slug"))


@register("f24_event_markdown", "SELECT event_id, '# ' || title || chr(10) || '- author: ' || author || chr(10) || '- date: ' || strftime(occurred_at, '%Y-%m-%d %H:%M:%S') || chr(10) || chr(10) || event_type AS text FROM m_events")
def f24(spark, d):
    e = M.events(spark, d)
    return e.select("event_id", T.event_markdown(F.col("title"), F.col("author"), F.lit(""), F.col("occurred_at"), F.col("event_type")).alias("text"))


@register("f25_render")
def f25(spark, d):
    c = F.col("content")
    merged = G.render_merge(c, F.lit("Details"), F.lit("An addition."))
    hedged = G.render_hedge(c, F.concat(F.lit("Claim "), F.col("doc_id").cast("string")), F.lit("not so"), F.lit("2024-01-02"), F.col("path"))
    return M.pages(spark, d).select("path", merged.alias("merged"), hedged.alias("hedged"), G.render_cross_ref(c, F.col("title"), F.col("path")).alias("linked"), G.render_new_page(F.col("title"), c, F.array("path")).alias("made"))


@register("f26_pdf_text", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text || chr(10) || chr(10) || chr(10) || 'a hy- ' || chr(10) || ' phen', '\n{3,}', chr(10) || chr(10), 'g'), '([a-zA-Z0-9_])-\s*\n\s*([a-zA-Z0-9_])', '\1\2', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents")
def f26(spark, d):
    return M.given(spark, d, "documents").select("doc_id", T.clean_pdf_text(F.concat("text", F.lit("\n\n\na hy- \n phen"))).alias("text"))


@register("f27_progress", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN round(100.0 * (o_orderkey % 5) / (o_orderkey % 7), 1) ELSE 0.0 END::DOUBLE AS pct FROM orders")
def f27(spark, d):
    k = F.col("o_orderkey")
    return M.given(spark, d, "orders").select("o_orderkey", T.progress_pct(k % 5, k % 7).alias("pct"))


@register("f28_references", r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(t, '(?:#|PR\s+#?)(\d+)', 1), lambda n: '#' || n),
  list_filter(regexp_extract_all(t, '\b([0-9a-f]{7,40})\b', 1), lambda h: regexp_matches(h, '[a-f]') AND regexp_matches(h, '[0-9]'))))), ' ') AS refs FROM (SELECT doc_id, text || ' see #' || doc_id || ' and PR 7' AS t FROM documents)""")
def f28(spark, d):
    docs = M.given(spark, d, "documents")
    return docs.select("doc_id", F.array_join(F.array_distinct(T.references(F.concat("text", F.lit(" see #"), F.col("doc_id").cast("string"), F.lit(" and PR 7")))), " ").alias("refs"))


@register("f29_preflight", "SELECT o_orderkey, round(((c * 1000) * 5.0 + (c * 301) * 25.0) / 1e6 + (greatest(1, c // 2) * 1000 * 5.0 + greatest(1, c // 2) * 150 * 25.0) / 1e6, 6) AS usd FROM (SELECT o_orderkey, o_orderkey % 9 AS c FROM orders)")
def f29(spark, d):
    return M.given(spark, d, "orders").select("o_orderkey", F.round(T.preflight_usd(F.col("o_orderkey") % 9, F.lit(1000), F.lit(301)), 6).alias("usd"))
