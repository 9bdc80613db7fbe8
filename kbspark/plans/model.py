"""The knowledge-base tables as derived from the given ones, for Spark and, by the same rules, as SQL for DuckDB.

Fixed clock: NOW. documents: workspace is the language, topic the source, the layer 'wiki' where a label says quality 1.
beliefs: a document's lines of 10 characters or more; a belief is superseded by the next of its workspace, subject and
predicate. pages: documents with a heading, sections and footnotes, of which some quote nothing that is there and some
name files that aren't. items, runs, sources, source_runs, messages: from pages, orders, supplier, lineitem and
conversations. Every table keeps all rows of what it is derived from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.sources.tables import spread

NOW = "2024-02-01 00:00:00"
DAY = 86400


def now():
    return F.lit(NOW).cast("timestamp")


def given(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    labels = given(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = given(spark, d, "documents").join(labels, "doc_id", "left")
    layer = F.when(F.col("quality") == 1, "wiki").otherwise("raw")
    return docs.select(
        "doc_id",
        F.col("lang").alias("workspace"),
        F.col("source").alias("topic"),
        layer.alias("layer"),
        F.concat(layer, F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.substring(F.split("text", "\n")[0], 1, 60).alias("title"),
        F.col("text").alias("content"),
        F.sha2("text", 256).alias("content_hash"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 720 * 3600).alias("updated_at"),
    )


def beliefs(spark: SparkSession, d: str) -> DataFrame:
    lines = documents(spark, d).select("doc_id", "workspace", "topic", "path", "updated_at", F.posexplode(F.split("content", "\n")).alias("pos", "line")).where(F.length("line") >= 10)
    rows = lines.withColumn("statement", F.substring("line", 1, 500)).withColumn("spo", T.spo(F.col("statement")))
    rows = rows.select(
        F.concat_ws("-", F.lit("b"), "doc_id", "pos").alias("belief_id"),
        "workspace", "topic", "path", "statement", "spo.*",
        F.when(F.col("pos") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("pos") % 4).cast("string"))).alias("footnote_ids"),
        F.timestamp_seconds(F.unix_timestamp("updated_at") + F.col("pos") * 60).alias("asserted_at"),
    )
    chain = Window.partitionBy("workspace", "subject", "predicate").orderBy("asserted_at", "belief_id")
    known = F.col("subject").isNotNull()
    return rows.withColumn("superseded_at", F.when(known, F.lead("asserted_at").over(chain))).withColumn("superseded_by", F.when(known, F.lead("belief_id").over(chain)))


def pages(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    n, i = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    first = F.replace(F.substring(F.split("content", "\n")[0], 1, 40), F.lit('"'), F.lit(""))
    note = lambda k, file, quote: F.when(n >= k, F.concat(F.lit(f"[^{k}]: "), file, F.lit(' — "'), quote, F.lit('"\n'))).otherwise("")
    content = F.concat(
        F.lit("# "), "title", F.lit("\n\n> Sources\n\n## Overview Of It\n"),
        F.when(n >= 1, F.concat(F.lit("The first line is "), first, F.lit(" [^1] and more.\n"))).otherwise(""),
        F.when(n >= 2, F.concat(F.lit("Claim "), i, F.lit(" was made up [^2]\n"))).otherwise(""),
        F.when(F.col("doc_id") % 11 == 0, F.lit("::: disputed\nsomething\n:::\n")).when(F.col("doc_id") % 11 == 1, F.lit("::: disputed\nUpdated 2024-01-02 per someone\n:::\n")).otherwise(""),
        F.lit("\n## Details\n"), F.col("content"), F.lit("\n\n"),
        note(1, F.col("path"), first), note(2, F.col("path"), F.concat(F.lit("fabricated "), i)), note(3, F.concat(F.lit("raw/missing/"), i, F.lit(".md")), first), note(4, F.concat(i, F.lit(".md")), first),
    )
    return docs.select("doc_id", "workspace", "topic", "layer", "path", "title", "updated_at", content.alias("content"))


def footnotes(spark: SparkSession, d: str) -> DataFrame:
    found = pages(spark, d).select("doc_id", "workspace", F.col("path").alias("page_path"), F.explode(T.footnotes(F.col("content"))).alias("f"))
    rows = found.select("doc_id", "workspace", "page_path", "f.footnote_id", "f.source_file", "f.page_hint", "f.quote")
    return rows.withColumn("stored_hash", F.when(F.col("doc_id") % 7 == 0, "0").otherwise(T.quote_hash(F.col("quote"))))


def events(spark: SparkSession, d: str) -> DataFrame:
    e = given(spark, d, "events")
    return e.select(
        "event_id",
        F.concat(F.lit("ws"), (F.col("user_id") % 4).cast("string")).alias("workspace"),
        F.concat(F.lit("kind"), (F.col("user_id") % 5).cast("string")).alias("source_type"),
        "event_type",
        F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")).alias("title"),
        F.col("user_id").cast("string").alias("author"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
        (F.col("ts").cast("timestamp") + F.make_dt_interval(mins=(F.col("event_id") % 90).cast("int"))).alias("ingested_at"),
    )


def items(spark: SparkSession, d: str) -> DataFrame:
    p = given(spark, d, "pages")
    i = F.col("page_id")
    return p.select(
        i.alias("item_id"),
        F.concat(F.lit("ws"), (i % 4).cast("string")).alias("workspace"),
        F.concat(F.lit("s"), (i % 10).cast("string")).alias("source_id"),
        F.when(i % 3 == 0, "rss").otherwise("imap").alias("adapter_type"),
        F.when(i % 9 != 0, F.col("url")).alias("external_id"),
        "url",
        T.html_title(F.col("html")).alias("title"),
        F.sha2("html", 256).alias("content_hash"),
        F.when(i % 4 == 0, "ingested").when(i % 4 == 1, "dismissed").otherwise("pending").alias("status"),
        F.timestamp_seconds(F.lit(1704067200) + i * 600).alias("published_at"),
    )


def messages(spark: SparkSession, d: str) -> DataFrame:
    return given(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "committed").when(F.col("o_orderstatus") == "P", "rejected").otherwise("pending")
    return given(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("ws"), (F.col("o_custkey") % 4).cast("string")).alias("workspace"), status.alias("status"), (F.col("o_totalprice") / 1e6).alias("usd"), F.col("o_orderdate").cast("timestamp").alias("started_at"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    s = given(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("source_id"), F.concat(F.lit("ws"), (F.col("s_nationkey") % 4).cast("string")).alias("workspace"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("enabled"))


def source_runs(spark: SparkSession, d: str) -> DataFrame:
    li = given(spark, d, "lineitem")
    start = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_run_id"),
        F.col("l_orderkey").alias("run_id"),
        F.col("l_suppkey").alias("source_id"),
        start.alias("started_s"),
        (start + F.col("l_quantity").cast("long") * 60).alias("ended_s"),
        F.col("l_quantity").cast("long").alias("items"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("long").alias("errors"),
    )


def eval_runs(spark: SparkSession, d: str) -> DataFrame:
    share = F.count_if(F.col("status") == "committed") / F.count("*")
    months = runs(spark, d).groupBy("workspace", F.date_format("started_at", "yyyy-MM").alias("month")).agg(share.alias("score"))
    return months.withColumn("metric", F.when(F.substring("month", 6, 2).cast("int") % 2 == 0, "M1").otherwise("M2")).withColumn("passed", F.col("score") >= 0.5)


def searches(spark: SparkSession, d: str) -> DataFrame:
    """One query per benchmark passage: the whole of it."""
    return given(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _spo_sql(group: int, cap: int) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower(statement), '{p}') THEN regexp_extract(lower(statement), '{p}', {group})" for p in T.SENTENCES)
    return rf"left(regexp_replace(CASE {cases} END, '^\s+|\s+$', '', 'g'), {cap})"


def _note_sql(k: int, file: str, quote: str) -> str:
    return f"CASE WHEN doc_id % 5 >= {k} THEN '[^{k}]: ' || {file} || ' — \"' || {quote} || '\"' || chr(10) ELSE '' END"


_FIRST = "replace(left(string_split(content, chr(10))[1], 40), '\"', '')"
NOW_SQL = f"TIMESTAMP '{NOW}'"

#: Name: (tables it needs, SQL).
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "m_documents": ((), """
      SELECT d.doc_id, lang AS workspace, source AS topic, CASE WHEN q.quality = 1 THEN 'wiki' ELSE 'raw' END AS layer,
        CASE WHEN q.quality = 1 THEN 'wiki' ELSE 'raw' END || '/' || source || '/' || d.doc_id || '.md' AS path,
        left(string_split(text, chr(10))[1], 60) AS title, text AS content, sha256(text) AS content_hash,
        TIMESTAMP '2024-01-01' + to_hours((d.doc_id % 720)::INT) AS updated_at
      FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) q USING (doc_id)"""),
    "m_beliefs": (("m_documents",), f"""
      SELECT *, CASE WHEN subject IS NOT NULL THEN lead(asserted_at) OVER w END AS superseded_at, CASE WHEN subject IS NOT NULL THEN lead(belief_id) OVER w END AS superseded_by FROM (
        SELECT 'b-' || doc_id || '-' || pos AS belief_id, workspace, topic, path, statement, {_spo_sql(1, 100)} AS subject, {_spo_sql(2, 100)} AS predicate, {_spo_sql(3, 200)} AS object,
          CASE WHEN pos % 4 = 0 THEN [] ELSE [(pos % 4)::VARCHAR] END AS footnote_ids, updated_at + to_minutes(pos::INT) AS asserted_at
        FROM (SELECT doc_id, workspace, topic, path, updated_at, pos - 1 AS pos, left(l[pos], 500) AS statement
          FROM (SELECT *, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT *, string_split(content, chr(10)) AS l FROM m_documents)) WHERE length(l[pos]) >= 10))
      WINDOW w AS (PARTITION BY workspace, subject, predicate ORDER BY asserted_at, belief_id)"""),
    "m_pages": (("m_documents",), f"""
      SELECT doc_id, workspace, topic, layer, path, title, updated_at, '# ' || title || chr(10) || chr(10) || '> Sources' || chr(10) || chr(10) || '## Overview Of It' || chr(10)
        || CASE WHEN doc_id % 5 >= 1 THEN 'The first line is ' || {_FIRST} || ' [^1] and more.' || chr(10) ELSE '' END
        || CASE WHEN doc_id % 5 >= 2 THEN 'Claim ' || doc_id || ' was made up [^2]' || chr(10) ELSE '' END
        || CASE WHEN doc_id % 11 = 0 THEN '::: disputed' || chr(10) || 'something' || chr(10) || ':::' || chr(10) WHEN doc_id % 11 = 1 THEN '::: disputed' || chr(10) || 'Updated 2024-01-02 per someone' || chr(10) || ':::' || chr(10) ELSE '' END
        || chr(10) || '## Details' || chr(10) || content || chr(10) || chr(10)
        || {_note_sql(1, "path", _FIRST)} || {_note_sql(2, "path", "'fabricated ' || doc_id")} || {_note_sql(3, "'raw/missing/' || doc_id || '.md'", _FIRST)} || {_note_sql(4, "doc_id || '.md'", _FIRST)} AS content
      FROM m_documents"""),
    "m_footnotes": (("m_pages",), rf"""
      SELECT doc_id, workspace, page_path, footnote_id, source_file, page_hint, quote,
        CASE WHEN doc_id % 7 = 0 THEN '0' ELSE sha256(regexp_replace(quote, '^\s+|\s+$', '', 'g')) END AS stored_hash FROM (
        SELECT doc_id, workspace, path AS page_path, regexp_extract(line, '{T.FOOTNOTE}', 1) AS footnote_id, regexp_extract(line, '{T.FOOTNOTE}', 2) AS source_file,
          nullif(regexp_extract(line, '{T.FOOTNOTE}', 3), '')::INT AS page_hint, nullif(regexp_extract(line, '{T.FOOTNOTE}', 4), '') AS quote
        FROM (SELECT *, unnest(string_split(content, chr(10))) AS line FROM m_pages) WHERE regexp_matches(line, '{T.FOOTNOTE}'))"""),
    "m_events": ((), """
      SELECT event_id, 'ws' || (user_id % 4) AS workspace, 'kind' || (user_id % 5) AS source_type, event_type, concat_ws(' ', event_type, json_extract_string(props, '$.k')) AS title,
        user_id::VARCHAR AS author, ts AS occurred_at, ts + to_minutes((event_id % 90)::INT) AS ingested_at FROM events"""),
    "m_items": ((), r"""
      SELECT page_id AS item_id, 'ws' || (page_id % 4) AS workspace, 's' || (page_id % 10) AS source_id, CASE WHEN page_id % 3 = 0 THEN 'rss' ELSE 'imap' END AS adapter_type,
        CASE WHEN page_id % 9 <> 0 THEN url END AS external_id, url,
        CASE WHEN regexp_matches(html, '(?is)<title[^>]*>.*?</title>') THEN regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '^\s+|\s+$', '', 'g') ELSE 'Untitled' END AS title,
        sha256(html) AS content_hash, CASE WHEN page_id % 4 = 0 THEN 'ingested' WHEN page_id % 4 = 1 THEN 'dismissed' ELSE 'pending' END AS status,
        TIMESTAMP '2024-01-01' + to_seconds(page_id * 600) AS published_at FROM pages"""),
    "m_messages": ((), "SELECT conv_id AS session_id, turn AS seq, role, text AS content FROM conversations"),
    "m_runs": ((), """
      SELECT o_orderkey AS run_id, 'ws' || (o_custkey % 4) AS workspace, CASE o_orderstatus WHEN 'F' THEN 'committed' WHEN 'P' THEN 'rejected' ELSE 'pending' END AS status,
        o_totalprice / 1e6 AS usd, o_orderdate::TIMESTAMP AS started_at FROM orders"""),
    "m_sources": ((), "SELECT s_suppkey AS source_id, 'ws' || (s_nationkey % 4) AS workspace, s_name AS name, s_acctbal > 0 AS enabled FROM supplier"),
    "m_source_runs": ((), """
      SELECT l_orderkey || '-' || l_linenumber AS source_run_id, l_orderkey AS run_id, l_suppkey AS source_id, epoch(l_shipdate::TIMESTAMP)::BIGINT AS started_s,
        epoch(l_shipdate::TIMESTAMP)::BIGINT + l_quantity::BIGINT * 60 AS ended_s, l_quantity::BIGINT AS items, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END::BIGINT AS errors FROM lineitem"""),
    "m_eval_runs": (("m_runs",), """
      SELECT *, CASE WHEN substr(month, 6, 2)::INT % 2 = 0 THEN 'M1' ELSE 'M2' END AS metric, score >= 0.5 AS passed FROM (
        SELECT workspace, strftime(started_at, '%Y-%m') AS month, count(*) FILTER (status = 'committed') / count(*) AS score FROM m_runs GROUP BY 1, 2)"""),
    "m_searches": ((), "SELECT item_id AS query_id, text AS query FROM benchmark"),
}


def sql(body: str) -> str:
    """`body` with the model tables that it names in front."""
    needed: list[str] = []

    def need(name: str) -> None:
        for other in SQL[name][0]:
            need(other)
        if name not in needed:
            needed.append(name)

    for name in SQL:
        if name in body:
            need(name)
    if not needed:
        return body
    made = ", ".join(f"{n} AS ({SQL[n][1]})" for n in needed)
    body = body.strip()
    return f"WITH {made}, {body[5:]}" if body.startswith("WITH ") and not body.startswith("WITH RECURSIVE") else f"WITH RECURSIVE {made}, {body[15:]}" if body.startswith("WITH RECURSIVE") else f"WITH {made} {body}"
