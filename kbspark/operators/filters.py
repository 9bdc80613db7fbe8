"""Filters and projections."""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import text as T


def _all(df: DataFrame, **equal) -> DataFrame:
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in equal.items() if v is not None), df)


def any_term(words: Column, query: str) -> Column:
    """Whether any term of the query is among the words; a query without terms matches nothing."""
    row = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.exists(T.query_terms(F.lit(query)), lambda t: F.contains(row, F.concat(F.lit(" "), t, F.lit(" "))))


def query_events(df: DataFrame, workspace=None, source_type=None, event_type=None, since=None, until=None, query=None, limit=50) -> DataFrame:
    """Newest events that meet all filters. A date-only `until` means the end of that day."""
    out = _all(df, workspace=workspace, source_type=source_type, event_type=event_type)
    if since:
        out = out.where(F.col("occurred_at") >= F.lit(since).cast("timestamp"))
    if until:
        at = F.lit(until).cast("timestamp")
        out = out.where(F.col("occurred_at") < at + F.expr("INTERVAL 1 DAY") if len(until) == 10 else F.col("occurred_at") <= at)
    if query:
        out = out.where(any_term(T.tokenize(F.col("title")), query))
    return out.orderBy(F.desc("occurred_at"), "event_id").limit(limit)


def list_beliefs(df: DataFrame, workspace=None, topic=None, subject=None, current_only=True, since=None, until=None, limit=50) -> DataFrame:
    """Newest beliefs that meet all filters; a belief is current while nothing superseded it."""
    out = _all(df, workspace=workspace, topic=topic, subject=subject)
    if current_only:
        out = out.where(F.col("superseded_at").isNull())
    if since:
        out = out.where(F.col("asserted_at") >= F.lit(since).cast("timestamp"))
    if until:
        out = out.where(F.col("asserted_at") < F.lit(until).cast("timestamp"))
    return out.orderBy(F.desc("asserted_at"), "belief_id").limit(limit)


def related_beliefs(df: DataFrame, subject: str, object: str) -> DataFrame:
    return df.where(F.col("superseded_at").isNull() & ((F.col("subject") == subject) | (F.col("object") == object)))


def beliefs_by_topic_like(df: DataFrame, topic: str) -> DataFrame:
    return df.where(F.col("superseded_at").isNull() & F.lower("topic").contains(topic.lower()))


def list_subscriptions(df: DataFrame, workspace=None, status=None, adapter_type=None, since=None, limit=50) -> DataFrame:
    out = _all(df, workspace=workspace, status=status, adapter_type=adapter_type)
    if since:
        out = out.where(F.col("published_at") >= F.lit(since).cast("timestamp"))
    return out.orderBy(F.desc("published_at"), "item_id").limit(limit)


def list_sources(df: DataFrame, enabled_only: bool = False) -> DataFrame:
    return (df.where("enabled") if enabled_only else df).orderBy("name")


def list_jobs(df: DataFrame, workspace=None, status=None, limit=50) -> DataFrame:
    return _all(df, workspace=workspace, status=status).orderBy(F.desc("started_at"), "run_id").limit(limit)


def glob_documents(df: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """Documents whose whole path or file name fits a shell pattern, with size and a token estimate of a quarter of it."""
    regex = fnmatch.translate(pattern).replace("\\Z", "$").replace("\\z", "$").replace("(?s:", "(?s:^")
    fits = F.col("path").rlike(regex) | F.element_at(F.split("path", "/"), -1).rlike(regex)
    size = F.length("content").cast("long")
    out = df.where(fits).select("workspace", "path", size.alias("size"), F.floor(size / 4).alias("tokens"))
    return out.orderBy("path").limit(limit) if limit else out


def grep(df: DataFrame, pattern: str, path_prefix: str = "", ignore_case: bool = False, limit: int | None = 50, width: int = 120) -> DataFrame:
    """(path, line_no, snippet) of the lines that match, the snippet clipped around the match."""
    p = ("(?i)" if ignore_case else "") + pattern
    lines = df.where(F.col("path").startswith(path_prefix)).where(F.col("content").rlike(p)).select("path", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    found = lines.where(F.col("line").rlike(p))
    at = F.greatest(F.lit(1), F.regexp_instr("line", F.lit(p)) - width // 2)
    out = found.select("path", (F.col("n") + 1).alias("line_no"), F.when(F.length("line") <= width, F.col("line")).otherwise(F.substring("line", at, F.lit(width))).alias("snippet"))
    return out.orderBy("path", "line_no").limit(limit) if limit else out


def grep_counts(df: DataFrame, pattern: str) -> DataFrame:
    found = df.select("path", F.regexp_count("content", F.lit(pattern)).cast("long").alias("matches"), F.regexp_substr("content", F.lit(pattern)).alias("first"))
    return found.where("matches > 0")


LOG_HEADER = r"^## \[(\d{4}-\d{2}-\d{2})\] (\S+) \| (.*)$"


def parse_operation_log(df: DataFrame, op: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
    """'## [date] op | title' headers with the '- ' lines below each, as rows (path, entry, date, op, title, details)."""
    lines = df.select("path", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    head = F.col("line").rlike(LOG_HEADER)
    numbered = lines.withColumn("entry", F.sum(head.cast("int")).over(Window.partitionBy("path").orderBy("n"))).where("entry > 0")
    rows = numbered.groupBy("path", "entry").agg(
        F.min_by("line", "n").alias("head"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("line").startswith("- "), F.struct("n", F.substring("line", 3, 1 << 30).alias("d"))))), lambda x: x["d"]).alias("details"),
    )
    rows = rows.select("path", "entry", *(F.regexp_extract("head", LOG_HEADER, g).alias(c) for g, c in ((1, "date"), (2, "op"), (3, "title"))), "details")
    rows = _all(rows, op=op)
    if since:
        rows = rows.where(F.col("date") >= since)
    return rows.orderBy(F.desc("date"), F.desc("entry"), "path").limit(limit) if limit else rows


def retag_code_beliefs(df: DataFrame) -> DataFrame:
    """source_kind 'code' for beliefs of the shapes that code analysis makes."""
    made = (F.col("predicate") == "is_a") & F.col("object").isin("type", "function")
    needs = (F.col("predicate") == "depends_on") & F.col("statement").like("Module depends on %")
    defines = (F.col("predicate") == "is_a") & F.col("statement").like("Defines % resource %")
    return df.withColumn("source_kind", F.when(F.coalesce(made | needs | defines, F.lit(False)), "code").otherwise(F.col("source_kind")))


#: Rules by table: (reason, condition that good rows meet).
RULES = {
    "documents": (("layer", "layer IN ('raw', 'wiki')"), ("path", "path IS NOT NULL")),
    "beliefs": (("statement", "length(statement) <= 500"), ("superseded", "superseded_by IS NULL OR superseded_at IS NOT NULL")),
    "items": (("status", "status IN ('pending', 'ingested', 'dismissed')"),),
    "runs": (("status", "status IN ('pending', 'verifying', 'committed', 'rejected', 'abandoned')"),),
}


def validate(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the table's rules, and those that don't with the first reason; a null counts as not met."""
    reason = F.coalesce(*(F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(r)) for r, c in RULES[table]))
    told = df.withColumn("reason", reason)
    return told.where("reason IS NULL").drop("reason"), told.where("reason IS NOT NULL")


def paywalled(df: DataFrame) -> DataFrame:
    return df.where(T.paywalled(F.col("content")))


def commit_log(events: DataFrame, grep: str | None = None, max_count: int = 50) -> DataFrame:
    out = events.where(F.col("title").rlike(grep)) if grep else events
    return out.orderBy(F.desc("occurred_at"), "event_id").limit(max_count)


def anchor_status(beliefs: DataFrame) -> DataFrame:
    status = F.when(F.size("footnote_ids") > 0, "has citations").otherwise("No footnote citations")
    return beliefs.where("superseded_at IS NULL").select("belief_id", "workspace", status.alias("status"))
