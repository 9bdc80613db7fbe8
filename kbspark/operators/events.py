"""Reports over sources and events (J19, J20, U1, U2), artifacts (T7), code beliefs."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import text as T


def source_sync_summary(sources: DataFrame, runs: DataFrame, since_s: int) -> DataFrame:
    """Runs, items and errors of each source since a time; sources without any stay, with zeros."""
    per = runs.where(F.col("started_s") >= since_s).groupBy("source_id").agg(F.count("*").alias("runs"), F.sum("items").alias("items"), F.sum("errors").alias("errors"))
    return sources.select("source_id", "name").join(per, "source_id", "left").na.fill(0, ["runs", "items", "errors"])


def recent_errors(sources: DataFrame, runs: DataFrame, since_s: int, n: int = 10) -> DataFrame:
    top = runs.where((F.col("started_s") >= since_s) & (F.col("errors") > 0)).orderBy(F.desc("started_s"), "source_run_id").limit(n)
    return top.join(sources.select("source_id", "name"), "source_id").select("source_run_id", "name", "started_s", "errors")


def slowest_runs(sources: DataFrame, runs: DataFrame, since_s: int, n: int = 10) -> DataFrame:
    took = runs.where((F.col("started_s") >= since_s) & F.col("ended_s").isNotNull()).withColumn("seconds", F.col("ended_s") - F.col("started_s"))
    top = took.orderBy(F.desc("seconds"), "source_run_id").limit(n)
    return top.join(sources.select("source_id", "name"), "source_id").select("source_run_id", "name", "seconds")


def digest_items(events: DataFrame, beliefs: DataFrame, items: DataFrame, now: Column, days: int = 7, limits: tuple[int, int, int] = (100, 50, 50)) -> DataFrame:
    """(workspace, kind, rank, at_s, title): each workspace's newest events, current beliefs and items of the last days."""
    since = F.unix_timestamp(now) - days * 86400

    def newest(df: DataFrame, kind: str, at: str, key: str, title: str, n: int) -> DataFrame:
        w = Window.partitionBy("workspace").orderBy(F.desc(at), key)
        rows = df.where((F.unix_timestamp(at) >= since) & (F.col(at) <= now)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
        return rows.select("workspace", F.lit(kind).alias("kind"), "rank", F.unix_timestamp(at).alias("at_s"), F.col(title).alias("title"))

    parts = [
        newest(events, "event", "occurred_at", "event_id", "title", limits[0]),
        newest(beliefs.where("superseded_at IS NULL"), "belief", "asserted_at", "belief_id", "statement", limits[1]),
        newest(items, "item", "published_at", "item_id", "title", limits[2]),
    ]
    return reduce(DataFrame.unionByName, parts)


def digest_text(items: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """(workspace, kind, text): dated lines of each section."""
    limits = limits or {"event": 20, "belief": 15, "item": 15}
    n = reduce(lambda c, kv: c.when(F.col("kind") == kv[0], kv[1]), limits.items(), F.when(F.lit(False), 0))
    line = F.concat(F.lit("- "), F.date_format(F.timestamp_seconds("at_s"), "yyyy-MM-dd"), F.lit(" "), "title")
    rows = items.where(F.col("rank") <= n).groupBy("workspace", "kind").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))).alias("x"))
    return rows.select("workspace", "kind", F.array_join(F.transform("x", lambda r: r["l"]), "\n").alias("text"))


# Hosts whose links are skipped, hosts by worth, and the worth of any other.
SKIPPED = ("www.w3.org", "schema.org")
WORTH = (("arxiv.org", 90), ("openreview.net", 85), ("proceedings.iclr.cc", 85), ("github.com", 80), ("huggingface.co", 75), ("research.google", 70), ("ai.meta.com", 70), ("developer.nvidia.com", 65), ("semanticscholar.org", 60), ("researchgate.net", 55))
OTHER_WORTH = 30


def clean_url(raw: Column) -> Column:
    """Without trailing punctuation and escapes; arXiv addresses as /abs/ without a version; null if under 20 characters."""
    url = F.split(F.regexp_replace(raw, r"""[.,;:!?)}\]'"]+$""", ""), r"\\")[0]
    paper = F.regexp_replace(F.regexp_replace(url, "arxiv.org/(html|pdf)/", "arxiv.org/abs/"), r"v\d+$", "")
    return F.when(F.length(url) >= 20, F.when(url.rlike("arxiv.org/(html|pdf)/"), paper).otherwise(url))


def artifact_kind(url: Column) -> Column:
    h, p = T.host(url), T.url_path(url)
    names = F.size(F.filter(F.split(p, "/"), lambda x: x != ""))
    paper = h.contains("arxiv.org") | h.contains("openreview.net") & (p.contains("/pdf") | p.contains("/forum")) | h.contains("proceedings") & p.contains(".pdf") | h.contains("huggingface.co") & p.contains("/papers/")
    return F.when(paper, "paper").when(h.contains("github.com"), F.when(names == 2, "repo").otherwise("page")).when(url.endswith(".pdf"), "pdf").otherwise("page")


def artifact_priority(url: Column, kind: Column) -> Column:
    h = T.host(url)
    worth = reduce(lambda c, hw: c.when(h.contains(hw[0]), hw[1]), WORTH[1:], F.when(h.contains(WORTH[0][0]), WORTH[0][1])).otherwise(OTHER_WORTH)
    return worth + F.when(kind == "paper", 5).when(kind == "repo", 3).otherwise(0)


def rank_artifacts(messages: DataFrame) -> DataFrame:
    """(url, kind, priority, domain): distinct links of all messages, without navigation and documentation, best first."""
    links = messages.select(F.explode(F.regexp_extract_all("content", F.lit(r"""(https?://[^\s<>"')\]]+)"""), 1)).alias("raw"))
    urls = links.select(clean_url(F.col("raw")).alias("url")).where("url IS NOT NULL").distinct()
    h, p = T.host(F.col("url")), T.url_path(F.col("url"))
    kept = urls.where((h != "") & ~h.isin(*SKIPPED) & ~p.contains("/api/") & ~p.contains("/docs/"))
    rows = kept.withColumn("kind", artifact_kind(F.col("url"))).withColumn("priority", artifact_priority(F.col("url"), F.col("kind"))).withColumn("domain", h)
    return rows.orderBy(F.desc("priority"), "url")


STRUCTURE = ("types", "functions", "imports")
#: Python texts that a task parses before it hands on what it found.
SLICE_ROWS = 128


def python_names(source: str) -> tuple[list[str], list[str], list[str]] | None:
    """Top-level classes, functions and imports of a Python text; null if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return None
    types = [n.name for n in tree.body if isinstance(n, ast.ClassDef)]
    functions = [n.name for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    imports = [a.name for n in tree.body if isinstance(n, ast.Import) for a in n.names] + [n.module or "." for n in tree.body if isinstance(n, ast.ImportFrom)]
    return types, functions, imports


#: Patterns of declarations by language: types, functions, imports (group 1 is the name).
DECLARATIONS = {
    "typescript": (r"(?m)^\s*(?:export\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+(\w+)", r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)", r"(?m)^\s*import\s.*?from\s+['\"]([^'\"]+)['\"]"),
    "rust": (r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", r"(?m)^\s*use\s+([^;]+);"),
    "go": (r"(?m)^type\s+(\w+)\s+(?:struct|interface)", r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)", r"(?m)^\s*(?:import\s+)?\"([^\"]+)\"$"),
    "terraform": (r"(?m)^resource\s+\"([^\"]+)\"", r"(?m)^module\s+\"([^\"]+)\"", r"(?m)^provider\s+\"([^\"]+)\""),
    "yaml": (r"(?m)^kind:\s*(\S+)", r"(?m)^\s*-\s+name:\s*(.+?)\s*$", r"(?m)^\s*-?\s*(?:import_\w+|include_\w+):\s*(\S+)"),
}
LANGUAGES = {".py": "python", ".ts": "typescript", ".js": "typescript", ".tsx": "typescript", ".jsx": "typescript", ".rs": "rust", ".go": "go", ".tf": "terraform", ".yml": "yaml", ".yaml": "yaml"}


def structured(files: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` of each file with its language, types, functions and imports: all null where the path is no source
    file's, null lists for Python that doesn't parse.

    Each row goes one way, Python texts through Arrow and all others through patterns, so that nothing is joined.
    """
    end = T.suffix(F.col("path"))
    language = reduce(lambda c, kv: c.when(end == kv[0], kv[1]), LANGUAGES.items(), F.when(F.lit(False), ""))
    rows = files.withColumn("language", language)
    is_python = F.col("language").eqNullSafe("python")

    def by_pattern(i: int) -> Column:
        found = {name: F.regexp_extract_all("content", F.lit(patterns[i]), 1) for name, patterns in DECLARATIONS.items()}
        return reduce(lambda c, kv: c.when(F.col("language") == kv[0], kv[1]), found.items(), F.when(F.lit(False), F.array().cast("array<string>")))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), SLICE_ROWS):
                batch = whole.slice(k, SLICE_ROWS)
                # One text at a time is a Python string beside the batch.
                found = [python_names(c.as_py() or "") or (None, None, None) for c in batch["content"]]
                lists = [pa.array([f[i] for f in found], pa.list_(pa.string())) for i in range(len(STRUCTURE))]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *lists], [*kept, *STRUCTURE])

    kept = [*keep, "language"]
    others = rows.where(~is_python).select(*kept, *(by_pattern(i).alias(c) for i, c in enumerate(STRUCTURE)))
    python = rows.where(is_python).select(*dict.fromkeys((*kept, "content")))
    return others.unionByName(python.mapInArrow(parse, others.schema))


def code_structure(files: DataFrame) -> DataFrame:
    """(path, language, types, functions, imports) of source files; Python that doesn't parse has null lists."""
    return structured(files, "path").where("language IS NOT NULL")


def code_beliefs(structures: DataFrame, topic: str) -> DataFrame:
    """Beliefs about declarations: what each type and function is, and the first 20 imports. The structures are read once."""

    def about(c: Column, says: str, subject: Callable[[Column], Column], predicate: str, object_: Callable[[Column], Column]) -> Column:
        return F.transform(c, lambda s: F.struct(F.concat(F.lit(says), s).alias("statement"), subject(s).alias("subject"), F.lit(predicate).alias("predicate"), object_(s).alias("object")))

    itself = lambda s: s
    beliefs = F.array_compact(
        F.array(
            about(F.col("types"), "Defines type ", itself, "is_a", lambda s: F.lit("type")),
            about(F.col("functions"), "Defines function ", itself, "is_a", lambda s: F.lit("function")),
            about(F.slice("imports", 1, 20), "Module depends on ", lambda s: F.lit("Module"), "depends_on", itself),
        )
    )
    rows = structures.select("path", F.explode(F.flatten(beliefs)).alias("b"))
    return rows.select("path", F.lit(topic).alias("topic"), "b.*", F.lit("code").alias("source_kind"))
