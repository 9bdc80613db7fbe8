"""Readers of landed files (S1, S4 to S11) and writers."""

from __future__ import annotations

import email
import email.policy
import email.utils
import io
import tarfile
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.functions import text as T

# What is read from trees and what is passed over.
CODE = (".py", ".ts", ".tsx", ".js", ".jsx", ".rs", ".go", ".tf", ".yml", ".yaml")
DOCS = (".md", ".txt", ".rst", ".adoc")
CONFIG = (".toml", ".ini", ".cfg", ".json")
SKIPPED_FOLDERS = (".git", "__pycache__", "node_modules", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "target", "build", "dist", ".next", ".nuxt", "coverage", ".terraform", ".terragrunt-cache", "subagents", "tasks")
SKIPPED_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "go.sum", "poetry.lock", "uv.lock")
ARCHIVED = (".md", ".txt", ".rst", ".org", ".adoc", ".json", ".yaml", ".yml", ".toml", ".csv", ".xml", ".py", ".js", ".ts", ".go", ".rs", ".java", ".rb", ".sh", ".html", ".htm")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def wanted(relative: Column, length: Column, exts: tuple[str, ...] = CODE + DOCS + CONFIG, max_bytes: int = 500_000) -> Column:
    """Whether a file of a tree is read: by extension and size, outside hidden and vendored folders; transcripts always."""
    parts = F.split(relative, "/")
    name = F.element_at(parts, -1)
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(*SKIPPED_FOLDERS))
    passed = name.isin(*SKIPPED_FILES) | name.endswith(".meta.json") | name.endswith(".lock")
    transcript = T.suffix(relative) == ".jsonl"
    return ~hidden & ~passed & F.when(transcript, length > 0).otherwise(T.suffix(relative).isin(*exts) & (length <= max_bytes))


def read_text_tree(spark: SparkSession, path: str, scope: str = "all", max_bytes: int = 500_000) -> DataFrame:
    """(path, content): text files under a folder, the path relative to it. Filters run before contents are decoded."""
    from kbspark.operators.ingest import docs_scope

    root = path.rstrip("/").split("/")[-1]
    files = _files(spark, path).withColumn("rel", F.element_at(F.split("path", f"/{root}/", 2), -1)).where(wanted(F.col("rel"), F.col("length"), max_bytes=max_bytes))
    rows = files.select(F.col("rel").alias("path"), F.decode("content", "UTF-8").alias("content"))
    return docs_scope(rows) if scope == "docs" else rows


SIDECAR = "page string, beliefs array<struct<statement:string,topic:string,subject:string,predicate:string,object:string,footnote_ids:array<string>>>"


def read_sidecars(spark: SparkSession, path: str, workspace: str) -> DataFrame:
    rows = spark.read.schema(SIDECAR).option("multiLine", True).json(path)
    return rows.select(F.lit(workspace).alias("workspace"), F.col("page").alias("path"), F.inline("beliefs"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(session, seq, role, content, ts) of chat transcripts in two JSON-lines dialects.

    In one a line has a type and a message whose content is a text or blocks; in the other a role and content. Lines
    that aren't JSON, empty messages and those that only name a tool are dropped; `seq` is the line's number in its file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    # A file's blocks are read each in its order.
    lines = lines.withColumn("seq", F.row_number().over(Window.partitionBy("file").orderBy("block", "place")).cast("long") - 1)
    get = lambda p: F.get_json_object("value", p)
    blocks = F.from_json(F.coalesce(get("$.message.content"), get("$.content")), "array<struct<type:string,text:string,name:string>>")
    joined = F.array_join(F.transform(blocks, lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "tool_use", F.concat(F.lit("[tool: "), b["name"], F.lit("]")))), "\n")
    plain = F.coalesce(get("$.message.content"), get("$.content"))
    content = T.strip(F.when(plain.startswith("["), F.coalesce(joined, plain)).otherwise(plain))
    role = F.coalesce(get("$.type"), get("$.role"))
    rows = lines.select(F.regexp_extract("file", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("session"), "seq", F.when(role == "human", "user").otherwise(role).alias("role"), content.alias("content"), F.expr("try_to_timestamp(get_json_object(value, '$.timestamp'))").alias("ts"))
    return rows.where(F.col("role").isin("user", "assistant") & (F.col("content") != "") & ~(F.col("content").startswith("[tool:") & ~F.col("content").contains("\n")))


LOG = "ts string, event string, level string, family string, run_id string, workspace string, layer string, data map<string,string>"


def read_logs(spark: SparkSession, path: str, run_id: str | None = None, family: str | None = None, tail: int = 50) -> DataFrame:
    """The newest log lines that meet the filters; malformed ones are dropped."""
    rows = spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path)
    rows = reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in (("run_id", run_id), ("family", family)) if v), rows)
    return rows.where("ts IS NOT NULL").orderBy(F.desc("ts")).limit(tail)


ISSUE = "number long, title string, body string, html_url string, state string, created_at string, user struct<login:string>, labels array<struct<name:string>>, pull_request map<string,string>"
RELEASE = "tag_name string, name string, body string, html_url string, published_at string, author struct<login:string>"


def _when(c: str) -> Column:
    return F.expr(f"try_to_timestamp({c})")


def issues_to_events(df: DataFrame) -> DataFrame:
    """Events of issue rows; a row with a pull_request key is a pull request."""
    kind = F.when(F.col("pull_request").isNotNull(), "pull_request").otherwise("issue")
    return df.select(F.lit("github").alias("source_type"), kind.alias("event_type"), "title", "body", F.col("html_url").alias("url"), F.col("user.login").alias("author"), _when("created_at").alias("occurred_at"), F.create_map(F.lit("state"), "state", F.lit("labels"), F.array_join(F.transform("labels", lambda x: x["name"]), ",")).alias("event_data"))


def releases_to_events(df: DataFrame, since: str | None = None) -> DataFrame:
    rows = df.select(F.lit("github").alias("source_type"), F.lit("release").alias("event_type"), F.coalesce("name", "tag_name").alias("title"), "body", F.col("html_url").alias("url"), F.col("author.login").alias("author"), _when("published_at").alias("occurred_at"), F.create_map(F.lit("tag"), "tag_name").alias("event_data"))
    return rows.where(F.col("occurred_at") >= F.lit(since).cast("timestamp")) if since else rows


def gitlog_to_events(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a log whose records end with 0x1e and whose fields are split by 0x00: sha, author, date, subject, body."""
    rows = spark.read.option("lineSep", "\x1e").text(path).select(F.split(F.regexp_replace("value", "^\n+", ""), "\x00").alias("f")).where(F.size("f") >= 4)
    return rows.select(F.lit("git").alias("source_type"), F.lit("commit").alias("event_type"), F.col("f")[3].alias("title"), F.coalesce(T.strip(F.get("f", F.lit(4))), F.lit("")).alias("body"), F.col("f")[1].alias("author"), F.expr("try_to_timestamp(f[2])").alias("occurred_at"), F.create_map(F.lit("sha"), F.col("f")[0]).alias("event_data"))


RSS = "guid string, link string, title string, description string, pubDate string, author string, category array<string>"
ATOM = "id string, title string, summary string, content string, updated string, published string, link array<struct<_href:string>>, author struct<name:string>, category array<struct<_term:string>>"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(external_id, title, url, author, content, tags, published, paywalled) of RSS items and Atom entries."""
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    rss, atom = read("item", RSS), read("entry", ATOM)
    link = F.get("link", F.lit(0))["_href"]
    a = rss.select(F.coalesce("guid", "link").alias("external_id"), "title", F.col("link").alias("url"), "author", F.col("description").alias("content"), F.coalesce("category", F.array().cast("array<string>")).alias("tags"), F.col("pubDate").alias("published"))
    b = atom.select(F.coalesce("id", link).alias("external_id"), "title", link.alias("url"), F.col("author.name").alias("author"), F.coalesce("content", "summary").alias("content"), F.coalesce(F.transform("category", lambda x: x["_term"]), F.array().cast("array<string>")).alias("tags"), F.coalesce("published", "updated").alias("published"))
    both = a.unionByName(b)
    return both.withColumn("content", T.strip_dangerous_links(F.col("content"))).withColumn("paywalled", T.paywalled(F.col("content")))


MAIL = "path string, subject string, from_name string, from_addr string, date string, message_id string, html string, body string"


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """Messages of .eml files with their HTML or text body; those without either are dropped."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch["path"], batch["content"]):
                m = email.message_from_bytes(raw, policy=email.policy.default)
                who, address = email.utils.parseaddr(str(m["from"] or ""))
                html, plain = m.get_body(("html",)), m.get_body(("plain",))
                parts = [p.get_content() if p else None for p in (html, plain)]
                if any(parts):
                    rows.append((name, str(m["subject"] or ""), who, address, str(m["date"] or ""), str(m["message-id"] or ""), *parts))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in MAIL.split(", ")])

    rows = _files(spark, path).where(F.col("path").endswith(".eml")).select("path", "content").mapInPandas(parse, MAIL)
    return rows.withColumn("html", T.strip_email_chrome(F.col("html")))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, content): text members of zip and tar files; members that climb out of the archive are dropped."""

    def members(name: str, raw: bytes) -> Iterator[tuple[str, bytes]]:
        if zipfile.is_zipfile(io.BytesIO(raw)):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
        else:
            with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile())

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(name, m, c.decode("utf-8", "replace")) for name, raw in zip(batch["path"], batch["content"]) for m, c in members(name, raw) if not m.startswith("/") and ".." not in m.split("/") and m.lower().endswith(ARCHIVED)]
            yield pd.DataFrame(rows, columns=["archive", "member", "content"])

    files = _files(spark, path).where(F.col("path").rlike(r"\.(zip|tar|tgz|tar\.gz|tar\.bz2|tar\.xz)$")).select("path", "content")
    return files.mapInPandas(unpack, "archive string, member string, content string")


def export_bundle(docs: DataFrame, beliefs: DataFrame, path: str) -> None:
    """Documents and beliefs as JSON, in folders by workspace."""
    docs.write.mode("overwrite").partitionBy("workspace").json(f"{path}/documents")
    beliefs.write.mode("overwrite").partitionBy("workspace").json(f"{path}/beliefs")


def export_beliefs(beliefs: DataFrame, path: str, kind: str = "json") -> None:
    """All beliefs, not only current ones, as JSON lines or CSV (lists joined)."""
    if kind == "csv":
        beliefs.withColumn("footnote_ids", F.array_join("footnote_ids", ";")).write.mode("overwrite").option("header", True).csv(path)
    else:
        beliefs.write.mode("overwrite").json(path)


BLOCKS = "array<struct<type:string,text:string,checked:boolean,language:string,url:string>>"


def blocks_to_markdown(blocks: Column) -> Column:
    """Typed blocks (JSON) as markdown lines, numbered items in their order."""
    parsed = F.from_json(blocks, BLOCKS)
    text = lambda b: F.coalesce(b["text"], F.lit(""))
    line = lambda b: (
        F.when(b["type"].isin("heading_1", "heading_2", "heading_3"), F.concat(F.repeat(F.lit("#"), F.substring(b["type"], 9, 1).cast("int")), F.lit(" "), text(b)))
        .when(b["type"] == "bulleted_list_item", F.concat(F.lit("- "), text(b)))
        .when(b["type"] == "numbered_list_item", F.concat(F.lit("1. "), text(b)))
        .when(b["type"] == "to_do", F.concat(F.when(b["checked"], "- [x] ").otherwise("- [ ] "), text(b)))
        .when(b["type"] == "quote", F.concat(F.lit("> "), text(b)))
        .when(b["type"] == "code", F.concat(F.lit("```"), F.coalesce(b["language"], F.lit("")), F.lit("\n"), text(b), F.lit("\n```")))
        .when(b["type"] == "divider", F.lit("---"))
        .when(b["type"] == "bookmark", F.coalesce(b["url"], F.lit("")))
        .otherwise(text(b))
    )
    return F.array_join(F.transform(parsed, line), "\n\n")


def markdown_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(session, seq, role, content) of markdown transcripts: '## User' and '## Assistant' headings with text below."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+?)\.[^./]+$", 1).alias("session"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    head = T.nonempty(F.lower(F.regexp_extract("line", r"(?i)^#{1,3}\s*(user|human|assistant)\b", 1)))
    w = Window.partitionBy("session").orderBy("n")
    rows = lines.withColumn("head", head).withColumn("seq", F.sum(F.col("head").isNotNull().cast("int")).over(w)).where("seq > 0")
    out = rows.groupBy("session", "seq").agg(F.first("head", ignorenulls=True).alias("role"), T.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("n", "line")))), lambda x: x["line"]), "\n")).alias("content"))
    return out.withColumn("role", F.when(F.col("role") == "human", "user").otherwise(F.col("role"))).where("content <> ''")
