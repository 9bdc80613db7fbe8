"""Change detection, upserts and page making."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators.events import structured
from kbspark.sources.buckets import Buckets


def classify_changes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """`incoming` with `change`: unchanged (the workspace has the hash), changed (it has the path), or new.

    Only keys are joined; the incoming side goes through once by hash and once by path.
    """
    hashes = existing.select("workspace", "content_hash").distinct().withColumn("_h", F.lit(True))
    paths = existing.select("workspace", "path").distinct().withColumn("_p", F.lit(True))
    both = incoming.join(hashes, ["workspace", "content_hash"], "left").join(paths, ["workspace", "path"], "left")
    return both.withColumn("change", F.when(F.col("_h"), "unchanged").when(F.col("_p"), "changed").otherwise("new")).drop("_h", "_p")


def diff_lines(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """`pairs` with `added` and `removed`: lines by a sequence diff of the two texts."""

    @F.pandas_udf("added long, removed long")
    def diff(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            rows = []
            for x, y in zip(a, b):
                x, y = (x or "").split("\n"), (y or "").split("\n")
                ops = [o for o in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if o[0] != "equal"]
                rows.append((sum(o[4] - o[3] for o in ops), sum(o[2] - o[1] for o in ops)))
            yield pd.DataFrame(rows, columns=["added", "removed"])

    return pairs.withColumn("_d", diff(old, new)).withColumns({"added": F.col("_d.added"), "removed": F.col("_d.removed")}).drop("_d")


def changed_line_counts(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """`pairs` with the numbers of distinct lines that only one side has: a cheap estimate of the diff."""
    a, b = F.split(old, "\n"), F.split(new, "\n")
    return pairs.withColumns({"added": F.size(F.array_except(b, a)).cast("long"), "removed": F.size(F.array_except(a, b)).cast("long")})


def new_items(items: DataFrame, seen: DataFrame, order: list[Column | str]) -> DataFrame:
    """Items whose (workspace, external_id, content_hash) wasn't seen; the first of a batch counts, a null id is always new."""
    keys = ["workspace", "external_id", "content_hash"]
    named = items.where("external_id IS NOT NULL")
    first = named.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return first.join(seen.select(*keys).distinct(), keys, "left_anti").select(*items.columns).unionByName(items.where("external_id IS NULL"))


def changed_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose path has another hash, or none, in the state of the last sync."""
    return files.join(state.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of two states of one schema with `side`: added, removed or kept, as sets."""
    tag = lambda d, s: d.withColumn("side", F.lit(s))
    return tag(new.subtract(old), "added").unionByName(tag(old.subtract(new), "removed")).unionByName(tag(old.intersect(new), "kept"))


def upsert_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The latest row of each (workspace, path); of equal times, the incoming one."""
    both = existing.withColumn("_n", F.lit(0)).unionByName(incoming.withColumn("_n", F.lit(1)))
    w = Window.partitionBy("workspace", "path").orderBy(F.desc("updated_at"), F.desc("_n"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_n")


DOCUMENT_KEYS = ["workspace", "path"]


def write_upserts(incoming: DataFrame, path: str, buckets: int = 64) -> list[int]:
    """Documents merged into the table at `path`, of which the buckets that they fall in are written anew; gives these."""
    schema = ", ".join(f"`{c}` {t}" for c, t in incoming.dtypes)
    return Buckets(incoming.sparkSession, path, schema, DOCUMENT_KEYS, buckets).upsert(incoming, upsert_documents)


def auto_ingest_queue(items: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending items of sources whose config says auto_ingest true, oldest first."""
    on = sources.where(F.get_json_object("config", "$.auto_ingest") == "true").select("source_id")
    out = items.where("status = 'pending'").join(on, "source_id").orderBy("published_at", "item_id")
    return out.limit(limit) if limit else out


def requeue_captures(queue: DataFrame, incoming: DataFrame) -> DataFrame:
    """(session_id, action): queue what is new, changed or wasn't done; skip what is done and unchanged."""
    q = queue.select("session_id", F.col("content_hash").alias("_h"), F.col("status").alias("_s"))
    skip = (F.col("_h") == F.col("content_hash")) & (F.col("_s") == "done")
    return incoming.join(q, "session_id", "left").select("session_id", F.when(F.coalesce(skip, F.lit(False)), "skip").otherwise("queue").alias("action"))


def new_notes(notes: DataFrame, docs: DataFrame) -> DataFrame:
    """Notes whose body hash no document of the workspace has in its metadata."""
    known = docs.select("workspace", F.get_json_object("metadata", "$.body_hash").alias("body_hash")).where("body_hash IS NOT NULL").distinct()
    return notes.withColumn("body_hash", T.quote_hash(F.col("body"))).join(known, ["workspace", "body_hash"], "left_anti")


def url_sources(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, url, updated_at) of raw web documents that name their source in the first 10 lines, oldest first."""
    head = F.array_join(F.slice(F.split("content", "\n"), 1, 10), "\n")
    url = T.nonempty(F.regexp_extract(head, r"(https?://[^\s)>\"]+)", 1))
    out = docs.where(F.col("path").like("raw/web/%")).select("path", url.alias("url"), "updated_at").where("url IS NOT NULL").orderBy("updated_at", "path")
    return out.limit(limit) if limit else out


def docs_scope(files: DataFrame) -> DataFrame:
    """Files under docs/, and at the top level README, CHANGELOG, CONTRIBUTING and text files."""
    parts = F.split(F.lower("path"), "/")
    name = F.element_at(parts, -1)
    top = (F.size(parts) == 1) & (name.startswith("readme") | name.startswith("changelog") | name.startswith("contributing") | T.suffix(F.col("path")).isin(".md", ".rst", ".txt"))
    return files.where((F.size(parts) > 1) & parts[0].isin("docs", "doc", "documentation") | top)


def body_of(content: Column) -> Column:
    """The text after a title and its metadata lines, without footnote definitions, clipped at 3000 characters."""
    meta = lambda s: s.startswith("- ") | s.isin("", "---") | s.startswith("# ")

    def start(x: Column) -> Column:
        """The first line that is text; under a title, metadata lines aren't. Without a title it is the first, as the content has no white space before it."""
        told = F.transform(x, lambda r, i: F.when(~T.let(T.trimmed(r), meta), i))
        return F.when(F.get(x, F.lit(0)).startswith("# "), F.coalesce(F.array_min(told), F.size(x))).when(F.get(x, F.lit(0)) == "", F.size(x)).otherwise(0)

    def after(x: Column) -> Column:
        return T.let(start(x), lambda first: F.filter(F.slice(x, first + 1, F.greatest(F.size(x) - first, F.lit(0))), lambda r: ~r.startswith("[^")))

    def clipped(body: Column) -> Column:
        return F.when(F.length(body) > 3000, F.concat(F.substring(body, 1, 3000), F.lit("\n\n... (content continues in raw source)"))).otherwise(body)

    body = F.array_join(T.let(F.split(T.trimmed(content), "\n"), after), "\n")
    return T.let(T.let(body, T.trimmed), clipped)


def _cited(path: Column, quote: Column) -> Column:
    return F.concat(F.lit(" [^1]\n\n[^1]: "), path, F.coalesce(F.concat(F.lit(' — "'), F.translate(quote, '"', ""), F.lit('"')), F.lit("")))


def structure_body(imports: Column, types: Column, functions: Column) -> Column:
    """The first 30 imports, the types and the functions of a source file, a section for each that has any."""
    ticked = lambda c: F.transform(c, lambda x: F.concat(F.lit("`"), x, F.lit("`")))
    section = lambda head, c, text: F.when(F.size(c) > 0, F.concat(F.lit(f"### {head}\n\n"), text))
    listed = lambda c: F.array_join(F.transform(ticked(c), lambda x: F.concat(F.lit("- "), x)), "\n")
    parts = section("Imports", imports, F.array_join(ticked(F.slice(imports, 1, 30)), ", ")), section("Types", types, listed(types)), section("Functions", functions, listed(functions))
    return F.concat_ws("\n\n", *parts)


def ingest_pages(files: DataFrame) -> DataFrame:
    """(workspace, path, title, page): a page for each file with one citation. Source files give their structure, quoted by
    their name; other texts, and source that can't be parsed, give their body, quoted by a sentence."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = structured(files, "workspace", "path", "content")
    is_code = F.col("types").isNotNull()
    title = F.when(is_code, F.concat(name, F.lit(" ("), "language", F.lit(")"))).otherwise(F.coalesce(T.title(F.col("content")), name))
    quote = F.when(is_code, name).otherwise(T.representative_quote(F.col("content")))
    body = F.when(is_code, structure_body(F.col("imports"), F.col("types"), F.col("functions"))).otherwise(body_of(F.col("content")))
    rows = rows.withColumns({"title": title, "quote": quote, "body": body})
    page = F.concat(F.lit("# "), "title", F.lit("\n\n> Source: "), "path", F.lit("\n\n"), "body", _cited(F.col("path"), F.col("quote")))
    return rows.select("workspace", "path", "title", page.alias("page"))
