"""Pages: slugs, links, edits and journals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kbspark.functions import text as T
from kbspark.operators.ordered import joined_in_order, running_sum


def assign_slugs(pages: DataFrame) -> DataFrame:
    """`pages` with a slug of its own per (workspace, topic): in path order the title's, or the first free of -2, -3 ...

    Slugs can only clash where they are the same without numbers at their ends. Such pages stream through a task in path
    order; it keeps the next number of each title's slug, not the pages.
    """
    rows = pages.withColumn("_base", T.slug(F.col("title"))).withColumn("_root", F.regexp_replace("_base", "(-[0-9]+)+$", ""))
    order = ["workspace", "topic", "_root", "path"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, following = None, {}  # the number that each slug's next page tries first; all below it are taken

        def taken(slug: str) -> bool:
            stem, _, n = slug.rpartition("-")
            return slug in following or n.isdigit() and n == str(int(n)) and int(n) > 1 and following.get(stem, 1) > int(n)

        for batch in batches:
            out = []
            for workspace, topic, root, base in zip(*(batch[c].to_pylist() for c in ("workspace", "topic", "_root", "_base"))):
                if (workspace, topic, root) != group:
                    group, following = (workspace, topic, root), {}
                n = following.get(base, 1)
                while taken(base if n == 1 else f"{base}-{n}"):
                    n += 1
                following[base] = n + 1
                out.append(base if n == 1 else f"{base}-{n}")
            yield batch.append_column("slug", pa.array(out, pa.string()))

    sorted_rows = rows.repartition("workspace", "topic", "_root").sortWithinPartitions(*order)
    schema = StructType([*sorted_rows.schema, StructField("slug", StringType())])
    return sorted_rows.mapInArrow(assign, schema).drop("_base", "_root")


def read_batch(docs: DataFrame, pattern: str, budget: int = 120_000) -> DataFrame:
    """Files of a workspace that match, in path order while the character budget lasts; the last one is clipped.

    Only sizes are summed up, over ranges of paths (`running_sum`); the texts of the chosen files are joined to them.
    """
    sizes = docs.where(F.col("path").rlike(pattern)).select("workspace", "path", F.length("content").cast("long").alias("size"))
    chosen = running_sum(sizes, ["workspace"], ["path"], "size", "before", before=True).where(F.col("before") < budget).drop("size")
    room = (F.lit(budget) - F.col("before")).cast("int")
    return docs.select("workspace", "path", "content").join(chosen, ["workspace", "path"]).select("workspace", "path", "before", F.substring("content", F.lit(1), room).alias("content"))


def first_raw_by_title(docs: DataFrame) -> DataFrame:
    w = Window.partitionBy("workspace", "title").orderBy("path")
    return docs.where("layer = 'raw'").withColumn("r", F.row_number().over(w)).where("r = 1").select("workspace", "title", F.col("path").alias("raw_path"))


def section_of_line(pages: DataFrame) -> DataFrame:
    """(path, line_no, line, section): the last heading seen up to each line."""
    lines = pages.select("path", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    heading = F.when(F.col("line").rlike(r"^#{1,6} "), F.regexp_extract("line", r"^#{1,6} (.*)$", 1))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(w))


def dedupe_consecutive_footnotes(pages: DataFrame) -> DataFrame:
    """`pages` without footnote lines that equal the line just before them; no row leaves its page."""
    x = F.split("content", "\n")
    kept = F.filter(x, lambda line, i: ~(line.startswith("[^") & F.coalesce(F.get(F.split(F.col("content"), "\n"), i - 1) == line, F.lit(False))))
    return pages.withColumn("content", F.array_join(kept, "\n"))


def journal(docs: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Wiki pages by month with the raw path of the same title and their current beliefs."""
    counts = beliefs.where("superseded_at IS NULL").groupBy("workspace", "path").agg(F.count("*").alias("beliefs"))
    wiki = docs.where("layer = 'wiki'").select("workspace", "path", "title", F.date_format("updated_at", "yyyy-MM").alias("month"))
    return wiki.join(first_raw_by_title(docs), ["workspace", "title"], "left").join(counts, ["workspace", "path"], "left").na.fill(0, ["beliefs"])


def rewrite_links(pages: DataFrame, slug_map: DataFrame) -> DataFrame:
    """(workspace, path, content): [label](x.md) led to its new path where (workspace, old, new) has one.

    Each page is cut at its links; the links are joined to the map and the page is put together in order again, so the
    map may be of any size. A page's parts are as many as its links.
    """
    link = r"\]\(([^()\s]+\.md)\)"
    targets = F.regexp_extract_all("content", F.lit(link), 1)
    gaps = F.split("content", link)
    parts = pages.select("workspace", "path", F.posexplode(F.arrays_zip(gaps.alias("gap"), targets.alias("old"))).alias("i", "p")).select("workspace", "path", "i", "p.gap", "p.old")
    led = parts.join(slug_map.select("workspace", "old", "new"), ["workspace", "old"], "left")
    piece = F.concat("gap", F.coalesce(F.concat(F.lit("]("), F.coalesce("new", "old"), F.lit(")")), F.lit("")))
    whole = led.groupBy("workspace", "path").agg(F.sort_array(F.collect_list(F.struct("i", piece.alias("s")))).alias("x"))
    return whole.select("workspace", "path", F.array_join(F.transform("x", lambda r: r["s"]), "").alias("content"))


def preview(content: Column, cap: int = 240) -> Column:
    """The first paragraph after the H1, without quotes and headings, `cap` characters of it."""
    rows = F.transform(F.split(content, "\n"), T.strip)
    # Everything after the first H1, with headings and quotes gone and blank lines as marks.
    h1 = F.array_position(F.transform(rows, lambda r: r.startswith("# ")), True).cast("int")
    rest = F.filter(F.slice(rows, h1 + 1, F.size(rows)), lambda r: ~(r.startswith(">") | r.startswith("#")))
    text = T.strip(F.regexp_replace(F.array_join(rest, "\n"), "^\n+", ""))
    para = F.replace(F.split(text, "\n\n")[0], F.lit("\n"), F.lit(" "))
    out = F.when(h1 > 0, para).otherwise("")
    return F.concat(F.substring(out, 1, cap), F.when(F.length(out) > cap, "…").otherwise(""))


def render_new_page(title: Column, body: Column, sources: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n> Sources: "), F.array_join(sources, ", "), F.lit("\n\n## Overview\n"), body, F.lit("\n"))


def _once(content: Column, footnote: Column) -> Column:
    """The footnote's line at the end, unless it is there."""
    line = T.strip(F.coalesce(footnote, F.lit("")))
    return F.when((line == "") | (F.instr(content, line) > 0), content).otherwise(F.concat(F.regexp_replace(content, r"\s+$", ""), F.lit("\n"), footnote, F.lit("\n")))


def render_merge(content: Column, section: Column, addition: Column, footnote: Column | None = None) -> Column:
    """The addition at the end of the section (## or ###), or, where it isn't there, in a new one; the footnote once.

    A section ends at the next heading or, in the last one, at the footnotes; a new one stands before the footnotes.
    """
    second, third = F.concat(F.lit("## "), section), F.concat(F.lit("### "), section)
    at = F.when(F.instr(content, second) > 0, F.instr(content, second)).otherwise(F.instr(content, third))
    after = at + F.length(second)
    rest = F.substring(content, after, F.length(content))
    following = F.regexp_instr(rest, F.lit(r"(?m)^#{1,6} "))
    notes = F.regexp_instr(content, F.lit(r"(?m)^\[\^\d+\]:"))
    cut = F.when((at > 0) & (following > 0), after + following - 2).when(notes > 0, notes - 1).otherwise(F.length(content)).cast("int")
    left, right = F.substring(content, F.lit(1), cut), F.substring(content, cut + 1, F.length(content))
    piece = F.when(at > 0, addition).otherwise(F.concat(second, F.lit("\n\n"), addition))
    inside = F.concat(left, F.lit("\n"), piece, F.lit("\n\n"), right)
    made = F.when(right != "", inside).otherwise(F.concat(content, F.lit("\n\n"), piece, F.lit("\n")))
    return made if footnote is None else _once(made, footnote)


def render_hedge(content: Column, claim: Column, note: Column, date: Column, source: Column, footnote: Column | None = None) -> Column:
    """The claim's first occurrence inside a dated disputed block, the footnote once; null where the claim isn't there."""
    at = F.instr(content, claim)
    block = F.concat(F.lit("::: disputed\n"), claim, F.lit("\n\n**Updated "), date, F.lit(" per "), source, F.lit(":** "), note, F.lit("\n:::\n"))
    made = F.concat(F.substring(content, F.lit(1), at - 1), block, F.substring(content, at + F.length(claim), F.length(content)))
    return F.when(at > 0, made if footnote is None else _once(made, footnote))


def render_cross_ref(content: Column, label: Column, path: Column) -> Column:
    """A link under See Also, once."""
    link = F.concat(F.lit("- ["), label, F.lit("]("), path, F.lit(")"))
    with_head = F.when(content.contains("## See Also"), content).otherwise(F.concat(F.regexp_replace(content, r"\s+$", ""), F.lit("\n\n## See Also\n")))
    return F.when(F.instr(content, link) > 0, content).otherwise(F.concat(F.regexp_replace(with_head, r"\s+$", ""), F.lit("\n"), link, F.lit("\n")))


def maps_of_content(docs: DataFrame) -> DataFrame:
    """(workspace, topic, content): a page per topic that lists its wiki pages by title, joined as they come in order."""
    line = F.concat(F.lit("- ["), "title", F.lit("]("), "path", F.lit(")"))
    lists = joined_in_order(docs.where("layer = 'wiki'").withColumn("_line", line), ["workspace", "topic"], ["title", "path"], "_line", "\n")
    return lists.select("workspace", "topic", F.concat(F.lit("# "), "topic", F.lit("\n\n"), "content").alias("content"))


def export_pages(docs: DataFrame) -> DataFrame:
    """(workspace, topic, path, content): wiki pages with front matter."""
    front = F.concat(F.lit("---\ntitle: "), "title", F.lit("\naliases: []\ntags: ["), "topic", F.lit("]\n---\n\n"))
    return docs.where("layer = 'wiki'").select("workspace", "topic", "path", F.concat(front, F.col("content")).alias("content"))
