"""Citations: verification, following and lint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.sources.tables import shared_table


def name_of(path):
    return F.element_at(F.split(path, "/"), -1)


def resolved(footnotes: DataFrame, docs: DataFrame) -> DataFrame:
    """Footnotes with `source_path`: the document of that path, else the first under raw/ with that file name.

    Paths that climb out of the workspace name nothing. Only paths are joined here, not contents.
    """
    paths = docs.select("workspace", "path")
    ref = footnotes.withColumn("_ref", F.when(~F.col("source_file").contains(".."), F.regexp_replace("source_file", "^/+", "")))
    exact = ref.join(paths.select("workspace", F.col("path").alias("_exact")), (ref["workspace"] == paths["workspace"]) & (F.col("_ref") == F.col("_exact")), "left").drop(paths["workspace"])
    named = paths.where(F.col("path").startswith("raw/")).groupBy("workspace", name_of("path").alias("_name")).agg(F.min("path").alias("_named"))
    both = exact.withColumn("_name", name_of("_ref")).join(named, ["workspace", "_name"], "left")
    return both.withColumn("source_path", F.coalesce("_exact", "_named")).drop("_ref", "_exact", "_name", "_named")


def verify_citations(footnotes: DataFrame, docs: DataFrame) -> DataFrame:
    """status (verified, quote_not_found, source_missing, hash_mismatch, no_quote_provided) and offset of each quote.

    A source's quotes meet its content once: the content is joined to the footnotes' paths and only the offset goes on.
    """
    notes = resolved(footnotes, docs)
    content = docs.select("workspace", F.col("path").alias("source_path"), F.col("content").alias("_content"))
    joined = notes.join(content, ["workspace", "source_path"], "left").withColumn("_at", F.instr("_content", F.col("quote"))).drop("_content")
    has_quote = F.length(T.strip(F.coalesce("quote", F.lit("")))) > 0
    status = (
        F.when(~has_quote, "no_quote_provided")
        .when(F.col("source_path").isNull(), "source_missing")
        .when(F.col("_at") == 0, "quote_not_found")
        .when(F.coalesce("stored_hash", T.quote_hash(F.col("quote"))) != T.quote_hash(F.col("quote")), "hash_mismatch")
        .otherwise("verified")
    )
    return joined.withColumn("status", status).withColumn("offset", F.when(F.col("status").isin("verified", "hash_mismatch"), F.col("_at") - 1)).drop("_at")


def _rarest(asked: DataFrame, there: DataFrame, by: str) -> DataFrame:
    """Each quote with the one of its keys that the fewest rows of `there` (one a key and row) have."""
    df = there.groupBy("key").agg(F.count("*").alias("df"))
    least = Window.partitionBy(by).orderBy(F.coalesce("df", F.lit(0)), "key")
    return asked.join(df, "key", "left").withColumn("_r", F.row_number().over(least)).where("_r = 1").drop("_r", "df")


def quote_search(quotes: DataFrame, docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(quote_id, doc_id, offset) of the documents that hold a quote verbatim.

    A quote meets documents by its rarest key: a run of up to `shingle` of its inner words (the first and last may be
    cut); with two words, up to two characters on either side of the boundary. Keys of a run are made of those of the run
    that is a word shorter, so that their cost is in proportion to the text. A single word is looked up among the distinct
    words of all texts, by its rarest three characters, and the words that hold it lead to the documents; only a quote of
    spaces alone meets every text. The equal join on the key's digest leaves few pairs for the text comparison. Documents
    give keys of the lengths that the quotes have only, which are looked up first. An empty quote is in no document.
    """
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    key = lambda kind, part: F.xxhash64(F.lit(kind), part)
    none = F.array().cast("array<bigint>")
    from_nth = lambda c, n: F.slice(c, n, F.greatest(F.size(c) - n + 1, F.lit(0)))

    def runs(hashes, n):
        """Keys of the runs of n words, each of that of n - 1 words and the next word's; ends without a next word are left out."""
        made = hashes
        for k in range(2, n + 1):
            made = F.zip_with(F.slice(made, 1, F.greatest(F.size(hashes) - k + 1, F.lit(0))), from_nth(hashes, k), lambda a, b: F.xxhash64(a, b))
        return F.transform(made, lambda h: key(f"words{n}", h))

    def bounds(ws, left, right):
        made = F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), from_nth(ws, 2), lambda a, b: F.concat(F.right(a, F.lit(left)), F.lit(" "), F.left(b, F.lit(right))))
        return F.transform(made, lambda x: key(f"bound{left}{right}", x))

    def grams(c, n):
        """The n-character strings of a text, by pieces put together, as counting characters from the start takes the square."""
        one = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
        made = one
        for k in range(2, n + 1):
            made = F.zip_with(F.slice(made, 1, F.greatest(F.size(one) - k + 1, F.lit(0))), from_nth(one, k), lambda a, b: F.concat(a, b))
        return F.array_distinct(made)

    hashed = lambda ws: F.transform(ws, lambda w: F.xxhash64(w))
    q = quotes.where("quote <> ''").withColumn("_all", words("quote"))
    q = q.withColumns({"_m": F.size("_all"), "_w": F.slice("_all", 2, F.greatest(F.size("_all") - 2, F.lit(0)))})
    q = q.withColumns({"_n": F.least(F.size("_w"), F.lit(shingle)), "_a": F.when(F.col("_m") == 2, F.least(F.length(F.col("_all")[0]), F.lit(2))).otherwise(0), "_b": F.when(F.col("_m") == 2, F.least(F.length(F.col("_all")[1]), F.lit(2))).otherwise(0), "_c": F.when(F.col("_m") == 1, F.least(F.length(F.get("_all", F.lit(0))), F.lit(3))).otherwise(0)})
    kinds = {tuple(r) for r in q.select("_m", "_n", "_a", "_b", "_c").withColumn("_m", F.least("_m", F.lit(3))).distinct().collect()}  # few
    lengths, cuts, sizes = sorted({k[1] for k in kinds if k[0] > 2}), sorted({k[2:4] for k in kinds if k[0] == 2}), sorted({k[4] for k in kinds if k[0] == 1})
    d = docs.select("doc_id", words("content").alias("_w"))

    # Two words or more.
    of = lambda here, each: F.array_distinct(F.concat(none, *each(F.col(here))))
    made = of("_w", lambda ws: [*(runs(hashed(ws), n) for n in lengths), *(bounds(ws, *c) for c in cuts)])
    by_words = [F.when((F.col("_m") > 2) & (F.col("_n") == n), runs(hashed(F.col("_w")), n)) for n in lengths]
    by_bounds = [F.when((F.col("_m") == 2) & (F.col("_a") == a) & (F.col("_b") == b), bounds(F.col("_all"), a, b)) for a, b in cuts]
    asked = q.where("_m >= 2").select("quote_id", "quote", F.explode(F.coalesce(none if not by_words and not by_bounds else F.lit(None).cast("array<bigint>"), *by_words, *by_bounds)).alias("key"))
    there = shared_table(d.select("doc_id", F.explode(made).alias("key")).join(asked.select("key").distinct(), "key", "left_semi"), "quote-keys")
    pairs = _rarest(asked, there, "quote_id").join(there, "key").select("quote_id", "quote", "doc_id")

    # One word.
    if sizes:
        holds = d.select("doc_id", F.explode(F.array_distinct("_w")).alias("word"))
        alone = q.where("_m = 1").withColumn("_word", F.col("_all")[0])
        wanted = alone.select("quote_id", "quote", "_word", F.explode(F.coalesce(*(F.when(F.col("_c") == n, grams(F.col("_word"), n)) for n in sizes))).alias("key"))
        known = holds.select("word").distinct()
        pieces = shared_table(known.select("word", F.explode(F.array_distinct(F.concat(*(grams(F.col("word"), n) for n in sizes)))).alias("key")).join(wanted.select("key").distinct(), "key", "left_semi"), "quote-words")
        within = _rarest(wanted, pieces, "quote_id").join(pieces, "key").where(F.contains("word", F.col("_word"))).select("quote_id", "quote", "word")
        pairs = pairs.unionByName(within.join(holds, "word").select("quote_id", "quote", "doc_id").distinct())

    # Spaces alone.
    if any(k[0] == 0 for k in kinds):
        pairs = pairs.unionByName(q.where("_m = 0").select("quote_id", "quote").crossJoin(docs.select("doc_id")))

    found = pairs.join(docs.select("doc_id", "content"), "doc_id").withColumn("offset", F.instr("content", F.col("quote")) - 1)
    return found.where("offset >= 0").select("quote_id", "doc_id", "offset")


def follow(footnotes: DataFrame, docs: DataFrame, cap: int = 8000) -> DataFrame:
    """The text that a footnote leads to, `cap` characters of it, and the page hint."""
    notes = resolved(footnotes, docs)
    content = docs.select("workspace", F.col("path").alias("source_path"), F.substring("content", 1, cap).alias("text"))
    return notes.join(content, ["workspace", "source_path"], "left")


def orphaned_beliefs(beliefs: DataFrame, pages: DataFrame) -> DataFrame:
    return beliefs.where("superseded_at IS NULL AND path <> ''").join(pages.select("workspace", "path"), ["workspace", "path"], "left_anti")


def missing_sources(footnotes: DataFrame, docs: DataFrame) -> DataFrame:
    return resolved(footnotes, docs).where("source_path IS NULL").drop("source_path")


def lint(pages: DataFrame, findings: DataFrame, beliefs: DataFrame, least: int = 100) -> DataFrame:
    """(workspace, path, severity, issue): nearly empty pages, pages without citations, missing sources, drifted quotes, orphans."""
    where = lambda d, c, severity, issue: d.where(c).select("workspace", "path", F.lit(severity).alias("severity"), F.lit(issue).alias("issue"))
    cited = pages.select("workspace", "path", F.length("content").alias("n"), (F.size(T.footnotes(F.col("content"))) == 0).alias("none"))
    notes = findings.withColumnRenamed("page_path", "path")
    parts = [
        where(cited, F.col("n") < least, "warning", "nearly empty"),
        where(cited, F.col("none"), "info", "no citations"),
        where(notes, F.col("status") == "source_missing", "error", "missing source"),
        where(notes, F.col("status").isin("quote_not_found", "hash_mismatch"), "error", "drifted quote"),
        where(orphaned_beliefs(beliefs, pages), F.lit(True), "warning", "orphan belief"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
