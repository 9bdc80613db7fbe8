"""Counts, metrics and reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators.ordered import joined_in_order

def current(beliefs: DataFrame) -> DataFrame:
    return beliefs.where("superseded_at IS NULL")


def capability_row(docs: DataFrame, beliefs: DataFrame, runs: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: pages, current beliefs, topics, committed runs, share of committed among committed and rejected."""
    topics = F.approx_count_distinct("topic") if approximate else F.count_distinct("topic")
    a = docs.agg(F.count_if(F.col("layer") == "wiki").alias("pages"))
    b = current(beliefs).agg(F.count("*").alias("beliefs"), topics.alias("topics"))
    done, bad = F.count_if(F.col("status") == "committed"), F.count_if(F.col("status") == "rejected")
    c = runs.agg(done.alias("committed"), F.round(done / F.when(done + bad > 0, done + bad), 4).alias("verified_rate"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # three single rows


def percentile_linear(df: DataFrame, column: str, by: list[str], points: tuple[float, ...] = (0.5, 0.95), approximate: bool = False) -> DataFrame:
    f = F.percentile_approx if approximate else F.percentile
    return df.groupBy(*by).agg(*(f(column, F.lit(p)).alias(f"p{round(100 * p)}") for p in points))


def workspace_stats(docs: DataFrame, beliefs: DataFrame) -> DataFrame:
    a = docs.groupBy("workspace").agg(*(F.count_if(F.col("layer") == k).alias(f"{k}_docs") for k in ("raw", "wiki")), F.array_join(F.sort_array(F.collect_set("topic")), ",").alias("topics"))
    b = beliefs.groupBy("workspace").agg(F.count_if(F.col("superseded_at").isNull()).alias("current_beliefs"), F.count_if(F.col("superseded_at").isNotNull()).alias("superseded_beliefs"))
    return a.join(b, "workspace", "full").na.fill(0)


def topic_density(beliefs: DataFrame) -> DataFrame:
    return current(beliefs).groupBy("workspace", "topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "workspace", "topic")


def belief_counts(beliefs: DataFrame) -> DataFrame:
    return current(beliefs).groupBy("workspace", "path").agg(F.count("*").alias("n"))


def _metric(df: DataFrame, name: str, score: Column, least: float) -> DataFrame:
    out = df.groupBy("workspace").agg(score.alias("score"))
    return out.select("workspace", F.lit(name).alias("metric"), "score", (F.col("score") >= least).alias("passed"))


def _share(part: Column, whole: Column, empty: float = 1.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(empty)


def sampled(beliefs: DataFrame, sample: int, seed: str = "", key: str = "belief_id") -> DataFrame:
    """`sample` rows of each workspace: those whose hash of seed and key is least, ties by key.

    The sample is the same on every run and for any partitioning, and a row stays in it unless smaller ones come. A share p
    of a sample of n has a standard error of sqrt(p (1 - p) / n), at most 0.5 / sqrt(n).
    """
    order = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    w = Window.partitionBy("workspace").orderBy("_order", key)
    return beliefs.withColumn("_order", order).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= sample).drop("_order", "_rank")


def citation_fidelity(beliefs: DataFrame, sample: int | None = None, seed: str = "") -> DataFrame:
    """M1: current beliefs with citations over all current ones, or over `sample` of them a workspace; 1 where there are none;
    passes from 0.8."""
    now = F.col("superseded_at").isNull()
    rows = beliefs if sample is None else sampled(beliefs.where(now), sample, seed).unionByName(beliefs.where(~now))
    return _metric(rows, "M1", _share(F.count_if(now & (F.size("footnote_ids") > 0)), F.count_if(now)), 0.8)


def coverage(docs: DataFrame) -> DataFrame:
    """M2: wiki pages over raw documents, at most 1; passes from 0.5."""
    wiki, raw = F.count_if(F.col("layer") == "wiki"), F.count_if(F.col("layer") == "raw")
    return _metric(docs, "M2", F.least(F.lit(1.0), _share(wiki, raw)), 0.5)


def pass_rate(runs: DataFrame) -> DataFrame:
    """M3: committed over committed and rejected runs; passes from 0.7."""
    done, bad = F.count_if(F.col("status") == "committed"), F.count_if(F.col("status") == "rejected")
    return _metric(runs, "M3", _share(done, done + bad), 0.7)


def cost(runs: DataFrame, budget: float = 50.0) -> DataFrame:
    """M4: what is left of the budget, as a share, 0 at least; passes while under it."""
    out = runs.groupBy("workspace").agg(F.sum("usd").alias("usd"))
    return out.select("workspace", F.lit("M4").alias("metric"), F.greatest(F.lit(0.0), 1 - F.col("usd") / budget).alias("score"), (F.col("usd") < budget).alias("passed"))


def self_consistency(beliefs: DataFrame) -> DataFrame:
    """M5: of the pairs of current beliefs of a topic, those where both have a subject; counted, not made."""
    per = current(beliefs).groupBy("workspace", "topic").agg(F.count("*").alias("n"), F.count("subject").alias("k"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    return _metric(per, "M5", _share(pairs("k"), pairs("n")), 0.6)


Metric = Callable[[dict[str, DataFrame]], DataFrame]
METRICS: dict[str, Metric] = {
    "M1": lambda t: citation_fidelity(t["beliefs"]),
    "M2": lambda t: coverage(t["documents"]),
    "M3": lambda t: pass_rate(t["runs"]),
    "M4": lambda t: cost(t["runs"]),
    "M5": lambda t: self_consistency(t["beliefs"]),
}


def belief_metrics(beliefs: DataFrame) -> DataFrame:
    """M1 and M5 from one pass over the beliefs."""
    now = F.col("superseded_at").isNull()
    counts = {"n": now, "cited": now & (F.size("footnote_ids") > 0), "k": now & F.col("subject").isNotNull()}
    per = beliefs.groupBy("workspace", "topic").agg(*(F.count_if(c).alias(name) for name, c in counts.items()))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = per.groupBy("workspace").agg(F.sum("n").alias("n"), _share(F.sum("cited"), F.sum("n")).alias("M1"), _share(pairs("k"), pairs("n")).alias("M5"))
    row = lambda m, least: F.struct(F.lit(m).alias("metric"), F.col(m).alias("score"), (F.col(m) >= least).alias("passed"))
    told = both.select("workspace", "n", F.inline(F.array(row("M1", 0.8), row("M5", 0.6))))
    # A workspace without current beliefs has no topics to compare.
    return told.where((F.col("metric") == "M1") | (F.col("n") > 0)).drop("n")


def metrics_report(tables: dict[str, DataFrame], metrics: dict[str, Metric] = METRICS) -> DataFrame:
    """All metrics; those that are as registered and read the beliefs share a pass."""
    shared = [name for name in ("M1", "M5") if metrics.get(name) is METRICS[name]]
    together = [belief_metrics(tables["beliefs"])] if len(shared) == 2 else []
    return reduce(DataFrame.unionByName, [*together, *(m(tables) for name, m in metrics.items() if not together or name not in shared)])


def synthesis_gate(eval_runs: DataFrame) -> DataFrame:
    """Open where the latest M1 and M2 both passed; reasons name those that didn't or aren't there."""
    last = eval_runs.where(F.col("metric").isin("M1", "M2")).groupBy("workspace").agg(*(F.max_by("passed", F.when(F.col("metric") == m, F.col("month"))).alias(m) for m in ("M1", "M2")))
    reason = lambda m: F.when(F.col(m).isNull(), f"{m} missing").when(~F.col(m), f"{m} failed")
    return last.select("workspace", (F.coalesce("M1", F.lit(False)) & F.coalesce("M2", F.lit(False))).alias("open"), F.concat_ws(", ", reason("M1"), reason("M2")).alias("reasons"))


def dedup_beliefs(beliefs: DataFrame) -> DataFrame:
    """Current beliefs of equal content on one page: the oldest stays, the others are superseded by it."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    same = F.xxhash64("workspace", empty("path"), empty("statement"), empty("subject"), empty("predicate"), empty("object"))
    w = Window.partitionBy("same", "workspace", "path").orderBy("asserted_at", "belief_id")
    rows = current(beliefs).withColumn("same", same).withColumn("kept_id", F.first("belief_id").over(w))
    return rows.where("belief_id <> kept_id").select("belief_id", F.col("kept_id").alias("superseded_by"), F.lit("dedup_cleanup").alias("reason"))


def events_by_type(events: DataFrame, since: str) -> DataFrame:
    return events.where(F.col("ingested_at") >= F.lit(since).cast("timestamp")).groupBy("source_type", "event_type").agg(F.count("*").alias("n"))


def event_rollup(events: DataFrame) -> DataFrame:
    """Counts by source type, event type and day with all subtotals; `level` tells the grouping."""
    days = events.withColumn("day", F.date_format("occurred_at", "yyyy-MM-dd"))
    return days.cube("source_type", "event_type", "day").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


STRUCTURAL = ("overview.md", "index.md", "log.md")


def verify_pages(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Verdict per page: structural pages need no citations; none, a bad one, or an undated dispute rejects."""
    per = findings.groupBy("workspace", F.col("page_path").alias("path")).agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("status").isin("hash_mismatch", "source_missing", "quote_not_found"), F.concat(F.lit("[^"), "footnote_id", F.lit("] "), "source_file", F.lit(": "), "status")))).alias("bad"),
    )
    name = F.element_at(F.split("path", "/"), -1)
    text = F.col("content")
    reasons = F.concat(
        F.when(F.col("n").isNull() & ~name.isin(*STRUCTURAL), F.array(F.lit("no footnotes"))).otherwise(F.array().cast("array<string>")),
        F.coalesce("bad", F.array().cast("array<string>")),
        F.when(text.contains("::: disputed") & ~(text.contains("Updated ") & text.contains(" per ")), F.array(F.lit("undated dispute"))).otherwise(F.array().cast("array<string>")),
    )
    out = pages.join(per, ["workspace", "path"], "left").withColumn("reasons", reasons)
    return out.select("workspace", "path", F.when(F.size("reasons") > 0, "reject").otherwise("commit").alias("verdict"), F.array_join("reasons", "; ").alias("reasons"))


def directory_sizes(docs: DataFrame) -> DataFrame:
    """Files, bytes and a token estimate by the first two directories, with totals."""
    parts = F.split("path", "/")
    size = F.length("content").cast("long")
    rows = docs.select(parts[0].alias("dir1"), parts[1].alias("dir2"), size.alias("size"))
    return rows.rollup("dir1", "dir2").agg(F.grouping_id().alias("level"), F.count("*").alias("files"), F.sum("size").alias("size"), F.floor(F.sum("size") / 4).alias("tokens"))


def llm_usage(calls: DataFrame, max_usd: float) -> DataFrame:
    """Tokens and USD by run and role, and whether the run's cost is over the budget."""
    per = calls.groupBy("run_id", "role").agg(*(F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "cache_read", "cache_write")))
    usd = T.usd(*(F.col(c) for c in ("tokens_in", "tokens_out", "cache_read", "cache_write")))
    return per.withColumn("usd", usd).withColumn("over_budget", F.sum("usd").over(Window.partitionBy("run_id")) > max_usd)


def capture_sessions(messages: DataFrame) -> DataFrame:
    """One document per session: its messages in order, their number and the text's hash. Messages are joined as they come in order."""
    said = F.concat(F.lit("**"), "role", F.lit("**: "), "content")
    sessions = joined_in_order(messages.withColumn("_said", said), ["session_id"], ["seq", "role", "content"], "_said", "\n\n")
    return sessions.withColumn("content_hash", F.sha2("content", 256))


def topic_index(docs: DataFrame) -> DataFrame:
    """Pages per topic, the first five titles and how many more there are; five titles a task are kept on the way."""
    first = Window.partitionBy("workspace", "topic").orderBy("title", "path")
    counts = docs.groupBy("workspace", "topic").agg(F.count("*").alias("pages"))
    top = docs.withColumn("r", F.row_number().over(first)).where("r <= 5").groupBy("workspace", "topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]), " | ").alias("titles"))
    return counts.join(top, ["workspace", "topic"]).withColumn("more", F.greatest(F.col("pages") - 5, F.lit(0)).cast("long"))


def journal_months(docs: DataFrame) -> DataFrame:
    return docs.groupBy("workspace", F.date_format("updated_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def gold_query_score(pairs: DataFrame) -> DataFrame:
    """Per query: shared over all topics, times the same of citations."""
    overlap = lambda a, b: _share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))
    return pairs.select("query_id", (overlap("expected_topics", "actual_topics") * overlap("expected_citations", "actual_citations")).alias("score"))


def index_integrity(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """One row per workspace: documents, indexed ones, and whether the numbers agree."""
    a = docs.groupBy("workspace").agg(F.count("*").alias("docs"))
    b = postings.groupBy("workspace").agg(F.count_distinct("doc_id").alias("indexed"))
    out = a.join(b, "workspace", "left").na.fill(0, ["indexed"])
    return out.withColumn("status", F.when(F.col("docs") == F.col("indexed"), "ok").otherwise("row_count_mismatch"))


def sync_report(source_runs: DataFrame) -> DataFrame:
    """Per cycle: sources, those without errors, items, errors, verdict; a run fails only with errors and no items."""
    failed = (F.col("errors") > 0) & (F.col("items") == 0)
    out = source_runs.groupBy("run_id").agg(F.count("*").alias("attempted"), F.count_if(F.col("errors") == 0).alias("succeeded"), F.sum("items").alias("items"), F.sum("errors").alias("errors"), F.count_if(failed).alias("failed"))
    return out.withColumn("verdict", F.when(F.col("errors") == 0, "pass").otherwise("partial"))


def duplicate_documents(docs: DataFrame) -> DataFrame:
    out = docs.groupBy("workspace", "content_hash").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))
    return out.where("n > 1")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def recent_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def eval_trend(eval_runs: DataFrame, drop: float = 0.05) -> DataFrame:
    """Each score with the one before it and whether it fell by more than `drop`."""
    w = Window.partitionBy("workspace", "metric").orderBy("month")
    out = eval_runs.withColumn("before", F.lag("score").over(w))
    return out.withColumn("regressed", F.coalesce(F.col("before") - F.col("score") > drop, F.lit(False)))
