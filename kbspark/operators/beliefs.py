"""Beliefs: extraction, history and revision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators.ordered import running_sum
from kbspark.sources.tables import Rounds

CONTENT = ("statement", "subject", "predicate", "object")


def extract_beliefs(pages: DataFrame) -> DataFrame:
    """Lines that cite (and aren't definitions) as beliefs: statement, section, footnotes, subject, predicate, object."""
    lines = pages.select("workspace", "topic", "path", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    heading = F.when(F.col("line").rlike(r"^#{1,6}\s+\S"), T.strip(F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1)))
    before = Window.partitionBy("workspace", "path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.last(heading, ignorenulls=True).over(before))
    cites = F.regexp_extract_all("line", F.lit(r"\[\^(\d+)\]"), 1)
    rows = lines.where((F.size(cites) > 0) & ~F.col("line").startswith("[^") & ~F.col("line").rlike(r"^#{1,6}\s+\S"))
    clean = T.strip(F.regexp_replace(F.regexp_replace(T.strip(F.col("line")), r"\[\^(\d+)\]", ""), r"\s+", " "))
    rows = rows.withColumn("whole", clean).where(F.length("whole") >= 10)
    anchor = F.when(F.col("section").isNotNull(), T.word_slug(F.col("section"), empty=""))
    return rows.select("workspace", "topic", "path", "pos", F.substring("whole", 1, 500).alias("statement"), anchor.alias("section"), F.array_sort(F.array_distinct(cites)).alias("footnote_ids"), T.spo(F.col("whole")).alias("spo")).select("*", "spo.*").drop("spo")


def rebuild_beliefs(pages: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Sidecar rows where a page has any, else what is extracted from it; index and log pages have none."""
    rest = pages.where(~F.element_at(F.split("path", "/"), -1).isin("index.md", "log.md")).join(sidecars.select("workspace", "path").distinct(), ["workspace", "path"], "left_anti")
    columns = ["workspace", "topic", "path", "statement", "footnote_ids"]
    return sidecars.select(*columns).unionByName(extract_beliefs(rest).select(*columns))


def neighbors(hits: DataFrame, beliefs: DataFrame) -> DataFrame:
    """(belief_id, relation, other_id): the direct successor and the predecessors of each hit."""
    ids = hits.select("belief_id")
    ahead = beliefs.join(ids, "belief_id", "left_semi").where("superseded_by IS NOT NULL").select("belief_id", F.lit("successor").alias("relation"), F.col("superseded_by").alias("other_id"))
    behind = beliefs.where("superseded_by IS NOT NULL").select(F.col("superseded_by").alias("belief_id"), F.lit("predecessor").alias("relation"), F.col("belief_id").alias("other_id")).join(ids, "belief_id", "left_semi")
    return ahead.unionByName(behind)


def supersession_chains(beliefs: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(belief_id, last_id, steps): where each belief's chain ends; by pointer doubling, in log2(longest chain) rounds.

    A chain ends at a belief without a successor or whose successor isn't there. Beliefs that run into a cycle have a
    null end. Each round's pointers are written to the shared folder, and those of the round before dropped. Joins are by
    merge: pointers written are a few bytes each, so that tables of any use look small enough to go through the driver,
    each round anew.
    """
    known, rounds = beliefs.select("belief_id", "superseded_by"), Rounds(beliefs.sparkSession, "chains")
    there = known.select(F.col("belief_id").alias("superseded_by"))
    now = rounds.written(known.join(there.hint("merge"), "superseded_by", "left_semi").select("belief_id", F.col("superseded_by").alias("next"), F.lit(1).cast("long").alias("steps")))
    total = now.count()
    for _ in range(max_rounds):
        far = now.select(F.col("belief_id").alias("next"), F.col("next").alias("_next"), F.col("steps").alias("_steps"))
        moved = now.join(far.hint("merge"), "next", "left").select("belief_id", F.coalesce("_next", "next").alias("next"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_next").isNotNull().alias("open"))
        now = rounds.written(moved)
        # A pointer that still moves after more steps than there are beliefs goes round in a cycle.
        left = now.agg(F.count_if("open").alias("open"), F.count_if(F.col("open") & (F.col("steps") <= total)).alias("straight")).first()
        if not left["open"] or not left["straight"]:
            break
        now = now.drop("open")
    ends = now.select("belief_id", F.when(~F.col("open"), F.col("next")).alias("last_id"), F.when(~F.col("open"), F.col("steps")).alias("steps"))
    rest = known.join(now.select("belief_id").hint("merge"), "belief_id", "left_anti").select("belief_id", F.col("belief_id").alias("last_id"), F.lit(0).cast("long").alias("steps"))
    return ends.unionByName(rest)


def as_of(beliefs: DataFrame, at: Column) -> DataFrame:
    """Beliefs held at a time: asserted before it and not superseded before it."""
    return beliefs.where((F.col("asserted_at") < at) & (F.col("superseded_at").isNull() | (F.col("superseded_at") >= at)))


def held(beliefs: DataFrame) -> DataFrame:
    """(workspace, belief_id, asserted_at, superseded_at) of the beliefs that were held at some time.

    One that was superseded no later than it was asserted never was.
    """
    return beliefs.where("asserted_at IS NOT NULL AND (superseded_at IS NULL OR superseded_at > asserted_at)").select("workspace", "belief_id", "asserted_at", "superseded_at")


def as_of_points(beliefs: DataFrame, points: DataFrame) -> DataFrame:
    """(point_id, workspace, n): how many beliefs were held at each of many points, in each workspace that has any.

    Starts and ends are events of +1 and -1, counted per instant; the points read the running sum, which is taken over
    range partitions (`running_sum`), so that neither a workspace nor the whole is one task. A point counts what was before
    its instant; points and instants meet by bins of time, not each with each.
    """
    rows = held(beliefs)
    plus = rows.select("workspace", F.col("asserted_at").alias("at"), F.lit(1).alias("d"))
    minus = rows.where("superseded_at IS NOT NULL").select("workspace", F.col("superseded_at").alias("at"), F.lit(-1).alias("d"))
    changes = plus.unionByName(minus).groupBy("workspace", "at").agg(F.sum("d").alias("d"))
    # A belief is held from the instant after it was asserted up to that at which it was superseded: a point goes first.
    # The result has a row for each workspace and point, so these are all made.
    marks = changes.select("workspace", "at", F.lit(1).alias("o"), "d", F.lit(None).cast("long").alias("point_id"))
    each = changes.select("workspace").distinct()
    asks = each.crossJoin(points).select("workspace", "at", F.lit(0).alias("o"), F.lit(0).cast("long").alias("d"), F.col("point_id").cast("long").alias("point_id"))
    return running_sum(marks.unionByName(asks), ["workspace"], ["at", "o", "point_id"], "d", "n").where("o = 0").select("point_id", "workspace", "n")


DAYS = 30


def as_of_each(beliefs: DataFrame, points: DataFrame, days: int = DAYS) -> DataFrame:
    """(point_id, workspace, belief_id): the beliefs held at each of many points, by an interval join over bins of time.

    A belief lies in the bins of `days` days from its start to its end, a point in one; those of one bin meet. A belief that
    is still held, or was for long, would lie in many bins: bins are of several widths, each twice the one before, and an
    interval is cut into the fewest that cover it, two of a width at most; a point asks once for each width. The range is
    tested on what meets.
    """
    seconds = days * 86400
    rows = held(beliefs)
    at = lambda c: F.floor(F.unix_timestamp(c) / seconds)
    ends = points.agg(F.max("at").alias("_last"))
    last = F.coalesce(F.least(F.col("superseded_at"), F.col("_last")), F.col("_last"))
    rows = rows.join(F.broadcast(ends)).where(F.col("asserted_at") < F.col("_last")).withColumns({"_low": at("asserted_at"), "_high": at(last)})  # one row
    covers = F.flatten(F.array(*(_cover(k) for k in range(WIDTHS))))
    bins = rows.withColumn("_bin", F.explode(covers)).select("workspace", "belief_id", "asserted_at", "superseded_at", "_bin")
    asks = points.select("point_id", "at", F.explode(F.array(*(F.struct(F.lit(k).alias("width"), F.shiftright(at("at"), k).alias("number")) for k in range(WIDTHS)))).alias("_bin"))
    met = bins.join(asks, "_bin").where((F.col("asserted_at") < F.col("at")) & (F.col("superseded_at").isNull() | (F.col("superseded_at") >= F.col("at"))))
    return met.select("point_id", "workspace", "belief_id")


#: Widths of bins: the widest is 2 to the power of WIDTHS - 1 as wide as the narrowest, and what is longer takes several of it.
WIDTHS = 12


def _cover(k: int) -> Column:
    """The bins of width 2^k (in narrowest ones) in the cover of _low to _high: what an end leaves over at this width, and
    of the widest all between."""
    a, b = F.shiftright(F.col("_low") + (1 << k) - 1, k), F.shiftright(F.col("_high") + 1, k)  # from a up to b
    bins = lambda numbers: F.transform(numbers, lambda x: F.struct(F.lit(k).alias("width"), x.alias("number")))
    ends = F.filter(F.array(F.when(a % 2 != 0, a), F.when(b % 2 != 0, b - 1)), lambda x: x.isNotNull())
    return F.when(a >= b, bins(F.array().cast("array<bigint>"))).otherwise(bins(F.sequence(a, F.greatest(a, b - 1)) if k == WIDTHS - 1 else ends))


def _key(df: DataFrame) -> Column:
    return F.xxhash64(*(F.coalesce(F.col(c), F.lit("\x00")) for c in CONTENT))


def merge_beliefs(current: DataFrame, incoming: DataFrame, page_keys: tuple[str, ...] = ("workspace", "path")) -> DataFrame:
    """(page keys, statement, belief_id, action): one row per content of a re-ingested page.

    The same content keeps its old id, missing content is superseded, new content is inserted. Contents meet by a hash
    of their null-safe fields, of which each side has one row.
    """
    pages = incoming.select(*page_keys).distinct()
    old = current.join(pages, list(page_keys), "left_semi").withColumn("k", _key(current)).groupBy(*page_keys, "k").agg(F.min_by("statement", "belief_id").alias("old_statement"), F.min("belief_id").alias("belief_id"))
    new = incoming.withColumn("k", _key(incoming)).groupBy(*page_keys, "k").agg(F.min("statement").alias("new_statement"))
    both = old.join(new, [*page_keys, "k"], "full")
    action = F.when(F.col("new_statement").isNull(), "supersede").when(F.col("belief_id").isNull(), "insert").otherwise("keep")
    return both.select(*page_keys, F.coalesce("old_statement", "new_statement").alias("statement"), "belief_id", action.alias("action"))


def footnote_coverage(beliefs: DataFrame, footnotes: DataFrame) -> DataFrame:
    """(workspace, path, footnote_id, gap): footnotes without a belief, and cited ids without a footnote."""
    cited = beliefs.select("workspace", "path", F.explode("footnote_ids").alias("footnote_id")).distinct()
    defined = footnotes.select("workspace", F.col("page_path").alias("path"), "footnote_id").distinct()
    keys = ["workspace", "path", "footnote_id"]
    return defined.join(cited, keys, "left_anti").withColumn("gap", F.lit("no belief")).unionByName(cited.join(defined, keys, "left_anti").withColumn("gap", F.lit("no footnote")))


def apply_supersessions(beliefs: DataFrame, pairs: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(all beliefs after the pairs (belief_id, statement, reason) are applied, pairs whose belief isn't there)."""
    p = pairs.select("belief_id", F.col("statement").alias("_statement"), F.col("reason").alias("_reason"), F.concat("belief_id", F.lit("-r")).alias("_new"))
    hit = beliefs.join(p, "belief_id", "left")
    closed = hit.select(*(c for c in beliefs.columns if c not in ("superseded_at", "superseded_by")), F.when(F.col("_new").isNotNull(), at).otherwise(F.col("superseded_at")).alias("superseded_at"), F.coalesce("_new", "superseded_by").alias("superseded_by"), F.col("_reason").alias("reason"))
    made = hit.where("_new IS NOT NULL").select(F.col("_new").alias("belief_id"), F.col("_statement").alias("statement"), *(c for c in beliefs.columns if c not in ("belief_id", "statement", "asserted_at", "superseded_at", "superseded_by")), at.alias("asserted_at"), F.lit(None).cast("timestamp").alias("superseded_at"), F.lit(None).cast("string").alias("superseded_by"), F.lit(None).cast("string").alias("reason"))
    return closed.unionByName(made), pairs.join(beliefs.select("belief_id"), "belief_id", "left_anti")


def supersede_documents(beliefs: DataFrame, pages: DataFrame, at: Column, reason: str) -> DataFrame:
    """All beliefs, the current ones of the given (workspace, path) pages closed with a time and a reason."""
    hit = beliefs.join(pages.select("workspace", "path").distinct().withColumn("_hit", F.lit(True)), ["workspace", "path"], "left")
    close = F.col("_hit").isNotNull() & F.col("superseded_at").isNull()
    return hit.withColumns({"superseded_at": F.when(close, at).otherwise(F.col("superseded_at")), "reason": F.when(close, reason)}).drop("_hit")


def graph(beliefs: DataFrame, include_superseded: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): beliefs and topics; in_topic, and supersedes where both ends are nodes."""
    rows = beliefs if include_superseded else beliefs.where("superseded_at IS NULL")
    topic = F.coalesce(T.nonempty(F.col("topic")), F.lit("general"))
    nodes = rows.select(F.col("belief_id").alias("id"), F.lit("belief").alias("kind"), F.substring("statement", 1, 80).alias("label"))
    nodes = nodes.unionByName(rows.select(F.concat(F.lit("topic:"), topic).alias("id"), F.lit("topic").alias("kind"), topic.alias("label")).distinct())
    edges = rows.select(F.col("belief_id").alias("src"), F.concat(F.lit("topic:"), topic).alias("dst"), F.lit("in_topic").alias("kind"))
    links = rows.where("superseded_by IS NOT NULL").select(F.col("superseded_by").alias("src"), F.col("belief_id").alias("dst"), F.lit("supersedes").alias("kind"))
    return nodes, edges.unionByName(links.join(rows.select(F.col("belief_id").alias("src")), "src", "left_semi").select("src", "dst", "kind"))

