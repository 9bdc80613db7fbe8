"""Streaming jobs (R1 to R10), each on the batch operator that it repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kbspark.functions import text as T
from kbspark.operators import ingest as I
from kbspark.operators import quality as Q
from kbspark.sources.buckets import Buckets
from kbspark.streaming import state


def _write(df: DataFrame, path: str, batch: int) -> None:
    """A batch goes to a folder of its own, so that a batch that runs again replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


class Seen:
    """The keys that a sink holds, in hash buckets beside it, with the batch that each came with.

    A batch reads the buckets that its keys fall in, one file each, and replaces them. Keys of the batch itself count as
    not seen, so that a batch that runs again finds what it found before.
    """

    def __init__(self, df: DataFrame, path: str, keys: list[str], batch: int, buckets: int):
        kinds = dict(df.dtypes)
        self.keys, self.batch = keys, batch
        self.table = Buckets(df.sparkSession, path, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", batch long", keys, buckets)
        self.known = self.table.read(self.table.touched(df)).where(F.col("batch") < batch)

    def record(self, rows: DataFrame) -> None:
        new = rows.select(*self.keys).distinct().withColumn("batch", F.lit(self.batch).cast("long"))
        self.table.replace(self.known.unionByName(new))


def stream_new_items(stream: DataFrame, items_path: str, events_path: str, checkpoint: str, window: str = "7 days", buckets: int = 64) -> StreamingQuery:
    """New items and an event for each, both idempotent by batch.

    Repeats that arrive within `window` are dropped by the state store, whose watermark runs on the time of arrival, so that
    an item published long ago is never too late. What is left is tested exactly against the keys of all earlier items.
    """
    keys = ["workspace", "external_id", "content_hash"]

    def land(df: DataFrame, batch: int) -> None:
        df = df.drop("_arrived", "_id").persist()
        seen = Seen(df, f"{items_path}_keys", keys, batch, buckets)
        fresh = I.new_items(df, seen.known, ["item_id"]).persist()
        _write(fresh, items_path, batch)
        _write(fresh.select("workspace", F.lit("subscription").alias("source_type"), F.lit("item").alias("event_type"), "title", "url", F.col("published_at").alias("occurred_at")), events_path, batch)
        seen.record(fresh.where("external_id IS NOT NULL"))
        fresh.unpersist()
        df.unpersist()

    # An item without an id of its source is always new.
    named = stream.withColumns({"_arrived": F.current_timestamp(), "_id": F.coalesce("external_id", F.concat(F.lit("\x00"), F.col("item_id").cast("string")))})
    once = named.withWatermark("_arrived", window).dropDuplicatesWithinWatermark(["workspace", "_id", "content_hash"])
    return once.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_changed_files(stream: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """(path, content_hash) whenever a file's content differs from the last one seen under its path."""
    changed = state.changed_files(stream.select("path", F.sha2("content", 256).alias("content_hash")))
    return changed.writeStream.format("parquet").option("path", state_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_commits(stream: DataFrame, sink_path: str, checkpoint: str, first: int = 200, buckets: int = 64) -> StreamingQuery:
    """Commits of each repository that weren't there before, told by their sha; of a repository's first batch, its newest `first`.

    Author dates don't matter but for those newest: rebased, merged and equally dated commits arrive, each once. The older
    commits of a first batch count as seen.
    """

    def land(df: DataFrame, batch: int) -> None:
        df = df.dropDuplicates(["repository", "sha"]).persist()
        seen = Seen(df, f"{sink_path}_keys", ["repository", "sha"], batch, buckets)
        known = Seen(df, f"{sink_path}_repositories", ["repository"], batch, buckets)
        repositories = known.known.select("repository")
        later = df.join(repositories, "repository", "left_semi").join(seen.known, ["repository", "sha"], "left_anti").select(*df.columns)
        new = Q.recent_per_key(df.join(repositories, "repository", "left_anti").select(*df.columns), ["repository"], [F.desc("occurred_at"), F.col("sha")], first).drop("rank")
        _write(later.unionByName(new), sink_path, batch)
        seen.record(df.join(seen.known, ["repository", "sha"], "left_anti"))
        known.record(df.join(repositories, "repository", "left_anti"))
        df.unpersist()

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_timeline(events: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Counts by day and kind, each day once the watermark has passed it."""
    days = events.withWatermark("occurred_at", watermark).groupBy(F.window("occurred_at", "1 day"), "workspace", "source_type").agg(F.count("*").alias("n"))
    return days.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "workspace", "source_type", "n")


def stream_weekly(events: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Counts over the last seven days, for every day."""
    weeks = events.withWatermark("occurred_at", watermark).groupBy(F.window("occurred_at", "7 days", "1 day"), "source_type", "event_type").agg(F.count("*").alias("n"))
    return weeks.select(F.date_format("window.end", "yyyy-MM-dd").alias("until"), "source_type", "event_type", "n")


def debounce(changes: DataFrame, gap: str = "500 milliseconds", watermark: str = "10 seconds") -> DataFrame:
    """(path, last_change, changes): a file once it has been quiet for `gap`."""
    quiet = changes.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "path").agg(F.max("ts").alias("last_change"), F.count("*").alias("changes"))
    return quiet.select("path", "last_change", "changes")


def stream_sessions(messages: DataFrame, sink_path: str, checkpoint: str) -> StreamingQuery:
    """Transcripts as they grow: a session that got new messages is captured anew, as its next version."""
    captured = state.sessions(messages)
    return captured.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_late(events: DataFrame, sink_path: str, late_path: str, checkpoint: str, delay: str = "2 days", width: str | None = "1 day") -> StreamingQuery:
    """Events that a query over windows of `width` with a watermark of `delay` would drop go to a table of their own; none is lost.

    The watermark of a batch is the latest event of the batches before it less `delay`, as Spark's is; it is kept with the
    sink, a row for each batch, of which a batch reads that before it. An event is late when its window ended by then (without
    a width, when it happened by then). So over the same batches `stream_timeline` and the late table add up to all events.
    """
    marks = f"{sink_path}_marks"

    def land(df: DataFrame, batch: int) -> None:
        df = df.persist()
        spark = df.sparkSession
        before = spark.read.schema("mark timestamp").parquet(f"{marks}/batch={batch - 1}").first()["mark"] if batch else None
        over = F.window("occurred_at", width)["end"] if width else F.col("occurred_at")
        late = F.coalesce(over <= F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {delay}"), F.lit(False))
        judged = df.withColumn("_late", late) if before is not None else df.withColumn("_late", F.lit(False))
        _write(judged.where("NOT _late").drop("_late"), sink_path, batch)
        _write(judged.where("_late").drop("_late"), late_path, batch)
        _write(df.agg(F.greatest(F.max("occurred_at"), F.lit(before).cast("timestamp")).alias("mark")), marks, batch)
        df.unpersist()

    return events.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sweep_stale(runs: DataFrame, now: Column, ttl_seconds: int, to: str = "abandoned") -> DataFrame:
    """Pending runs that started longer ago than the limit get another status."""
    stale = (F.col("status") == "pending") & (F.unix_timestamp(now) - F.unix_timestamp("started_at") > ttl_seconds)
    return runs.withColumn("status", F.when(stale, to).otherwise(F.col("status")))


def stream_redact_logs(lines: DataFrame, extra_patterns: tuple[tuple[str, bool], ...] = ()) -> DataFrame:
    return lines.withColumn("value", T.redact(F.col("value"), extra_patterns))
