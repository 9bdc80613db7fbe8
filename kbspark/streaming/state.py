"""Keyed state of the streams: what was last seen of a file, a session or a run.

State lies in Spark's state store (RocksDB, in the query's checkpoint), so that a batch reads its own rows and the state of
their keys only, and a restart goes on where the last batch ended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state needs another store than Spark's default; a provider that the session sets itself stays."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class _Changed(StatefulProcessor):
    """The hashes of a path that differ from the one before them."""

    def init(self, handle):
        self.last = handle.getValueState("last", "content_hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, out = self.last.get()[0] if self.last.exists() else None, []
        for batch in rows:
            for h in batch["content_hash"]:
                if h != known:
                    out.append(h)
                    known = h
        if out:
            self.last.update((known,))
            yield pd.DataFrame({"path": key[0], "content_hash": out})

    def close(self):
        pass


def changed_files(files: DataFrame) -> DataFrame:
    """(path, content_hash) of (path, content_hash) rows, whenever a path's hash isn't the last one seen."""
    use_rocksdb(files.sparkSession)
    return files.groupBy("path").transformWithStateInPandas(_Changed(), "path string, content_hash string", "Append", "None")


class _Session(StatefulProcessor):
    """A session's messages by their numbers; a document whenever messages come that weren't there."""

    def init(self, handle):
        self.messages = handle.getMapState("messages", "seq long", "role string, content string")
        self.made = handle.getValueState("made", "version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        grown = False
        for batch in rows:
            for seq, role, content in zip(batch["seq"], batch["role"], batch["content"]):
                if not self.messages.containsKey((seq,)):
                    self.messages.updateValue((seq,), (role, content))
                    grown = True
        if grown:
            version = (self.made.get()[0] if self.made.exists() else 0) + 1
            self.made.update((version,))
            said = sorted((k[0], *v) for k, v in self.messages.iterator())
            content = "\n\n".join(f"**{role}**: {text}" for _, role, text in said if role is not None and text is not None)
            yield pd.DataFrame({"session_id": [key[0]], "version": [version], "n": [len(said)], "content": [content], "content_hash": [hashlib.sha256(content.encode()).hexdigest()]})

    def close(self):
        pass


def sessions(messages: DataFrame) -> DataFrame:
    """(session_id, version, n, content, content_hash) whenever a session has grown; a message's number counts once."""
    use_rocksdb(messages.sparkSession)
    kind = dict(messages.dtypes)["session_id"]
    return messages.groupBy("session_id").transformWithStateInPandas(_Session(), f"session_id {kind}, version long, n long, content string, content_hash string", "Append", "None")


class _Run(StatefulProcessor):
    """A run's last status, with a timer while it is pending, and how often it was told."""

    def __init__(self, ttl_seconds: int, to: str):
        self.ttl, self.to = ttl_seconds, to

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", "due long, version long")

    def told(self, key, status: str, due: int | None) -> pd.DataFrame:
        version = (self.last.get()[1] if self.last.exists() else 0) + 1
        self.last.update((due, version))
        return pd.DataFrame({"run_id": [key[0]], "version": [version], "status": [status]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values("seen_at")
        if self.last.exists() and self.last.get()[0] is not None:
            self.handle.deleteTimer(self.last.get()[0])
        status, started, due = rows["status"].iloc[-1], rows["started_at"].iloc[-1], None
        if status == "pending":
            due = int(started.timestamp() * 1000) + self.ttl * 1000 + 1  # older than the limit, not as old
            if due <= timerValues.getCurrentWatermarkInMs():
                status, due = self.to, None
            else:
                self.handle.registerTimer(due)
        yield self.told(key, status, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.told(key, self.to, None)

    def close(self):
        pass


def stale_runs(runs: DataFrame, ttl_seconds: int, to: str = "abandoned", watermark: str = "0 seconds") -> DataFrame:
    """(run_id, version, status) whenever a run's status is told in (run_id, status, started_at, seen_at) rows, and once the
    watermark of seen_at passes the limit of one that is pending still: the last version of each equals the batch sweep at it."""
    use_rocksdb(runs.sparkSession)
    kind = dict(runs.dtypes)["run_id"]
    timed = runs.withWatermark("seen_at", watermark).groupBy("run_id")
    return timed.transformWithStateInPandas(_Run(ttl_seconds, to), f"run_id {kind}, version long, status string", "Append", "EventTime")
