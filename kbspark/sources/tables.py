"""Tables in the folder that driver and executors share, and typed loading."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Schemas of the main tables (S3); files are read with these, never inferred.
SCHEMAS = {
    "documents": "doc_id long, workspace string, topic string, layer string, path string, title string, content string, content_hash string, updated_at timestamp",
    "beliefs": "belief_id string, workspace string, topic string, path string, statement string, subject string, predicate string, object string, footnote_ids array<string>, asserted_at timestamp, superseded_at timestamp, superseded_by string",
    "events": "event_id long, workspace string, source_type string, event_type string, title string, author string, occurred_at timestamp, ingested_at timestamp",
    "items": "item_id long, workspace string, source_id string, adapter_type string, external_id string, url string, title string, content_hash string, status string, published_at timestamp",
    "runs": "run_id long, workspace string, status string, usd double, started_at timestamp",
}


def read_tables(spark: SparkSession, path: str, schemas: dict[str, str] = SCHEMAS, suffix: str = "") -> dict[str, DataFrame]:
    """Each table under `path`, read with its own schema; `suffix` ends the tables' names there."""
    return {name: spark.read.schema(T.StructType.fromDDL(ddl)).parquet(f"{path}/{name}{suffix}") for name, ddl in schemas.items()}


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows dealt out to all cores, where its files give fewer tasks than the cluster runs at a time.

    A table of one small file is read by one task, and all work on its rows would be that task's. Tables with a split for
    each core or more stay as they are, so that nothing of any size is shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Spark's setting that a query's shuffle files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the one set on the context; for a local session, as in tests, a new folder. An error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            if not spark.sparkContext._jsc.sc().isLocal():
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = known.get()
    return at


def _write(df: DataFrame, path: str) -> None:
    """`df` written; the shuffles of the write go when it is done, as nothing reads them again."""
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def shared_table(df: DataFrame, what: str) -> DataFrame:
    """`df` written to the shared folder and read again: its lineage ends here and it survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The tables of an iteration's rounds in a folder of their own in the shared folder; each round drops the one before."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.at, self.turn = spark, f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}", 0

    def written(self, df: DataFrame) -> DataFrame:
        path = f"{self.at}/{self.turn}"
        _write(df, path)
        if self.turn:
            before = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{self.turn - 1}")
            before.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(before, True)
        self.turn += 1
        return self.spark.read.schema(df.schema).parquet(path)


#: Blocks that meet all slices in a round of `in_rounds`.
ROUND = 8


def in_rounds(spark: SparkSession, blocks: int, met: Callable[[int, int], DataFrame], best: Callable[[DataFrame], DataFrame], what: str) -> DataFrame:
    """What all blocks hand on. `met` gives that of the blocks from the first number up to the second, `best` drops of it
    what others make needless.

    A round takes ROUND blocks; what is left of it is written and its shuffles go before the next, so that the copies for
    each block take as much disk as ROUND of them, whatever the number of blocks.
    """
    rounds, kept = Rounds(spark, what), None
    for low in range(0, blocks, ROUND):
        found = met(low, min(low + ROUND, blocks))
        found = found if kept is None else kept.unionByName(found)
        if low + ROUND < blocks:
            kept = rounds.written(best(found))
    return found
