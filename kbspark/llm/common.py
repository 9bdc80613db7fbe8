"""Reading tables and shared intermediate tables for the operators of this subpackage.

Arrow batches keep the session's own limits: Spark ends a batch at 64 MB (spark.sql.execution.arrow.maxBytesPerBatch).
What is made of a batch is made and handed on slice by slice. The queries and the pipeline ask for batches of BATCH_ROWS
rows where the session's limit is larger (`small_batches`), as every worker and its task hold a batch each. The reader of
Parquet files holds READ_ROWS rows at a time then, as all their texts lie in one array, which doubles as it grows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.sources.tables import spread

#: Rows of an Arrow batch whose results a task holds at a time.
SLICE_ROWS = 128


#: Rows of an Arrow batch in the queries and the pipeline.
BATCH_ROWS = 1000
#: Rows that the reader of a Parquet file holds at a time there.
READ_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_ROWS rows and those of Parquet readers by READ_ROWS; smaller limits stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        if not 0 < int(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


def slices(batches: Iterator) -> Iterator:
    """Record batches, series or tuples of series in slices of SLICE_ROWS rows."""
    for b in batches:
        n = len(b[0]) if isinstance(b, tuple) else len(b)
        for k in range(0, max(n, 1), SLICE_ROWS):
            if isinstance(b, pa.RecordBatch):
                yield b.slice(k, SLICE_ROWS)
            elif isinstance(b, tuple):
                yield tuple(x.iloc[k : k + SLICE_ROWS] for x in b)
            else:
                yield b.iloc[k : k + SLICE_ROWS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one set on the context.

    Where neither is set, a folder of this machine serves a local session, as in tests; on a cluster that is an error, as
    executors would write to disks of their own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext._jsc.sc()
        if not context.getCheckpointDir().isDefined():
            if not context.isLocal():
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        at = context.getCheckpointDir().get()
    return at


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """The tables that an operator writes on its way, in a folder of its own in the shared folder.

    A table cuts the lineage and survives lost executors. It is dropped when what was made of it is written too.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.at = spark, shared_path(spark, what)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def clear(self) -> None:
        deleted(self.spark, self.at)

    def drop(self, *names: str) -> None:
        for name in names:
            deleted(self.spark, f"{self.at}/{name}")


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read again: lineage ends here and survives lost executors."""
    return Scratch(df.sparkSession, what).written(df, "table")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, though the body uses it many times or inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
