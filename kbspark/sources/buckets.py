"""Tables in hash buckets of their keys, of which a write replaces those that it touches and no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Buckets:
    """A Parquet table with a folder for each of `n` buckets of its keys. `schema` is that of its rows, without the bucket.

    A lookup reads the buckets that its keys fall in; a write replaces these by dynamic partition overwrite, one file each,
    so that their number of files doesn't grow with the number of writes. Null keys have a bucket like any other.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], n: int = 64):
        self.spark, self.path, self.schema, self.keys, self.n = spark, path, schema, keys, n

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows fall in: at most n numbers."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or the given buckets of it; empty where nothing was written yet."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).drop("bucket")

    def replace(self, rows: DataFrame) -> None:
        """The buckets that rows fall in hold these rows from now on."""
        dealt = rows.withColumn("bucket", self.bucket()).repartition("bucket").sortWithinPartitions("bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def upsert(self, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Rows of the touched buckets and incoming ones merged and written; gives the buckets. Merged rows keep their keys.

        What is merged is read before the buckets are replaced, as these are moved in when the job commits.
        """
        touched = self.touched(incoming)
        if touched:
            self.replace(merge(self.read(touched), incoming))
        return touched
