"""Work along an order whose groups may be as large as the table: sums up to each row, texts joined in order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.sources.tables import shared_table


def running_sum(df: DataFrame, by: list[str], order: list[str], value: str, name: str, before: bool = False) -> DataFrame:
    """`df` with `name`, the sum of `value` over a group's rows up to each row, or before it, in the order given.

    Two levels: rows are dealt out by ranges of (group, order), so that a large group takes many partitions; each sums up
    its own rows, and the sums of the partitions before it, a row for each partition and group, are joined to them. Null
    values count as 0. Rows that tie in the whole order are in any order.
    """
    cut = shared_table(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = cut.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    sums = cut.groupBy("_part", *by).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", *by, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ("_part", *by)]
    met = local.alias("l").join(offsets.alias("o"), same)
    return met.select(*(F.col(f"l.{c}") for c in df.columns), (F.col("l._local") + F.col("o._offset")).alias(name))


def joined_in_order(df: DataFrame, by: list[str], order: list[str], piece: str, separator: str) -> DataFrame:
    """(by, n, content): the pieces of each group, joined in order. Null pieces count in n and add nothing.

    Rows come sorted to the tasks, which hold one group's pieces at a time: no row or buffer holds a group's list.
    """
    rows = df.select(*by, *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.col(piece).alias("_piece"))
    ordered = rows.repartition(*by).sortWithinPartitions(*by, *(f"_o{i}" for i in range(len(order)))).select(*by, "_piece")
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.select(*by).dtypes)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pieces, n = None, [], 0
        schema = None

        def made() -> pa.RecordBatch:
            columns = [pa.array([v], t) for v, t in zip(last, (schema.field(c).type for c in by))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([n], pa.int64()), pa.array([separator.join(pieces)])], [*by, "n", "content"])

        for b in batches:
            schema = b.schema
            for *key, text in zip(*(b[c].to_pylist() for c in (*by, "_piece"))):
                if n and key != last:
                    yield made()
                    pieces, n = [], 0
                last, n = key, n + 1
                if text is not None:
                    pieces.append(text)
        if n:
            yield made()

    return ordered.mapInArrow(join, f"{kinds}, n long, content string")
