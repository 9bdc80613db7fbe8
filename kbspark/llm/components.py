"""Connected components of a link table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import Scratch


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to its least neighbour: the larger ones (large star), or the smaller ones and itself."""
    if large:
        around = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = around.join(least, "u")
    if large:
        made = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return made.where("u <> v").distinct()


def components(links: DataFrame, scratch: Scratch | None = None, name: str = "components") -> DataFrame:
    """(id, component): every node of (a, b) links, with the least node that it reaches.

    Only links are shuffled, and each round's are written to the shared folder, after which those of the round before are
    dropped. Rounds grow with the logarithm of the longest chain. An empty table gives an empty table.
    """
    scratch = scratch or Scratch(links.sparkSession, "components")
    now = scratch.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}0")
    before, turn = None, 0
    while True:
        now, turn = scratch.written(_stars(_stars(now, large=True), large=False), f"{name}{turn + 1}"), turn + 1
        scratch.drop(f"{name}{turn - 1}")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
