"""Sums and joins along an order, beliefs at many points, samples: against plain versions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kbspark.operators import beliefs as B
from kbspark.operators import quality as Q
from kbspark.operators.ordered import joined_in_order, running_sum

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("before", [False, True])
def test_running_sums_as_by_one_window(spark, before):
    r = random.Random(1)
    rows = [("a" if i % 10 else r.choice(["b", None]), r.randrange(1000), i, r.choice([None, 1, 5, -3])) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, x int, i int, v long")
    w = Window.partitionBy("g").orderBy("x", "i").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    want = df.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0))).collect()
    got = running_sum(df, ["g"], ["x", "i"], "v", "s", before)
    assert sorted(got.collect(), key=str) == sorted(want, key=str)
    assert running_sum(df.limit(0), ["g"], ["x"], "v", "s").count() == 0


def test_a_single_group_takes_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = running_sum(spark.range(10_000).withColumn("g", F.lit("only")), ["g"], ["id"], "id", "s")
    parts = [r.n for r in df.groupBy(F.floor(F.col("id") / 2500)).agg(F.count("*").alias("n")).collect()]
    held = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(parts) == 10_000 and len(held) > 1 and max(r["count"] for r in held) < 9000


def test_texts_joined_in_order(spark):
    rows = [("s1", 2, "b"), ("s1", 1, "a"), ("s1", 10, None), ("s2", 1, "é"), (None, 1, "x"), (None, 0, "y")]
    df = spark.createDataFrame(rows, "k string, seq int, t string").repartition(3)
    got = {r.k: (r.n, r.content) for r in joined_in_order(df, ["k"], ["seq"], "t", "|").collect()}
    assert got == {"s1": (3, "a|b"), "s2": (1, "é"), None: (2, "y|x")}
    assert joined_in_order(df.limit(0), ["k"], ["seq"], "t", "|").count() == 0


def made(spark, n):
    r = random.Random(2)
    rows = []
    for i in range(n):
        start = T0 + timedelta(seconds=r.randrange(90 * 86400))
        end = r.choice([None, start, start - timedelta(days=1), start + timedelta(seconds=r.randrange(1, 200_000)), start + timedelta(days=r.randrange(400))])
        rows.append((r.choice("ab"), f"b{i}", start, end))
    rows += [("b", "at", T0, T0 + timedelta(days=9)), ("c", "never", T0, T0 - timedelta(1)), ("c", "valid", T0, None)]
    points = [(k, T0 + timedelta(days=k)) for k in range(-3, 100, 3)] + [(200, T0 + timedelta(days=9)), (201, T0 + timedelta(days=9, seconds=1))]
    return rows, points, spark.createDataFrame(rows, "workspace string, belief_id string, asserted_at timestamp, superseded_at timestamp"), spark.createDataFrame(points, "point_id long, at timestamp")


@pytest.mark.parametrize("days,widths", [(1, 12), (30, 12), (1, 2), (1, 1)])
def test_beliefs_at_each_point(spark, monkeypatch, days, widths):
    monkeypatch.setattr(B, "WIDTHS", widths)
    rows, points, beliefs, asked = made(spark, 200)
    want = {(p, b) for p, at in points for _, b, start, end in rows if start < at and (end is None or end >= at) and (end is None or end > start)}
    got = [(r.point_id, r.belief_id) for r in B.as_of_each(beliefs, asked, days).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_counts_at_points_with_inverted_intervals(spark):
    rows, points, beliefs, asked = made(spark, 200)
    got = {(r.point_id, r.workspace): r.n for r in B.as_of_points(beliefs, asked).collect()}
    valid = [(w, s, e) for w, _, s, e in rows if e is None or e > s]
    assert got == {(p, w): sum(v == w and s < at and (e is None or e >= at) for v, s, e in valid) for p, at in points for w in "abc"}
    # One belief that never held and one that does.
    two = beliefs.where("workspace = 'c'")
    assert {r.n for r in B.as_of_points(two, asked.where("point_id = 30")).collect()} == {1}


def test_samples_are_stable(spark):
    df = spark.range(5000).select(F.concat(F.lit("w"), F.col("id") % 2).alias("workspace"), F.concat(F.lit("b"), "id").alias("belief_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit("1"))).otherwise(F.array().cast("array<string>")).alias("footnote_ids"), F.lit(None).cast("timestamp").alias("superseded_at"))
    first = sorted(r.belief_id for r in Q.sampled(df.repartition(3), 100).collect())
    assert len(first) == 200 and first == sorted(r.belief_id for r in Q.sampled(df.repartition(7), 100).collect()) != sorted(r.belief_id for r in Q.sampled(df, 100, "other").collect())
    gone = df.withColumns({"workspace": F.lit("gone"), "superseded_at": F.lit(T0)})
    got = {r.workspace: r.score for r in Q.citation_fidelity(df.unionByName(gone), 400).collect()}
    assert got["gone"] == 1.0 and all(abs(got[w] - 1 / 3) < 4 * (2 / 9 / 400) ** 0.5 for w in ("w0", "w1"))
    assert {r.score for r in Q.citation_fidelity(df, 10_000).collect()} == {r.score for r in Q.citation_fidelity(df).collect()}
