"""Linked vectors against all pairs' cosines, on spread-out vectors with near copies of every closeness and large groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm import vectordup

SCHEMA = "vec_id long, embedding array<float>, n_links int, digest string"


def brute(ids, vectors):
    """(links, component, kept) of each row, by plain loops over all pairs."""
    x = np.array(vectors, np.float32).astype(float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = x @ x.T >= vectordup.LEAST
    component = np.arange(len(x))
    for _ in range(len(x)):
        moved = np.where(near, component[None, :], len(x)).min(axis=1)
        if (moved == component).all():
            break
        component = moved
    least = {c: min(i for i, d in zip(ids, component) if d == c) for c in set(component.tolist())}
    return [(i, int(n) - 1, least[c]) for i, n, c in zip(ids, near.sum(axis=1), component.tolist())]


def got(spark, ids, vectors):
    df = spark.createDataFrame([(i, [float(a) for a in v], 7, "x") for i, v in zip(ids, vectors)], SCHEMA)
    rows = vectordup.groups(df).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return sorted((r.vec_id, r.n_links, r.component_id) for r in rows)


def spread(r, n, width):
    x = r.standard_normal((n, width))
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def at_cosine(r, x, cosine):
    u = spread(r, len(x), x.shape[1])
    u -= (u * x).sum(axis=1, keepdims=True) * x
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    return cosine * x + np.sqrt(1 - cosine**2) * u


def test_recall_at_the_least_cosine(spark):
    r = np.random.default_rng(5)
    x = spread(r, 1500, 48)
    y = at_cosine(r, x, 0.9505)
    rows = got(spark, range(3000), np.concatenate([x, y]))
    assert sum(n for _, n, _ in rows) / 3000 > 0.985
    below = got(spark, range(3000), np.concatenate([x, at_cosine(r, x, 0.9495)]))
    assert sum(n for _, n, _ in below) == 0


def test_groups_copies_and_chains(spark, monkeypatch):
    monkeypatch.setattr(vectordup, "CELL", 64)  # so that lists are cut into cells
    r = np.random.default_rng(6)
    centre = spread(r, 1, 32)
    group = centre + 0.02 * spread(r, 300, 32)
    chain = [np.cos(a) * np.eye(32)[0] + np.sin(a) * np.eye(32)[1] for a in np.arange(0, 1.2, 0.2)]  # each links with the next only
    x = np.concatenate([spread(r, 200, 32), group, np.repeat(spread(r, 1, 32), 200, axis=0), at_cosine(r, group[:50], 0.97), chain])
    ids = r.permutation(len(x)).tolist()
    assert got(spark, ids, x) == sorted(brute(ids, x))


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(5, v), (5, v), (9, [2.0, 4.0, 6.0]), (2, [-x for x in v]), (None, v), (1, None), (3, []), (4, [0.0, -0.0]), (6, [1.0, None, 3.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (10, [1.0, 2.0, 3.0, 0.0]), (11, [1e-30, 2e-30, 3e-30]), (12, [1e30, 2e30, 3e30])]
    df = spark.createDataFrame([(i, e, 7, "x") for i, e in rows], SCHEMA)
    out = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectordup.groups(df).collect()), key=str)
    together = {5, 9, 10, 11, 12}
    want = [(i, 5, 5, i == 5) if i in together else (i, 0, i, True) for i, _ in rows]
    assert out == sorted(want, key=str)
    assert vectordup.groups(df.limit(0)).count() == 0
    doubles = df.select(F.col("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("e"))
    assert vectordup.groups(doubles, "k", "e").agg(F.sum("n_links")).first()[0] == 30


@pytest.mark.parametrize("n", [1, 500, 10**5, 10**9])
def test_plans_reach_the_recall(n):
    tail, directions, count = vectordup.calibrated(n)
    p = vectordup.collides(tail, vectordup.LEAST)
    r = np.random.default_rng(1).binomial(directions, p, 200_000)
    assert (r >= count).mean() > vectordup.RECALL - 0.002 and count >= 2
    assert vectordup.collides(tail, 0.99) > vectordup.collides(tail, 0.97) > p
