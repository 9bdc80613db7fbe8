"""The learned list against a plain covering of the same rows, with several kinds of junk, and odd rows."""

import random
from math import log2

import pytest
from pyspark.sql import functions as F

from kbspark.llm import quality
from tests.llm.test_operators import prose


def plain_covering(rows: list, edges: dict, max_tests: int = 3, purity: float = 0.97, least: int = 5) -> list:
    """Sequential covering in plain loops. `rows`: dicts of the features, bad and held."""
    meets = lambda r, t: (r[t[0]] >= t[2]) == t[1]
    rules, left, failed = [], rows, set()
    while sum(r["bad"] for r in left) >= least:
        grow, tests = [r for r in left if not r["held"]], []
        while len(tests) < max_tests:
            bad = sum(r["bad"] for r in grow)
            if bad in (0, len(grow)):
                break
            best, gain = None, 0.0
            for f in sorted(edges):
                for e in edges[f]:
                    for side in (True, False):
                        if not tests and (f, side) in failed:
                            continue
                        met = [r for r in grow if meets(r, (f, side, e))]
                        p = sum(r["bad"] for r in met)
                        if p and p * (log2(p / len(met)) - log2(bad / len(grow))) > gain + 1e-9:
                            best, gain = (f, side, e), p * (log2(p / len(met)) - log2(bad / len(grow)))
            if not best:
                break
            tests.append(best)
            grow = [r for r in grow if meets(r, best)]
        if not tests:
            break
        for k in range(1, len(tests) + 1):
            met = [r for r in left if all(meets(r, t) for t in tests[:k])]
            parts = [[r["bad"] for r in met if r["held"] == h] for h in (True, False)]
            if any(parts[0]) and all(sum(x) >= purity * len(x) for x in parts) and sum(map(sum, parts)) >= least:
                rules.append(tests[:k])
                left, failed = [r for r in left if r not in met], set()
                break
        else:
            failed.add(tests[0][:2])
    return rules


def junk(rng: random.Random, kind: int) -> str:
    words = prose(rng, rng.randrange(60, 120)).split()
    if kind == 1:
        return " ".join(w + "###" if rng.random() < 0.6 else w for w in words)
    if kind == 2:
        return " ".join(w.upper() for w in words)
    if kind == 3:
        return " ".join(w + str(rng.randrange(10**6)) for w in words)
    if kind == 4:  # junk only as two things together
        return " ".join(w + "!" if rng.random() < 0.5 else w for w in words).replace(" ", "\n")
    return " ".join(words) if rng.random() < 0.5 else "\n".join(words) if rng.random() < 0.5 else " ".join(w + "!" for w in words)


@pytest.mark.parametrize("seed,noise", [(1, 0), (2, 10)])
def test_list_equals_plain_covering(spark, seed, noise):
    rng = random.Random(seed)
    rows = [(i, junk(rng, i % 9), int(i % 9 not in (1, 2, 3, 4)) ^ int(rng.randrange(1000) < noise)) for i in range(450)]
    numbers = quality.measured(spark.createDataFrame(rows, "doc_id long, text string, quality int"), "text", F.col("doc_id"), F.col("quality")).cache()
    rules = quality.learn(numbers, bins=8)
    held = numbers.select("*", (F.pmod(F.xxhash64(*quality.FEATURES, "doc_id"), F.lit(3)) == 0).alias("held"), (F.col("quality") == 0).alias("bad"))
    cuts = numbers.agg(*(F.percentile_approx(f, [k / 8 for k in range(9)], 1000).alias(f) for f in quality.FEATURES)).first()
    edges = {f: sorted({(a + b + 1) // 2 for a, b in zip(v, v[1:])}) for f in quality.FEATURES for v in [sorted(set(cuts[f]))]}
    assert [[(t.feature, t.at_least, t.threshold) for t in r.tests] for r in rules] == plain_covering([r.asDict() for r in held.collect()], edges)
    assert len(rules) >= (1 if noise else 3) and all(r.bad >= 0.97 * (r.bad + r.good) for r in rules)
    if not noise:
        judged = quality.decided(numbers, rules).where("NOT base_failed")
        # Thresholds are coarse here, at eight quantiles.
        assert judged.where("kept AND quality = 0").count() <= 0.05 * judged.where("quality = 0").count()
        assert judged.where("NOT kept AND quality = 1").count() <= 0.02 * judged.where("quality = 1").count()


def test_odd_rows(spark):
    rows = [(1, None, "a", 7, True), (None, "word " * 60, "b", 7, True), (2, "", "c", 7, True), (2, "x " * 3, "d", 7, True), (3, "w%d " * 100_000 % tuple(range(100_000)), "e", 7, True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _q_words string, n_words int, kept boolean").withColumn("_t", F.lit(1)).withColumn("_row", F.lit("r"))
    labels = spark.createDataFrame([(1, 0), (None, 1), (3, None), (9, 0)], "doc_id long, quality int")
    out = {r._q_words: r for r in quality.judged(df, labels).collect()}
    assert {k: (r.n_words, r.kept, r._t, r._row) for k, r in out.items()} == {"a": (0, False, 1, "r"), "b": (60, False, 1, "r"), "c": (0, False, 1, "r"), "d": (3, False, 1, "r"), "e": (100_000, True, 1, "r")}
    assert quality.judged(df, labels.limit(0), least_words=1).where("kept").count() == 2
    assert quality.judged(df.limit(0), labels).count() == 0


def test_steps_are_queries_of_bins(spark, monkeypatch):
    """A step reads what was binned before it, so that its query doesn't hold all thresholds."""
    rng, seen, grow = random.Random(3), [], quality._grow
    monkeypatch.setattr(quality, "_grow", lambda rows, *a: seen.append(rows) or grow(rows, *a))
    cleared = []
    monkeypatch.setattr(quality.Scratch, "clear", lambda self: cleared.append(self))
    rows = [(i, junk(rng, i % 9), int(i % 9 not in (1, 2, 3, 4))) for i in range(180)]
    numbers = quality.measured(spark.createDataFrame(rows, "doc_id long, text string, quality int"), "text", F.col("doc_id"), F.col("quality"))
    rules = quality.learn(numbers, bins=8)
    assert rules and seen and cleared
    most = seen[0].agg(*(F.max(c).alias(c) for c in seen[0].columns if c not in ("bad", "held"))).first()
    assert max(most) <= 8 < max(t.threshold for r in rules for t in r.tests)


def test_steps_make_no_rows(spark, monkeypatch):
    """A step counts rows as they are, exactly though many tasks count, and what failed attempts share is counted once."""
    rows = spark.range(0, 20_000, 1, 50).select((F.col("id") % 7 == 0).alias("bad"), (F.col("id") * 13 % 33).cast("int").alias("a"), (F.col("id") % 2).cast("int").alias("b"))
    found = quality._counts(rows, {"a": 32, "b": 1})
    for f in ("a", "b"):
        want = {r[f]: (r.bad, r.all - r.bad) for r in rows.groupBy(f).agg(F.count_if("bad").alias("bad"), F.count("*").alias("all")).collect()}
        assert found[f] == want
    assert quality._counts(rows.limit(0), {"a": 32}) == {}

    rng, asked, counts, plans = random.Random(4), [], quality._counts, []

    def seen(rows, edges):
        asked.append(rows._jdf.queryExecution().optimizedPlan().toString())
        frame = type(rows.groupBy("bad").agg(F.count("*")))
        collect = frame.collect
        monkeypatch.setattr(frame, "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
        try:
            return counts(rows, edges)
        finally:
            monkeypatch.setattr(frame, "collect", collect)

    monkeypatch.setattr(quality, "_counts", seen)
    labelled = [(i, junk(rng, 0), int(rng.random() < 0.9)) for i in range(180)]  # nothing to learn: all attempts fail
    numbers = quality.measured(spark.createDataFrame(labelled, "doc_id long, text string, quality int"), "text", F.col("doc_id"), F.col("quality"))
    assert quality.learn(numbers, bins=8) == []
    assert len(asked) > 3 and plans and not any("Generate" in p for p in plans)
    # The first tests of all attempts come from one count.
    assert sum("(bad" not in p and p.count(">=") + p.count("<") == 0 for p in asked) == 1
