"""Ranked search against a plain evaluation of every item on every document, and the mined sets against the items."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kbspark.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=20):
    counted = [(id, Counter(t), len(t)) for id, text in docs if (t := terms(text))]
    n, length = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for id, c, size in counted:
            m = 75 + 25 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, id is None, id or 0, id))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return out


def got(spark, docs, items, k=20):
    d = spark.createDataFrame([(i, t, 1, 1, 1) for i, t in docs], "doc_id long, text string, rank int, score int, item_id int")
    q = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, n int, terms string")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked.search(d.repartition(3), q.repartition(2), k).collect()), key=str)


@pytest.mark.parametrize("block,held", [(1 << 20, 32 << 20), (1500, 50_000)])
def test_against_brute_force(spark, monkeypatch, block, held):
    monkeypatch.setattr(ranked, "BLOCK", block)
    monkeypatch.setattr(ranked, "HELD", held)
    r = random.Random(4)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(400)] + ["ÄÖ", "äö", "naïve", "It's", "日本", "X²"]
    text = lambda n: " ".join(r.choices(words, k=n))
    docs = [(i, text(int(r.paretovariate(0.5)) % 900)) for i in range(250)]
    docs += [(r.randrange(500, 600), docs[7][1]) for _ in range(60)] + [(None, docs[7][1]), (3, docs[7][1]), (3, None), (9, ""), (9, " .,!")]
    shared = text(30)
    items = [(i, f"{shared} {text(r.randrange(1, 25))}") for i in range(30)] + [(i, text(12)) for i in range(30, 40)]
    items += [(40, docs[7][1]), (41, "unknownterm"), (42, None), (43, ""), (44, shared), (44, shared), (None, shared)]
    assert got(spark, docs, items) == sorted(brute(docs, items), key=str)
    if block > 1500:
        assert got(spark, docs, items, 3) == sorted(brute(docs, items, 3), key=str)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a b")]) == [] and got(spark, [(1, "a b")], []) == [] and got(spark, [(1, None)], [(1, "a")]) == []


def test_sets_add_up_to_their_items():
    r = random.Random(8)
    for _ in range(300):
        common = [r.sample(range(40), r.randrange(2, 8)) for _ in range(3)]
        items = [r.choices(range(60), k=r.randrange(0, 12)) + (r.choice(common) if r.random() < 0.7 else []) for _ in range(r.randrange(1, 20))]
        pairs, rests = ranked.shared_sets(items)

        def leaves(p):
            return [p] if p >= 0 else leaves(pairs[-1 - p][0]) + leaves(pairs[-1 - p][1])

        assert [sorted(sum(map(leaves, rest), [])) for rest in rests] == [sorted(x) for x in items]
        assert all(a > -1 - i and b > -1 - i for i, (a, b) in enumerate(pairs))  # of earlier nodes
        assert len(pairs) + sum(map(len, rests)) <= sum(map(len, items))


def test_blocks_do_not_depend_on_partitions(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"some words of item number {i} " * 5) for i in range(60)], "item_id long, text string")
    for partitions in ("4", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert ranked.planned(items, "item_id", "text").count() == 1
        monkeypatch.setattr(ranked, "BLOCK", 2000)
        assert 5 <= ranked.planned(items, "item_id", "text").count() <= 15
        monkeypatch.undo()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_shared_sets_are_added_up_once():
    shared = [b"%d" % i for i in range(50)]
    plan = ranked.Plan([(i, i, [*shared, b"own%d" % i, b"the", b"the"]) for i in range(100)])
    assert plan.sums < 400  # as against 5300 terms
    accumulators = np.zeros((plan.size, 2), np.int64)
    accumulators[: len(plan.words)] = np.arange(1, len(plan.words) + 1)[:, None]
    scores = plan.scores(accumulators)
    own = [plan.words[b"own%d" % i] + 1 for i in range(100)]
    assert scores[:, 0].tolist() == [sum(plan.words[w] + 1 for w in shared) + o + 2 * (plan.words[b"the"] + 1) for o in own]


def test_a_very_long_text_takes_time_in_proportion():
    import time

    start = time.time()
    assert len(ranked.terms("word Ünï " * 500_000)) == 1_000_000
    ranked.Plan([(0, 0, ranked.terms(" ".join(map(str, range(100_000))))), (1, 1, ranked.terms(" ".join(map(str, range(0, 200_000, 2)))))])
    assert time.time() - start < 20
