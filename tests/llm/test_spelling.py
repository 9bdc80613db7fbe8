"""Near words, forms and roots against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kbspark.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) == len(x) + 1 and any(x == y[:k] + y[k + 1 :] for k in range(len(y)))


def brute(docs):
    total = Counter()
    for id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}
    others = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(((-words[x], x) for x in others[w]), default=None)
        if best and -best[0] >= 2 * n:
            form[w] = best[1]

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(others[w]), words.get(form.get(w))) for w, n in words.items())


def got(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect())


def texts(r, n):
    parts = ["th", "er", "an", "on", "in", "es", "re", "ti", "ou", "ß", "é", "q"]
    stems = ["".join(r.choices(parts, k=r.randrange(2, 6))) for _ in range(120)]

    def word():
        w = stems[min(int(r.paretovariate(0.7)) - 1, len(stems) - 1)]
        if r.random() < 0.3:
            k = r.randrange(len(w))
            w = w[:k] + r.choice(["", r.choice("etaoxzé"), w[k] + r.choice("aex")]) + w[k + 1 :]
        return w.upper() if r.random() < 0.1 else w

    return [(i, " ".join(word() for _ in range(r.randrange(0, 200))) + ", 'x-y' Ünïted×run 12") for i in range(n)]


@pytest.mark.parametrize("block,pairs,counted", [(20_000, 1 << 17, 1 << 19), (40, 50, 100), (2, 1000, 10)])
def test_against_brute_force(spark, monkeypatch, block, pairs, counted):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "PAIRS", pairs)
    monkeypatch.setattr(spelling, "COUNTED", counted)
    docs = texts(random.Random(block), 150)
    docs += [(None, docs[3][1]), (5, docs[5][1]), (5, docs[5][1]), (7, None), (8, ""), (9, "ÀÉÎÕÜ àéîõü " * 4 + "chain chaine chainer " * 3), (10, "chainer " * 8 + "chaine " * 2), (11, "chaine " * 3 + "chainer " * 60)]
    docs += [(12, "y" * 5000 + " " + "y" * 5001), (13, "y" * 5000 + " " + "y" * 5001), (14, "y" * 5000 + " " + "y" * 5001)]
    want = brute(docs)
    assert got(spark, docs) == want and sum(w[1] is not None for w in want) > 20 and any(w[2] != (w[1] or w[0]) for w in want)


def test_empty(spark):
    assert got(spark, []) == [] and got(spark, [(1, None), (2, "abc de")]) == [] and got(spark, [(1, "lonely lonely lonely")]) == [("lonely", None, "lonely", 3, 0, None)]


def test_moves_lead_to_every_block_once():
    for depth in (1, 2, 3, 8):
        by = [m.by for m in spelling.moves(depth)]
        assert len(by) == len(set(by)) and by[0] == (0,) * (depth + 1) and len(by) * 2 - 1 == 3 + 4 * depth + depth * (depth - 1)


def test_one_edit():
    r = random.Random(2)
    for _ in range(20_000):
        x, y = ("".join(r.choices("ab", k=r.randrange(1, 7))) for _ in range(2))
        assert spelling.one_edit(x.encode(), y.encode()) == near(x, y)


def test_many_words_of_one_vector_take_time_in_proportion():
    import time

    r = random.Random(3)
    words = list({"".join(r.sample("abcdefghijklmnop", 16)).encode() for _ in range(20_000)})
    start = time.time()
    v = spelling.vectors(words)
    found = spelling.near_words(words, v, np.zeros(len(words), np.int64), spelling.moves(1))
    assert len(np.unique(v, axis=0)) == 1 and not sum(len(s) for s, _ in found)
    assert time.time() - start < 10
