"""Substring dedup against plain 51-word windows, word by word."""

import os
import random

import pytest

from kbspark.llm import substrings
from tests.test_queries import DATA


def plain(rows: list[tuple]) -> dict:
    """For each document the places of its words that lie in a 51-word window which a document of smaller id holds."""
    least: dict[tuple, int] = {}
    n = substrings.MIN_WORDS + 1
    split = {i: (t or "").encode().split() for i, t in rows}
    for i, w in split.items():
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            least[key] = min(least.get(key, i), i)
    return {i: {p for k in range(len(w) - n + 1) if least[tuple(w[k : k + n])] < i for p in range(k, k + n)} for i, w in split.items()}


def removed(out) -> dict:
    """The places of the words inside the removed spans."""
    found = {}
    for r in out:
        places, gone = [], set()
        data = r.before or ""
        at = 0
        for w in data.encode().split():
            at = data.index(w.decode(), at)
            places.append(at)
            at += len(w.decode())
        for span in filter(None, r.removed_spans.split(",")):
            s, e = map(int, span.split(":"))
            gone |= {k for k, p in enumerate(places) if s <= p < e}
        assert r.removed_words == len(gone) and len((r.text or "").split()) == len(places) - len(gone)
        found[r.doc_id] = gone
    return found


def made(seed: int, words, chained: bool) -> list[tuple]:
    """Texts of new words around common passages and copies of texts; if `chained`, also parts and chains of passages."""
    rng = random.Random(seed)
    new = lambda n: [rng.choice(words) + str(rng.randrange(10**6)) if rng.random() < 0.7 else rng.choice(words) for _ in range(n)]
    passages = [new(rng.choice((30, 49, 50, 51, 52, 60, 90, 200))) for _ in range(12)]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p)) if chained and rng.random() < 0.4 else 0
            parts += (rng.choice(([], new(1), new(rng.randrange(40)))) if chained else new(rng.randrange(1, 40))) + p[a:]
        if rows and rng.random() < 0.15:
            parts = rng.choice(rows)[1].split()
            parts[rng.randrange(len(parts))] = "changed"
        rows.append((i, " ".join(parts + new(rng.randrange(30)))))
    return rows


WORDS = ["ka", "lo", "mira", "ne", "pulver", "ra", "so", "tizig", "o", "extraordinarily"]


@pytest.mark.parametrize("seed", range(4))
def test_passages_parts_and_chains(spark, seed):
    """Nothing goes that stands in no earlier document as a whole; of what does, hardly anything stays.

    Words that happen to stand beside a passage twice may stay, and a chain whose parts all have earlier sources.
    """
    rows = made(seed, WORDS, chained=seed > 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("*", "text AS before")
    got, want = removed(substrings.dedup(df).collect()), plain(rows)
    assert all(got[i] <= want[i] for i in want)
    assert sum(map(len, got.values())) >= 0.98 * sum(map(len, want.values()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables aren't here")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = removed(substrings.dedup(docs.selectExpr("*", "text AS before")).collect())
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()]) and any(got.values())


def test_stretches_by_both_ways():
    rng = random.Random(3)
    for _ in range(2000):
        run, own = ([rng.randrange(rng.choice((2, 3, 6, 30))) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        where: dict = {}
        for k, d in enumerate(own):
            where.setdefault(d, []).append(k)
        for found in (substrings.stretches(run, own, where), substrings._stretches_by_automaton(run, own)):
            assert all(run[a : b + 1] == own[p : p + b - a + 1] for a, b, p in found)
            fits = lambda a, b: any(run[a : b + 1] == own[p : p + b - a + 1] for p in range(len(own)))
            longest = {(a, b) for a in range(len(run)) for b in range(a, len(run)) if fits(a, b)}
            want = {(a, b) for a, b in longest if not any((c, d) != (a, b) and c <= a and b <= d for c, d in longest)}
            assert {(a, b) for a, b, _ in found} == want


def test_odd_rows(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    schema = "doc_id long, text string, _id string, _runs int, id long, found string, row string, removed_words string, whole int"
    rows = [(i, t, "x", 1, 2, "y", "z", "w", 3) for i, t in ((1, f"a {passage} b"), (2, f"c {passage} d"), (2, f"{passage}"), (3, None), (4, ""), (None, passage), (None, None), (5, "e " * 100 + passage), (5, "e " * 100 + passage))]
    out = substrings.dedup(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.removed_words) for r in out) == sorted([(1, f"a {passage} b", 0), (2, "c d", 60), (2, "", 60), (3, "", 0), (4, "", 0), (0, passage, 0), (0, "", 0), (5, ("e " * 100).strip(), 60), (5, ("e " * 100).strip(), 60)])
    assert all((r._id, r._runs, r.id, r.found, r.row, r.whole) == ("x", 1, 2, "y", "z", 3) for r in out)
    assert sum(r.text is None for r in out) == 2


def test_very_long_text(spark):
    rng = random.Random(12)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(80))
    long = " ".join(f"w{rng.randrange(10**7)}" for _ in range(200_000))
    rows = [(1, f"x {passage} y"), (2, f"{long} {passage} {long[:100]}"), (3, "a b " * 200_000 + passage), (4, "a b " * 200_000 + "tail")]
    out = {r.doc_id: r.removed_words for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: 0, 2: 80, 3: 80, 4: 400_000}
