import random

import pyarrow as pa

from kbspark.llm import substrings


def shared(passage: str, rng: random.Random) -> bool:
    """Whether a passage between other words has a chunk pair in common with itself elsewhere."""
    sets = []
    for _ in range(2):
        around = [" ".join(rng.choice(["over", "tree", "winter", "lamp"]) + str(rng.randrange(99999)) for _ in range(30)) for _ in range(2)]
        data = f"{around[0]} {passage} {around[1]}".encode()
        sets.append(set(substrings.digests(data, substrings.chunked(data)[0])))
    return bool(sets[0] & sets[1])


def test_short_and_periodic_words_share_chunks():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    for _ in range(300):
        assert shared(" ".join([word(rng.randint(1, 5)), word(rng.randint(1, 5))] * 40), rng)
        assert shared(" ".join(word(1) for _ in range(51)), rng)
        assert shared(" ".join(word(rng.randint(1, 2)) for _ in range(51)), rng)
        assert shared("\t".join(str(rng.randrange(10)) for _ in range(51)), rng)


def test_passages(spark):
    rng = random.Random(6)
    fill = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))
    two, tabbed, long = "ab cd " * 39 + "ab cd", "\t".join(rng.choice("xyz") + str(i) for i in range(55)), fill(52)
    phrase = " ".join(long.split()[:14])
    rows = [(1, fill(20) + " " + phrase + " " + fill(20)), (9, fill(9) + " no no " + fill(9))]
    for k, passage in ((10, two), (20, tabbed), (30, long)):
        rows += [(k + i, f"{fill(20)} {passage} {fill(20)}") for i in range(2)]
    rows.append((40, f"{fill(9)} {'no ' * 70}{fill(9)}"))
    out = {r.doc_id: r for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in out.items() if r.removed_words} == {11, 21, 31}
    for i, passage in ((11, two), (21, tabbed), (31, long)):
        assert len(passage.split()) - 1 <= out[i].removed_words <= len(passage.split())
        assert out[i].text.split()[:20] == dict(rows)[i].split()[:20]


def test_only_texts_with_repeats_become_python_strings(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = spark.createDataFrame([(1, f"one {passage}"), (2, f"{passage} two"), (3, None)], "doc_id long, text string")
    # A byte that is no UTF-8 would end a task that decodes its text.
    odd = spark.sql("SELECT 4L AS doc_id, CAST(X'6162FF' AS STRING) AS text")
    out = {r.doc_id: tuple(r)[1:] for r in substrings.dedup(rows.unionByName(odd)).selectExpr("doc_id", "hex(text)", "removed_words", "removed_spans").collect()}
    assert out[4] == ("6162FF", 0, "") and out[3] == (None, 0, "")
    assert bytes.fromhex(out[1][0]).decode() == f"one {passage}" and out[2][1] > 50


def test_cheaper_steps_equal_plain_ones(monkeypatch):
    """Words beside a place, words in common, lists of a slice, and one automaton for all runs that ask a source."""
    rng = random.Random(8)
    for _ in range(300):
        data = "".join(rng.choice(["a", "bc", "é", " ", "  ", "\n", " \t"]) for _ in range(rng.randrange(1, 120))).encode()
        at, reach = rng.randrange(len(data) + 1), rng.randrange(60)
        for left in (True, False):
            words = data[:at].split()[::-1] if left else data[at:].split()
            most = max(k for k in range(len(words) + 1) if k == 0 or sum(map(len, words[:k])) + k - 1 <= reach)
            assert substrings.beside(data, at, reach, left) == words[:most]
            k, end = substrings._same(data, at, b" ".join(words), left)
            assert k == len(words) and (data[end:at] if left else data[at:end]).strip() == (data[:at] if left else data[at:]).strip()
            assert substrings._same(data, at, b"x", left) == (0, at)
    column = pa.array([[1], [2, 3], [], [4, 5, 6], [7]], pa.list_(pa.int64()))
    assert list(substrings.lists(column[1:4])) == [[2, 3], [], [4, 5, 6]]
    assert list(substrings.lists(column[:0])) == [] == list(substrings.lists(pa.array([], pa.list_(pa.int64()))))
    made, automaton = [], substrings._automaton
    monkeypatch.setattr(substrings, "_automaton", lambda own: made.append(0) or automaton(own))
    own, kept = [1, 2] * 600, []
    where = {d: [k for k, x in enumerate(own) if x == d] for d in (1, 2)}
    found = [substrings.stretches([1, 2] * n, own, where, kept) for n in (30, 40, 50)]
    assert len(made) == 1 and found == [substrings._stretches_by_automaton([1, 2] * n, own) for n in (30, 40, 50)]


def test_answers_read_no_chunks(spark, monkeypatch):
    """Sources are cut again, so that the digests of all texts aren't shuffled twice; a hot source's rows share that."""
    rng, read, written = random.Random(9), [], substrings.Scratch.written
    fill = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))
    hot = fill(300).split()
    texts = [" ".join(hot)] + [f"{fill(20)} {' '.join(hot[k : k + 60])} {fill(20)}" for k in range(0, 240, 8)]
    df = spark.createDataFrame([*enumerate(texts), (0, fill(30)), (0, texts[0])], "doc_id long, text string")

    def noted(self, df, name):
        if name == "answers":
            read.extend(df.inputFiles())
        return written(self, df, name)

    monkeypatch.setattr(substrings.Scratch, "written", noted)
    whole = sorted(map(tuple, substrings.dedup(df).collect()))
    assert read and not any("/chunks/" in f for f in read)
    assert [r[2] for r in whole if r[0] > 0] == [60] * 30 and not any(r[2] for r in whole if r[0] == 0)
    monkeypatch.setattr(substrings, "ASKS", 1)
    assert sorted(map(tuple, substrings.dedup(df).collect())) == whole
