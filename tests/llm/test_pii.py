import random
import time

import pytest

from kbspark.llm import pii
from tests.llm.test_operators import base_plain


@pytest.mark.parametrize(
    "kind,text",
    [
        ("email", "jane@example dot com"),
        ("email", "jane at example.com"),
        ("email", "jane (at) example dot com"),
        ("email", "jane at example [dot] com"),
        ("email", "john dot doe@example.com"),
        *(("email", f"jane at firm dot {end}") for end in ("ie", "xyz", "online", "sg", "gr", "cz")),
        ("ip", "192 dot 168 dot 0 dot 1"),
        ("ip", "one two seven dot zero dot zero dot one"),
        ("ip", "one two seven.zero.zero.one"),
        ("ip", "১৯২.১৬৮.০.১"),
        ("phone", "+1 five five five 0123 456"),
        ("phone", "+one 5 five 5 one 2 three 4"),
        ("card", "4 one 1 one 1 one 1 one 1 one 1 one 1 one 1 one"),
        ("card", "four 1 one 1 one 1 one 1 one 1 one 1 one 1 one 1"),
    ],
)
def test_disguises(kind, text):
    if kind == "card":
        digits = "".join(pii.DIGIT_WORDS.get(w, w) for w in text.split())
        last = next(d for d in "0123456789" if pii.luhn(digits[:-1] + d))
        text = text.rsplit(" ", 1)[0] + " " + (last if text.endswith("1") else next(w for w, d in pii.DIGIT_WORDS.items() if d == last))
    for t in (text, f"So: {text}, as said"):
        found = {(s["kind"], t[s["start"] : s["end"]]) for s in pii.personal(t) if s["added"]}
        assert (kind, text) in found, (t, found)


@pytest.mark.parametrize(
    "text",
    ["look at the dot on the map", "more information at www.example.com/x", "look at example.com", "Exception in main at java.lang.String.format(", "arrived at noon.then", "at 10.30 we met at 11.45", "one. Two. Three. 4. 5", "version two dot five"],
)
def test_prose(text):
    assert pii.personal(text) == []


def test_long_zeros():
    assert [s["kind"] for s in pii.personal("0" * 5000 + ".0.0.1")] == ["ip"]


LONG = ["1 ", "a-", "a.", "one ", "1-", "+1", "а", "at ", " dot ", "a@", "(at", " ", "one two 1 ", "walked at dot dot dot ", "1.", "0"]


@pytest.mark.parametrize("part", LONG)
def test_very_long_texts(part):
    """Time grows with the text, not with its square; base spans are those of the plain patterns."""
    tail = " x(at) mail dot com one two dot 1.2.3.4"
    took = []
    for n in (20_000, 80_000):
        text = "one two " + part * (n // len(part)) + tail
        start = time.process_time()
        found = pii.personal(text)
        took.append(time.process_time() - start)
        assert any(not s["added"] and text[s["start"] : s["end"]] == "1.2.3.4" for s in found)
    assert took[1] < 12 * took[0] + 0.3


def test_base_spans_with_long_runs():
    rng = random.Random(8)
    parts = ["1", "0", "a", ".", "-", " ", "@", "+", "(", "dot ", "at ", "4111 1111 1111 1111", "255.", "x@y.zz"]
    for _ in range(300):
        t = "".join(rng.choice(parts) * rng.choice((1, 1, 2, 3, 40)) for _ in range(rng.randrange(1, 12)))
        assert {(s["kind"], s["start"], s["end"]) for s in pii.personal(t) if not s["added"]} == base_plain(t), t


def test_spans_map_back():
    """Each added span, rewritten alone, is found as a whole."""
    rng = random.Random(9)
    parts = ["jane", " (at) ", " at ", "mаil", " dot ", "com", "１", "one ", "two ", "+", "plus ", "​", ".", "@", " and ", "192", "five "]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(3, 14)))
        r = pii.deobfuscated(t)
        if r.starts is not None:
            assert len(r.starts) == len(r.ends) == len(r.changed) == len(r.text)
            assert all(t[s:e] == c for s, e, c, new in zip(r.starts, r.ends, r.text, r.changed) if not new)
            assert (r.starts[1:] >= r.starts[:-1]).all() and (r.ends <= len(t)).all() and (r.starts < r.ends).all()


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a@b.cc", "x", 1)], "doc_id long, text string, personal string, start int")
    (row,) = pii.detect(df).collect()
    assert [s.kind for s in row.personal] == ["email"] and row.start == 1 and row.text == "a@b.cc"
    assert pii.mask(df).collect()[0].personal == "x"
