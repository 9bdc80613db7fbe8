"""JSON web tokens within runs, and that long runs take time in proportion."""

import re
import time

from kbspark.llm import secrets

OPEN = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
PARTS = ("eyJ", "a", "12345678", ".", "eyJabcdefgh", " ", "-", "eyJeyJeyJabc")


def test_tokens_as_by_plain_pattern():
    import random

    r = random.Random(3)
    for _ in range(20_000):
        text = "".join(r.choices(PARTS, k=r.randrange(1, 14)))
        assert [(s["start"], s["end"]) for s in secrets.candidates(text) if s["kind"] == "jwt"] == [m.span() for m in OPEN.finditer(text)], text


def test_a_megabyte_of_starts():
    for unit in ("eyJ", "eyJ.", "eyJabcdefgh.", "eyJabcdefgh.eyJ", "password ", "AKIA", "0123456789abcdef ", "ghp_", "-----BEGIN "):
        start = time.time()
        secrets.candidates(unit * (1_000_000 // len(unit)))
        assert time.time() - start < 10, unit
