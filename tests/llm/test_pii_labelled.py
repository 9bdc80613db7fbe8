"""Precision and recall of disguised identifiers on a labelled set: sentences with one each, and prose with none."""

import random

from kbspark.llm import pii

NAMES = "jane reed omar li anna.k t_smith paul-w kim99 sven maria.lopez dr.who info sales nora b.otto yuki".split()
HOSTS = "example firmware-shop mail northwind acme univ-graz blue-sky contoso data7 post".split()
ENDS = "com org net de io co.uk edu info fr app".split()
FRAMES = ("Please write to {} before Friday.", "Contact: {}", "You can reach her under {} or come by.", "{} is where I read mail", "We (the team) use {}; it works.", "Questions, as always, go to {}!", "He said {} was his, and left.")
DIGITS = "zero one two three four five six seven eight nine".split()
WIDE = str.maketrans({c: chr(ord(c) + 0xFEE0) for c in map(chr, range(33, 127))})
GLYPHS = str.maketrans({"a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "i": "і", "s": "ѕ"})
PROSE = (
    "We met at {} on {} and stayed until {}.", "Look at the dot on page {}, it is at {} percent.", "She lives at {} Main Street.", "Prices rose {} points, from {} to {}.", "At {} dot matrix printers were sold in {}.",
    "Version {}.{} came out at last.", "The score was {} to {} at half time.", "Dial {} for help at the desk.", "Put a dot at the end. At dawn {} birds sang.", "Chapter {}: at home and at work.",
    "one two three, look at me, {} times", "More at the library, open at {} daily.", "He was at best average, at worst {}.", "the ratio is {} : {} at most", "See section {}.{} at the back of the book.",
)


def email(r):
    local, host = r.choice(NAMES), f"{r.choice(HOSTS)}.{r.choice(ENDS)}"
    at, dot = r.choice([(" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" AT ", " DOT "), ("@", " dot "), (" (at) ", "."), ("{at}", "."), (" _at_ ", " _dot_ ")])
    spelled = local.replace(".", dot) if r.random() < 0.3 else local
    kind = r.randrange(4)
    if kind == 0:
        return f"{local}@{host}".translate(WIDE)
    if kind == 1:
        return f"{local}@{host}".translate(GLYPHS)
    return f"{spelled}{at}{host.replace('.', dot)}"


def phone(r):
    digits = [str(r.randrange(10)) for _ in range(r.randrange(9, 13))]
    how = r.randrange(3)
    if how == 0:
        return "+" + " ".join(DIGITS[int(d)] for d in digits)
    if how == 1:
        return ("+" + "".join(digits[:2]) + " " + "".join(digits[2:])).translate(WIDE)
    return "+" + digits[0] + " " + " ".join(DIGITS[int(d)] if r.random() < 0.5 else d for d in digits[1:])


def address(r):
    parts = [str(r.randrange(256)) for _ in range(4)]
    return r.choice([" dot ", "(dot)", " [dot] "]).join(parts) if r.random() < 0.7 else ".".join(parts).translate(WIDE)


def test_precision_and_recall():
    r = random.Random(17)
    found = wanted = right = 0
    missed = {}
    for _ in range(1500):
        kind, made = r.choice([("email", email), ("phone", phone), ("ip", address)])
        told, frame = made(r), r.choice(FRAMES)
        start, text = frame.index("{}"), frame.format(told)
        spans = pii.personal(text)
        hit = any(s["kind"] == kind and s["start"] == start and s["end"] == start + len(told) for s in spans)
        wanted, found, right = wanted + 1, found + len(spans), right + hit
        if not hit:
            missed.setdefault(kind, []).append((text, [(s["kind"], text[s["start"] : s["end"]]) for s in spans]))
    for _ in range(1500):
        frame = r.choice(PROSE)
        text = frame.format(*(r.choice([r.randrange(100), "noon", "seven", r.randrange(2000)]) for _ in range(frame.count("{}"))))
        found += len(pii.personal(text))
    print(f"recall {right / wanted:.3f}, precision {right / found:.3f}", {k: (len(v), v[:4]) for k, v in missed.items()})
    assert right / wanted > 0.9 and right / found > 0.9
