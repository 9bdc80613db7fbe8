"""Personal data with offset-preserving deobfuscation.

Base detectors run over the text as it is. Transducers then rewrite disguises, first by character (homoglyphs, full-width
and mathematical letters, decimal digits of any script, zero-width characters), then by word ("at" and "dot", each however
the other is written, spelled digits, "dot" between numbers), and keep for every
character they write the source span it stands for. The same detectors run over the result, and their spans are mapped
back to the source; one that holds rewritten characters and isn't a base span is added.

Defined cases: a null or empty text has none; null keys, repeated rows and other columns pass through, but for one named
like the result, which is replaced; an empty table gives an empty table; spans may overlap between kinds and, for
disguised ones, with a base span of their kind; no ties arise. A very long text is one value of a task: detectors and
transducers take time and memory in proportion to it, whatever it holds.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import slices, text_or_empty

KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<place:int,kind:string,start:int,end:int,added:boolean>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits, as it would begin at the run's start instead.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each '@domain', with the run of local characters before it back to the last match: no scan of words without '@'."""
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            yield start, last


def detected(text: str) -> list[tuple[int, int, int]]:
    """(kind's place, start, end), by kind, then start."""
    found = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p := q.lstrip("0")) <= 3 and int(p or 0) <= 255 for q in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


# Letters of other scripts that look like ASCII ones, and characters that don't show.
LOOKALIKES = dict(zip("АВЕКМНОРСТУХавеикмнорстухѕіјԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρ", "ABEKMHOPCTYXabeukmhopctyxsijdqwhABEZHIKMNOPTYXoavp")) | {"٠": "0", "‐": "-", "‑": "-", "‒": "-", "–": "-", "․": ".", "。": ".", "﹒": ".", "﹫": "@", "\xa0": " ", " ": " ", " ": " ", "　": " "}
UNSEEN = "​‌‍⁠﻿\xad"
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_CHARACTERS = LOOKALIKES | {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)] if unicodedata.normalize("NFKC", chr(c)).isascii()} | {chr(c): str(unicodedata.decimal(chr(c))) for c in range(0x80, 0x20000) if unicodedata.decimal(chr(c), None) is not None} | dict.fromkeys(UNSEEN, "")
_ODD = re.compile("[" + re.escape("".join(_CHARACTERS)) + "]")
_ODD_SET = frozenset(_CHARACTERS)
_ODD_LATIN = [c for c in _CHARACTERS if ord(c) < 256]
_ONE = "(?:" + "|".join(DIGIT_WORDS) + ")"
_NUMBER = rf"(?:{_ONE}|[0-9]+)"
_SPELLED = re.compile(rf"\b(?:plus[ -]+)?{_NUMBER}(?:(?:[ ,.-]{{1,2}}|[ \t]+dot[ \t]+){_NUMBER})+\b", re.I | re.A)
# Where a digit word may stand beside a number: the last letter of one and the second, or a figure before a digit word.
_SIDE = rf"[{''.join(sorted({w[-1] for w in DIGIT_WORDS}))}]"
_BESIDE = re.compile(rf"{_SIDE}[ ,.-]{{1,2}}{_ONE}\b|{_ONE}[ ,.-]{{1,2}}[0-9]|[0-9][ ,.-]{{1,2}}{_ONE}\b", re.I | re.A)
_ITEM = re.compile(rf"plus|{_NUMBER}", re.I | re.A)
_BRACKETED = re.compile(r"[\[({<][ \t]*(at|@|dot|\.)[ \t]*[\])}>][ \t]*", re.I | re.A)
_PART = r"[A-Za-z0-9_%+-]+"
_AT = re.compile(r"@|(?<=[ \t])at(?=[ \t])", re.I | re.A)
_HOST = re.compile(r"[ \t]*([A-Za-z0-9-]+(?:(?:\.|[ \t]+dot[ \t]+)[A-Za-z0-9-]+)+)", re.I | re.A)
_DOT_WORD = re.compile(r"[ \t]+dot[ \t]+", re.I | re.A)
_HAS_DOT = re.compile(r"[ \t]dot[ \t]", re.I | re.A)
# Fixed values that tell prose around a bare "at" ("look at the dot on the map", "more at example.com"): words that end no
# address, words that begin no host, words that stand before a place or a site, and ends of file names. Any other end may
# be an address's; a spelled dot before one of _ENDS is an address whatever stands before.
_NO_END = frozenset("a i an the and or of on if up with from for that this which was were are will when then dot at he she we they out off into over".split())
_NO_HOST = frozenset("a an the this that these those each every any some his her my our your their its which www".split())
_PROSE = frozenset(
    "me us you him her them it that this is are was were be been am here there out up down in on off over back only just even not now still more less most best all both each and or the a an to of"
    " available online free live lives found see seen visit read information details site website page pages web link links homepage store shop blog news article articles story documentation docs document documents"
    " source code download downloads version file files error errors exception warning line look looks stare stares work works stay stays arrive arrives aim aims point points meet meets sit sits stand stands start starts stop stops"
    " begin begins began end ends met sat stood sold buy order sale sales price prices job jobs team office engineer engineers manager director professor researcher scientist founder ceo editor writer reporter student students people"
    " person place time today tomorrow yesterday week month year day night home school university".split()
)
_FILES = frozenset("html htm txt php json csv xml yml yaml pdf png jpg gif java cpp hpp js jsx ts tsx exe dll log conf cfg ini".split())
_ENDS = frozenset("com org net edu gov mil int info biz name io ai app dev co me tv eu us uk de fr es it nl be ch at pl se no dk fi pt ru ua cn jp kr in au nz ca mx br ar za".split())
_CUE = re.compile(r"mail|contact|address|write|reach", re.I | re.A)


class Rewritten:
    """A text with, for each character, the source span it stands for and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.changed = text, None, None, None

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply (start, end, new) edits, ascending and apart, given in this text's positions."""
        if not edits:
            return
        if self.starts is None:
            self.starts = np.arange(len(self.text), dtype=np.int32)
            self.ends, self.changed = self.starts + 1, np.zeros(len(self.text), bool)
        begins, stops, news = zip(*edits)
        # Kept stretches and new ones by turns: where each begins and ends here, and how long it is in the new text.
        first = np.zeros(2 * len(edits) + 1, np.int64)
        last = np.full(len(first), len(self.text), np.int64)
        first[1::2], first[2::2], last[1::2], last[:-1:2] = begins, stops, stops, begins
        length, kept = last - first, np.arange(len(first)) % 2 == 0
        length[1::2] = [len(x) for x in news]
        place = np.repeat(first, length)
        stays = np.repeat(kept, length)
        place += np.where(stays, np.arange(len(place)) - np.repeat(np.cumsum(length) - length, length), 0)
        self.starts, self.ends = self.starts[place], self.ends[np.where(stays, place, np.repeat(last, length) - 1)]
        self.changed = ~stays | self.changed[place]
        self.text = "".join(x for pair in zip((self.text[a:b] for a, b in zip((0, *stops), begins)), news) for x in pair) + self.text[stops[-1] :]


def _prose(r: Rewritten, start: int, local: str, host: re.Match, labels: list[str]) -> bool:
    """Whether what stands around a bare "at" is prose rather than an address."""
    first, last, word = labels[0].lower(), labels[-1].lower(), local.lower()
    if first in _NO_HOST or len(last) < 2 or not last.isalpha():
        return True
    spelled = _DOT_WORD.search(host[1]) or r.changed is not None and r.changed[host.start() : host.end()].any()
    if spelled and last in _ENDS:
        return False
    if word in _PROSE or len(word) >= 6 and word.endswith(("ed", "ing")) and not _CUE.search(r.text, max(0, start - 40), start):
        return True
    return not spelled and (last in _FILES or not (labels[-1].islower() or host[1].isupper()) or r.text[host.end() : host.end() + 1] in ("(", "/", ":", "_"))


def _after(matches: Iterator[re.Match]) -> Iterator[tuple[int, re.Match]]:
    """Matches, each with the end of the one before it."""
    last = 0
    for m in matches:
        yield last, m
        last = m.end()


def _back(text: str, at: int, last: int) -> int:
    """Where the spaces and tabs before `at` begin."""
    while at > last and text[at - 1] in " \t":
        at -= 1
    return at


def _dot_before(text: str, at: int, last: int) -> int | None:
    """Where a bare "dot" between spaces that ends at `at` begins."""
    word = _back(text, at, last)
    if word == at or word - 3 < last or text[word - 3 : word].lower() != "dot":
        return None
    start = _back(text, word - 3, last)
    return start if start < word - 3 else None


def _addresses(r: Rewritten) -> list[tuple[int, int, str]]:
    """Bare "at" and "dot" inside addresses become signs, each however the other is written."""
    text, edits, last = r.text, [], 0
    for at in _AT.finditer(text):
        if at.start() < last:
            continue
        bare, host = at[0] != "@", _HOST.match(text, at.end())
        if host is None or not bare and host.start(1) > at.end():
            continue
        # Words at the end that end no address are not part of it.
        pieces = list(re.finditer(r"[A-Za-z0-9-]+", _DOT_WORD.sub(lambda m: "." * len(m[0]), host[1])))
        while len(pieces) > 1 and pieces[-1][0].lower() in _NO_END:
            pieces.pop()
        if len(pieces) < 2:
            continue
        host = _HOST.match(text, at.end(), host.start(1) + pieces[-1].end())
        at_start = _back(text, at.start(), last) if bare else at.start()
        dots, start = [], at_start
        while True:
            begun = start
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            back = _dot_before(text, start, last) if start < begun else None
            if back is None or back == last or text[back - 1] not in _LOCAL:
                break
            dots.append((back, start, "."))
            start = back
        if dots and dots[-1][0] == start:
            start = dots.pop()[1]
        local = text[start:at_start]
        if not local or bare and _prose(r, start, local, host, [x[0] for x in pieces]):
            continue
        edits += dots[::-1]
        if bare:
            edits.append((at_start, host.start(1), "@"))
        edits += [(w.start() + host.start(1), w.end() + host.start(1), ".") for w in _DOT_WORD.finditer(host[1])]
        last = host.end()
    return edits


def _spelled(m: re.Match) -> list[tuple[int, int, str]]:
    """Digit words of a run become digits and "dot" a dot. What stands between two words goes, except the dots of an address."""
    items = [(w.start() + m.start(), w.end() + m.start(), w[0].lower()) for w in _ITEM.finditer(m[0]) if w[0].lower() != "dot"]
    between = [m.string[a[1] : b[0]] for a, b in zip(items, items[1:])]
    said = [bool(_DOT_WORD.fullmatch(x)) for x in between]
    if not any(said) and all(w[2].isdigit() for w in items):
        return []
    dotted = any(said) or sum(x == "." for x in between) == 3
    edits = []
    for k, (start, end, word) in enumerate(items):
        if not word.isdigit():
            edits.append((start, end, "+" if word == "plus" else DIGIT_WORDS[word]))
        if k < len(between):
            words = not word.isdigit() and not items[k + 1][2].isdigit()
            figures = word.isdigit() and items[k + 1][2].isdigit()
            if said[k]:
                edits.append((end, items[k + 1][0], "."))
            elif word == "plus" or words and not (dotted and set(between[k]) & set(".,")):
                edits.append((end, items[k + 1][0], ""))
            elif not figures and between[k] not in (" ", "-", "."):
                edits.append((end, items[k + 1][0], " "))
            elif not figures and between[k] == "." and not dotted:
                edits.append((end, items[k + 1][0], " "))
    return edits


def odd(text: str) -> bool:
    """Whether any character is to be rewritten; texts of Western letters are told without a look at each character."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _ODD_SET.isdisjoint(text)
    return any(c in text for c in _ODD_LATIN)


def deobfuscated(text: str) -> Rewritten:
    r = Rewritten(text)
    if odd(text):
        r.replace([(m.start(), m.end(), _CHARACTERS[m[0]]) for m in _ODD.finditer(text)])
    r.replace([(_back(r.text, m.start(), last), m.end(), "@" if m[1].lower() in ("at", "@") else ".") for last, m in _after(_BRACKETED.finditer(r.text))])
    dot = _HAS_DOT.search(r.text)
    if dot or _AT.search(r.text):
        r.replace(_addresses(r))
    if dot or _BESIDE.search(r.text):
        r.replace([e for m in _SPELLED.finditer(r.text) for e in _spelled(m)])
    return r


def personal(text: str) -> list[dict]:
    """Base spans and added ones, by kind, then start."""
    base = detected(text)
    found = {(*x, False) for x in base}
    r = deobfuscated(text)
    if r.starts is not None:
        for place, start, end in detected(r.text):
            span = (place, int(r.starts[start]), int(r.ends[end - 1]))
            if r.changed[start:end].any() or span[2] - span[1] != end - start:
                if (*span, False) not in found:
                    found.add((*span, True))
    return [{"place": p, "kind": KINDS[p], "start": s, "end": e, "added": a} for p, s, e, a in sorted(found)]


def found_in(text: Column) -> Column:
    @F.pandas_udf(f"array<{SPAN}>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in slices(batches):
            yield texts.map(personal)

    return find(text)


def detect(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with `personal`: spans (code points, end exclusive) by kind, then start."""
    return df.withColumn("personal", found_in(text_or_empty(text)))


def masked(text: str) -> str:
    """`text` with every span replaced by its kind in brackets; spans that overlap become the first one's kind."""
    out, at = [], 0
    for s in sorted(personal(text), key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with personal data in `text` masked; nulls stay null."""

    @F.pandas_udf("string")
    def hide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in slices(batches):
            yield texts.map(lambda t: None if t is None else masked(t))

    return df.withColumn(text, hide(F.col(text)))


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
