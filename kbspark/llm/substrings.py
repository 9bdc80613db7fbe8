"""Substring deduplication by content-defined chunking with a gear rolling hash.

A text is cut where the gear hash of the last 16 bytes is the largest within RADIUS bytes on either side, moved on to
the next word's start: cuts depend on nearby bytes only, so a passage has the same inner chunks wherever it stands, and
an insertion shifts nothing but its own chunks. Texts that repeat every few bytes are cut at each of their equal peaks,
and among short words a cut also stands where the hash is the largest of NEAR words on either side. Digests of chunks,
two by two, are counted over all documents; a pair that also stands in a document of smaller id is a repeat, and the
least such document is its source.

A run of repeats is only a candidate. It is sent to each source of its pairs, which answers with the stretches of the
run that follow one another there too, and with the words around each. A stretch with the words around it that are the
same on both sides is removed if it has more than MIN_WORDS words: what goes stands as a whole in one earlier document.
A passage stays where every pair of it also stands, in other company, in documents before the first that holds it whole.

Digests and ids are shuffled, not texts, until the runs are known; counts are added before the shuffle. Equal runs ask a
source once, and the questions to one source are dealt to groups of ASKS, so that a hot source is no single row.

Defined cases: null and empty texts stay as they are; rows with a null id stay and are no source; rows of one id count
as one document, so none of them repeats another; repeats within one document stay; a document that is repeated whole
becomes empty; of equal passages that of the least id stays, so no ties arise; an empty table gives an empty table; other
columns are kept, but for those named removed_words and removed_spans, which are replaced. A very long text is one value
of a task, as are its digests; time and memory grow in proportion to it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import Scratch, slices

#: Bytes on either side among which a cut has the largest hash; chunks are about twice as long.
RADIUS = 14
#: Words on either side among which a cut has the largest hash where all of them begin within NEAR_BYTES, so that a
#: passage of more than MIN_WORDS short words still holds two whole chunks in a row.
NEAR = 2
NEAR_BYTES = 20
MIN_WORDS = 50
#: Cuts nearer than this to a passage's end may depend on what follows it: the hash's bytes, and a radius or NEAR words.
EDGE = 64
#: Between the digests of equal pairs in a row.
STEP = 0x9E3779B97F4A7C15
#: Questions to a source that are answered in a row.
ASKS = 256
_GEAR = np.random.default_rng(20240102).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """For each byte the hash (h << 1) + gear[byte] over the last 16 bytes, in four doublings."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8):
        h[s:] += h[:-s].copy() << np.uint32(s)
    return h


def _ahead(h: np.ndarray, n: int) -> np.ndarray:
    """The largest of each n values that begin at a position, by doubling."""
    m, s = h, 1
    while 2 * s <= n:
        m, s = np.maximum(m[:-s], m[s:]), 2 * s
    return np.maximum(m[: len(m) - (n - s)], m[n - s :])


def chunked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the chunks of a text, with its end, and of its words. Leading spaces belong to no chunk."""
    b = np.frombuffer(data, np.uint8)
    space = _SPACE[b]
    words = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(words):
        return np.zeros(0, np.int64), words
    padded = np.zeros(len(b) + 2 * RADIUS, np.uint32)
    padded[RADIUS : len(b) + RADIUS] = gear(b)
    most = _ahead(padded, RADIUS)
    h = padded[RADIUS : len(b) + RADIUS]
    peaks = np.flatnonzero((h >= most[: len(b)]) & (h >= most[RADIUS + 1 : RADIUS + 1 + len(b)])) if len(b) > 1 else np.zeros(0, np.int64)
    cut = np.zeros(len(words) + 1, bool)  # whether a chunk starts with a word; the last is the end
    cut[np.searchsorted(words, peaks, side="right")] = True
    n = 2 * NEAR + 1
    if len(words) > n:
        dense = words[n:] - words[:-n] <= NEAR_BYTES
        if dense.any():
            near = h[words[:-1]]
            cut[NEAR : NEAR + len(dense)] |= dense & (near[NEAR : NEAR + len(dense)] == _ahead(near, n))
    cut[[0, -1]] = True
    return np.append(words, len(b))[cut], words


def digests(data: bytes, starts: np.ndarray) -> list[int]:
    """Of each two chunks that follow one another, so that repeats which only happen to meet don't join; of a lone one.

    Equal ones in a row are numbered, by STEP, so that the source of the n-th has as many in a row.
    """
    edges, content_digest = starts.tolist(), xxhash.xxh3_64_intdigest
    contents = [data[s:e].rstrip() for s, e in zip(edges, edges[2:] or edges[1:])]
    plain = np.array([content_digest(c) for c in contents], np.uint64)
    if not (plain[1:] == plain[:-1]).any():
        return (plain ^ np.uint64(1 << 63)).view(np.int64).tolist()
    out, before, n = [], None, 0
    for content, d in zip(contents, plain.tolist()):
        n = n + STEP if content == before else 0
        before = content
        out.append((d + n) % (1 << 64) - (1 << 63))
    return out


def unnumbered(own: list[int]) -> list[int]:
    """A whole text's digests without their numbers."""
    a = np.array(own, np.int64).view(np.uint64)
    if not (a[1:] - a[:-1] == np.uint64(STEP)).any():
        return own
    out, before = [], None
    for d in own:
        out.append(out[-1] if before is not None and (d - before - STEP) % (1 << 64) == 0 else d)
        before = d
    return out


def lists(column: pa.ListArray) -> Iterator[list[int]]:
    """A column of lists of numbers as Python has them; `to_pylist` makes a scalar of each element. A null is empty."""
    ends = column.offsets.to_numpy().tolist()
    values = column.values.to_numpy()
    return (values[a:b].tolist() for a, b in zip(ends, ends[1:]))


def whole(data: bytes) -> int:
    """A text's digest, by which rows of one id are told apart."""
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, whole: the text's digest, digests of chunk pairs, starts of the chunks and the end, words in each chunk)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: tuple[list, ...] = ([], [], [], [])
            for data in batch["text"].cast(pa.binary()).to_pylist():
                starts, words = chunked(data)
                rows[0].append(whole(data))
                rows[1].append(digests(data, starts))
                rows[2].append(starts.astype(np.int32))
                rows[3].append(np.diff(np.searchsorted(words, starts)).astype(np.int32))
            arrays = [pa.array(c, t) for c, t in zip(rows, (pa.int64(), *(pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int32()))))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *arrays], ["doc_id", "whole", "digests", "starts", "words"])

    return docs.mapInArrow(cut, "doc_id long, whole long, digests array<long>, starts array<int>, words array<int>")


def repeats(cut: DataFrame) -> DataFrame:
    """(doc_id, digest, source): chunks that a document of smaller id, the least of which is `source`, has too."""
    each = cut.select("doc_id", F.explode(F.array_distinct("digests")).alias("digest"))
    common = each.groupBy("digest").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").select("digest", "source")
    return each.join(common, "digest").where("source < doc_id")



#: A part of a run of repeats that a source is asked for: `reach` is how many bytes beside any stretch of it can belong to
#: the same passage; `starts` are those of its chunks, with its end.
RUN = "doc_id long, whole long, source long, reach int, starts array<int>, digests array<long>"
_RUN = pa.schema([*((x, pa.int64()) for x in ("doc_id", "whole", "source")), ("reach", pa.int32()), ("starts", pa.list_(pa.int32())), ("digests", pa.list_(pa.int64()))])


def _around(starts: list[int], first: int, last: int) -> tuple[int, int]:
    """The chunks from and up to which the words around those from `first` to `last` can belong to the same passage.

    The chunk beside them may have been cut off at its other end by what stands around, within EDGE bytes of it.
    """
    low, high = max(0, first - 1), min(last + 1, len(starts) - 1)
    edges = starts[low] - EDGE, starts[high] + EDGE
    while low > 0 and starts[low] > edges[0]:
        low -= 1
    while high < len(starts) - 1 and starts[high] < edges[1]:
        high += 1
    return low, high


def _parts(sources: list[int], upto: list[int]) -> Iterator[tuple[int, int, int]]:
    """(source, first, last) for each source of a run's pairs: those within MIN_WORDS words of one that it is the source of.

    A passage with such a pair in it lies there. `upto` counts the words before each chunk of the run.
    """
    open_: dict[int, tuple[int, int]] = {}
    for i, s in enumerate(sources):
        first, last = open_.get(s, (i, i))
        if upto[i] - upto[last] > 2 * MIN_WORDS:
            yield s, first, last
            first = i
        open_[s] = first, i
    yield from ((s, *places) for s, places in open_.items())


def runs(cut: DataFrame, repeated: DataFrame) -> DataFrame:
    """Parts of the maximal runs of repeats that, with the chunks around them, hold more than MIN_WORDS words."""
    per_doc = repeated.groupBy("doc_id").agg(F.collect_list("digest").alias("known"), F.collect_list("source").alias("sources"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc, text, own, starts, words, known, sources in zip(*(batch[c].to_pylist() for c in ("doc_id", "whole")), *(lists(batch[c]) for c in ("digests", "starts", "words", "known", "sources"))):
                source, n, i, plain = dict(zip(known, sources)), len(own), 0, unnumbered(own)
                upto = list(accumulate(words, initial=0))
                while i < n:
                    if own[i] not in source:
                        i += 1
                        continue
                    j, of = i, [source[own[i]]]
                    # Of equal pairs in a row, those beyond the longest row elsewhere repeat as well.
                    while j + 1 < n and (own[j + 1] in source or plain[j + 1] == plain[j]):
                        j += 1
                        of.append(source.get(own[j], of[-1]))
                    low, high = _around(starts, i, min(j + 2, len(words)))
                    if upto[high] - upto[low] > MIN_WORDS:
                        for s, first, last in _parts(of, upto[i:]):
                            a = max(i, bisect_left(upto, upto[i + first] - MIN_WORDS) - 1)
                            b = min(j, bisect_left(upto, upto[i + last] + MIN_WORDS) + 1)
                            edges = starts[a : min(b + 2, len(words)) + 1]
                            reach = 2 * EDGE + max(y - x for x, y in zip(starts[max(0, a - 1) :], starts[max(1, a) : b + 4]))
                            # Rounded up, so that copies ask alike.
                            out.append((doc, text, s, -(-reach // EDGE) * EDGE, edges, plain[a : b + 1]))
                    i = j + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(_RUN), _RUN.types)], schema=_RUN)

    return cut.join(per_doc, "doc_id").select("doc_id", "whole", "digests", "starts", "words", "known", "sources").mapInArrow(find, RUN)


def stretches(run: list[int], own: list[int], where: dict[int, list[int]], made: list | None = None) -> list[tuple[int, int, int]]:
    """(first, last, place): the maximal stretches of `run` that stand in `own`, from `place` on, none inside another.

    `made` keeps the automaton of `own`, where one is made, for further runs.
    """
    if sum(len(where.get(d, ())) for d in run) > 16 * len(run) + 4096:
        made = [] if made is None else made
        if not made:
            made.append(_automaton(own))
        return _stretches_by_automaton(run, own, made[0])
    out, now = [], {}  # the place in `own` of the last digest of each stretch that goes on, with its first in `run`
    for i, d in enumerate([*run, None]):
        following = {p: now.get(p - 1, i) for p in where.get(d, ())}
        ended = [(first, p) for p, first in now.items() if p + 1 not in following]
        if ended:
            first, _ = min(ended)
            if first < min(following.values(), default=i + 1):
                out += [(first, i - 1, p - (i - 1 - first)) for f, p in ended if f == first]
        now = following
    return out


def _automaton(own: list[int]) -> tuple[list[int], list[int], list[int], list[dict[int, int]]]:
    """The states of the suffix automaton of `own`: lengths, links, ends and what follows (Blumer et al., 1985)."""
    length, link, end, following = [0], [-1], [-1], [{}]
    state = 0
    for i, d in enumerate(own):
        new, p = len(length), state
        length.append(length[state] + 1), link.append(0), end.append(i), following.append({})
        while p >= 0 and d not in following[p]:
            following[p][d] = new
            p = link[p]
        if p >= 0:
            q = following[p][d]
            if length[q] > length[p] + 1:
                copy = len(length)
                length.append(length[p] + 1), link.append(link[q]), end.append(end[q]), following.append(dict(following[q]))
                while p >= 0 and following[p].get(d) == q:
                    following[p][d] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        state = new
    return length, link, end, following


def _stretches_by_automaton(run: list[int], own: list[int], made: tuple | None = None) -> list[tuple[int, int, int]]:
    """The same in time that grows with the lengths only, for texts that repeat themselves."""
    length, link, end, following = made or _automaton(own)
    out, state, n, before = [], 0, 0, None
    for i, d in enumerate([*run, None]):
        while state and d not in following[state]:
            state = link[state]
            n = length[state]
        if d in following[state]:
            state, n = following[state][d], n + 1
        else:
            state, n = 0, 0
        first = i - n + 1
        if before and (not n or first > before[0]):
            out.append(before)
        before = (first, i, end[state] - n + 1) if n else None
    return out


def beside(data: bytes, at: int, reach: int, left: bool) -> list[bytes]:
    """The words on one side of `at`, the nearest first, as many as take up to `reach` bytes."""
    size = reach + EDGE
    while True:
        low = max(0, at - size) if left else at
        high = at if left else min(len(data), at + size)
        words = data[low:high].split()
        if left:
            words.reverse()
        whole_side = low == 0 if left else high == len(data)
        if not whole_side:
            words = words[:-1]  # the limit may have cut the last word
        upto = list(accumulate(map(len, words)))
        # So many bytes do the first k + 1 words take, with one between each two.
        n = bisect_right(range(len(upto)), reach, key=lambda k: upto[k] + k)
        if n < len(words) or whole_side:
            return words[:n]
        size *= 2


def shifts(found: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The stretches, those together that are one stretch of a source at places one pair apart."""
    group: list[tuple[int, int, int]] = []
    for x in found:
        if group and x != (group[-1][0] + 1, group[-1][1] + 1, group[-1][2]):
            yield group
            group = []
        group.append(x)
    if group:
        yield group


def held(data: bytes, starts: list[int], found: list[tuple[int, int, int]], reach: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(first, last, left, right) of the stretches that may belong to a passage, with the words around them in the source.

    A run of equal pairs that is longer than the source's row holds the same stretch at each place. If the row alone is a
    passage that is one answer; if not, only the first and the last place can have more in common with the source.
    """
    for group in shifts(found):
        first, last, place = group[0]
        start, end = starts[place], starts[min(place + last - first + 2, len(starts) - 1)]
        inside = len(data[start:end].split())
        # At most so many words stand within reach.
        if inside + len(data[max(0, start - reach - 1) : start].split()) + len(data[end : end + reach + 1].split()) <= MIN_WORDS:
            continue
        left, right = (beside(data, at, reach, side) for at, side in ((start, True), (end, False)))
        if inside + len(left) + len(right) <= MIN_WORDS:
            continue
        told = b" ".join(left), b" ".join(right)
        if len(group) == 1:
            yield first, last, *told
            continue
        period = data[start : starts[place + 1]].split()
        row = inside + _follows(left, period[::-1]) + _follows(right, period)
        if row > MIN_WORDS:
            yield first, group[-1][1], *told
        else:
            yield from ((f, e, *told) for f, e, _ in (group[0], group[-1]))


def _follows(words: list[bytes], period: list[bytes]) -> int:
    """How many of `words` go on with the period."""
    k = 0
    while k < len(words) and words[k] == period[k % len(period)]:
        k += 1
    return k


ANSWER = "source long, key long, first int, last int, left binary, right binary"
_ANSWER = pa.schema([("source", pa.int64()), ("key", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])


def answers(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(source, key, first, last, left, right): stretches of runs that stand in a source, and the words around them there,
    the nearest first.

    Sources are cut again: a second shuffle of all texts' digests and starts costs more than to chunk those that are asked.
    """
    asks = found.select("source", "key", "digests", "reach").dropDuplicates(["source", "key"])
    parts = asks.groupBy("source").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("parts"))
    dealt = asks.join(parts, "source").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    asked = dealt.groupBy("source", "part").agg(F.collect_list(F.struct("key", "reach", "digests")).alias("asked"))
    texts = docs.join(asked.withColumnRenamed("source", "doc_id"), "doc_id")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, starts, own, where, made = None, [], [], {}, []
        for batch in slices(batches):
            out = []
            contents = batch["text"].cast(pa.binary()).to_pylist()
            for doc, data, asked in zip(batch["doc_id"].to_pylist(), contents, batch["asked"]):
                if data != before:  # the rows of a hot source follow one another
                    edges, _ = chunked(data)
                    before, starts, own, where, made = data, edges.tolist(), unnumbered(digests(data, edges)), {}, []
                    for k, d in enumerate(own):
                        where.setdefault(d, []).append(k)
                key, reach, runs_asked = (asked.values.field(c) for c in ("key", "reach", "digests"))
                for k, r, run in zip(key.to_pylist(), reach.to_pylist(), lists(runs_asked)):
                    out += [(doc, k, *x) for x in held(data, starts, stretches(run, own, where, made), r)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(_ANSWER), _ANSWER.types)], schema=_ANSWER)

    return texts.select("doc_id", "text", "asked").mapInArrow(fetch, ANSWER)


def _same(data: bytes, at: int, words: bytes, left: bool) -> tuple[int, int]:
    """How many words beside `at` are the same as `words`, the nearest first, and where the last of them ends, or `at`."""
    k = 0
    for mine, w in zip(beside(data, at, len(words) + 1, left), words.split()):
        if mine != w:
            break
        k += 1
        # Only space lies between, so that the nearest place of a word is its own.
        at = data.rfind(w, 0, at) if left else data.find(w, at) + len(w)
    return k, at


def removed(text: str, found: list[dict]) -> tuple[str, int, list[tuple[int, int]]]:
    """The text without its repeated stretches, how many words went, and their spans in code points."""
    data, spans = text.encode(), []
    own = whole(data)
    for r in found:
        if r["whole"] != own:  # a run of another text of the same id
            continue
        begin, end = int(r["begin"]), int(r["end"])
        (lead, low), (tail, high) = _same(data, begin, r["left"], True), _same(data, end, r["right"], False)
        if lead + len(data[begin:end].split()) + tail > MIN_WORDS:
            spans.append((low, high if tail else begin + len(data[begin:end].rstrip())))
    joined_spans: list[list[int]] = []
    for s, e in sorted(spans):
        if joined_spans and s <= joined_spans[-1][1]:
            joined_spans[-1][1] = max(e, joined_spans[-1][1])
        else:
            joined_spans.append([s, e])
    if not joined_spans:
        return text, 0, []
    out, at = "", 0
    for s, e in [*joined_spans, (len(data), len(data))]:
        part = data[at:s].decode()
        out = joined(out, part) if at else part
        at = e
    places, counted, at = [], 0, 0  # code points up to a byte
    for s, e in joined_spans:
        before = counted + len(data[at:s].decode())
        counted, at = before + len(data[s:e].decode()), e
        places.append((before, counted))
    return out, sum(len(data[s:e].split()) for s, e in joined_spans), places


def joined(left: str, right: str) -> str:
    """The two sides of a removed run: one line end or space remains of those that stood around it."""
    a, b = left.rstrip(" \t\n\r\f\v"), right.lstrip(" \t\n\r\f\v")
    around = left[len(a) :] + right[: len(right) - len(b)]
    return a + ("\n" if "\n" in around else " ") + b if a and b else a or b


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with repeats removed from `text`, and removed_words, removed_spans (start:end in the old text's code points)."""
    rows = docs.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scratch = Scratch(docs.sparkSession, "substrings")
    cut = scratch.written(chunks(rows), "chunks")
    found = scratch.written(runs(cut, repeats(cut)).withColumn("key", F.xxhash64("digests", "reach")), "runs")
    scratch.drop("chunks")
    said = scratch.written(answers(rows, found), "answers")
    known = found.join(said, ["source", "key"])
    end = F.least(F.col("last") + 2, F.size("starts") - 1)
    parts = F.struct("whole", F.get("starts", F.col("first")).alias("begin"), F.get("starts", end).alias("end"), "left", "right")
    per_doc = scratch.written(known.select("doc_id", parts.alias("part")).groupBy("doc_id").agg(F.collect_set("part").alias("found")), "found")
    scratch.drop("runs", "answers")

    @F.pandas_udf("text string, words long, spans string")
    def clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, all_runs in slices(batches):
            out = []
            for t, found in zip(texts, all_runs):
                t, n, spans = (t, 0, []) if found is None or t is None or not len(found) else removed(t, list(found))
                out.append((t, n, ",".join(f"{s}:{e}" for s, e in spans)))
            yield pd.DataFrame(out, columns=["text", "words", "spans"])

    # The rows' own columns travel in a struct, so that none can clash with those of the runs.
    all_rows = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("id"))
    met = all_rows.join(per_doc.withColumnRenamed("doc_id", "id"), "id", "left")
    # Only texts with something found go to Python and back.
    found_in = F.col("found").isNotNull()
    made = met.select("row", found_in.alias("found_in"), clean(F.when(found_in, F.col("row").getField(text)), F.col("found")).alias("clean"))
    left = F.when(F.col("found_in"), F.col("clean.text")).otherwise(F.col("row").getField(text))
    kept = [left.alias(text) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("removed_words", "removed_spans")]
    return made.select(*kept, F.col("clean.words").alias("removed_words"), F.col("clean.spans").alias("removed_spans"))
