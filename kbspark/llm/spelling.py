"""Spelling variants by a trie over letter-group counts.

Words are counted over all texts; a word's frequency vector holds how many of its letters fall in each of GROUPS groups, and
its sum is the word's length. One inserted, deleted or replaced letter changes at most one count by +1 (a surplus) and at
most one by -1 (a deficit). The vectors make a trie, a level for each group; two subtries are searched together, depth
first, as long as the counts on the way differ by a surplus of one and a deficit of one at most. Words whose leaves are
reached are compared where they agree in their first or their last half, as two words with one edit must, and verified.

The trie's upper levels are Spark's partitioning: words of one length with equal counts in the first groups form a block, and a word is
sent to its own block and, with what it has spent, to each larger block that surplus and deficit allow, so that every
two blocks meet once. The number of those levels is the least for which no block holds over BLOCK words (all of them, if a
whole vector is that common). Tasks give each word's number of near words and its most frequent one, not the pairs.

Defined cases: null and empty texts have no words; repeated rows count each; a null id counts as an empty one in the digest
that deletes letters; ties for a form go to the smaller word in code-point order; an empty table gives an empty table;
columns other than key and text don't matter. A very long text is one value of a task, counted in time in proportion, and
so is a very long run of letters.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import Scratch, slices, text_or_empty
from kbspark.llm.vectordup import runs

#: Code points and occurrences that a word needs; the divisor of digests whose run loses a letter.
LETTERS, TIMES, DIVISOR = 5, 3, 97
#: How much more frequent a form must be.
RATIO = 2
#: Letter groups, the most frequent letters apart from each other; all other letters go by their number.
GROUPS = ("e", "t", "a", "o", "i", "n", "s", "r", "h", "dl", "uc", "mf", "pgwyb", "vkxjqz")
#: Words of a block at most, where the vectors allow, and pairs of nodes that a task searches at a time.
BLOCK, PAIRS = 1 << 15, 1 << 17
#: Different words that a task counts before it hands them on.
COUNTED = 1 << 19
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))
_GROUP = np.arange(256) % len(GROUPS)
for _i, _g in enumerate(GROUPS):
    for _c in _g:
        _GROUP[ord(_c)] = _i


def runs_of_letters(text: str) -> list[bytes]:
    """Lower-cased runs in Latin-1, where a byte is a code point; what it can't hold is no letter here."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def varied(found: Counter, id: int | None) -> Iterator[tuple[bytes, int]]:
    """A text's runs with how often each occurs, those that the digest chooses without one letter."""
    start = zlib.crc32(f"{'' if id is None else id}:".encode())
    for w, n in found.items():
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
        if h % DIVISOR == 0:
            k = h % len(w)
            w = w[:k] + w[k + 1 :]
        if len(w) >= LETTERS:
            yield w, n


def counted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(word, n): words of LETTERS letters and TIMES occurrences or more. Tasks count before words are shuffled."""
    rows = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = defaultdict(int)

        def told() -> Iterator[pa.RecordBatch]:
            words, n = list(total), list(total.values())
            for k in range(0, len(words), 1 << 14):
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words[k : k + (1 << 14)]]), pa.array(n[k : k + (1 << 14)], pa.int64())], ["word", "n"])
            total.clear()

        for b in slices(batches):
            for id, t in zip(b["id"].to_pylist(), b["text"].to_pylist()):
                for w, n in varied(Counter(runs_of_letters(t)), id):
                    total[w] += n
            if len(total) > COUNTED:
                yield from told()
        yield from told()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


def vectors(words: list[bytes]) -> np.ndarray:
    """Frequency vectors, a row for each word."""
    size = np.array([len(w) for w in words], np.int64)
    at = np.repeat(np.arange(len(words)), size) * len(GROUPS) + _GROUP[np.frombuffer(b"".join(words), np.uint8)]
    return np.bincount(at, minlength=len(words) * len(GROUPS)).reshape(len(words), len(GROUPS))


def with_vectors(words: DataFrame) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = vectors([w.encode("latin-1") for w in b["word"].to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * len(GROUPS), pa.int32()), pa.array(v.reshape(-1), pa.int32()))
            yield pa.RecordBatch.from_arrays([b["word"], b["n"], lists], ["word", "n", "v"])

    return words.mapInArrow(add, "word string, n long, v array<int>")


def levels(words: DataFrame) -> int:
    """The least number of upper levels for which no block holds over BLOCK words."""
    length = F.length("word").cast("string")
    sizes = words.select(*(F.concat_ws(",", length, F.array_join(F.slice("v", 1, k), ",")).alias(str(k)) for k in range(1, len(GROUPS) + 1)))
    for k in range(1, len(GROUPS)):
        if (sizes.groupBy(str(k)).count().agg(F.max("count")).first()[0] or 0) <= BLOCK:
            return k
    return len(GROUPS)


class Move(NamedTuple):
    """A change of length and first counts, and what is left of surplus and deficit for the other counts."""

    by: tuple[int, ...]
    surplus: int
    deficit: int


def moves(depth: int) -> list[Move]:
    """The moves from a block to itself (the first) and to the larger ones that near words can be in, by length and counts."""
    found = []
    for i in range(-1, depth):
        for j in range(-1, depth):
            if i >= 0 and i == j:
                continue
            counts = [int(k == i) - int(k == j) for k in range(depth)]
            surplus, deficit = int(i < 0), int(j < 0)
            for rest in range(-deficit, surplus + 1):
                by = (sum(counts) + rest, *counts)
                if by >= (0,) * len(by):
                    found.append(Move(by, surplus, deficit))
    return sorted(found)


def blocks(words: DataFrame, depth: int) -> DataFrame:
    """(block, move, word, n): each word in its own block (move 0) and in those that it may have near words in."""
    ways = F.array(*(F.struct(F.lit(i).alias("move"), F.array(*(F.lit(x) for x in m.by)).alias("by")) for i, m in enumerate(moves(depth))))
    place = F.concat(F.array(F.length("word")), F.slice("v", 1, depth))
    sent = words.withColumn("way", F.explode(ways)).withColumn("to", F.zip_with(place, "way.by", lambda a, b: a + b))
    # A block's name is the hash of its counts, so that rows can be sorted by it.
    return sent.where(F.forall("to", lambda x: x >= 0)).select(F.xxhash64("to").alias("block"), F.col("way.move").alias("move"), "word", "n")


class Trie:
    """The distinct rows of counts as a trie: at each level the nodes' keys (parent and count), ascending, and each row's leaf."""

    def __init__(self, v: np.ndarray):
        node, self.levels = np.zeros(len(v), np.int64), []
        for column in v.T:
            distinct, node = np.unique((node << 32) + column, return_inverse=True)
            node = node.reshape(-1)
            self.levels.append(distinct)
        self.leaf = node


def leaf_pairs(a: Trie, b: Trie, ways: list[Move]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaves of a and b within what each move has left; a's first level is the move, its others are b's.

    Depth first: pairs of nodes lie on a stack, and at most PAIRS of them are taken a level further at a time.
    """
    first = a.levels[0]
    stack = [(0, np.arange(len(first)), np.zeros(len(first), np.int64), *(np.array([getattr(ways[m], c) for m in first]) for c in ("surplus", "deficit")))]
    while stack:
        level, x, y, up, down = stack.pop()
        if level == len(b.levels):
            yield x, y
            continue
        keys_a, keys_b = a.levels[level + 1], b.levels[level]
        first, last = np.searchsorted(keys_a, x << 32), np.searchsorted(keys_a, (x + 1) << 32)
        who, child = expanded(first, last)
        count, found = keys_a[child] & 0xFFFFFFFF, []
        for by in (-1, 0, 1):
            i = np.flatnonzero((down[who] > 0) & (count > 0) if by < 0 else up[who] > 0) if by else np.arange(len(who))
            want = (y[who[i]] << 32) + count[i] + by
            at = np.searchsorted(keys_b, want)
            hit = keys_b[np.minimum(at, len(keys_b) - 1)] == want
            i, at = i[hit], at[hit]
            found.append((child[i], at, up[who[i]] - (by > 0), down[who[i]] - (by < 0)))
        x, y, up, down = (np.concatenate(c) for c in zip(*found))
        for k in range(0, len(x), PAIRS):
            part = slice(k, k + PAIRS)
            stack.append((level + 1, x[part], y[part], up[part], down[part]))


def expanded(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, value) for each value of each range."""
    n = last - first
    who = np.repeat(np.arange(len(n)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + first[who]


def one_edit(x: bytes, y: bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced letter makes y of x."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    low, high = 0, len(x)  # the length of the common start
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if x[:middle] == y[:middle] else (low, middle - 1)
    return x[low + 1 :] == y[low + 1 :] if len(x) == len(y) else x[low:] == y[low + 1 :]


class Words:
    """Words with the digests of their halves: of half the length and of half of one less, from the start and from the end."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.array([[hash(w[: len(w) // 2]) for w in words], [hash(w[: (len(w) - 1) // 2]) for w in words]], np.int64)
        self.end = np.array([[hash(w[len(w) - len(w) // 2 :]) for w in words], [hash(w[len(w) - (len(w) - 1) // 2 :]) for w in words]], np.int64)


def _mixed(leaf: np.ndarray, half: np.ndarray, length: np.ndarray, side: int) -> np.ndarray:
    return half ^ (leaf * 4 + side + (length << 40)) * np.int64(0x1E3779B97F4A7C15)


def near_words(words: list[bytes], v: np.ndarray, move: np.ndarray, ways: list[Move]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of near words of a block, each two once; j is of move 0.

    A word of the block is looked up by its leaf and a half of it, so that words of one leaf don't all meet.
    """
    home = np.flatnonzero(move == 0)
    known = Words(words)
    a, b = Trie(np.column_stack((move, v))), Trie(v[home])
    members = np.argsort(a.leaf, kind="stable")
    bounds = np.searchsorted(a.leaf[members], np.arange(a.leaf.max() + 2))
    leaf_of = np.zeros(len(words), np.int64)
    leaf_of[home] = b.leaf
    length_b = np.zeros(b.leaf.max() + 1, np.int64)  # words of a leaf have one length
    length_b[b.leaf] = known.size[home]
    index = []
    for side, halves in enumerate((known.start, known.end)):
        # For a partner of the same length or a longer one, and for one that is shorter by one letter.
        keys = np.concatenate([_mixed(b.leaf, halves[c][home], (known.size[home] - c) // 2, side) for c in (0, 1)])
        twice = np.concatenate([np.ones(len(home), bool), known.size[home] % 2 == 0])  # else both halves are the same
        keys, at = keys[twice], np.concatenate((home, home))[twice]
        order = np.argsort(keys, kind="stable")
        index.append((keys[order], at[order]))
    for x, y in leaf_pairs(a, b, ways):
        for k in range(0, len(x), PAIRS):
            p, q = x[k : k + PAIRS], y[k : k + PAIRS]
            who, at = expanded(bounds[p], bounds[p + 1])
            i, leaf = members[at], q[who]
            shorter = (length_b[leaf] < known.size[i]).astype(np.int64)
            length = np.minimum(length_b[leaf], known.size[i]) // 2
            for side, halves in enumerate((known.start, known.end)):
                keys, places = index[side]
                want = _mixed(leaf, halves[shorter, i], length, side)
                met, at = expanded(np.searchsorted(keys, want, "left"), np.searchsorted(keys, want, "right"))
                s, t = i[met], places[at]
                keep = (move[s] > 0) | (s < t)
                if side:  # found by their first halves already
                    keep &= known.start[shorter[met], s] != known.start[(known.size[t] > known.size[s]).astype(np.int64), t]
                s, t = s[keep], t[keep]
                good = np.fromiter((one_edit(words[m], words[n]) for m, n in zip(s.tolist(), t.tolist())), bool, len(s))
                yield s[good], t[good]


def met(rows: pa.Table, ways: list[Move]) -> pa.RecordBatch | None:
    """(word, near, best_n, best) of a block's words: how many near ones they have here, and the most frequent of them."""
    move = rows["move"].to_numpy()
    if (move > 0).all():
        return None
    words = [w.encode("latin-1") for w in rows["word"].to_pylist()]
    rest = vectors(words)[:, len(ways[0].by) - 1 :]
    s, t = (np.concatenate(c) for c in zip(*[(np.zeros(0, np.int64),) * 2, *near_words(words, rest, move, ways)]))
    if not len(s):
        return None
    s, t = np.concatenate((s, t)), np.concatenate((t, s))
    n = rows["n"].to_numpy()
    involved = sorted(set(t.tolist()), key=lambda i: (-n[i], words[i]))
    rank = np.zeros(len(words), np.int64)
    rank[involved] = np.arange(len(involved))
    near, best = np.bincount(s, minlength=len(words)), np.full(len(words), len(involved))
    np.minimum.at(best, s, rank[t])
    some = np.flatnonzero(near)
    of = np.array(involved)[best[some]]
    return pa.RecordBatch.from_arrays([rows["word"].combine_chunks().take(pa.array(some)), pa.array(near[some]), pa.array(n[of]), rows["word"].combine_chunks().take(pa.array(of))], ["word", "near", "best_n", "best"])


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, best): best has n and word of the most frequent near word."""
    depth = levels(words)
    ways = moves(depth)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ("block",)):
            made = met(rows, ways)
            if made is not None:
                yield made

    sent = blocks(words, depth).repartition("block").sortWithinPartitions("block")
    found = sent.mapInArrow(search, "word string, near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("rank"), F.col("best").alias("word"))).alias("best"))


def rooted(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of the words (word, form) that have a form: the last of the forms.

    A form is RATIO times as frequent as its word, so chains are short; each round doubles how far a word looks.
    """
    now, turn = scratch.written(forms.select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            return now
        moved = now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        now, turn = scratch.written(moved, f"roots{turn + 1}"), turn + 1
        scratch.drop(f"roots{turn - 1}")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per word: form and root, n, n_near and form_n."""
    kept, scratch = Scratch(docs.sparkSession, "spelling"), Scratch(docs.sparkSession, "spelling_work")
    words = scratch.written(with_vectors(counted(docs, key, text)), "words")
    known = words.select("word", "n").join(near(words), "word", "left")
    better = -F.col("best.rank") >= RATIO * F.col("n")
    known = scratch.written(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("best.word")).alias("form"), F.when(better, -F.col("best.rank")).alias("form_n")), "near")
    roots = rooted(known.where("form IS NOT NULL"), scratch)
    made = kept.written(known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    scratch.clear()
    return made
