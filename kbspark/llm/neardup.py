"""Near-duplicate documents by bottom-k sketches of one hash function.

Each document's distinct shingles are hashed once; its sketch is the k least hashes. Documents with equal sets form a
class at once. Inverted lists of the classes' retained values then give candidates in two steps:

1. with K1 values per class, a class stays if enough of its values occur in another class too;
2. with K2 values of those that stay, each class enters the lists of its rarest values only: so many that two classes
   that share as many values as similarity asks for must meet in one (prefix filtering). Where the sketch is the whole
   set this loses nothing; where it isn't, the number asked for lies over six standard deviations below the mean.

Two classes that meet pass a filter inside the join: their set sizes, and the parity bits of their whole sets, whose
difference is at most that of the sets. First each list's classes are compared with the list's hub only, in STARS rounds;
what links is united, and then only classes of different components are compared. Candidates are estimated by the sketch of
the union and confirmed on the full sets. Components come from linked classes.

No pairs within a class or a component are made, no list is cut, and nothing but a few counts reaches the driver. What a list
of different components costs is another matter: its classes are compared by size and parity with one another, in cells, so
that work grows with the square of the documents that share a rare template and yet don't link.

Defined cases: texts that are null or without words have an empty set, link with nothing and are kept; equal sets link
whatever the ids; rows with a null id link with nothing, have no component (null) and are kept; rows of one id are each
judged by their own text; of equal ids and sets no tie matters, as a component is named by its least id; an empty table
gives an empty table; columns other than key and text don't matter. A very long text is one value of a task, and the
hashes of its whole set one value of a row, in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import Scratch, slices, text_or_empty
from kbspark.llm.components import components

WORDS = 5
#: Similarity as a fraction: links have NUM/DEN or more.
NUM, DEN = 3, 4
K1, SHARED1 = 48, 16
K2, SHARED2 = 192, 105
#: Rounds in which a list's classes are compared with its hub alone, before the rest are compared with one another.
STARS = 2
#: Classes of a list in a cell: a list of more is cut, and each cell's classes meet the whole list in a task of their own.
CELL = 1024
#: Longs of parity bits of a set.
PARITY = 16
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]
#: Words whose digests a worker remembers.
_REMEMBERED = 1 << 17


class Shingler:
    """Distinct hashed shingles of texts, ascending, as unsigned 64-bit integers."""

    def __init__(self):
        self.words: dict[bytes, int] = {}

    def hashed(self, words: list[bytes]) -> np.ndarray:
        known = self.words
        if len(known) > _REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # bytes: lower-cases A-Z only and splits at the six ASCII spaces only
        if not words:
            return np.empty(0, np.uint64)
        h = self.hashed(words)
        n = max(1, len(h) - WORDS + 1)
        out = np.full(n, len(words) if len(words) < WORDS else WORDS, np.uint64)
        for j in range(min(WORDS, len(h))):
            out = (out ^ h[j : j + n]) * _MULTIPLIERS[j]
            out ^= out >> np.uint64(31)
        out = out * _MULTIPLIERS[0]
        return np.unique(out ^ out >> np.uint64(29))


def parity(hashes: np.ndarray) -> np.ndarray:
    bits = np.bincount((hashes >> np.uint64(7)).astype(np.int64) & (64 * PARITY - 1), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def _asked(n: Column, k: int, shared: int, share: Column) -> Column:
    """Values that two linked classes share at least: `share` of n where both sketches are whole sets, else `shared`."""
    return F.when(n * DEN <= k * NUM, F.ceil(n * share).cast("int")).otherwise(F.lit(shared))


def _frequent(values: DataFrame) -> DataFrame:
    """(value, df) of the values in two classes or more; counts are added before the shuffle."""
    return values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, digest of the set, sketch: its K1 least hashes as signed longs) of each row."""
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64())]

    # Over record batches, so that a task holds the texts of a slice as objects, and no others.
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in slices(batches):
            rows = []
            for text in batch["text"].to_pylist():
                s = shingles(text)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), s[:K1].view(np.int64)))
            made = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, kinds)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *made], ["doc_id", "n", "digest", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(sketch, "doc_id long, n long, digest binary, sketch array<long>")


def survivors(classes: DataFrame) -> DataFrame:
    """Ids of the classes that share enough of their K1 values with others."""
    values = classes.select("id", "n", F.explode("sketch").alias("value"))
    common = values.join(_frequent(values), "value").groupBy("id").agg(F.first("n").alias("n"), F.count("*").alias("c"))
    return common.where(F.col("c") >= _asked(F.col("n"), K1, SHARED1, F.lit(NUM) / DEN)).select("id")


def postings(full: DataFrame) -> DataFrame:
    """(value, id, n, parity, near): each class in the lists of its rarest values.

    `near` marks the shorter prefix, which is enough for the smaller of two classes; ties in size go by id.
    """
    values = full.select("id", F.explode("sketch").alias("value"))
    known = values.join(_frequent(values), "value").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
    rows = full.join(known, "id")
    size = F.size("sketch")
    unique = size - F.size("shared")
    asked = _asked(F.col("n"), K2, SHARED2, F.lit(NUM) / DEN)
    # The smaller of two linked classes shares 2 NUM/(NUM+DEN) of its set or more.
    both = _asked(F.col("n"), K2, SHARED2, F.lit(2 * NUM) / (NUM + DEN))
    prefix, short = size - asked + 1 - unique, size - both + 1 - unique
    rows = rows.where(prefix > 0).select("id", "n", "parity", short.alias("short"), F.posexplode(F.slice("shared", 1, F.greatest(prefix, F.lit(0)))).alias("place", "s"))
    return rows.select("id", "n", "parity", (F.col("place") < F.col("short")).alias("near"), F.col("s.value").alias("value"))


def _close(a: str, b: str) -> Column:
    """Whether the sizes and parity bits of a and b leave room for similarity: exact, no linked pair fails."""
    n = lambda x: F.col(f"{x}.n")
    sizes = (DEN * F.least(n(a), n(b)) >= NUM * F.greatest(n(a), n(b)))
    differ = sum((F.bit_count(F.col(f"{a}.parity")[i].bitwiseXOR(F.col(f"{b}.parity")[i])) for i in range(PARITY)), F.lit(0))
    return sizes & (differ * (NUM + DEN) <= (DEN - NUM) * (n(a) + n(b)))


def confirmed(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar; the estimate by the union's sketch spares most of the others."""
    mine = full.select("id", "hashes")
    joined = pairs.join(mine.withColumnsRenamed({"id": "a", "hashes": "x"}), "a").join(mine.withColumnsRenamed({"id": "b", "hashes": "y"}), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, y = batch["x"], batch["y"]
            keep = [similar(x[i].values.to_numpy().view(np.uint64), y[i].values.to_numpy().view(np.uint64)) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    k = 64
    if min(len(x), len(y)) > 4 * k:
        least = np.unique(np.concatenate((x[:k], y[:k])))[:k]
        both = np.isin(least, x[:k], assume_unique=True) & np.isin(least, y[:k], assume_unique=True)
        if both.sum() < k * NUM / DEN - 7 * (k * NUM * (DEN - NUM)) ** 0.5 / DEN:  # seven standard deviations
            return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * shared >= NUM * (len(x) + len(y) - shared)


def whole_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, n, sketch of K2, parity, hashes) of the surviving classes, from one text of each."""
    stay = classes.join(survivors(classes), "id").select("id", F.col("least").alias("doc_id"), "digest")
    kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]

    # An Arrow function, as Spark would compute a column's function for all documents, before the join.
    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in slices(batches):
            rows = []
            for id, text, digest in zip(*(batch[c].to_pylist() for c in ("id", "text", "digest"))):
                s = shingles(text)
                if xxhash.xxh3_128_digest(s.tobytes()) == digest:  # else another text of the same id
                    rows.append((id, len(s), s[:K2].view(np.int64), parity(s), s.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["id", "n", "sketch", "parity", "hashes"])

    again = docs.join(stay, "doc_id").select("id", "text", "digest")
    return again.mapInArrow(hash_all, "id long, n long, sketch array<long>, parity array<long>, hashes array<long>").dropDuplicates(["id"])


def starred(lists: DataFrame, full: DataFrame, turn: int) -> DataFrame:
    """Confirmed links between each list's hub and its other classes, where their components differ.

    The hub is drawn by the digest of value, id and turn, so that a class meets other hubs in other lists: a class that
    links with a part of a group is almost sure to meet one of that part. Pairs are as many as list entries at most.
    """
    drawn = F.xxhash64("value", "id", F.lit(turn))
    hub = lists.groupBy("value").agg(F.min(F.struct(drawn.alias("h"), "id", "n", "parity", "component")).alias("hub"), F.count("*").alias("c")).where("c > 1").select("value", "hub.*")
    other = (F.col("x.value") == F.col("y.value")) & (F.col("x.component") != F.col("y.component"))
    met = lists.alias("x").join(hub.alias("y"), other & _close("x", "y"))
    return confirmed(met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), full)


def mixed(lists: DataFrame, united: DataFrame) -> DataFrame:
    """Lists with their classes' components and in how many cells they are cut, without those whose classes are all in one
    component, which have nothing more to say."""
    known = lists.drop("component", "cells").join(united, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_values = known.groupBy("value").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / CELL).alias("cells"))
    return known.join(open_values.where("low < high").select("value", "cells"), "value")


def linked_classes(docs: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of the classes that link with another class."""
    full = scratch.written(whole_sets(docs, classes), "sets")
    lists = scratch.written(postings(full).withColumn("component", F.col("id")), "postings")
    links = None
    for turn in range(STARS):
        found = scratch.written(starred(lists, full, turn), f"links{turn}")
        links = found if links is None else links.unionAll(found)
        lists = scratch.written(mixed(lists, components(links, scratch, f"united{turn}-")), f"mixed{turn}")
        scratch.drop(f"mixed{turn - 1}" if turn else "postings")
    a = lists.where("near").withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells"))).alias("a")
    b = lists.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))).alias("b")
    smaller = F.struct("a.n", "a.id") < F.struct("b.n", "b.id")
    met = a.join(b, (F.col("a.value") == F.col("b.value")) & (F.col("a.cell") == F.col("b.cell")) & smaller & (F.col("a.component") != F.col("b.component")) & _close("a", "b"))
    rest = confirmed(met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct(), full)
    return components(links.unionAll(rest), scratch)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id it reaches), kept (doc_id is component_id)."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    # The result reads the sketches and the classes' components; all other tables go.
    kept, scratch = Scratch(docs.sparkSession, "near_duplicates"), Scratch(docs.sparkSession, "near_duplicates_work")
    made = kept.written(sets(rows), "sketches")
    members = made.where("n > 0 AND doc_id IS NOT NULL")
    classes = members.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch.written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    united = classes.select("id", "digest", "least").join(linked_classes(rows, classes, scratch), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = united.groupBy("component").agg(F.min("least").alias("component_id"))
    per_class = kept.written(united.join(least, "component").select("digest", "component_id"), "components")
    scratch.clear()
    out = made.select("doc_id", "n", "digest").join(per_class, "digest", "left")
    # Empty sets link with nothing.
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
