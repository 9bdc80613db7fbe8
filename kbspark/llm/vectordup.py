"""Near-duplicate vectors by counted collisions of one-dimensional projections.

Equal vectors form a class at once. Each class is projected on many drawn directions; every direction is a sorted list,
of which the two ends are kept: the classes whose projection lies beyond TAIL deviations, where a query's window holds few
others. Two classes collide in a list if both lie in the same end and within WINDOW of each other. A pair that collides
in at least `count` lists is a candidate, and is verified by its cosine in double precision.

As directions are normal and vectors have length 1, the collisions of a pair of cosine LEAST are binomial whatever the data:
`calibrated` chooses so many directions that their mean is MEAN, and the largest count that RECALL of such pairs reach;
pairs that are closer collide more often. Ends hold about sqrt(n) of n classes, so that work grows with the power 1.5.

A list's rows carry their vector and all their collisions' places, so that a pair is counted and verified where it meets,
and only in the first list in which it collides. No pair leaves its task: tasks give the number of links for each class
and a spanning forest of the links between its classes. A list of more than CELL rows, as those of a large group of near
copies, is cut into cells, and each two cells meet in a task of their own.

Defined cases: vectors that are null, empty, zero or hold a null, a NaN or an infinity link with nothing and are kept; so
do rows with a null id, which have no component (null); shorter vectors end in zeros; rows that repeat an id or a vector
count each, as links of one another if their cosine says so; components are named by their least id, so ties don't matter;
an empty table gives an empty table; columns other than key and embedding don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, exp, log, pi, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import Scratch
from kbspark.llm.components import components

LEAST = 0.95
#: Collisions that a pair of cosine LEAST has on average, and the share of such pairs that must pass the count.
MEAN, RECALL = 7.0, 0.99
#: Half of a window, in deviations of the projections: 2.4 times the deviation of the difference of a pair of cosine LEAST.
WINDOW = 0.75
#: Rows of a list that meet in one task.
CELL = 1024
SEED = 20240229
#: Directions that are drawn and multiplied at a time.
_DRAWN = 1024
_SMALL = 32


class Plan(NamedTuple):
    tail: float
    directions: int
    count: int


def _upper(z: float) -> float:
    return 0.5 * (1 - erf(z / sqrt(2)))


def collides(tail: float, cosine: float, window: float = WINDOW) -> float:
    """The probability that two unit vectors of a cosine collide in a drawn direction."""
    rest = sqrt(1 - cosine * cosine)
    cdf = lambda x, z: 0.5 * (1 + erf((x - cosine * z) / rest / sqrt(2)))
    step, total = 0.01, 0.0
    for i in range(600):
        z = tail + (i + 0.5) * step
        total += exp(-z * z / 2) / sqrt(2 * pi) * step * max(0.0, cdf(z + window, z) - cdf(max(tail, z - window), z))
    return 2 * total


def calibrated(n: int) -> Plan:
    """Tail, number of directions and count for n classes."""
    share, low, high = 0.8 / sqrt(max(n, 256)), 0.0, 8.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _upper(middle) > share else (low, middle)
    p = collides(low, LEAST)
    directions = ceil(MEAN / p)
    # Binomial probabilities of fewer collisions than count, by their logarithms' recursion.
    count, below, term = 0, 0.0, exp(directions * log(1 - p))
    while below + term <= 1 - RECALL:
        below += term
        term *= (directions - count) / (count + 1) * p / (1 - p)
        count += 1
    return Plan(low, directions, max(1, count))


def matrix(v: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of length 1 in double precision, ended with zeros."""
    size = v.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(axis=1, initial=0, keepdims=True)  # so that squares neither overflow nor vanish
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def read(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """(vec_id, digest, v): the digest is null where a vector links with nothing."""
    kind = "double" if dict(vectors.dtypes)[embedding] == "array<double>" else "float"
    e = F.col(embedding)
    value = lambda x: x.cast("double")
    sound = F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf"))) & F.exists("v", lambda x: value(x) != 0)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), e.cast(f"array<{kind}>").alias("v"))
    rows = rows.select("vec_id", F.when(F.coalesce(sound, F.lit(False)), F.col("v")).alias("v"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b["v"]
            flat, ends = v.values.to_numpy(zero_copy_only=False) + 0.0, v.offsets.to_numpy()  # -0 becomes 0
            known = v.is_valid().to_numpy(zero_copy_only=False)
            made = [xxhash.xxh3_128_digest(np.trim_zeros(flat[ends[i] : ends[i + 1]], "b").tobytes()) if known[i] else None for i in range(len(v))]
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(made, pa.binary()), v], ["vec_id", "digest", "v"])

    return rows.mapInArrow(digest, f"vec_id long, digest binary, v array<{kind}>")


def placed(classes: DataFrame, plan: Plan, width: int) -> DataFrame:
    """`classes` with the lists that each is in, ascending, and its places there; without those in fewer than count lists."""
    tail, directions, count = plan

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["v"], width).astype(np.float32)
            found = []
            for first in range(0, directions, _DRAWN):
                drawn = np.random.default_rng((SEED, first)).standard_normal((width, min(_DRAWN, directions - first)), np.float32)
                p = x @ drawn
                row, column = np.nonzero(np.abs(p) >= tail)
                value = p[row, column]
                found.append((row, 2 * (first + column) + (value < 0), np.abs(value)))
            row, lists, places = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((lists, row))
            ends = np.searchsorted(row[order], np.arange(len(x) + 1)).astype(np.int32)
            columns = [pa.ListArray.from_arrays(ends, pa.array(c[order].astype(t))) for c, t in ((lists, np.int32), (places, np.float32))]
            made = pa.RecordBatch.from_arrays([b["id"], b["n"], b["v"], *columns], ["id", "n", "v", "lists", "places"])
            yield made.filter(pa.array(np.diff(ends) >= count))

    kind = dict(classes.dtypes)["v"]
    return classes.select("id", "n", "v").mapInArrow(project, f"id long, n long, v {kind}, lists array<int>, places array<float>")


def counted(at: np.ndarray, lists: np.ndarray, places: np.ndarray, size: int, here: int) -> tuple[np.ndarray, np.ndarray]:
    """Collisions of each two of `size` rows, and whether any is in a list before `here`; by entries (row, list, place)."""
    n, early = np.zeros((size, size), np.int16), np.zeros((size, size), bool)
    order = np.argsort(lists, kind="stable")
    at, lists, places = at[order], lists[order], places[order]
    starts = np.flatnonzero(np.diff(lists, prepend=-1))
    lengths = np.diff(starts, append=len(lists))
    for s, k in zip(starts[lengths > _SMALL], lengths[lengths > _SMALL]):
        rows, p = at[s : s + k], places[s : s + k]
        hit = np.abs(p[:, None] - p[None, :]) <= WINDOW
        n[np.ix_(rows, rows)] += hit
        if lists[s] < here:
            early[np.ix_(rows, rows)] |= hit
    short = np.repeat(lengths <= _SMALL, lengths)
    end = np.repeat(starts + lengths, lengths)
    partners = np.where(short, end - np.arange(len(lists)) - 1, 0)
    i = np.repeat(np.arange(len(lists)), partners)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(partners) - partners, partners)
    hit = np.abs(places[i] - places[j]) <= WINDOW
    i, j = i[hit], j[hit]
    for a, b in ((at[i], at[j]), (at[j], at[i])):
        np.add.at(n, (a, b), 1)
        early[a[lists[i] < here], b[lists[i] < here]] = True
    return n, early


def verified(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j of x have the cosine asked for."""
    if len(i) * 8 > len(x) ** 2:
        return (x @ x.T)[i, j] >= LEAST
    out = np.empty(len(i), bool)
    for k in range(0, len(i), 1 << 15):
        part = slice(k, k + (1 << 15))
        out[part] = np.einsum("ij,ij->i", x[i[part]], x[j[part]]) >= LEAST
    return out


def linked(rows: pa.Table, width: int, count: int) -> pa.RecordBatch:
    """(id, to, links) of a list's rows, or two cells' of it: links of each row, and a class that it is connected with."""
    here, crossed = rows["list"][0].as_py(), rows["low"][0].as_py() != rows["high"][0].as_py()
    ids, n, cell = (rows[c].to_numpy() for c in ("id", "n", "cell"))
    lists, places = (rows[c].combine_chunks() for c in ("lists", "places"))
    at = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
    flat, place = lists.flatten().to_numpy(), places.flatten().to_numpy()
    collisions, early = counted(at, flat, place, len(ids), here)
    own = np.zeros(len(ids), place.dtype)
    own[at[flat == here]] = place[flat == here]
    met = (collisions >= count) & ~early & (np.abs(own[:, None] - own[None, :]) <= WINDOW)
    if crossed:
        met &= cell[:, None] != cell[None, :]
    i, j = np.nonzero(np.triu(met, 1))
    if len(i):
        good = verified(matrix(rows["v"].combine_chunks(), width), i, j)
        i, j = i[good], j[good]
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, i, n[j])
    np.add.at(links, j, n[i])
    least, before = np.arange(len(ids)), None
    while before is None or (least != before).any():
        before = least.copy()
        low = np.minimum(least[i], least[j])
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        least = least[least]
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (ids, ids[least], links)], ["id", "to", "links"])


def runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of rows with equal `by` columns of batches that are sorted by them."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b[c].to_numpy() for c in by], axis=1)
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)]
        for s, e in zip(starts, [*starts[1:], b.num_rows]):
            if held and tuple(keys[s]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = tuple(keys[s])
    if held:
        yield pa.Table.from_batches(held)


def meetings(members: DataFrame) -> DataFrame:
    """A row of a member for each list that it is in, and for each two cells of a long list that its own cell is one of."""
    sizes = members.select(F.explode("lists").alias("list")).groupBy("list").count().where(F.col("count") > CELL)
    # As many rows as there are lists at most, which is some sqrt(n).
    long = F.broadcast(sizes.select("list", F.ceil(F.col("count") / CELL).cast("int").alias("cells")))
    rows = members.withColumn("list", F.explode("lists")).join(long, "list", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    return rows.select("list", F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high"), "cell", "id", "n", "v", "lists", "places")


def links(members: DataFrame, width: int, count: int) -> DataFrame:
    """(id, to, links) from every list: `links` add up to a class's links with rows of others."""
    key = ("list", "low", "high")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, key):
            if len(rows) > 1:
                yield linked(rows, width, count)

    met = meetings(members).repartition(*key).sortWithinPartitions(*key)
    return met.mapInArrow(meet, "id long, to long, links long")


def groups(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id (least id it reaches), kept (vec_id is component_id)."""
    spark = vectors.sparkSession
    # The result reads the rows and the classes' components; all other tables go.
    kept, scratch = Scratch(spark, "near_vectors"), Scratch(spark, "near_vectors_work")
    rows = scratch.written(read(vectors, key, embedding), "rows")
    made = kept.written(rows.select("vec_id", "digest"), "rows")
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = scratch.written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    scratch.drop("rows")
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    plan, width = calibrated(size["n"]), size["width"] or 1
    members = scratch.written(placed(classes, plan, width), "members")
    found = scratch.written(links(members, width, plan.count), "found")
    united = components(found.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")).distinct(), scratch)
    total = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("id", "digest", "least", "n").join(united, "id", "left").join(total, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    per_class = known.join(least, "component").select("digest", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    per_class = kept.written(per_class, "components")
    scratch.clear()
    out = made.join(per_class, "digest", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
