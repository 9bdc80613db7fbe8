"""Exact top-k inner-product search by distributed histogram selection.

Queries and candidates are cut into blocks, and every block of queries meets every block of candidates: all pairs are
scored, none is skipped. No score leaves its block at first. Each pass counts, for every query, how many scores lie in
each bin of the interval that holds its k-th best; Spark adds the counts over all blocks, and the interval narrows to
the bin where the k-th lies, until it is one value. The last pass sends the scores above that value and the smallest
ids at it, and a window ranks them.

A block holds BLOCK_BYTES of vectors on either side, so that a vector travels once for as many others as a task can
hold: for n vectors of b bytes that is n * n * b / BLOCK_BYTES over 20 for each pass, the least that blocks allow.

Defined cases: rows whose vector is null, or holds a null, a NaN or an infinity, or whose id is null, take no part; a
vector that is shorter than another counts as ended with zeros; rows that repeat an id or a whole row are each candidates
and queries, and only a query's own row is no candidate for it; fewer than k candidates give all of them; ties go to the smaller id; components and scores beyond a long's range count as its ends,
all others are exact; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import Scratch

#: Bytes of vectors on either side of a block, and queries and candidates whose scores are held at a time.
BLOCK_BYTES = 8 << 20
QUERIES, CANDIDATES = 1024, 4096
BINS = 4096
#: Scores lie between -MOST and MOST; the query's own row scores _OWN.
MOST = (1 << 63) - 2
_OWN = np.iinfo(np.int64).min
_LIMB = 21


def sound(vectors: DataFrame, key: str, embedding: str, scale: int) -> DataFrame:
    """vec_id, v (whole numbers) of the rows that take part."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & e.isNotNull() & finite)
    # From 2^62 on the floor of a double may not fit a long; it counts as the long's end.
    whole = lambda x: F.when(F.abs(x) < 2.0**62, F.floor(x)).when(x > 0, F.lit(MOST)).otherwise(F.lit(-MOST))
    return rows.select(F.col(key).cast("long").alias("vec_id"), F.transform(e, lambda x: whole(x.cast("double") * scale)).alias("v"))


def in_blocks(rows: DataFrame, block: str, n: int) -> DataFrame:
    return rows.withColumn(block, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))


def matrix(t: pa.Table) -> np.ndarray:
    """A row for each vector, with zeros at the end of shorter ones."""
    v = t["v"].combine_chunks()
    size = v.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), size.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, exact; beyond MOST they are MOST."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * d
    if bound < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)  # exact: every partial sum fits a double
    if bound <= MOST:
        return a @ b.T
    # Three limbs of 21 bits; products of limbs, summed, fit a double.
    mask = (1 << _LIMB) - 1
    limbs = [[(x >> i * _LIMB & mask if i < 2 else x >> 2 * _LIMB).astype(float) for i in range(3)] for x in (a, b)]
    sums = [sum(limbs[0][i] @ limbs[1][k - i].T for i in range(max(0, k - 2), min(k, 2) + 1)) for k in range(5)]
    out, carry = np.zeros(sums[0].shape, np.int64), np.zeros(sums[0].shape, np.int64)
    for k in range(3):
        now = sums[k].astype(np.int64) + carry
        out |= (now & mask) << k * _LIMB
        carry = now >> _LIMB
    # What lies above bit 63: 0 or, for negative numbers, -1 where the sum fits a long.
    above = sums[4] * 2.0**_LIMB + (sums[3] + carry)
    out = np.where(above == -1, out | np.int64(_OWN), out)
    return np.clip(np.where(above > 0, MOST, np.where(above < -1, -MOST, out)), -MOST, MOST)


def tiles(queries: pa.Table, candidates: pa.Table):
    """(query places, candidate ids ascending, scores) of a block, as many at a time as QUERIES and CANDIDATES say."""
    candidates = candidates.sort_by("vec_id")
    own, others, ids = queries["row"].to_numpy(), candidates["row"].to_numpy(), candidates["vec_id"].to_numpy()
    parts = [(c, matrix(candidates.slice(c, CANDIDATES))) for c in range(0, len(ids), CANDIDATES)]
    for q in range(0, len(own), QUERIES):
        a, places = matrix(queries.slice(q, QUERIES)), np.arange(q, min(q + QUERIES, len(own)))
        for c, b in parts:
            s = products(a, b)
            s[own[places][:, None] == others[c : c + CANDIDATES][None, :]] = _OWN
            yield places, ids[c : c + CANDIDATES], s


def counted(k: int, span: int, width: int):
    """Counts by query and bin, of `width` each, of a block's scores in the `span` from `low` on. Below a tile's own k-th best none can be the k-th of all."""

    def count(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        lows, row, found = queries["low"].to_numpy(), queries["row"].to_numpy(), [(np.zeros(0, np.int64),) * 2]
        for places, _, s in tiles(queries, candidates):
            low = lows[places][:, None]
            least = np.partition(s, -k, axis=1)[:, -k, None] if s.shape[1] > k else np.full((len(s), 1), _OWN)
            # Differences are taken unsigned, as they may exceed a long.
            over = s.astype(np.uint64) - low.astype(np.uint64)
            q, c = np.nonzero((s >= np.maximum(least, low)) & (over < np.uint64(span)) & (s != _OWN))
            found.append(np.unique(places[q] * BINS + (over[q, c] // np.uint64(width)).astype(np.int64), return_counts=True))
        keys, n = (np.concatenate(x) for x in zip(*found))
        return pa.table([pa.array(row[keys // BINS]), pa.array(keys % BINS, pa.int32()), pa.array(n)], ["row", "bin", "n"])

    return count


def chosen(queries: pa.Table, candidates: pa.Table) -> pa.Table:
    """Scores above each query's k-th best, and of those equal to it the smallest ids, as many as are wanted."""
    lows, needs, found = queries["low"].to_numpy(), queries["need"].to_numpy(), [(np.zeros(0, np.int64),) * 4]
    rows, own = queries["row"].to_numpy(), queries["vec_id"].to_numpy()
    for places, ids, s in tiles(queries, candidates):
        low, need = lows[places][:, None], needs[places][:, None]
        equal = (s == low) & (s != _OWN)
        q, c = np.nonzero(((s > low) | equal & (np.cumsum(equal, axis=1) <= need)) & (s != _OWN))
        found.append((rows[places[q]], own[places[q]], ids[c], s[q, c]))
    return pa.table([pa.array(np.concatenate(x)) for x in zip(*found)], ["row", "query_id", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best among all other rows; `is_query` is over vec_id."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "top_k")
    rows = scratch.written(sound(vectors, key, embedding, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = rows.where(is_query)
    top = rows.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("m"), F.max(F.size("v")).alias("d"), F.count("*").alias("n")).first()
    bound = min((top["d"] or 0) * (top["m"] or 0) ** 2, MOST)
    # Blocks of the size a task can hold, or smaller ones where there would be fewer tasks than the cluster runs at a time.
    size = max(1, BLOCK_BYTES // (8 * (top["d"] or 1)))
    n_queries = max(1, -(-queries.count() // size))
    n_candidates = max(1, -(-top["n"] // size), min(2 * spark.sparkContext.defaultParallelism // n_queries, -(-top["n"] // CANDIDATES)))
    queries = in_blocks(queries, "q_block", n_queries)
    sent = in_blocks(rows, "c_block", n_candidates).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))).select("q_block", "c_block", "row", "vec_id", "v")

    def met(queries: DataFrame, by, schema: str) -> DataFrame:
        left = queries.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))))
        return left.groupBy("q_block", "c_block").cogroup(sent.groupBy("q_block", "c_block")).applyInArrow(by, schema)

    span, turn = 2 * bound + 1, 0
    state = queries.withColumns({"low": F.lit(-bound).cast("long"), "need": F.lit(k)})
    while True:
        width = -(-span // BINS)
        found = met(state, counted(k, span, width), "row long, bin int, n long").groupBy("row", "bin").agg(F.sum("n").alias("n"))
        falling = Window.partitionBy("row").orderBy(F.desc("bin"))
        summed = found.withColumn("upto", F.sum("n").over(falling))
        # The bin of the k-th best; with fewer candidates, the lowest bin that has any.
        at = summed.join(state.select("row", "need"), "row").groupBy("row").agg(F.coalesce(F.max(F.when(F.col("upto") >= F.col("need"), F.struct("bin", (F.col("upto") - F.col("n")).alias("above")))), F.min(F.struct("bin", (F.col("upto") - F.col("n")).alias("above")))).alias("at"))
        moved = state.join(at, "row", "left").withColumns({"low": (F.col("low").cast("decimal(38,0)") + F.coalesce(F.col("at.bin"), F.lit(0)) * F.lit(width).cast("decimal(20,0)")).cast("long"), "need": (F.col("need") - F.coalesce(F.col("at.above"), F.lit(0))).cast("int")}).drop("at")
        state, turn = scratch.written(moved, f"thresholds{turn}"), turn + 1
        if turn > 1:
            scratch.drop(f"thresholds{turn - 2}")
        if width == 1:
            break
        span = width
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = met(state, chosen, "row long, query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
