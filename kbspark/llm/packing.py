"""Sequence packing along a space-filling curve.

A document's vector counts its hashed byte 4-grams. A fixed random projection brings it to three dimensions, whose
cells are numbered along a Hilbert curve. The curve is cut into stretches of equal text, one a partition; documents are
sorted along it and each partition is cut into sequences: neighbours in a sequence resemble each other. Documents may be
cut anywhere, so every sequence but those at a partition's end is full; what is left at the end is cut into powers of
two, which need no padding.

Defined cases: a null text counts as empty; an empty text is packed as its end token alone; repeated rows are packed
each for itself; a null key sorts first; documents at one point of the curve go by key, then text; other columns don't
matter; an empty table gives no pieces. A very long text is one value of a task, which holds its ids as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import slices, text_or_empty

DIMENSIONS, BITS, FEATURES = 3, 10, 256
#: Bits of a curve position that are counted; their counts, 24 bytes for each of 2 ** CELL_BITS cells at most, are broadcast.
CELL_BITS = 16
#: Bytes of text that a partition should hold, and the least where there would be fewer partitions than tasks at a time.
#: Beyond MOST_PARTITIONS partitions grow instead; a task streams its partition, so only its sort grows with it.
PARTITION_BYTES, LEAST_BYTES, MOST_PARTITIONS = 32 << 20, 1 << 20, 200_000


def projection() -> np.ndarray:
    return np.random.default_rng(20240101).standard_normal((FEATURES, DIMENSIONS))


def projected(text: str, matrix: np.ndarray) -> np.ndarray:
    """The text's hashed 4-gram counts, of unit length, projected; zeros for texts under four bytes."""
    b = np.frombuffer(text.encode(), np.uint8)
    if len(b) < 4:
        return np.zeros(DIMENSIONS)
    h = np.ascontiguousarray(b[:-3]).astype(np.uint32)
    for k in range(1, 4):
        h = h << np.uint32(8) | b[k : len(b) - 3 + k]
    h *= np.uint32(2654435761)
    counts = np.bincount(h >> np.uint32(24), minlength=FEATURES).astype(float)
    return counts @ matrix / np.linalg.norm(counts)


def cells(points: np.ndarray) -> np.ndarray:
    """Each coordinate as an integer of BITS bits; its scale is fixed, as that of a unit vector's projection."""
    return np.clip((np.tanh(points / 1.5) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert(coordinates: np.ndarray) -> np.ndarray:
    """Position on the Hilbert curve of each row of integer coordinates (Skilling's transform, 2004)."""
    x = coordinates.T.copy()
    q = 1 << (BITS - 1)
    while q > 1:
        for i in range(DIMENSIONS):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, DIMENSIONS):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (BITS - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(BITS - 1, -1, -1):
        for i in range(DIMENSIONS):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def curve_key(text: Column) -> Column:
    @F.pandas_udf("long")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matrix = projection()
        for texts in slices(batches):
            points = np.array([projected(t, matrix) for t in texts]).reshape(-1, DIMENSIONS)
            yield pd.Series(hilbert(cells(points)))

    return keys(text)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A function from text to ids as the tokenizers library gives them for the byte-level BPE file at `path`.

    The file's vocabulary and merges are handed to tiktoken, which gives the same ids several times faster; texts that
    its splitter can't handle (runs of millions of spaces) go to the tokenizers library itself.
    """
    import json

    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    library: list[Tokenizer] = []  # loaded where a text needs it only, as it takes much memory

    def plain(text: str) -> np.ndarray:
        if not library:
            library.append(Tokenizer.from_file(path))
        return np.array(library[0].encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    if file["pre_tokenizer"]["type"] != "ByteLevel" or file["normalizer"] or file["post_processor"]:
        return plain
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = {bytes(map(letters.__getitem__, t)): i for t, i in file["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    endless = re.compile(r"\s{20000}")

    def ids(text: str) -> np.ndarray:
        if len(text) >= 20000 and endless.search(text):
            return plain(text)
        return fast.encode_to_numpy(text, allowed_special="all")

    return ids


def stretches(docs: DataFrame) -> tuple[DataFrame, int]:
    """`docs` with `part`, the stretch of the curve that a row belongs to, and how many there are.

    Stretches hold equal numbers of bytes. A cell that holds more than its share, as with many copies of a text, is split
    between stretches by digest.
    """
    spark = docs.sparkSession
    size = F.octet_length("text").cast("long") + 4
    cell = F.shiftright("curve", DIMENSIONS * BITS - CELL_BITS)
    counts = docs.groupBy(cell.alias("cell")).agg(F.sum(size).alias("bytes")).collect()  # CELL_BITS bound them
    at, held = (np.array([r[k] for r in sorted(counts)], np.int64) for k in ("cell", "bytes"))
    total = int(held.sum())
    n = max(1, min(-(-total // PARTITION_BYTES), MOST_PARTITIONS), min(2 * spark.sparkContext.defaultParallelism, total // LEAST_BYTES))
    # An Arrow table reaches Spark as it is; rows would start a second set of Python workers in every executor.
    cells = F.broadcast(spark.createDataFrame(pa.table({"cell": at, "before": np.cumsum(held) - held, "bytes": held})))
    share = F.pmod(F.xxhash64("doc_id", "tie"), F.lit(1 << 20)) / (1 << 20)
    part = F.floor((F.col("before") + share * F.col("bytes")) * n / max(1, total)).cast("int")
    # Every cell is there. An outer join, as for an inner one Spark would compute the position once more to test it for null.
    return docs.withColumn("cell", cell.cast("long")).join(cells, "cell", "left").withColumn("part", F.least(part, F.lit(n - 1))), n


def pack(df: DataFrame, path: str, end_id: int, length: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    One shuffle, by stretch of the curve (texts move, tokens are made after it). Positions are computed once to count the
    bytes along the curve and once more on the way to the shuffle, which is less work than to write the texts with them.
    A task holds one batch and one open sequence.
    """
    docs = df.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    docs = docs.withColumn("curve", curve_key(F.col("text"))).withColumn("tie", F.xxhash64("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        sequence = TaskContext.get().partitionId() << 32
        pieces, fill, kind = [], 0, pa.null()
        for batch in slices(batches):
            done: list[tuple] = []
            kind = batch.schema.field("doc_id").type
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = np.append(encode(text), end_id).astype("<u4")
                at = 0
                while at < len(ids):
                    n = min(len(ids) - at, length - fill)
                    pieces.append((doc, at, n, ids[at : at + n].tobytes(), len(ids), sequence, fill))
                    at, fill = at + n, fill + n
                    if fill == length:
                        done += pieces
                        pieces, fill, sequence = [], 0, sequence + 1
            yield piece_batch(done, kind)
        if pieces:
            yield piece_batch(powers_of_two(pieces, fill, sequence), kind)

    kind = dict(df.dtypes)[key]
    dealt, n = stretches(docs)
    placed = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("curve", "doc_id", "tie").select("doc_id", "text")
    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def piece_batch(pieces: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    columns = zip(*pieces) if pieces else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def powers_of_two(pieces: list[tuple], fill: int, sequence: int) -> list[tuple]:
    """The pieces of a sequence of `fill` tokens, cut anew into sequences whose lengths are falling powers of two."""
    out, room, offset = [], 1 << (fill.bit_length() - 1), 0
    for doc, at, n, packed, total, _, _ in pieces:
        taken = 0
        while taken < n:
            m = min(n - taken, room - offset)
            out.append((doc, at + taken, m, packed[4 * taken : 4 * (taken + m)], total, sequence, offset))
            taken, offset, fill = taken + m, offset + m, fill - m
            if offset == room:
                room, offset, sequence = 1 << (fill.bit_length() - 1) if fill else 0, 0, sequence + 1
    return out
