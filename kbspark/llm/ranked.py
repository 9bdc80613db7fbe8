"""Ranked lexical search of many queries at once by common subexpressions.

A document's score for an item is a sum over the item's terms, so items that share terms share parts of their sums. In each
block of items, pairs of terms that occur together in two or more items are mined and replaced by a node of their own, then
pairs of nodes, until none repeats: a sharing DAG whose inner nodes are term sets and whose tops are the items. A document's
accumulators, one for each node, are computed once, leaves first, and every item that shares a set adds up the same one.

The documents are read once for each block: their terms of the block's vocabulary are counted and written as postings, from
which frequencies and lengths are added up, and then the DAG is evaluated over batches of documents, as sums of matrix
rows. A task keeps the best K of each item over its documents; only those are shuffled and ranked. A block holds BLOCK
bytes of items (or one item), which bounds its vocabulary, its DAG and what is broadcast, whatever the tables' sizes.

Defined cases: null and empty texts have no terms; items without terms or without documents give no rows; repeated items
and documents are each one of their own (an item that repeats an id gets ranks of its own); equal scores go by doc_id, null
ids last; an empty table gives an empty result; columns other than id and text don't matter. A very long document is one
value of a task, counted in time in proportion; its postings hold the block's terms only.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import Scratch, slices, text_or_empty

#: Bytes of items' texts in a block.
BLOCK = 1 << 20
#: Bytes of accumulators that a task holds at a time.
HELD = 32 << 20
#: Fixed values of the score.
SCALE, UNIT, K1, SHARE = 1000, 1_000_000_000, 12, 25
#: ASCII letters lower-cased, digits and all bytes beyond ASCII as they are, the rest blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Terms in UTF-8, in the text's order."""
    return text.encode().translate(_BYTES).split()


def shared_sets(items: list[list[int]]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(pairs, items' rests): pair i is node -1 - i, of two terms or earlier nodes; each rest adds up to its item.

    An item is a list of terms with repeats. In every round each item's parts, ordered by how many items hold them, offer
    their neighbours as pairs; pairs that two items or more offer become nodes, the most frequent first. A round takes time
    in proportion to the items, and a pair replaced is a part less in at least two of them, so rounds end.
    """
    # The second occurrence of a term in an item is another part than the first, so that repeats are shared as well.
    leaves: dict[tuple[int, int], int] = {}
    rests = []
    for item in items:
        seen: Counter = Counter()
        parts = []
        for t in item:
            parts.append(leaves.setdefault((t, seen[t]), len(leaves)))
            seen[t] += 1
        rests.append(parts)
    term_of = [t for t, _ in leaves]
    made: list[tuple[int, int]] = []
    while True:
        df = Counter(p for parts in rests for p in parts)
        for parts in rests:
            parts.sort(key=lambda p: (-df[p], p))
        offered = Counter(q for parts in rests for q in zip(parts, parts[1:]))
        if not any(n > 1 for n in offered.values()):
            break
        numbers: dict[tuple[int, int], int] = {}
        chosen = []
        for parts in rests:
            # Pairs of an item may overlap: those that more items offer come first.
            taken, here = set(), {}
            for n, k in sorted(((offered[q], k) for k, q in enumerate(zip(parts, parts[1:])) if offered[q] > 1), key=lambda x: (-x[0], x[1])):
                if k not in taken and k + 1 not in taken:
                    taken |= {k, k + 1}
                    here[k] = (parts[k], parts[k + 1])
            chosen.append(here)
        used = Counter(q for here in chosen for q in here.values())
        changed = False
        for i, here in enumerate(chosen):
            parts, out, k = rests[i], [], 0
            while k < len(parts):
                q = here.get(k)
                if q and used[q] > 1:
                    out.append(numbers.setdefault(q, len(leaves) + len(made) + len(numbers)))
                    changed, k = True, k + 2
                else:
                    out.append(parts[k])
                    k += 1
            rests[i] = out
        made += list(numbers)
        if not changed:
            break
    name = lambda p: term_of[p] if p < len(leaves) else len(leaves) - 1 - p
    return [(name(a), name(b)) for a, b in made], [[name(p) for p in parts] for parts in rests]


class Plan:
    """A block's vocabulary, nodes by level, and items as rows of nodes. Rows of accumulators: terms, then nodes."""

    def __init__(self, rows: list[tuple[int, int | None, list[bytes]]]):
        self.rows = [(row, id) for row, id, _ in rows]
        self.words: dict[bytes, int] = {}
        items = [[self.words.setdefault(t, len(self.words)) for t in text] for _, _, text in rows]
        pairs, rests = shared_sets(items)
        n = len(self.words)
        at = lambda p: p if p >= 0 else n - 1 - p
        depth = np.zeros(n + len(pairs), np.int64)
        for i, (a, b) in enumerate(pairs):
            depth[n + i] = 1 + max(depth[at(a)], depth[at(b)])
        left, right = (np.array([at(p[side]) for p in pairs], np.int64) for side in (0, 1))
        self.size, self.levels = n + len(pairs), []
        for d in range(1, int(depth.max(initial=0)) + 1):
            nodes = np.flatnonzero(depth[n:] == d)
            self.levels.append((n + nodes, left[nodes], right[nodes]))
        self.parts = np.array([at(p) for rest in rests for p in rest], np.int64)
        self.starts = np.cumsum([0, *map(len, rests[:-1])])
        self.sums = len(pairs) + len(self.parts)  # as against the number of all terms

    def scores(self, accumulators: np.ndarray) -> np.ndarray:
        """Items' scores (a row each) from accumulators whose rows of terms are filled in."""
        for nodes, left, right in self.levels:
            accumulators[nodes] = accumulators[left] + accumulators[right]
        return np.add.reduceat(accumulators[self.parts], self.starts, axis=0)


def planned(items: DataFrame, id: str, text: str) -> DataFrame:
    """(plan): a row for each block. Items whose greatest words are the same share a block, as long as it has room."""
    rows = items.select(F.col(id).cast("long").alias("id"), text_or_empty(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    # As many blocks as the items fill; a block doesn't depend on how many partitions there are.
    blocks = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.array_max(F.split("text", " "))), F.lit(blocks)))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        pack = lambda: pa.RecordBatch.from_pydict({"plan": pa.array([pickle.dumps(Plan(held))], pa.binary())})
        for b in batches:
            for block, row, id, text in zip(*(b[c].to_pylist() for c in ("block", "row", "id", "text"))):
                found = terms(text)
                if held and (block != last or size + len(text) > BLOCK):
                    yield pack()
                    held, size = [], 0
                last = block
                if found:
                    held.append((row, id, found))
                    size += len(text)
        if held:
            yield pack()

    return dealt.repartition("block").sortWithinPartitions("block", "row").mapInArrow(plan, "plan binary")


def posted(docs: DataFrame, words: dict[bytes, int], id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tf): a document's number of terms and those of `words` with how often each occurs."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = known.value
        for b in slices(batches):
            lengths, ends, ids, tf = [], [0], [], []
            for t in b["text"].to_pylist():
                found = terms(t)
                lengths.append(len(found))
                for w, n in Counter(found).items():
                    if w in vocabulary:
                        ids.append(vocabulary[w])
                        tf.append(n)
                ends.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (ids, tf)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tf array<int>").where("n > 0")


def weight(n: int, df: int) -> int:
    return math.floor(SCALE * math.log((2 * n + 2) / (2 * df + 1)))


def merged(best: tuple[np.ndarray, np.ndarray], score: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of `best` and (score, doc); equal scores by document."""
    score, doc = np.concatenate((best[0], score)), np.concatenate((best[1], doc))
    if len(score) > 4 * k:
        least = np.partition(score, -k)[-k]
        score, doc = score[score >= least], doc[score >= least]
    order = np.lexsort((doc, -score))[:k]
    return score[order], doc[order]


def ranked(postings: DataFrame, plan: Plan, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(row, doc_id, score): every task's k best documents of each item."""
    known = postings.sparkSession.sparkContext.broadcast((plan, weights))
    last = np.iinfo(np.int64).max  # stands for a null id among equal scores

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights = known.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in plan.rows]
        size = max(1, HELD // (8 * (plan.size + len(plan.parts) + len(plan.rows))))
        for batch in batches:
            for s in range(0, batch.num_rows, size):
                b = batch.slice(s, size)
                m = np.array([100 - SHARE + SHARE * n * n_docs // n_terms for n in b["n"].to_pylist()], np.int64)
                column = np.repeat(np.arange(len(m)), b["terms"].value_lengths().to_numpy(zero_copy_only=False))
                term, tf = (b[c].flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
                accumulators = np.zeros((plan.size, len(m)), np.int64)
                accumulators[term, column] = weights[term] * ((UNIT * tf) // (SCALE * tf + K1 * m[column]))
                doc = b["doc_id"].fill_null(last).to_numpy(zero_copy_only=False)
                for i, score in enumerate(plan.scores(accumulators)):
                    low = best[i][0][-1] if len(best[i][0]) == k else 1
                    some = score >= low
                    if some.any():
                        best[i] = merged(best[i], score[some], doc[some], k)
        for (row, _), (score, doc) in zip(plan.rows, best):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), row)), pa.array(doc, mask=doc == last), pa.array(score)], ["row", "doc_id", "score"])

    return postings.mapInArrow(evaluate, "row long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    kept, scratch = Scratch(spark, "ranked"), Scratch(spark, "ranked_work")
    plans = scratch.written(planned(items, item_id, text), "plans")
    found = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    # A block after the other passes through the driver: BLOCK bytes of items bound each.
    for block, held in enumerate(plans.toLocalIterator()):
        plan = pickle.loads(held["plan"])
        postings = scratch.written(posted(docs, plan.words, doc_id, text), f"postings{block}")
        total = postings.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        weights = np.zeros(len(plan.words), np.int64)
        for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[r["term"]] = weight(total["docs"], r["count"])
        ids = spark.createDataFrame(plan.rows, "row long, item_id long")
        best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        tops = ranked(postings, plan, weights, total["docs"], total["terms"], k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found.append(kept.written(tops.join(F.broadcast(ids), "row").select("item_id", "rank", "doc_id", "score"), f"block{block}"))
        scratch.drop(f"postings{block}")
    scratch.clear()
    return reduce(DataFrame.unionAll, found)
