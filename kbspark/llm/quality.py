"""Quality rules: text statistics and a decision list learned from labels, as DataFrame expressions throughout.

`statistics` adds the numbers, `learn` grows and prunes an ordered list of threshold conjunctions by sequential
covering on histograms that Spark aggregates, `verdict` is the list as one conditional expression. There is no Python
function, pandas, Arrow or RDD code on this path.

Defined cases: a null or empty text has no words and fails the base rules; a text without lines that hold a word has no
repeated lines; repeated rows are judged alike; of several labels of a document the least counts; labels that are null
or have no document don't count; without labelled rows the list is empty and the base rules decide alone; of equal gains
the first feature, the least threshold and "at least" win; an empty table gives an empty table; columns of the input are
kept, but for those named like a result, which are replaced. A very long text is one row: its words and the digests of
its windows are held in memory, in proportion to it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import Scratch, let

#: The characters that separate words.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test: whole numbers that don't depend on the text's length.
FEATURES = (
    "symbols_per_1000", "capitals_per_1000", "digits_per_1000", "exclamations_per_1000", "stops_per_1000",
    "word_length_x100", "repeats_per_1000", "dup_lines_per_1000", "words_per_line",
)


def _per(part: Column, whole: Column, times: int = 1000) -> Column:
    return F.when(whole > 0, F.floor(part * times / whole)).otherwise(0).cast("long")


def _count(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def _repeated(words: Column) -> Column:
    """Words that lie in a 3-word window which occurs twice or more.

    Windows are sorted by digest with their positions; those equal to a neighbour repeat. Their sorted positions
    cover three words each, less what the next one covers too.
    """
    n = F.size(words)
    rest = F.greatest(n - 2, F.lit(0))
    windows = F.arrays_zip(F.slice(words, 1, rest).alias("a"), F.slice(words, 2, rest).alias("b"), F.slice(words, 3, rest).alias("c"))
    digests = F.transform(windows, lambda w: F.xxhash64(w["a"], w["b"], w["c"]))

    def covered(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        twice = let(F.sort_array(placed), lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])))
        add = lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(3), i - acc["last"])).alias("sum"), i.alias("last"))
        none = F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last"))
        # A text whose windows are all distinct needs no sort.
        return F.when(F.size(F.array_distinct(h)) < F.size(h), F.aggregate(F.sort_array(F.transform(twice, lambda x: x["i"])), none, add, lambda acc: acc["sum"])).otherwise(0)

    return let(digests, covered)


def measured(df: DataFrame, text: str = "text", *kept: Column) -> DataFrame:
    """The columns of BASE and FEATURES, all long, from each row's whole text, beside the columns `kept`."""
    words = F.filter(F.split("_t", "[ \t\n\x0b\f\r]+"), lambda w: w != "")
    lines = F.filter(F.split("_t", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    # Plain columns, each used more than once below, so that Spark computes them once and doesn't inline them.
    parts = df.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumns({"_q_words": words, "_q_lines": lines})
    t = F.col("_t")
    q_words, q_lines = F.col("_q_words"), F.col("_q_lines")
    counted = {
        "n_words": F.size(q_words),
        "word_chars": F.char_length(F.translate(t, SPACES, "")),
        "n_symbols": _count(t, SYMBOLS),
        "n_dup_lines": F.size(q_lines) - F.size(F.array_distinct(q_lines)),
        "n_repeat_words": let(q_words, _repeated),
        "n_lines": F.size(q_lines),
        "capitals": _count(t, CAPITALS),
        "digits": _count(t, "0123456789"),
        "exclamations": _count(t, "!"),
        "stops": _count(t, "."),
    }
    numbers = parts.withColumns({f"_m_{k}": c.cast("long") for k, c in counted.items()})
    m = {k: F.col(f"_m_{k}") for k in counted}
    chars = m["word_chars"]
    made = {k: m[k] for k in BASE} | {
        "symbols_per_1000": _per(m["n_symbols"], chars),
        "capitals_per_1000": _per(m["capitals"], chars),
        "digits_per_1000": _per(m["digits"], chars),
        "exclamations_per_1000": _per(m["exclamations"], chars),
        "stops_per_1000": _per(m["stops"], m["n_words"]),
        "word_length_x100": _per(chars, m["n_words"], 100),
        "repeats_per_1000": _per(m["n_repeat_words"], m["n_words"]),
        "dup_lines_per_1000": _per(m["n_dup_lines"], m["n_lines"]),
        "words_per_line": _per(m["n_words"], m["n_lines"], 1),
    }
    return numbers.withColumns(made).drop("_t", "_q_words", "_q_lines", *(f"_m_{k}" for k in counted))


def beside(rows: DataFrame, columns: list[str], *results: str) -> DataFrame:
    """The columns of the struct `_row`, but for those named like a result, and the results."""
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in columns if c not in results), *results)


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with the columns of BASE and FEATURES."""
    return beside(measured(df, text, F.struct("*").alias("_row")), df.columns, *BASE, *FEATURES)


def base_failed(least_words: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    at_least: bool
    threshold: int

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.at_least else c < self.threshold


@dataclass(frozen=True)
class Rule:
    """A conjunction that calls a document bad, with how many bad and good rows it met where it was learned."""

    tests: tuple[Test, ...]
    bad: int
    good: int

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (t.column() for t in self.tests))


def learn(labelled: DataFrame, label: str = "quality", max_tests: int = 3, bins: int = 32, purity: float = 0.97, least: int = 5) -> list[Rule]:
    """Sequential covering over rows that have FEATURES and a label (1 good, 0 bad), all of them, none sampled.

    Features are binned once and written, so that the many steps are small queries, for which executors compile and keep
    little code. Each step counts the rows that a rule still covers by (feature, bin, label) in Spark, in one aggregate a
    feature, so that a row stays one: at most len(FEATURES) * (bins + 1) * 2 counts reach the driver. A rule grows by the
    test with the highest weighted gain (FOIL), is pruned by dropping tests that don't lower its purity on the held-out
    third, and is kept if its purity is `purity` or more and it covers `least` bad rows. After one that isn't, the next
    begins with another feature or direction, from counts that are there already; covering ends when all have failed or
    fewer than `least` bad rows are left.
    """
    rows = labelled.where(F.col(label).isin(0, 1)).select((F.col(label) == 0).alias("bad"), (F.pmod(F.xxhash64(*FEATURES, "doc_id"), F.lit(3)) == 0).alias("held"), *FEATURES)
    cuts = rows.agg(*(F.percentile_approx(f, [k / bins for k in range(bins + 1)], 1000).alias(f) for f in FEATURES)).first()
    # Thresholds lie half-way between quantiles, so that rows between those that were seen fall on the nearer side.
    steps = {f: sorted(set(cuts[f] or [])) for f in FEATURES}
    edges = {f: sorted({(a + b + 1) // 2 for a, b in zip(v, v[1:])}) for f, v in steps.items()}
    used = [f for f in FEATURES if edges[f]]
    if not used:
        return []
    scratch = Scratch(labelled.sparkSession, "rules")
    # A value's bin is how many edges it reaches; tests are of bins until the list is done.
    binned = scratch.written(rows.select("bad", "held", *(sum((F.col(f) >= e).cast("int") for e in edges[f]).alias(f) for f in used)), "bins")
    rules: list[Rule] = []
    left, failed, known = binned, set(), {}
    while known or left.agg(F.count_if("bad")).first()[0] >= least:
        grown = _grow(left.where(~F.col("held")), {f: len(edges[f]) for f in used}, max_tests, failed, known)
        if not grown:
            break
        pruned = _prune(grown, left, purity)
        if not pruned or pruned.bad < least:
            failed.add((grown[0].feature, grown[0].at_least))
            continue
        rules.append(pruned)
        left, failed, known = left.where(~pruned.column()), set(), {}
    scratch.clear()
    return [Rule(tuple(Test(t.feature, t.at_least, edges[t.feature][t.threshold - 1]) for t in r.tests), r.bad, r.good) for r in rules]


def _counts(rows: DataFrame, edges: dict[str, int]) -> dict[str, dict[int, tuple[int, int]]]:
    """(bad, good) rows by feature and bin.

    A histogram of more bars than there are bins holds a bar for each: bars of different bins, which lie 1 apart, are only
    joined where there are too many. Those of one bin that come from several tasks may differ by rounding.
    """
    bars = [F.histogram_numeric(F.col(f).cast("double"), F.lit(4 * (n + 1))).alias(f) for f, n in edges.items()]
    found: dict[str, dict[int, tuple[int, int]]] = {}
    for r in rows.groupBy("bad").agg(*bars).collect():
        for f in edges:
            for x, y in r[f]:
                bad, good = found.setdefault(f, {}).get(round(x), (0, 0))
                found[f][round(x)] = (bad + round(y), good) if r.bad else (bad, good + round(y))
    return found


def _grow(rows: DataFrame, edges: dict[str, int], max_tests: int, failed: set[tuple[str, bool]], known: dict[tuple[Test, ...], dict]) -> list[Test]:
    """Tests of bins in the order in which they were added; the first is none of those that have failed before.

    `rows` have the bins of the features in `edges`, which says how many edges each has. `known` keeps the counts of what
    conjunctions of tests cover among them.
    """
    tests: list[Test] = []
    while len(tests) < max_tests:
        covered = tuple(tests)
        if covered not in known:
            known[covered] = _counts(reduce(lambda d, t: d.where(t.column()), tests, rows), edges)
        found = known[covered]
        best, gain = None, 0.0
        for f, by_bin in sorted(found.items()):
            bad, good = (sum(x[k] for x in by_bin.values()) for k in (0, 1))
            if not bad or not good:
                return tests
            for k in range(1, edges[f] + 1):
                above = [sum(x[j] for b, x in by_bin.items() if b >= k) for j in (0, 1)]
                for at_least, (p, n) in ((True, above), (False, (bad - above[0], good - above[1]))):
                    if not tests and (f, at_least) in failed:
                        continue
                    if p and (g := p * (log2(p / (p + n)) - log2(bad / (bad + good)))) > gain + 1e-9:
                        best, gain = Test(f, at_least, k), g
        if not best:
            break
        tests.append(best)
    return tests


def _prune(tests: list[Test], rows: DataFrame, purity: float) -> Rule | None:
    """The shortest prefix of the conjunction that is as pure on held-out rows as asked for, else the purest if it is."""
    columns = []
    for k in range(1, len(tests) + 1):
        met = reduce(lambda a, b: a & b, (t.column() for t in tests[:k]))
        for held in (True, False):
            for bad in (True, False):
                columns.append(F.count_if(met & (F.col("held") == held) & (F.col("bad") == bad)))
    counts = rows.agg(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
    for k in range(1, len(tests) + 1):
        bad_held, good_held, bad, good = counts[4 * k - 4 : 4 * k]
        if bad_held and bad_held >= purity * (bad_held + good_held) and bad >= purity * (bad + good):
            return Rule(tuple(tests[:k]), bad + bad_held, good + good_held)
    return None


def verdict(rules: list[Rule], least_words: int = 50) -> Column:
    """True where a document is kept: the base rules, then the learned ones in their order; the default is to keep."""
    out = F.when(base_failed(least_words), False)
    for r in rules:
        out = out.when(r.column(), False)
    return out.otherwise(True)


def learned(scratch: Scratch, numbers: DataFrame, labels: DataFrame, least_words: int) -> list[Rule]:
    """Rules from the rows with statistics that have a label and pass the base rules. Texts don't meet the labels."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = scratch.written(numbers.where(~base_failed(least_words)).select("doc_id", *FEATURES).join(known, "doc_id"), "labelled")
    rules = learn(labelled)
    scratch.drop("labelled")
    return rules


def trained(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 50) -> tuple[DataFrame, list[Rule]]:
    """(doc_id and the statistics of every document, written; rules learned from those that are labelled).

    The texts are read once and never shuffled; labels meet the statistics.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    numbers = scratch.written(measured(docs, text, F.col(key).alias("doc_id")), "statistics")
    return numbers, learned(scratch, numbers, labels, least_words)


def decided(numbers: DataFrame, rules: list[Rule], least_words: int = 50) -> DataFrame:
    """Rows that have statistics, with base_failed and kept."""
    return numbers.withColumn("base_failed", base_failed(least_words)).withColumn("kept", verdict(rules, least_words))


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 50) -> DataFrame:
    """`docs` with statistics, base_failed and kept, by rules learned from the labelled documents among them.

    Statistics cost far more than to write the rows, so the rows are written with them once, learned from and judged.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.written(measured(docs, text, F.struct("*").alias("_row"), F.col(key).alias("doc_id")), "rows")
    rules = learned(scratch, rows, labels, least_words)
    return beside(decided(rows, rules, least_words), docs.columns, *BASE, *FEATURES, "base_failed", "kept")


def filtered(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 50) -> DataFrame:
    """The rows of `docs` that are kept, without their statistics.

    The statistics are written, not the texts; rows are left out by the keys and text digests of those that aren't kept,
    a table that Spark sends to the tasks where it is small and shuffles where it isn't.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    digest = lambda c: F.xxhash64(F.coalesce(c, F.lit("")))
    numbers = scratch.written(measured(docs, text, F.col(key).alias("doc_id"), digest(F.col(text)).alias("digest")), "statistics")
    rules = learned(scratch, numbers, labels, least_words)
    out = scratch.written(decided(numbers, rules, least_words).where("NOT kept").select("doc_id", "digest").distinct(), "rejected")
    scratch.drop("statistics")
    same = F.col(f"d.{key}").eqNullSafe(F.col("r.doc_id")) & (digest(F.col(f"d.{text}")) == F.col("r.digest"))
    return docs.alias("d").join(out.alias("r"), same, "left_anti")
