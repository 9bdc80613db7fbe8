"""Secret scan with corpus-wide ownership frequency.

Each text is searched for candidates; their digests are then counted over the distinct repositories and owners that
hold them. A candidate that many owners share is a copied example, one that few share and that looks random is live.
Only spans and digests are shuffled, counts are pre-aggregated, and the texts are read once.

Defined cases: a null or empty text has no candidates; a null repository counts as one more, named ''; repeated rows
count once for ownership and are each reported; null keys are kept; an empty table gives an empty table; columns of the
input other than key, text and repository don't matter; spans of one start go by kind, so no ties arise. A very long text is one
value of a task; each pattern passes it once, but for jwt, which passes a run of its characters
up to three times.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import slices, text_or_empty, written


def either_case(words: str) -> str:
    """A pattern that takes ASCII letters in either case and nothing else: (?i) also folds some letters beyond ASCII."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


#: Kind, pattern, group that holds the secret, its least length. The first three are the base kinds, in their order.
KINDS = (
    ("assign", either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),  # the same as [0-9a-f]+ of 32 or more: both take maximal runs
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("private", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 27),
)
BASE = ("assign", "access", "hex")
_R = "[A-Za-z0-9_-]"
#: By kind, a pattern whose group 1 takes the same spans in time in proportion: tried where a run of its characters starts,
#: once what follows the run fits, so that a run is passed three times at most.
_ONCE = {"jwt": rf"(?<!{_R})(?={_R}*+\.eyJ{_R}{{8,}}+\.{_R}{{8}}){_R}*?(eyJ{_R}{{8,}}+\.eyJ{_R}{{8,}}+\.{_R}{{8,}}+)"}
#: Kind, pattern, groups that are the span and the secret, least length.
_COMPILED = [(k, re.compile(_ONCE.get(k, p)), int(k in _ONCE), int(k in _ONCE) or g, n) for k, p, g, n in KINDS]
SPAN = "struct<start:int,place:int,kind:string,end:int,digest:string,random:boolean>"


def looks_random(secret: str) -> bool:
    """Eight or more different characters, with digits and letters among them."""
    return len(set(secret)) >= 8 and bool(re.search("[0-9]", secret)) and bool(re.search("[A-Za-z]", secret))


def candidates(text: str) -> list[dict]:
    """Spans by start, then kind: code points, end exclusive; the digest is that of the secret itself."""
    found = []
    for place, (kind, pattern, span, group, least) in enumerate(_COMPILED):
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(span), place, kind, m.end(span), hashlib.sha256(m[group].encode()).hexdigest()[:32], looks_random(m[group])))
    return [dict(zip(("start", "place", "kind", "end", "digest", "random"), x)) for x in sorted(found)]


def found_in(text: Column) -> Column:
    @F.pandas_udf(f"array<{SPAN}>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in slices(batches):
            yield texts.map(candidates)

    return find(text)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", repository: str = "source", owner: Column | None = None, wide: int = 3) -> DataFrame:
    """Per row: key, `secrets` (spans with n_repositories, n_owners, n_copies and verdict).

    `owner` is the part of the repository's name before the first '/' unless given. Verdicts: 'copied' (`wide` or more
    owners hold it), 'live' (fewer, and it looks random), 'plain' (the rest).
    """
    repo = F.coalesce(F.col(repository).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), repo.alias("repository"), F.coalesce(owner if owner is not None else F.split(repo, "/")[0], F.lit("")).alias("owner"), found_in(text_or_empty(text)).alias("secrets"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")
    single = rows.where(F.size("secrets") > 0).select("row", "repository", "owner", F.explode("secrets").alias("s"))
    held = single.groupBy(F.col("s.digest").alias("digest"), "repository", "owner").agg(F.count("*").alias("copies"))
    counted = held.groupBy("digest").agg(F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"), F.sum("copies").alias("n_copies"))
    verdict = F.when(F.col("n_owners") >= wide, "copied").when(F.col("s.random"), "live").otherwise("plain")
    known = single.select("row", "s", F.col("s.digest").alias("digest")).join(counted, "digest")
    per_row = known.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s.start", "s.place", "s.kind", "s.end", "digest", "n_repositories", "n_owners", "n_copies", verdict.alias("verdict")))).alias("found"))
    joined = rows.drop("secrets").join(per_row, "row", "left")
    return joined.select("doc_id", "repository", F.coalesce("found", F.array()).alias("secrets"))


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
