"""From raw documents to packed sequences: quality rules, near-duplicates, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet and read again
before the next. All but the last return the columns of `docs`, whatever they are named, with n_chars set anew where the
text has changed. A stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import neardup, packing, pii, quality, substrings
from kbspark.llm.common import Scratch, small_batches, table

#: Words that a document needs to stay. The learned rules judge short ones too; packing has a place for any length.
LEAST_WORDS = 1


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one, so that no result of an operator clashes with them."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *(F.col(c) for c in docs.columns if c not in ("doc_id", "text"))).alias("row"))


def _documents(rows: DataFrame, docs: DataFrame, changed: bool = False) -> DataFrame:
    """`rows` with the columns of `docs` again."""
    kinds = dict(docs.dtypes)
    counted = F.char_length("text").cast(kinds.get("n_chars", "long"))
    own = lambda c: F.col(c) if c in ("doc_id", "text") else counted if changed and c == "n_chars" else F.col("row").getField(c)
    return rows.select(*(own(c).alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules, from LEAST_WORDS words on, and the learned list keep.

    Those without words go (null and empty texts). Repeated rows are judged alike, so are rows of any or no id; ties don't
    arise. Without labels the base rules decide alone.
    """
    return quality.filtered(docs, table(spark, sf_dir, "labels"), least_words=LEAST_WORDS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the least id. Of repeated rows of it, one too; of equal ones any.

    Rows without an id or without words are in no group and stay.
    """
    small_batches(spark)
    groups = neardup.groups(docs).where("kept").select("doc_id").distinct()
    kept = docs.alias("d").join(groups.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")), "left_semi")
    known = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
    return known.unionByName(kept.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents of smaller id have; those of which nothing is left go.

    Null and empty texts stay as they are, as do rows without an id; of equal passages that of the least id stays.
    """
    return _documents(substrings.dedup(_carried(docs)).where("removed_words = 0 OR text <> ''"), docs, changed=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked. Null texts stay null; spans that overlap are masked as one."""
    return _documents(pii.mask(_carried(docs)), docs, changed=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as rows with their ids. A null text counts as empty; repeated rows are packed each."""
    import public_tokenizers

    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: SQL can't express the learned rules, the tokens and their packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' last result. A stage's table is dropped when the next one's is written."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.written(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
