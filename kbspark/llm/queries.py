"""The queries of this subpackage: each applies an operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import bpe, html, neardup, packing, pii, quality, ranked, secrets, spelling, substrings, topk, vectordup, warc
from kbspark.llm.common import shared_path, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE))
    count = lambda field, value: F.size(F.filter("secrets", lambda s: s[field] == value)).cast("long")
    return found.select(
        "doc_id",
        *(count("kind", k).alias(f"n_{k}") for k in secrets.BASE),
        F.sha2(secrets.told(base), 256).alias("base_sha256"),
        secrets.told(F.col("secrets")).alias("spans"),
        *(count("verdict", v).alias(f"n_{v}") for v in ("live", "copied")),
        *(F.coalesce(F.array_max(F.transform("secrets", lambda s: s[f"n_{c}"])), F.lit(0)).alias(f"most_{c}") for c in ("owners", "repositories")),
    )


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    read = warc.read(spark, path, payloads=False).where("kind = 'record'")
    number = lambda c: F.regexp_extract(c, "(-?[0-9]+)>", 1).try_cast("long")
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("personal", lambda s: ~s["added"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return docs.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(pii.told(base), 256).alias("base_sha256"),
        pii.told(F.col("personal")).alias("spans"),
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "text", "removed_words", "removed_spans")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.decided(*quality.trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.col("coded.n_tokens").alias("n_tokens"), F.sha2("coded.ids", 256).alias("ids_sha256"), F.sha2("coded.decoded", 256).alias("decoded_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_vector_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordup.groups(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_html": op2_html,
    "op3_warc": op3_warc,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_top_k": op8_top_k,
    "op9_quality_rules": op9_quality_rules,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_vector_near_duplicates": op12_vector_near_duplicates,
    "op13_ranked_search": op13_ranked_search,
}
from kbspark.llm.oracle import ORACLE_SQL  # noqa: E402, F401
