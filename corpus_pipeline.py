"""A corpus pipeline: rules, near-dedup, secrets, mixing, token ids.

Each stage takes (spark, docs, folder) and works on all rows that the stage before kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracktally.llm import byte_bpe, dart_minhash, mixing, quality_rules, secret_links
from tracktally.llm.common import exact, read_table, saved


def quality_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the rule cascade rejects go."""
    return quality_rules.quality_cascade(docs).where("kept").select([exact(c) for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document of the smallest id of each group of near copies stays."""
    return dart_minhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Reported spans are masked; ``n_chars`` follows the text."""
    masked = secret_links.redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sources at their target weights: documents repeat by epochs, one a source is cut."""
    mixed = mixing.mix_documents(docs)
    if "n_chars" not in docs.columns:
        return mixed
    return mixed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def token_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document, with the digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode_bpe(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secrets_stage),
    ("mixing", mixing_stage),
    ("bpe", token_stage),
]

#: SQL can't express near copies by weighted MinHash or the merges of BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
