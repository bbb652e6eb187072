"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracktally.catalog import Catalog
from tracktally.llm import (
    byte_bpe,
    dart_minhash,
    html_main,
    license_diagonals,
    mixing,
    quality_rda,
    quality_rules,
    secret_links,
    shards,
    syncmers,
    token_alignment,
    toxic_ordinal,
    turn_repair,
)
from tracktally.llm.common import read_table
from tracktally.llm.license_sql import LICENSE_SQL
from tracktally.llm.sql import MIX_SQL, QUALITY_SQL
from tracktally.llm.turn_sql import REPAIR_SQL

catalog = Catalog()


@catalog.add()
def op1_secret_links(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    found = secret_links.scan_secrets(docs)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"].isin(*secret_links.BASE_KINDS))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in secret_links.BASE_KINDS),
        F.sha2(secret_links.spans_text(base), 256).alias("base_sha256"),
        secret_links.spans_text(F.col("secrets")).alias("spans"),
    )


@catalog.add()
def op2_jump_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    text = F.coalesce("text", F.lit(""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shards.shard_of(F.col("doc_id"), 8).alias("shard"),
        shards.shard_of(F.col("doc_id"), 9).alias("grown_shard"),
    )
    return shards.number_slots(placed, "shard").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


@catalog.add()
def op3_tree_scored_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages").select("page_id", "url", "html")
    return html_main.extract_main(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@catalog.add()
def op4_rank_queue_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode_bpe(docs, path, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@catalog.add()
def op5_dart_minhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return dart_minhash.near_duplicates(docs).select("doc_id", "class_id", F.col("cls").alias("class_node"))


@catalog.add()
def op6_quadratic_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rda.score_quality(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@catalog.add()
def op7_ordinal_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxic_ordinal.score_toxicity(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@catalog.add(MIX_SQL)
def op8_prefix_sum_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sizes(read_table(spark, folder, "documents"))


@catalog.add()
def op9_closed_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.fingerprint_edits(read_table(spark, folder, "documents"))


@catalog.add(QUALITY_SQL)
def op10_rule_cascade(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return quality_rules.quality_cascade(docs, counts=True).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


@catalog.add(LICENSE_SQL)
def op11_diagonal_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = license_diagonals.scan_licenses(read_table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["phrase"])
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["start"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


@catalog.add(REPAIR_SQL)
def op12_auction_turns(spark: SparkSession, folder: str) -> DataFrame:
    return turn_repair.audit_conversations(read_table(spark, folder, "conversations")).withColumnRenamed("conv", "conv_id")


@catalog.add()
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.align_tokenizers(docs, *paths)


@catalog.add()
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
