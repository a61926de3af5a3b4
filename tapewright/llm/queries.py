"""The registered queries of this subpackage, one per operator, and their SQL where SQL can say the same."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import alignment, ann, leaks, lm, merkle, mixing, near_dup, packing, pii, quality, sharding, tokens, warc
from tapewright.llm.common import ensure_checkpoint_dir
from tapewright.llm.sql import SQL


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    packed = packing.pack(docs, tokenizer("word_bpe_49k.json"), window=4096, end_id=2, keep_ids=False, drop_text=True)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    counts = [F.expr(f"CAST(size(filter(base_spans, s -> s.kind = '{k}')) AS BIGINT) AS n_{k}") for k in pii.BASE_KINDS]
    base_sha256 = F.sha2(F.expr(pii.listing("base_spans")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base_sha256, F.expr(pii.listing("spans")).alias("spans"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = quality.apply_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = tokens.over_limit(tokens.count_tokens(docs, tokenizer("piece_bpe_32k.model")), 4096)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return counted.select("doc_id", size, "n_tokens", "over_limit")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    text = F.coalesce("text", F.lit("")).cast("binary")
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    dealt = sharding.assign_shards(sized, sharding.topology(16))
    dealt = sharding.assign_shards(dealt, sharding.topology(17), out="grown_shard")
    return sharding.number_slots(dealt).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), only_ids=True)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, least_bytes=0)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.fit_and_score(documents(spark, sf_dir).select("doc_id", "text"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    offered = {"text": F.when(tampered, lower).otherwise(F.col("text"))}
    proved = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], part="lang", order=["doc_id"], offered=offered)
    return proved.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), "folded_root", "verified")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_hit")
    items_sha256 = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    contaminated = (F.size("spans") > 0).alias("contaminated")
    return found.select("doc_id", "n_words", n_hit, F.size("items").cast("long").alias("n_items"), items_sha256, contaminated)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows, _ = alignment.align(docs, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_pii": op2_pii,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_counts": op4_token_counts,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_sharding": op6_sharding,
    "op7_nearest": op7_nearest,
    "op8_mixing": op8_mixing,
    "op9_warc": op9_warc,
    "op10_lm_scores": op10_lm_scores,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_decontamination": op12_decontamination,
    "op13_token_alignment": op13_token_alignment,
}


__all__ = ["QUERIES", "SQL"]
