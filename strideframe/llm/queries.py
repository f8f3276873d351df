"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and their DuckDB twins."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import bpe, decontamination, jaccard, line_chunks, personal, phrases, quality, simhash, substrings, suffixes, token_counts, tries, wavelet
from strideframe.llm.oracles import ORACLES as ORACLES
from strideframe.llm.store import documents, new_path, texts


def op1_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = wavelet.shards(spark, wavelet.write_shards(documents(spark, sf_dir), new_path(spark, "token-shards")))
    read = wavelet.read_documents(files).select("shard", "doc_id", "offset", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return read.join(wavelet.shard_starts(files), "shard").select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_later")


def op3_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op5_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir)).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                             F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_chunks.line_dedup(texts(documents(spark, sf_dir)))
    return kept.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.overlaps(texts(documents(spark, sf_dir)), benchmark).select("doc_id", "overlap.*")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_phrases(phrases.phrases(documents(spark, sf_dir)))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(documents(spark, sf_dir)).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return tries.prefix_trie(tries.with_family_heads(tries.sequences(conversations)))


QUERIES = {f.__name__: f for f in (
    op1_wavelet_shards, op2_suffix_array, op3_boosted_pii, op4_token_counts, op5_difference_cover, op6_simhash, op7_quality_rules, op8_bpe,
    op9_line_chunks, op10_winnowing, op11_phrases, op12_jaccard, op13_prefix_trie)}
