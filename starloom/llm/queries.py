"""The queries of this package over the whole documents, pages and benchmark tables, and their DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, lang_ppm, lcp, line_dedup, lsh_forest, mixing, oracles, quality, secret_scan, tokens, warc


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", lang_ppm.held_out(F.col("doc_id")))
    model = lang_ppm.fit(docs.where(~F.col("held_out")))
    return lang_ppm.identify(docs.drop("lang"), model).select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), keep=["doc_id"])
    return out.select("doc_id", F.col("__topic").alias("topic"), F.col("__tokens").alias("n_words"), F.col("__probability").alias("probability"), F.col("__sampled").alias("sampled"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), read(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "contaminated", "best_item", "coverage", "items")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, tokenizer_path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "rep_id", "n_links", "n_shingles")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_round_trip(read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lcp.fingerprint_edits(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_source_mix": op2_source_mix,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_line_dedup": op6_line_dedup,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_secret_scan": op8_secret_scan,
    "op9_warc": op9_warc,
    "op10_fingerprints": op10_fingerprints,
}
ORACLES: dict[str, str] = {"op6_line_dedup": oracles.LINE_DEDUP, "op7_near_duplicates": oracles.NEAR_DUPLICATES, "op8_secret_scan": oracles.SECRETS, "op9_warc": oracles.WARC}
