"""Registered queries of the corpus operators; each applies one operator to its whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontamination, html_extraction, language_id, license_scan, line_dedup, merkle_manifest, oracles, quality_classifier, quality_rules, sentencepiece_codec, simhash, suffix_dedup, toxicity, vector_codes
from .common import SPACE, table
from .registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]

#: Public vocabulary files; the folder is a parameter of the queries.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


@query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_benchmark_decontamination", oracles.DECONTAMINATION)
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contamination(docs, items).drop("spans", "n_near_items")


@query("op1_quality_rules", oracles.QUALITY_RULES)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query("op6_html_extraction")
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(table(spark, sf_dir, "pages")).drop("path")


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_line_dedup")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))).cast("long").alias("n_lines"),
        F.sha2("text", 256).alias("text_sha256"),
    )


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    vocabulary = sentencepiece_codec.load(f"{tokenizers}/piece_bpe_32k.model")
    out = sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), vocabulary, texts=False)
    return out.select("doc_id", "n_tokens", F.xxhash64("ids").alias("ids_hash"), F.col("same").alias("round_trip"))


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_repeated", F.size("spans").cast("long").alias("n_spans"), F.to_json("spans").alias("spans"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


@query("op11_license_scan", oracles.license_scan())
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("found")


@query("op13_merkle_manifest", oracles.MERKLE_MANIFEST)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents")).drop("lang", "proof")


@query("op12_vector_codes", oracles.vector_codes())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")
