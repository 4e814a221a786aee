"""One registered query for each operator, over its whole tables, and the
DuckDB SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fxledger.llm import (conversations, files, fingerprints, fm_index, jaccard_join, lexical, license_scan,
                          oracle, packing, quality, rans, substring_dedup, suffix_dedup, toxicity, warc)
from fxledger.llm.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.score(docs, machine).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def tokenizer() -> str:
    """The vocabulary file of the queries, where the tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing_kk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer(), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.spans(table(spark, sf_dir, "documents")))


def op4_decontaminate_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.digest(fm_index.find(table(spark, sf_dir, "documents"),
                                         table(spark, sf_dir, "benchmark")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", "kept", "fail_bits")


def op6_jaccard_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


def op8_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.folder(spark, "rans")
    manifest = rans.write(table(spark, sf_dir, "documents"), path, tokenizer(), end_id=0)
    return rans.read(manifest, path).select("doc_id", "start", "n_tokens",
                                            F.crc32("ids").alias("ids_crc32"))


def op9_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"), files.folder(spark, "warc"))
    return warc.read(manifest, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.spans(table(spark, sf_dir, "documents")))


def op11_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "item_id", "rank", "doc_id", "score")


def op12_scaled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.next_text(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.digest(conversations.repair(rows))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity_fm": op1_toxicity_fm,
        "op2_packing_kk": op2_packing_kk,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_decontaminate_fm": op4_decontaminate_fm,
        "op5_quality_rules": op5_quality_rules,
        "op6_jaccard_rtree": op6_jaccard_rtree,
        "op7_license_scan": op7_license_scan,
        "op8_rans_ids": op8_rans_ids,
        "op9_warc_roundtrip": op9_warc_roundtrip,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_ball_tree_search": op11_ball_tree_search,
        "op12_scaled_fingerprints": op12_scaled_fingerprints,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": oracle.SUBSTRING,
        "op4_decontaminate_fm": oracle.DECONTAMINATE,
        "op5_quality_rules": oracle.QUALITY,
        "op9_warc_roundtrip": oracle.WARC,
        "op13_conversation_repair": oracle.CONVERSATIONS,
        "op11_ball_tree_search": oracle.LEXICAL,
        "op7_license_scan": oracle.licenses(license_scan.TEMPLATES, license_scan.PERCENT),
    }
