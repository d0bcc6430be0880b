"""One query for each operator, applied to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ampliflow.llm import bpe, conversation_trie, exact_dedup, fill_in_middle, fingerprints, html_extract, license_scan, line_crf, maxent_lm, packing, quality_rules, simhash_dedup, suffix_dedup
from ampliflow.llm.common import table


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; its folder has the same place on all machines."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.op1_query(table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.op2_query(table(spark, sf_dir, "pages"))


def op3_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.op3_query(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op4_query(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.op5_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op6_query(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op7_query(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.op8_query(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.op9_query(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.op11_query(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.op12_query(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.op13_query(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_html_extract": op2_html_extract,
    "op3_maxent_lm": op3_maxent_lm,
    "op4_bpe": op4_bpe,
    "op5_line_crf": op5_line_crf,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_packing": op10_packing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLES: dict[str, str] = {
    "op7_quality_rules": quality_rules.ORACLE,
    "op9_license_scan": license_scan.ORACLE,
    "op11_fill_in_middle": fill_in_middle.ORACLE,
    "op12_exact_dedup": exact_dedup.ORACLE,
    "op13_conversation_trie": conversation_trie.ORACLE,
}
