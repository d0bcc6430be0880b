"""The corpus pipeline: quality rules, quality classifier, SimHash near-dedup, suffix-array dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliflow.llm import line_crf, packing, quality_rules, simhash_dedup, suffix_dedup
from ampliflow.llm.common import materialize, table
from ampliflow.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents with another text and its length."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject; the others keep the lines that pass."""
    judged = quality_rules.quality_rules(docs.select(*COLUMNS))
    return _with_text(judged.where("qr_kept"), "qr_clean_text")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is below the threshold of a classifier that learned from the whole documents and labels."""
    docs = docs.select(*COLUMNS)
    crf = line_crf.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return line_crf.score(docs, crf, out_col="quality_score").where(F.col("quality_score") >= line_crf.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that with the least id, nulls last, then the least hash of its text."""
    return simhash_dedup.one_of_each_group(docs, list(COLUMNS))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated strings from the texts; documents of which nothing is left go."""
    found = suffix_dedup.suffix_dedup(docs, ["lang", "source"])
    return _with_text(found.where("clean_text != ''"), "clean_text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.best_fit_packing(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", clean_lines),
    ("quality classifier", classify),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("best-fit packing", pack),
]

#: The classifier, the repeats and the packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
