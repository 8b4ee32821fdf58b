"""A training corpus from ``documents``: quality rules, cross-site lines,
near duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept, and returns the columns of ``documents`` (the last: packed pieces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import jaccard, line_dedup, packing, quality, secrets, storage
from starloom.llm.queries import tokenizer_path
from starloom.sources.tables import read_table


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or that the voting rules reject go."""
    counted = storage.checkpointed(quality.with_counts(docs))
    return quality.judge(counted).where("__q_kept").select(*docs.columns)


def cross_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines leave the texts; every document stays."""
    return _with_length(line_dedup.remove_boilerplate(docs, copies_only=True).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more: the document with the
    smallest id of each group stays, and one row of repeated rows."""
    grouped = jaccard.near_duplicates(docs, n=5, num=80, den=100)
    dropped = grouped.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    mark = max([*docs.columns, "_"], key=len) + "_hash"         # no column of the documents
    kept = docs.join(dropped, "doc_id", "left_anti").withColumn(mark, F.xxhash64("text"))
    return kept.dropDuplicates(["doc_id", mark]).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks; every document stays."""
    return _with_length(secrets.redact_secrets(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", cross_site_lines),
    ("ngram_jaccard", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

# Expectation-maximisation and tokenisation are beyond SQL; tests compare the
# stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = storage.materialise(docs, f"stage-{name}")
    return docs
