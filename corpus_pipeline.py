"""The corpus pipeline: quality rules, line dedup, near-dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and returns the columns of documents;
the last one returns the packed pieces.  run() writes each stage's result to the shared folder and reads it for the next.

Null texts fail the quality rules; extra columns pass through all stages but the last; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import common, line_dedup, near_dedup, packing, quality, secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = common.read(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.keep(docs, labels)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose key stands in ten documents or more go from every text; all documents stay."""
    bitmaps = line_dedup.keep_bitmaps(common.documents(docs), min_docs=10, keep_first=False)
    kept = line_dedup.apply_bitmaps(common.carry(docs), bitmaps)
    return common.restore(kept, docs.columns, F.col("kept_text"), F.col("n_dropped") > 0)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each class of exact and near copies, under its least doc_id; of repeated rows one."""
    return near_dedup.representatives(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; all documents stay."""
    return secrets.redact(docs, secrets.extend_ledger(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scans", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: Neither Order MinHash classes nor tokenizer ids can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
