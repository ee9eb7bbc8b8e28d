"""A corpus pipeline: documents through five of the training-data operators.

Each stage of ``STAGES`` takes (spark, docs, sf_dir), works on all that the stage before kept
and returns a DataFrame; ``run`` writes each as Parquet in the shared folder and rereads it.
All but the last return the columns of ``documents``, whatever their names.

Rows: a null or empty text is an empty text (the classifier scores it as such, and what it keeps
of them are copies of each other for the near duplicates); a null id is smaller than any other
and never matches a label; repeated rows are documents each, of which the near duplicates keep
one; a text of any length is worked on whole. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from playmetrics.llm import (
    decontaminate, pack_harmonic, quality_rff, secret_ledger, simhash_pivots,
)
from playmetrics.llm.common import read_table, write_table

#: Not expressible in SQL: the classifier, the packing. See tests/llm/test_pipeline.py.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more, learnt from the table's labels."""
    return quality_rff.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group whose fingerprints link."""
    return simhash_pivots.drop_near_duplicates(docs, width=3, limit=2)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those contaminated by a benchmark item."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; the secrets in their texts become a mark."""
    return secret_ledger.redact_secrets(docs, "doc_id", "text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    return pack_harmonic.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark),
          ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
