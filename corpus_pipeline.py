"""The corpus pipeline: quality rules, near-duplicate removal, secret redaction, packing.

Each stage works on all that the stage before kept; run() writes each result as Parquet in the shared folder and
reads it again, so a lost executor costs at most the work of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mosaiq.llm import ngram_join, packing, quality, secrets
from mosaiq.llm.queries import tokenizer
from mosaiq.tables import table, written


#: Python workers outlive stages and share an executor's memory with a full heap, so each remembers little.
KNOWN = 100_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go, and so do the documents that the rules reject."""
    return quality.clean_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard likeness of 0.8 of five-word shingles, the document of the least id stays."""
    return ngram_join.representatives(docs, n=5, num=80, den=100)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found gives way to a mark."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), known=KNOWN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("secret_scans", secret_stage),
    ("packing", packing_stage),
]

#: SQL can't tokenise; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
