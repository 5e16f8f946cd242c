"""The corpus pipeline: quality, toxicity, line dedup, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of
documents. run() applies them to the documents table in turn; a driver may also write and reread
each stage's result between them. The stages with Python workers lower the session's rows of an
Arrow batch, for their results are made when the caller writes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import dart, linededup, packing, quality, toxicity
from quarryline.llm.common import cut, small_batches, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the compression classifier doesn't reject."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weakly supervised classifier doesn't reject."""
    small_batches(spark)
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match an earlier one."""
    return linededup.dedup_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    small_batches(spark)
    return dart.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("lines", line_stage), ("near_duplicates", near_stage), ("packing", packing_stage)]

#: SQL can't express the first two stages, which train models; tests/llm/ holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
