"""Whole plans over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which indicators every document evidences, with which clause, and whether that is new: the submission's rows."""
    from quarryline.plans.catalogue import emit_csv_rows

    return emit_csv_rows(spark, sf_dir)
