"""Reference CSV files in; submission CSV and JSON out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions.text import blank, strip
from quarryline.operators.findings import csv_rows, law_objects

#: The columns of the reference files, in order, and those that are kept.
REFERENCE_COLUMNS = ("country", "Act.and.or.practice", "Coverage", "Timeframe", "References", "cluster", "Region", "Cov.Name", "pillar.name", "policy.description")
REFERENCE_FIELDS = {"country": "country", "Act.and.or.practice": "act_name", "Coverage": "coverage", "Timeframe": "timeframe", "References": "url", "cluster": "cluster"}


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """Reference items; quoted fields may hold lines, a byte order mark is no part of the first name."""
    schema = ", ".join(f"`{c}` string" for c in REFERENCE_COLUMNS)
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', enforceSchema=True)
    return rows.select(*[strip(blank(F.col(f"`{c}`"))).alias(n) for c, n in REFERENCE_FIELDS.items()])


def write_csv(findings: DataFrame, path: str) -> None:
    """One file with a header, also without findings, in document and keyword order."""
    csv_rows(findings.orderBy("pos", "kw_pos")).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(findings: DataFrame, path: str, **options) -> None:
    """One JSON array of laws, [] without any: each law a line, commas between."""
    laws = law_objects(findings, **options)
    n = laws.count()
    # The output is one file by contract, so its order is total.
    order = Window.orderBy("law_pos", "law")
    lines = laws.withColumn("k", F.row_number().over(order)).select(F.concat(F.when(F.col("k") == 1, "[").otherwise(""), F.col("law"), F.when(F.col("k") == n, "]").otherwise(",")).alias("value"))
    out = lines if n else laws.sparkSession.createDataFrame([("[]",)], "value string")
    out.coalesce(1).write.mode("overwrite").text(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of a crawl's result as JSON lines of its own folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
