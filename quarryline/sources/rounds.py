"""Tables that grow by whole rounds, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (tests, a single machine).
LOCAL = "/tmp/checkpoints/quarryline"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only if that is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.conf.get("spark.master", "local").split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (folder or LOCAL).rstrip("/")


class Rounds:
    """A versioned table: each round is written once, as Parquet of its own, and read from there by all later plans, so that no plan holds more than one round and a lost executor costs no earlier one."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path, self.n, self.schema = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0, None

    def put(self, rows: DataFrame) -> DataFrame:
        """Write the next round, and give it back as read from its files."""
        if self.schema is not None and rows.columns != self.schema.names:
            rows = rows.select(*self.schema.names)
        self.schema = self.schema or rows.schema
        at = f"{self.path}/{self.n}"
        rows.write.parquet(at)
        self.n += 1
        return self.spark.read.schema(self.schema).parquet(at)

    def all(self) -> DataFrame:
        """All rounds' rows."""
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{i}" for i in range(self.n)])

    def last(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self.n - 1}")

    def drop(self) -> None:
        """Delete the table, once nothing reads it any more."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
