"""Shared helpers: reading tables, cutting lineage in the shared folder, exact total orders."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Used only where the session names no shared folder (tests, a single machine).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/quarryline"
#: Rows of an Arrow batch that a worker turns into Python objects at once.
AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a local one only if that is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.conf.get("spark.master", "local").split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (folder or LOCAL_CHECKPOINTS).rstrip("/")


#: Rows that Spark sends a Python worker at once.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Asks Spark to delete a query's shuffle files once the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that outlive any executor. What was shuffled for it is deleted with the query."""
    spark, schema = df.sparkSession, df.schema
    path, before = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(schema).parquet(path)
    table._cut_path = path
    del df
    # Plans of what was written are of no more use; a heap that is full of them is asked to shrink, so that a long chain of tables fits a small driver.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and that nothing reads any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t._cut_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def bare(docs: DataFrame, *known: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the known ones renamed by place, so that no name of theirs can clash, and a function that gives a result docs' columns and names back."""
    names = docs.columns
    inner = [n if n in known else f"__c{i}" for i, n in enumerate(names)]
    return docs.toDF(*inner), lambda result: result.select(*inner).toDF(*names)


def clean_text(text: str | Column = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bucket(df: DataFrame, key: str, buckets: int) -> Column:
    """A Column that deals long `key` into about `buckets` equally full ordered ranges, 0 the lowest.

    The bounds are approximate quantiles, gathered in one pass over the key alone; the driver gets
    `buckets` longs, so callers bound that number. Two levels of bounds make a look-up cost two
    square roots of it. Null keys go to bucket 0.
    """
    side = max(2, int(buckets**0.5 + 0.999))
    steps = [i / (side * side) for i in range(1, side * side)]
    got = df.agg(F.percentile_approx(key, steps, 10 * side * side).alias("b")).first()
    bounds = sorted(set(got.b or []))
    if not bounds:
        return F.lit(0).cast("long")
    rows = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    firsts = F.array(*[F.lit(r[0]).cast("long") for r in rows[1:]]) if len(rows) > 1 else F.lit(None).cast("array<long>")
    fine = F.array(*[F.array(*[F.lit(b).cast("long") for b in r]) for r in rows])
    k = F.col(key)
    coarse = F.coalesce(F.size(F.filter(firsts, lambda b: b < k)), F.lit(0)) if len(rows) > 1 else F.lit(0)
    inner = F.size(F.filter(F.get(fine, coarse), lambda b: b < k))
    return F.coalesce(F.when(k.isNotNull(), (coarse * side + inner)), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], rows: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches: a worker then holds objects of a few rows, whatever Spark sends at once. At the end Arrow's unused memory goes back, as workers wait for other stages' tasks."""
    try:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)
    finally:
        b = None
        pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession, rows: int = 4 * AT_ONCE) -> None:
    """From now on the session sends Python workers at most so many rows at once: Arrow's buffers of them are outside the heap, in the executor and again in the worker. Results don't depend on it."""
    if not 0 < int(spark.conf.get(_BATCH)) <= rows:
        spark.conf.set(_BATCH, rows)


def with_numbers(docs: DataFrame, keep: list[str], made: list[tuple[str, DataType]], worker: Callable[[], Callable[[list[str]], list]], text: str = "text") -> DataFrame:
    """docs' columns `keep` and, for each of `made`, what the worker's function gives for some whole texts (null: empty). A text that is kept is sent once."""
    sent = keep if text in keep else [*keep, text]
    schema = StructType([*(docs.schema[k] for k in keep), *(StructField(n, t) for n, t in made)])

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = worker()
        for b in slices(batches):
            texts = [t or "" for t in b.column(sent.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *map(pa.array, function(texts))], [*keep, *(n for n, _ in made)])

    return docs.select(*sent).mapInArrow(here, schema)
