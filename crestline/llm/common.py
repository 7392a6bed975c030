"""Shared pieces of the pipeline operators: registry, tables, batches, cut lineage."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from crestline.session import roots, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Rows that one Arrow batch holds at most, so that a Python worker keeps few whole texts at once.
BATCH_ROWS = 512
#: Scratch tables of pipeline stages, and whether one is being built.
_of_stages: list[str] = []
_in_stage: list[bool] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def query(name: str, sql: str | None = None):
    """Register a callable (spark, table folder) and, where there is one, its SQL."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: read from there on, whatever executor is lost. What the write
    shuffled is deleted at its end, since nothing reads ``df`` again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _in_stage:
        _of_stages.append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def pipeline_stage(docs: DataFrame):
    """While a stage over ``docs`` is built. First the scratch tables of earlier stages are deleted, apart from those
    that ``docs`` reads: what they were for has been written as a whole."""
    spark = docs.sparkSession
    read = roots(docs)
    gone = [p for p in _of_stages if not any(p.rsplit("/", 1)[-1] in r for r in read)]
    _of_stages[:] = [p for p in _of_stages if p not in gone]
    for p in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _in_stage.append(True)
    try:
        yield
    finally:
        _in_stage.pop()
