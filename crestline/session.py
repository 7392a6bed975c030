"""Session helpers: settings, shared folders, lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "crestline") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        # call-site capture costs several JVM calls per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CRESTLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Only a local
    master without that setting gets a temporary folder."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        base = configured
    elif sc.getCheckpointDir():
        base = sc.getCheckpointDir()
    elif sc.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="crestline-")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them from there on."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written_table(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder. Unlike a checkpoint it shows its
    real size to later plans; in loops, size estimates would multiply from join
    to join."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, False)


class BucketedTable:
    """A table in the shared folder that is laid out by a hash of one column, in sorted buckets. Joins and
    aggregates by that column don't shuffle it. Only the running session knows its name."""

    def __init__(self, df: DataFrame, name: str, column: str, buckets: int) -> None:
        self.spark, self.column, self.buckets = df.sparkSession, column, buckets
        self.path = scratch_path(self.spark, name)
        self.name = re.sub(r"\W", "_", self.path.rsplit("/", 1)[-1])
        self._write(df.repartition(buckets, column), "errorifexists")

    def _write(self, df: DataFrame, mode: str) -> None:
        df.write.option("path", self.path).mode(mode).bucketBy(self.buckets, self.column).sortBy(self.column).saveAsTable(self.name)

    def append(self, df: DataFrame) -> None:
        """Add rows that are partitioned by the column already, as a join with this table leaves them."""
        self._write(df, "append")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self) -> DataFrame:
        """Give up the name; the rows stay and can be read."""
        rows = self.read()
        self.spark.sql(f"DROP TABLE {self.name}")
        return rows

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def roots(df: DataFrame) -> set[str]:
    """Folders and files that a plan names as its sources; their contents are not listed."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            found |= {paths.apply(k).toString() for k in range(paths.size())}
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/crestline-{name}-{uuid.uuid4().hex}"
