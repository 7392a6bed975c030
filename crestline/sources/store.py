"""Sinks, versioned collections, point lookups and inventories."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.functions.text import slug
from crestline.operators.flatten import upsert
from crestline.operators.keyed import last_wins
from crestline.session import written_table


class TargetExistsError(RuntimeError):
    pass


# --- JSON sinks ----------------------------------------------------------------

def tagged_name(path: str) -> str:
    return path.replace(".json", "_tagged.json")


def write_json(df: DataFrame, path: str) -> None:
    """One record per line, many files; never overwrites."""
    df.write.mode("errorifexists").json(path)


def write_by_root(areas: DataFrame, path: str, base_url: str) -> None:
    """Area records below ``root_slug=<slug of the start URL>``."""
    areas.withColumn("root_slug", slug(F.lit(base_url))).write.partitionBy("root_slug") \
        .mode("errorifexists").json(path)


def write_by_state(areas: DataFrame, path: str) -> None:
    areas.write.partitionBy("state").mode("errorifexists").json(path)


def write_arrays(df: DataFrame, path: str, per_file: int = 1000, member: str | None = None) -> None:
    """Files of one indented JSON array each, as other tools read them, of about ``per_file`` records
    (dealt out by a hash of the record); with ``member``, an object that holds the array."""
    write_array_text(df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("record")), path, per_file, member)


def write_array_text(records: DataFrame, path: str, per_file: int = 1000, member: str | None = None) -> None:
    """``write_arrays`` of records that are JSON text (column ``record``) already."""
    files = max(1, -(-records.count() // per_file))
    text = F.concat(F.lit("[ "), F.array_join(F.collect_list("record"), " ,\n"), F.lit(" ]"))
    if member is not None:
        text = F.concat(F.lit(f'{{ "{member}" : '), text, F.lit(" }"))
    # equal records are dealt out too
    spread = F.pmod(F.xxhash64("record", F.monotonically_increasing_id()), F.lit(files))
    records.withColumn("file", spread).groupBy("file").agg(text.alias("value")).write.partitionBy("file").mode("errorifexists").text(path)


# --- versioned tables ----------------------------------------------------------

def _status(spark: SparkSession, pattern: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []


def folders(spark: SparkSession, pattern: str) -> list[str]:
    return [s.getPath().toString() for s in _status(spark, pattern)]


def delete_folders(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def versions(spark: SparkSession, base: str) -> list[int]:
    """Finished versions (``v=<n>`` folders with a success marker)."""
    done = [s.getPath().getParent().getName() for s in _status(spark, f"{base}/v=*/_SUCCESS")]
    return sorted(int(re.sub(r"^v=", "", d)) for d in done)


def read_version(spark: SparkSession, base: str, version: int | None = None) -> DataFrame | None:
    found = versions(spark, base)
    if not found:
        return None
    return spark.read.parquet(f"{base}/v={found[-1] if version is None else version}")


def next_version(spark: SparkSession, base: str) -> int:
    """Above all versions, also those that a writer began and never finished."""
    begun = [re.sub(r"^v=", "", s.getPath().getName()) for s in _status(spark, f"{base}/v=*")]
    return max((int(n) for n in begun if n.isdigit()), default=0) + 1


def has_rows(spark: SparkSession, base: str) -> bool:
    """Probe of an existing target."""
    df = read_version(spark, base)
    return df is not None and not df.limit(1).isEmpty()


def write_version(df: DataFrame, base: str, cluster_by: Sequence[str | Column] | None = None,
                  project: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Write the next version; earlier ones stay as backups. With ``cluster_by``
    rows are range partitioned and sorted, so later prefix and range filters
    read few files. A folder that another writer has begun is an error.

    ``project`` derives what is stored from the rows in their place (row by row), so that derived texts
    are neither shuffled nor sorted; ``cluster_by`` are columns of ``df`` then."""
    version = next_version(df.sparkSession, base)
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    if project is not None:
        df = project(df)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{base}/v={version}")
    return version


def upsert_version(incoming: DataFrame, base: str, key: str, order: str, force: bool = False,
                   cluster_by: list[str] | None = None) -> int:
    """Set documents by id into a collection. Without ``force`` a non-empty
    target is an error."""
    spark = incoming.sparkSession
    if not force and has_rows(spark, base):
        raise TargetExistsError(base)
    return write_version(upsert(read_version(spark, base), incoming, key, order), base, cluster_by)


# --- collections in parts ------------------------------------------------------

PARTS = 64


def part_of(key: Column, parts: int) -> Column:
    """The part of a key; any engine with MD5 gives the same."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(parts)).cast("int")


def _number_of_parts(spark: SparkSession, base: str) -> int | None:
    found = [s.getPath().getName() for s in _status(spark, f"{base}/of=*")]
    return int(found[0].removeprefix("of=")) if found else None


def read_parts(spark: SparkSession, base: str, keys: DataFrame | None = None) -> DataFrame | None:
    """Rows of a collection in parts. With ``keys``, one column of layout keys, only the parts that hold
    them are read; their numbers, not the keys, reach the driver."""
    n = _number_of_parts(spark, base)
    if n is None:
        return None
    rows = spark.read.parquet(f"{base}/of={n}")
    if keys is not None:
        wanted = [r[0] for r in keys.select(part_of(F.col(keys.columns[0]), n)).distinct().collect()]
        rows = rows.filter(F.col("part").isin(wanted))
    return rows.drop("part")


def upsert_parts(incoming: DataFrame, base: str, key: str, order: str | None = None, by: str | None = None,
                 parts: int = PARTS, backup: bool = True) -> list[int]:
    """Set documents by ``key`` in a collection laid out by a hash of ``by`` (default: the key; a document
    keeps its ``by``). Only parts with a document that changes are read whole and written; their numbers
    are returned, none if everything is there already. The last row in ``order`` wins, which is a column of
    its own and not stored; without it ``incoming`` has each key once.

    The number of parts is fixed by the first write. Parts are replaced when the whole write has
    succeeded, one after the other; a run that dies in between is repeated as it was. With ``backup``
    the rows of the touched parts are kept first, as the next version of ``<base>/_before``.
    """
    spark = incoming.sparkSession
    by = by or key
    new = last_wins(incoming, [key], [order]).drop(order) if order else incoming
    n = _number_of_parts(spark, base) or parts
    new = written_table(new.withColumn("part", part_of(F.col(by), n)), "incoming")
    folder = f"{base}/of={n}"
    if _number_of_parts(spark, base) is None:
        new.hint("rebalance", "part").write.partitionBy("part").mode("errorifexists").parquet(folder)
        return sorted(r[0] for r in new.select("part").distinct().collect())
    offered = [r[0] for r in new.select("part").distinct().collect()]  # at most n numbers
    stored = spark.read.parquet(folder).filter(F.col("part").isin(offered))
    # rows are compared by a digest of their text, so that only keys and digests are shuffled
    text = F.to_json(F.struct(*[c for c in new.columns if c != "part"]), {"ignoreNullFields": "false"})
    digest = F.sha2(text, 256).alias("_digest")
    changed = new.select(key, "part", digest).join(stored.select(key, digest), [key, "_digest"], "left_anti")
    touched = sorted(r[0] for r in changed.select("part").distinct().collect())
    if not touched:
        return []
    stored = stored.filter(F.col("part").isin(touched))
    if backup:
        stored.write.partitionBy("part").mode("errorifexists").parquet(f"{base}/_before/v={next_version(spark, f'{base}/_before')}")
    kept = stored.join(new.select(key), key, "left_anti")
    kept.unionByName(new.filter(F.col("part").isin(touched)), allowMissingColumns=True).hint("rebalance", "part").write.option(
        "partitionOverwriteMode", "dynamic").partitionBy("part").mode("overwrite").parquet(folder)
    return touched


def undo_parts(spark: SparkSession, base: str) -> list[int]:
    """Put the parts of the last backup back; their numbers."""
    last = versions(spark, f"{base}/_before")[-1]
    rows = spark.read.parquet(f"{base}/_before/v={last}")
    rows.hint("rebalance", "part").write.option("partitionOverwriteMode", "dynamic").partitionBy("part").mode("overwrite").parquet(
        f"{base}/of={_number_of_parts(spark, base)}")
    return sorted(r[0] for r in rows.select("part").distinct().collect())


def send_in_groups(df: DataFrame, send, size: int = 500, retries: int = 3) -> None:
    """Hand rows to an external store in groups of at most ``size`` from each
    partition; ``send(list_of_rows)`` must be an idempotent set-by-id."""
    def run(rows):
        from itertools import islice

        rows = iter(rows)
        while group := list(islice(rows, size)):
            for attempt in range(retries):
                try:
                    send(group)
                    break
                except Exception:
                    if attempt == retries - 1:
                        raise
    df.foreachPartition(run)


# --- lookups -------------------------------------------------------------------

def by_name(areas: DataFrame) -> DataFrame:
    return areas.orderBy("area_name", "area_id")


def by_id(df: DataFrame, key: str, value: str) -> DataFrame:
    """Zero or one row; the predicate reaches the scan."""
    return df.filter(F.col(key) == value).limit(1)


def area_source(spark: SparkSession, from_file: DataFrame, collection: str, skip_areas: bool) -> DataFrame:
    """Area dimension from the load file or, when areas are skipped, from the
    stored collection."""
    if not skip_areas:
        return from_file
    stored = read_version(spark, collection)
    if stored is None:
        raise TargetExistsError(f"no stored areas in {collection}")
    return stored


# --- inventory -----------------------------------------------------------------

def inventory(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(name, path, bytes, size_mb) of files, by name; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern) \
        .option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.select(
        F.substring_index("path", "/", -1).alias("name"), "path", F.col("length").alias("bytes"),
        (F.col("length") / F.lit(1024.0 * 1024.0)).alias("size_mb")).orderBy("name", "path")


def size_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"),
                     F.sum("size_mb").alias("size_mb"))


def upload_outcomes(files: DataFrame, errors: DataFrame) -> DataFrame:
    """``files`` of an inventory with ``status`` and ``error``; ``errors`` = (name, error) of those that failed."""
    failed = errors.groupBy("name").agg(F.min("error").alias("error"))
    return files.join(failed, "name", "left").withColumn("status", F.when(F.col("error").isNull(), "successful").otherwise("failed"))


def write_upload_summary(outcomes: DataFrame, path: str, bucket: str) -> DataFrame:
    """Write the outcome of an upload: ``<path>/totals`` one JSON row (bucket, total_files, successful, failed, bytes),
    ``<path>/files`` a row a file below its status. Returns the totals."""
    outcomes.write.partitionBy("status").mode("errorifexists").json(f"{path}/files")
    failed = F.col("status") == "failed"
    outcomes.agg(F.lit(bucket).alias("bucket"), F.count("*").alias("total_files"), F.count_if(~failed).alias("successful"),
                 F.count_if(failed).alias("failed"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes")) \
        .coalesce(1).write.mode("errorifexists").json(f"{path}/totals")
    return outcomes.sparkSession.read.schema("bucket string, total_files bigint, successful bigint, failed bigint, bytes bigint").json(f"{path}/totals")


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """Rows per upload status."""
    return outcomes.groupBy("status").agg(F.count("*").alias("n"))
