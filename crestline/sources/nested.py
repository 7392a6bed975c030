"""Nested area files: arrays of areas that embed their routes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline import schemas
from crestline.sources import arrays


_RECORD = schemas.NESTED_AREA + ", part int, corrupt string"
#: What ``read_nested`` returns.
_READ = _RECORD + ", file_path string, area_pos struct<block:bigint,row:bigint>"


class NoDataError(RuntimeError):
    pass


def location(base: str, name: str) -> str:
    """Base folder (``file:``, ``s3a:``, ...) plus file name; full locations pass."""
    return name if "://" in name else f"{base.rstrip('/')}/{name.lstrip('/')}"


def read_nested(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True,
                split_bytes: int | None = None) -> DataFrame:
    """Area rows with ``file_path`` and ``area_pos`` (position inside the file).

    The file root is an array or a single object. Incoming files are one JSON
    array each, hence ``multi_line``: their records are found by all tasks at
    once (``arrays``). Files written by this package hold one record per line
    (``multi_line=False``). Records that do not parse have ``corrupt`` set.
    """
    if multi_line:
        return parsed(arrays.split_records(spark, paths, split_bytes=split_bytes), _RECORD)
    df = (spark.read.schema(_RECORD).option("columnNameOfCorruptRecord", "corrupt")
          .option("ignoreMissingFiles", True).json(paths if isinstance(paths, str) else list(paths)))
    return df.select("*", F.col("_metadata.file_path").alias("file_path"),
                     F.struct(F.col("_metadata.file_block_start").alias("block"),
                              F.monotonically_increasing_id().alias("row")).alias("area_pos"))


def parsed(records: DataFrame, schema: str) -> DataFrame:
    """Fields of ``schema`` from the records of array files."""
    row = F.from_json("value", schema, {"columnNameOfCorruptRecord": "corrupt"})
    return records.select(row.alias("r"), "file_path", "area_pos").select("r.*", "file_path", "area_pos")


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Paths that exist, by one listing per folder; names come from a manifest,
    one entry per file."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    listed: dict[str, set[str]] = {}

    def names(folder: str) -> set[str]:
        if folder not in listed:
            path = hadoop.Path(folder)
            fs = path.getFileSystem(conf)
            listed[folder] = {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()
        return listed[folder]

    return [p for p in paths if p.rsplit("/", 1)[-1] in names(p.rsplit("/", 1)[0] or "/")]


def read_manifest(spark: SparkSession, path: str) -> list[str]:
    """File names of a manifest (one JSON array of strings)."""
    text = spark.read.option("wholetext", True).text(path)
    names = text.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "name"))
    return [r["name"] for r in names.orderBy("pos").collect()]


def plain_path(path: Column) -> Column:
    """Path as written by people: without URL escapes, one form of the scheme."""
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.regexp_replace(F.regexp_replace(decoded, "^file:/+", "/"), "^([a-z0-9]+):/+", "$1://")


def readable(nested: DataFrame) -> DataFrame:
    """Records that parsed; a record with an id survives a bad field."""
    return nested.filter(F.col("corrupt").isNull() | F.col("area_id").isNotNull())


def scan_manifest(spark: SparkSession, manifest: str, base: str,
                  multi_line: bool = True) -> tuple[DataFrame, list[str]]:
    """Union of the listed files and the names that were skipped. Unreadable
    files are skipped; no file at all is an error."""
    names = read_manifest(spark, manifest)
    if not names:
        raise NoDataError("the manifest lists no files")
    wanted = {location(base, n): n for n in names}
    found = existing_paths(spark, list(wanted))
    if not found:
        raise NoDataError("none of the listed files exists")
    listed = spark.createDataFrame(list(enumerate(found)), "file_ord int, listed string").select(
        "file_ord", F.regexp_replace("listed", "^file:/+", "/").alias("_key"))
    df = readable(read_nested(spark, found, multi_line))
    # a listed name is a file, or a folder of part files
    path = plain_path(F.col("file_path"))
    folder = listed.select(F.col("file_ord").alias("_folder_ord"), F.col("_key").alias("_folder"))
    df = df.withColumn("_key", path).withColumn("_folder", F.regexp_replace(path, "/[^/]*$", "")) \
        .join(listed, "_key", "left").join(folder, "_folder", "left") \
        .withColumn("file_ord", F.coalesce("file_ord", "_folder_ord")).drop("_key", "_folder", "_folder_ord")
    if not df.take(1):
        raise NoDataError("no areas could be loaded")
    return df, [n for p, n in wanted.items() if p not in found]


def _first_character(spark: SparkSession, path: str) -> str:
    """First character that is no white space; nothing else reaches the driver."""
    start = F.substring(F.regexp_replace(F.substring("value", 1, 4096), r"^\s+", ""), 1, 1)
    head = spark.read.text(path).select(start.alias("c")).filter("c <> ''").limit(1).collect()
    return head[0][0] if head else ""


def scan_single(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """One file whose root must be a non-empty array."""
    first = _first_character(spark, path)
    if not first:
        raise NoDataError("empty file")
    if first != "[":
        raise ValueError("expected an array of areas")
    return read_nested(spark, path, split_bytes=split_bytes)


def scan_states(spark: SparkSession, folder: str, suffix: str = "_routes_tagged.json",
                multi_line: bool = True) -> DataFrame:
    """All files ``<state><suffix>`` of a folder, or folders of part files with
    such a name, with ``state``."""
    df = read_nested(spark, f"{folder.rstrip('/')}/*{suffix}", multi_line)
    path = plain_path(F.col("file_path"))
    name = F.when(path.endswith(suffix), F.substring_index(path, "/", -1)).otherwise(
        F.substring_index(F.substring_index(path, "/", -2), "/", 1))
    return df.withColumn("state", F.regexp_replace(name, re.escape(suffix) + "$", ""))


def snapshot_or_empty(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Earlier nested snapshot; missing or broken files count as empty."""
    try:
        df = read_nested(spark, path, multi_line)
    except AnalysisException:
        return spark.createDataFrame([], _READ)
    return readable(df)


def flatten_nested(nested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(areas, routes). Array positions become ordinals, and each route carries
    the name and hierarchy of its area. An area cut into parts is one area."""
    context = [c for c in ("state", "file_ord", "file_path", "area_pos", "part") if c in nested.columns]
    first_part = F.coalesce(F.col("part"), F.lit(0)) == 0 if "part" in nested.columns else F.lit(True)
    areas = nested.filter(first_part).select(*schemas.AREA_COLUMNS, *context)
    routes = nested.select(
        "area_id", "area_name", "area_hierarchy", *context,
        F.posexplode("routes").alias("route_pos", "r"),
    ).select("area_id", "area_name", "area_hierarchy", *context, "route_pos", "r.*")
    return areas, routes


def read_flat(spark: SparkSession, areas_file: str, routes_file: str,
              split_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``{"areas": [...]}`` and ``[...]`` files; other shapes fail. Ordinals are places in the file."""
    if _first_character(spark, routes_file) != "[":
        raise ValueError("expected an array of routes")

    def ordered(records: DataFrame, schema: str, name: str) -> DataFrame:
        place = F.struct("file_path", F.col("area_pos.block"), F.col("area_pos.row")).alias(name)
        return parsed(records, schema).select("*", place).drop("file_path", "area_pos")

    areas = ordered(arrays.split_records(spark, areas_file, "areas", split_bytes), schemas.AREA, "area_ord")
    return areas, ordered(arrays.split_records(spark, routes_file, split_bytes=split_bytes), schemas.FLAT_ROUTE, "route_ord")
