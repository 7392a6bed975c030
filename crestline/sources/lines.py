"""JSON lines: result scan and request sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.sources import store


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(batch_ord, line_no, value) of one or several files or folders.

    ``batch_ord`` follows the given order of the paths. ``line_no`` orders the
    lines of one path by file name, block and row; it is not a dense number, so
    no task ever has to count lines.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for i, p in enumerate(paths):
        one = spark.read.text(p).select(
            F.lit(i).alias("batch_ord"),
            F.struct(F.col("_metadata.file_name").alias("file"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row")).alias("line_no"),
            "value")
        out = one if out is None else out.unionByName(one)
    return out


def batch_paths(base: str, batch_ids: str, suffix: str = ".jsonl") -> list[str]:
    """Paths of a comma-separated id list, in the given order."""
    return [f"{base.rstrip('/')}/{b.strip()}{suffix}" for b in batch_ids.split(",") if b.strip()]


def write_requests(requests: DataFrame, path: str, by_batch: bool = False) -> None:
    """One JSON object per line; with ``by_batch`` one folder per batch_no."""
    line = F.to_json("request").alias("value")
    if by_batch:
        requests.select("batch_no", line).write.partitionBy("batch_no").mode("errorifexists").text(path)
    else:
        requests.select(line).write.mode("errorifexists").text(path)


def write_raw(lines: DataFrame, path: str, per_file: int = 1000) -> None:
    """Raw results as they came, as JSON array files of about ``per_file`` records; lines that are no JSON
    objects are left out, the rest is not looked into."""
    good = lines.filter(F.col("value").rlike(r"^\s*\{") & F.from_json("value", "map<string,string>").isNotNull())
    store.write_array_text(good.select(F.trim("value").alias("record")), path, per_file)
