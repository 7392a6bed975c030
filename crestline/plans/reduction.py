"""Reduction job: the files of all states in, one reduced output per state and statistics out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.operators import reduction
from crestline.sources import nested, store


def run(spark: SparkSession, folder: str, base: str, suffix: str = "_routes_tagged.json", multi_line: bool = True) -> DataFrame:
    """Write the trad and sport routes of all ``<state><suffix>`` files below ``folder`` as the next
    version of ``base``, one folder per state; earlier versions stay as backups. Returns the
    statistics per state with sizes of input and output, and their total."""
    states = nested.scan_states(spark, folder, suffix, multi_line)
    areas, routes = nested.flatten_nested(states)
    stats = reduction.reduction_stats(areas, routes)
    target = f"{base}/v={store.next_version(spark, base)}"
    store.write_by_state(reduction.reduce_nested(states).drop("corrupt", "file_path", "area_pos"), target)
    read = _sizes(spark, folder, rf"/([^/]+){suffix.replace('.', '[.]')}(?:/|$)").withColumnRenamed("bytes", "bytes_in")
    wrote = _sizes(spark, target, "/state=([^/]+)/").withColumnRenamed("bytes", "bytes_out")
    sized = stats.join(read, "state", "left").join(wrote, "state", "left").fillna(0, ["bytes_in", "bytes_out"])
    return reduction.with_grand_total(sized)


def _sizes(spark: SparkSession, folder: str, state: str) -> DataFrame:
    files = store.inventory(spark, folder)
    return files.groupBy(F.regexp_extract(nested.plain_path(F.col("path")), state, 1).alias("state")).agg(
        F.sum("bytes").alias("bytes"))
