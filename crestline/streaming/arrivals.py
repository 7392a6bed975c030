"""Result files that arrive over time, as a file stream.

Every micro-batch parses its lines, keeps the last one per id and writes them
to ``<state>/batch=<id>``. Writing is idempotent: a repeated batch overwrites
its own folder. Readers let the highest (batch, line) per id win, so earlier
batches never have to be rewritten; ``compact`` folds them from time to time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.operators.enrich import accepted, parse_results
from crestline.operators.keyed import last_wins
from crestline.sources import store

KEYS = ["kind", "entity_id"]
COMPACTED = "_compacted"  # hidden from readers of the batches


def start(spark: SparkSession, incoming: str, state: str, checkpoint: str, available_now: bool = True):
    """Start the stream over the text files of ``incoming``."""
    lines = (spark.readStream.format("text").load(incoming)
             .select("value", F.col("_metadata.file_modification_time").alias("arrived"),
                     F.col("_metadata.file_name").alias("file"),
                     F.col("_metadata.file_block_start").alias("block")))

    def write(batch: DataFrame, batch_id: int) -> None:
        ordered = batch.select(
            F.lit(batch_id).alias("batch_ord"),
            F.struct("arrived", "file", "block",
                     F.monotonically_increasing_id().alias("row")).alias("line_no"), "value")
        good = accepted(parse_results(ordered)).select(*KEYS, "batch_ord", "line_no", "tags")
        last_wins(good, KEYS, ["batch_ord", "line_no"]).write.mode("overwrite") \
            .parquet(f"{state}/batch={batch_id}")

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _rows(spark: SparkSession, state: str) -> DataFrame:
    """The last compacted version and the batches that are still there."""
    kept = store.read_version(spark, f"{state}/{COMPACTED}")
    try:
        batches = spark.read.parquet(state).drop("batch")
    except AnalysisException:
        if kept is None:
            raise
        return kept
    return batches if kept is None else kept.unionByName(batches)


def current(spark: SparkSession, state: str) -> DataFrame:
    """Latest tags per id over all batches so far: kind, entity_id, tags."""
    return last_wins(_rows(spark, state), KEYS, ["batch_ord", "line_no"]).select(*KEYS, "tags")


def compact(spark: SparkSession, state: str) -> int:
    """Fold version and batches into the next version, then delete those batches; returns the
    version. A batch that arrives meanwhile stays; if the deletion fails, its rows are folded
    again later, with the same result."""
    done = store.folders(spark, f"{state}/batch=*")
    version = store.write_version(last_wins(_rows(spark, state), KEYS, ["batch_ord", "line_no"]), f"{state}/{COMPACTED}")
    store.delete_folders(spark, done)
    return version
