"""Work ledger and resume: tables plus anti joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline import fixed
from crestline.operators.keyed import chosen, last_wins

STATES = ("pending", "processing", "completed", "failed")


def add_files(ledger: DataFrame, files: DataFrame, added_at: Column) -> DataFrame:
    """New files enter as pending; files already listed are left alone."""
    new = files.select("input_file").distinct().join(ledger, "input_file", "left_anti").select(
        "input_file", F.lit("pending").alias("status"), added_at.alias("added_at"),
        F.lit(None).cast("string").alias("batch_id"), F.lit(None).cast("string").alias("error"))
    return ledger.unionByName(new)


def status_counts(ledger: DataFrame, column: str = "status") -> DataFrame:
    return ledger.groupBy(column).agg(F.count("*").alias("n"))


def remaining(todo: DataFrame, checkpoint: DataFrame, base_url: str) -> DataFrame:
    """URLs not processed yet; a checkpoint of another start URL is ignored."""
    done = checkpoint.filter(F.col("base_url") == base_url).select(F.explode("processed_urls").alias("url"))
    return chosen(todo, done, "url", "left_anti")


def latest_fetch(fetches: DataFrame) -> DataFrame:
    """Newest fetch per (url, data_type)."""
    return last_wins(fetches, ["url", "data_type"], ["fetched_at", "fetch_id"])


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def is_fresh(fetched_at: Column, now: Column, days: int = fixed.FRESH_DAYS,
             no_cache: bool = False) -> Column:
    """At most ``days`` whole days old; ``no_cache`` accepts nothing."""
    if no_cache:
        return F.lit(False)
    return F.floor((_micros(now) - _micros(fetched_at)) / F.lit(86400 * 10**6)) <= days


def cache_key(url: Column) -> Column:
    return F.md5(url)


def only_urls(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """Given URLs only, no discovery."""
    return pages.join(urls, "url", "left_semi")


def good_and_failed(records: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Failed items leave the main table, the rest goes on."""
    return records.filter(F.col(error).isNull()), records.filter(F.col(error).isNotNull())
