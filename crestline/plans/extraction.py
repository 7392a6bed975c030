"""Extraction job: pages into nested area records, resumed where it stopped."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline import schemas
from crestline.operators import extract, ledger
from crestline.operators.keyed import chosen
from crestline.session import written_table
from crestline.sources import nested, store
from crestline.sources.html import with_elements


def run(spark: SparkSession, area_pages: DataFrame, route_pages: DataFrame, stats_pages: DataFrame, base: str,
        start_url: str) -> DataFrame:
    """Records of the area pages (url, html) that no earlier run of ``start_url`` has finished, written as
    the next version of ``<base>/records``; then one checkpoint row for each page. A page that can't be
    read gets no row, so the next run takes it again. Returns the URLs of this run with ``done``.

    Records are written before the checkpoint: a run that dies in between repeats its pages, which
    have the same ids.
    """
    todo = ledger.remaining(area_pages, checkpoint(spark, base), start_url)
    good, failed = ledger.good_and_failed(with_elements(todo))
    areas, listed = extract.areas_and_lists(good)
    wanted_routes, wanted_stats = pages_of(listed, route_pages, stats_pages)
    records = extract.nest(areas, extract.routes_of_areas(
        listed, with_elements(wanted_routes), with_elements(wanted_stats, tags=extract.STATS_TAGS)))
    version = store.next_version(spark, f"{base}/records")
    store.write_json(records, f"{base}/records/v={version}")
    todo = written_table(good.select("url", F.lit(True).alias("done")).unionByName(
        failed.select("url", F.lit(False).alias("done"))), "extracted")
    todo.filter("done").select(F.lit(start_url).alias("base_url"), F.array("url").alias("processed_urls"),
                F.current_timestamp().alias("timestamp")).write.mode("append").parquet(f"{base}/checkpoint")
    return todo


def pages_of(listed: DataFrame, route_pages: DataFrame, stats_pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The route and stats pages (url, html) of listed routes, found by URL before any page is parsed: a resumed run
    parses what its own areas list."""
    urls = listed.select(F.col("route_url").alias("url")).distinct()
    stats = urls.select(extract.stats_url(F.col("url")).alias("url"))
    return chosen(route_pages, urls, "url", "left_semi"), chosen(stats_pages, stats, "url", "left_semi")


def checkpoint(spark: SparkSession, base: str) -> DataFrame:
    """Checkpoint rows (base_url, processed_urls, timestamp) of all runs; none before the first."""
    try:
        return spark.read.schema(schemas.CHECKPOINT).parquet(f"{base}/checkpoint")
    except AnalysisException:
        return spark.createDataFrame([], schemas.CHECKPOINT)


def records(spark: SparkSession, base: str) -> DataFrame:
    """Nested records of all runs."""
    return nested.read_nested(spark, f"{base}/records", multi_line=False)
