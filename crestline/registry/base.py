"""Query registry and the derived frames most queries start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.functions import derive
from crestline.operators import enrich, flatten
from crestline.plans import mapping as m
from crestline.registry.sql import full
from crestline.session import scratch_path
from crestline.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable; ``sql`` is the body below the shared CTEs."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = full(sql)
        return fn
    return add


def joined(arr: Column, sep: str = ",") -> Column:
    return F.array_join(arr, sep)


def long_tags(df: DataFrame, key: str, tags: str = "route_tags") -> DataFrame:
    """(key, category, tags text), one row per category."""
    return df.select(key, F.explode(tags).alias("category", "_t")).select(
        key, "category", joined(F.col("_t")).alias("tags"))


def ruled(spark, sf) -> DataFrame:
    """Routes with votes, histogram and rule tags."""
    return enrich.with_manual_tags(m.routes(spark, sf, with_ratings=True))


def listing(spark, sf) -> DataFrame:
    """Routes of the in-memory listing: rule tags plus area context."""
    r = ruled(spark, sf).withColumnRenamed("manual_tags", "route_tags")
    return flatten.attach_area(r, m.areas(spark, sf)).withColumn(
        "area_path", derive.web_path(F.col("area_hierarchy")))


def _route_rows(spark, sf) -> DataFrame:
    """Routes with their area and, joined last, their text."""
    r = enrich.with_manual_tags(m.routes(spark, sf, with_ratings=True)).withColumnRenamed("manual_tags", "route_tags")
    return m.with_texts(flatten.attach_area(r, m.areas(spark, sf)), spark, sf)


def route_docs(spark, sf) -> DataFrame:
    """Flattened route documents of the store."""
    return flatten.project_routes(_route_rows(spark, sf))


_STORED: dict[tuple[str, str], str] = {}


def stored_routes(spark, sf) -> DataFrame:
    """The route documents as a stored collection, clustered by path and id; written
    once for each application and table folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        base = scratch_path(spark, "routes")
        store.write_version(_route_rows(spark, sf), base, flatten.route_place(), flatten.project_routes)
        _STORED[key] = base
    return store.read_version(spark, _STORED[key])


def area_docs(spark, sf) -> DataFrame:
    """Flattened area documents; approach tags as their tag map."""
    from crestline import fixed
    from crestline.functions.arrays import empty_tags

    a = m.areas(spark, sf)
    tags = F.when(F.col("approach").isNull(), empty_tags()).otherwise(
        F.create_map(F.lit(fixed.APPROACH), F.array("approach")))
    return flatten.project_areas(a.withColumn("area_tags", tags))
