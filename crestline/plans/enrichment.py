"""Enrichment job: nested snapshot in, tagged flat tables and summary out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline import schemas
from crestline.functions import derive
from crestline.operators import enrich, extract
from crestline.session import written_table
from crestline.sources import lines, nested, store

PART = 1000  # routes of an area in one record


def typed(areas: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat tables from files -> typed rule inputs: tag maps, numbers, ordinals.
    Parts of one area (records of one folder with a ``part``) have one ordinal."""
    order, in_area = _ordinals(areas)
    areas = areas.withColumn("area_tags", derive.tag_map(F.col("area_tags"))).withColumn("area_ord", order)
    routes = (
        routes.withColumn("route_tags", derive.tag_map(F.col("route_tags")))
        .withColumn("route_votes", F.col("route_votes").try_cast("int"))
        .withColumn("route_stars", F.col("route_stars").try_cast("double"))
        .withColumn("area_ord", order).withColumn("route_ord", in_area)
    )
    return areas, routes


def run_versions(spark: SparkSession, nested_areas: DataFrame, result_paths: str | Sequence[str], base: str) -> int:
    """Enrich and write the tagged nested records as the next version of ``base``, with the tags of the
    version before; that one stays as a backup. Returns the number of the version."""
    found = store.versions(spark, base)
    previous = nested.snapshot_or_empty(spark, f"{base}/v={found[-1] if found else 0}", multi_line=False)
    areas, routes, _ = run(spark, nested_areas, result_paths, previous)
    first = F.coalesce(F.col("part"), F.lit(0)) * PART + F.col("route_pos") if "part" in routes.columns else F.col("route_pos")
    fields = [c for c in schemas.ROUTE_COLUMNS if c in routes.columns and c not in ("manual_tags", "llm_tags")]
    records = extract.nest(
        areas.select([F.to_json(c).alias(c) if c == "area_tags" else F.col(c) for c in schemas.AREA_COLUMNS]),
        routes.select("area_id", first.alias("route_pos"), *[
            F.to_json(c).alias(c) if c == "route_tags" else F.col(c) for c in fields]), PART)
    version = store.next_version(spark, base)
    store.write_json(records, f"{base}/v={version}")
    return version


def _ordinals(areas: DataFrame) -> tuple[Column, Column]:
    """(order of an area, order of a route inside its area)."""
    path, pos = F.col("file_path"), F.col("area_pos")
    part = F.col("part") if "part" in areas.columns else F.lit(None).cast("int")
    start = F.struct(F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("row"))
    folder = F.regexp_replace(path, "/[^/]*$", "")
    order = F.struct(*[F.col(c) for c in ("file_ord",) if c in areas.columns],
                     F.when(part.isNull(), path).otherwise(folder).alias("file"),
                     F.when(part.isNull(), pos).otherwise(start).alias("pos"), F.col("area_id").alias("id"))
    return order, F.coalesce(part, F.lit(0)).cast("bigint") * (1 << 32) + F.col("route_pos")


def run(spark: SparkSession, nested_areas: DataFrame, result_paths: str | Sequence[str],
        previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(areas, routes, summary). ``previous`` is an earlier tagged nested snapshot."""
    areas, routes = typed(*nested.flatten_nested(nested_areas))
    # narrow; read for areas and for routes
    results = written_table(enrich.latest_results(enrich.parse_results(lines.read_lines(spark, result_paths))), "results")
    old_areas = old_routes = None
    if previous is not None:
        old_areas, old_routes = typed(*nested.flatten_nested(previous))
    areas, routes = enrich.enrich(areas, routes, results, old_areas, old_routes)
    return areas, routes, enrich.run_summary(routes, areas)
