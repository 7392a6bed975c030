"""Enrichment that follows result batches: what a batch touches is merged again, the rest stays.

A catalogue below one folder, all collections in parts:

* ``areas`` and ``routes``: the rows before any result (earlier tags merged, rule tags set) with the latest
  result of each in ``result_tags``; both laid out by area, so a change of an area finds its routes.
* ``places``: route id to area id, laid out by route id, so a result finds the parts of its routes.
* ``enriched_areas`` and ``enriched_routes``: what the whole enrichment gives, laid out by area.

A batch changes the routes that it names, the areas that it names, and, where the tags that routes inherit
differ, all routes of such an area. Only the parts that hold these rows are read, and only parts with rows
that differ are written. State follows the enriched rows and areas come last, because they tell which areas
changed: a batch that died is applied again as a whole, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline import fixed
from crestline.functions.arrays import tags_in
from crestline.operators import enrich
from crestline.session import written_table
from crestline.sources import store

INHERITED = (fixed.APPROACH,)


def _key(*columns: str) -> Column:
    return F.md5(F.to_json(F.struct(*columns)))


def _enriched_areas(areas: DataFrame) -> DataFrame:
    return enrich.apply_area_tags(areas, "result_tags")


def _enriched_routes(routes: DataFrame, areas: DataFrame) -> DataFrame:
    tagged = enrich.apply_route_tags(routes, "result_tags")
    return enrich.guard_stick_clip(enrich.inherit_tags(tagged, _enriched_areas(areas), INHERITED))


def begin(areas: DataFrame, routes: DataFrame, base: str, previous_areas: DataFrame | None = None,
          previous_routes: DataFrame | None = None, parts: int = store.PARTS) -> None:
    """Write the catalogue ``base`` from flat areas and routes (both with a tag map column) without results."""
    if previous_areas is not None:
        areas = enrich.merge_area_snapshot(areas, previous_areas)
    if previous_routes is not None:
        routes = enrich.merge_route_snapshot(routes, previous_routes)
    none = F.lit(None).cast(areas.schema["area_tags"].dataType).alias("result_tags")
    areas = written_table(areas.select(_key("area_ord", "area_id").alias("row_key"), "*", none), "areas")
    routes = written_table(enrich.with_manual_tags(routes).select(
        _key("area_id", "area_ord", "route_ord", "route_id").alias("row_key"), "*", none), "routes")
    places = routes.select("route_id", "area_id").distinct().select(_key("route_id", "area_id").alias("row_key"), "*")
    for rows, name, by in ((areas, "areas", "area_id"), (routes, "routes", "area_id"), (places, "places", "route_id"),
                           (_enriched_areas(areas), "enriched_areas", "area_id"),
                           (_enriched_routes(routes, areas), "enriched_routes", "area_id")):
        store.upsert_parts(rows, f"{base}/{name}", "row_key", by=by, parts=parts)


def apply_batch(spark: SparkSession, base: str, results: DataFrame) -> dict[str, int]:
    """Merge one batch of latest results (kind, entity_id, tags; one row per id) into the catalogue ``base``. They
    replace earlier results of their ids; ids that the catalogue doesn't have are left out. Returns how many
    areas and routes were merged again and how many parts of enriched rows were written."""
    new = written_table(results.select("kind", "entity_id", F.col("tags").alias("_new")), "batch")
    for_areas = new.filter("kind = 'area'").select(F.col("entity_id").alias("area_id"), "_new")
    for_routes = new.filter("kind = 'route'").select(F.col("entity_id").alias("route_id"), "_new")

    def part(name: str, keys: DataFrame) -> DataFrame:
        return store.read_parts(spark, f"{base}/{name}", keys)

    named = part("areas", for_areas.select("area_id")).join(for_areas, "area_id")
    before, after = F.coalesce("result_tags", "area_tags"), F.col("_new")
    differs = F.exists(F.array(*[tags_in(before, c) != tags_in(after, c) for c in INHERITED]), lambda d: d)
    named = written_table(named.withColumn("_differs", differs), "named-areas")
    changed = named.filter("_differs").select("area_id").distinct()
    areas = named.drop("_differs").withColumn("result_tags", F.col("_new")).drop("_new")

    places = part("places", for_routes.select("route_id")).join(for_routes, "route_id", "left_semi")
    homes = written_table(places.select("area_id").unionByName(changed).distinct(), "homes")
    routes = part("routes", homes).join(for_routes, "route_id", "left").join(
        changed.withColumn("_moved", F.lit(True)), "area_id", "left").filter("_new IS NOT NULL OR _moved")
    routes = written_table(routes.withColumn("_named", F.col("_new").isNotNull()).withColumn(
        "result_tags", F.coalesce("_new", "result_tags")).drop("_new", "_moved"), "touched-routes")
    # the areas of touched routes as they are now
    around = part("areas", homes).join(homes, "area_id", "left_semi").join(for_areas, "area_id", "left").withColumn(
        "result_tags", F.coalesce("_new", "result_tags")).drop("_new")

    merged = _enriched_routes(routes.drop("_named"), around)
    written = len(store.upsert_parts(merged, f"{base}/enriched_routes", "row_key", by="area_id", backup=False))
    written += len(store.upsert_parts(_enriched_areas(areas), f"{base}/enriched_areas", "row_key", by="area_id", backup=False))
    store.upsert_parts(routes.filter("_named").drop("_named"), f"{base}/routes", "row_key", by="area_id", backup=False)
    store.upsert_parts(areas, f"{base}/areas", "row_key", by="area_id", backup=False)
    return {"areas": areas.count(), "routes": routes.count(), "parts": written}


def enriched(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(areas, routes) of the catalogue."""
    return tuple(store.read_parts(spark, f"{base}/{name}").drop("row_key") for name in ("enriched_areas", "enriched_routes"))
