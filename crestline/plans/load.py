"""Load job: flat tables into stored, versioned collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.operators import flatten
from crestline.operators.keyed import last_wins
from crestline.sources import store


def run(spark: SparkSession, areas: DataFrame, routes: DataFrame, base: str, force: bool = False,
        skip_areas: bool = False) -> DataFrame:
    """Write the next versions of ``<base>/areas`` and ``<base>/routes``; one row per
    collection with valid, invalid, skipped and stored rows. Filled targets need
    ``force``. With ``skip_areas`` routes take their area from the stored collection.

    Collections are clustered by path and id, so path ranges and ids reach few files.
    """
    counts = flatten.load_counts(areas, routes)
    if not skip_areas:
        store.upsert_version(flatten.project_areas(areas), f"{base}/areas", "area_id", "area_ord", force,
                             ["area_hierarchy_path", "area_id"])
    known = store.area_source(spark, areas, f"{base}/areas", skip_areas)
    rows = flatten.attach_area(flatten.loadable(routes), known)
    stored_rows = f"{base}/routes"
    if store.versions(spark, stored_rows):
        store.upsert_version(flatten.project_routes(rows), stored_rows, "route_id", "route_ord", force, ["area_hierarchy_path", "route_id"])
    else:  # no document to replace: derived texts are made last
        store.write_version(last_wins(rows, ["route_id"], ["route_ord"]), stored_rows, flatten.route_place(), flatten.project_routes)
    stored = [store.read_version(spark, f"{base}/{name}").agg(F.lit(name).alias("collection"), F.count("*").alias("stored"))
              for name in ("areas", "routes")]
    return counts.join(stored[0].unionByName(stored[1]), "collection")
