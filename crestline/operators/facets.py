"""Tag facets in long form: one row per (category, tag)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline import fixed


def facets(routes: DataFrame, tags: str = "route_tags") -> DataFrame:
    """Distinct tags per category with their number of routes."""
    pairs = routes.select(F.explode(tags).alias("category", "_tags")).select(
        "category", F.explode(F.array_distinct("_tags")).alias("tag"))
    return pairs.groupBy("category", "tag").agg(F.count("*").alias("n_routes"))


def facet_menu(spark) -> DataFrame:
    """Curated menu; a fixed table of a few dozen rows."""
    rows = [(c, i, t, label, always) for i, (c, t, label, always) in enumerate(fixed.FACET_MENU)]
    return spark.createDataFrame(rows, "category string, ord int, tag string, label string, always boolean")


def curated_facets(routes: DataFrame, tags: str = "route_tags") -> DataFrame:
    """Menu entries that occur in the data or are always shown, in menu order.
    Categories without entries vanish because they have no rows."""
    menu = facet_menu(routes.sparkSession)
    found = facets(routes, tags).select("category", "tag", F.lit(True).alias("found"))
    # found is cut to the menu's pairs first, so the menu is the only small side
    found = found.join(F.broadcast(menu.select("category", "tag")), ["category", "tag"], "left_semi")
    return menu.join(found, ["category", "tag"], "left").filter(
        F.col("always") | F.coalesce("found", F.lit(False))).select("category", "ord", "tag", "label")


def selected_and_available(selection: DataFrame, routes: DataFrame, tags: str = "route_tags") -> DataFrame:
    """Selected (category, tag) rows that occur among the routes."""
    return selection.join(facets(routes, tags).select("category", "tag"), ["category", "tag"], "left_semi")
