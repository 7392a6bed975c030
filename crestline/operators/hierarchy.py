"""Area paths and trees as edge tables.

Trees stay in edge form (child, parent): a parent's children are never
gathered into one row, so the widest node costs no more than its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.functions.derive import names, path_prefixes
from crestline.operators.keyed import first_wins


def path_edges(areas: DataFrame) -> DataFrame:
    """Distinct (parent_path, path) with the place of first occurrence
    (area_ord, level); the root parent is ``''``."""
    exploded = areas.select("area_ord", F.explode(path_prefixes(F.col("area_hierarchy"))).alias("p"))
    return exploded.groupBy(F.col("p.parent").alias("parent_path"), F.col("p.path").alias("path")).agg(
        F.min(F.struct("area_ord", "p.level")).alias("first_seen"))


def area_paths(areas: DataFrame) -> DataFrame:
    """Distinct paths; ``path_ord`` = (first use of the parent, first use of the path)."""
    edges = path_edges(areas)
    parents = edges.groupBy("parent_path").agg(F.min("first_seen").alias("parent_seen"))
    return edges.join(parents, "parent_path").groupBy("path").agg(
        F.min(F.struct("parent_seen", "first_seen")).alias("path_ord"))


def children_of(areas: DataFrame, parent: str) -> DataFrame:
    return path_edges(areas).filter(F.col("parent_path") == parent).select("path", "first_seen")


def last_name(hierarchy: Column, back: int = 1) -> Column:
    """Name ``back`` levels from the end, null when there is none."""
    n = names(hierarchy)
    return F.get(n, F.size(n) - back)


def tree_by_depth(areas: DataFrame) -> DataFrame:
    """(area_id, parent_id): the parent's name is the last hierarchy name and
    its depth is one less; first by name wins; no match makes a root."""
    depth = F.coalesce(F.size("area_hierarchy"), F.lit(0))
    keyed = areas.select("area_id", "area_name", depth.alias("depth"),
                         last_name(F.col("area_hierarchy")).alias("up_name"))
    parents = first_wins(
        keyed.select(F.col("area_name").alias("up_name"), (F.col("depth") + 1).alias("depth"),
                     F.col("area_id").alias("parent_id")),
        ["up_name", "depth"], ["parent_id"])
    return keyed.join(parents, ["up_name", "depth"], "left").select(
        "area_id", "area_name", "parent_id", F.col("parent_id").isNull().alias("is_root"))


def tree_by_name(areas: DataFrame) -> DataFrame:
    """(area_id, parent_id): the parent's last hierarchy name is the area's
    second last; areas without such a name are roots, unmatched ones drop out."""
    keyed = areas.select("area_id", "area_name", "area_ord",
                         last_name(F.col("area_hierarchy"), 1).alias("own"),
                         last_name(F.col("area_hierarchy"), 2).alias("up"))
    parents = first_wins(keyed.select(F.col("own").alias("up"), F.col("area_id").alias("parent_id"),
                                      "area_ord"), ["up"], ["area_ord"]).drop("area_ord")
    has_up = F.coalesce("up", F.lit("")) != ""
    roots = keyed.filter(~has_up).select(
        "area_id", "area_name", F.lit(None).cast("string").alias("parent_id"), F.lit(True).alias("is_root"))
    linked = keyed.filter(has_up).join(parents, "up").select(
        "area_id", "area_name", "parent_id", F.lit(False).alias("is_root"))
    return roots.unionByName(linked)


def descendants(areas: DataFrame, path: str) -> DataFrame:
    """Areas at or below a path, by whole segments."""
    p = F.array_join(names(F.col("area_hierarchy")), " / ")
    return areas.filter((p == path) | p.startswith(path + " / "))


def toggle_selection(selected: list[str], path: str) -> list[str]:
    """Remove the path when selected, append it otherwise."""
    return [s for s in selected if s != path] if path in selected else [*selected, path]


def remove_selection(selected: list[str], path: str) -> list[str]:
    return [s for s in selected if s != path]
