"""Denormalised area and route collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline import fixed
from crestline.functions import derive
from crestline.functions.arrays import has
from crestline.functions.grades import grade_migrate
from crestline.operators.keyed import last_wins
from crestline.schemas import COMMENTS


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def filled(*names: str) -> Column:
    """All required fields present and not empty."""
    cond = F.lit(True)
    for n in names:
        cond = cond & (F.coalesce(F.col(n).cast("string"), F.lit("")) != "")
    return cond


AREA_REQUIRED = ("area_id", "area_name")
ROUTE_REQUIRED = ("route_id", "route_name", "area_id")


def has_excluded_text(route_type: Column) -> Column:
    """Text form only: the type text merely contains an excluded word."""
    t = F.coalesce(route_type, F.lit(""))
    hit = F.lit(False)
    for word in fixed.EXCLUDED_TYPES:
        hit = hit | t.contains(word)
    return hit & ~t.startswith("[")


def load_counts(areas: DataFrame, routes: DataFrame) -> DataFrame:
    """Valid, invalid and skipped rows of a load, one row per collection."""
    a_ok, r_ok = filled(*AREA_REQUIRED), filled(*ROUTE_REQUIRED)
    skip = has_excluded_text(F.col("route_type"))
    a = areas.agg(F.lit("areas").alias("collection"), F.count_if(a_ok).alias("valid"),
                  F.count_if(~a_ok).alias("invalid"), F.lit(0).cast("bigint").alias("skipped"))
    r = routes.agg(F.lit("routes").alias("collection"), F.count_if(r_ok & ~skip).alias("valid"),
                   F.count_if(~r_ok).alias("invalid"), F.count_if(r_ok & skip).alias("skipped"))
    return a.unionByName(r)


def _flat(df: DataFrame, tags: str) -> Column:
    """Flat tags of a map column, or of raw JSON text that holds a list or a map."""
    raw = dict(df.dtypes)[tags] == "string"
    return derive.flat_tags_any(F.col(tags)) if raw else derive.flat_tags(F.col(tags))


def project_areas(areas: DataFrame, tags: str = "area_tags") -> DataFrame:
    """Area documents with defaults; needs a tag column (map or raw JSON text) and ``area_ord``."""
    flat = _flat(areas, tags)
    h = F.coalesce("area_hierarchy", F.array().cast(areas.schema["area_hierarchy"].dataType))
    kept = areas.filter(filled(*AREA_REQUIRED))
    return kept.select(
        _text("area_id"), _text("area_url"), _text("area_name"), _text("area_gps"),
        _text("area_description"), _text("area_getting_there"), flat.alias("area_tags"),
        h.alias("area_hierarchy"), derive.store_path(h).alias("area_hierarchy_path"),
        derive.levels(h).alias("area_hierarchy_levels"), _text("area_access_issues"),
        _text("area_page_views"), _text("area_shared_on"),
        F.coalesce("area_comments", F.array().cast(areas.schema["area_comments"].dataType))
        .alias("area_comments"),
        derive.search_text([F.col("area_name"), F.col("area_description")], [flat])
        .alias("searchable_text"),
        "area_ord",
    )


def attach_area(routes: DataFrame, areas: DataFrame) -> DataFrame:
    """Route -> name and hierarchy of its area; the last area of an id wins,
    a missing area gives empty values. Routes are the left side, so a crowded
    area is split by adaptive execution; Spark broadcasts areas only below its
    own size threshold."""
    dim = last_wins(
        areas.filter(filled(*AREA_REQUIRED)).select("area_id", "area_name", "area_hierarchy", "area_ord"),
        ["area_id"], ["area_ord"]).drop("area_ord")
    empty = F.array().cast(areas.schema["area_hierarchy"].dataType)
    return routes.join(dim, "area_id", "left") \
        .withColumn("area_name", F.coalesce("area_name", F.lit(""))) \
        .withColumn("area_hierarchy", F.coalesce("area_hierarchy", empty))


def loadable(routes: DataFrame) -> DataFrame:
    """The routes that ``project_routes`` keeps."""
    return routes.filter(filled(*ROUTE_REQUIRED) & ~has_excluded_text(F.col("route_type")))


def route_place() -> list[Column]:
    """Path and id, by which documents are clustered, of routes that carry their area."""
    return [derive.store_path(F.col("area_hierarchy")), F.coalesce(F.col("route_id").cast("string"), F.lit(""))]


def project_routes(routes: DataFrame, tags: str = "route_tags", array_types: bool = False) -> DataFrame:
    """Route documents from routes that carry their area; needs a tag column (map
    or raw JSON text). Routes without a comment column have no comments.
    With ``array_types`` the type column is raw JSON text (text or array)."""
    c = F.col
    kept = loadable(routes)
    types = derive.type_list_any(c("route_type")) if array_types else derive.type_list(c("route_type"))
    flat = _flat(routes, tags)
    tag_map = derive.tag_map(c(tags)) if dict(routes.dtypes)[tags] == "string" else c(tags)
    none = F.array().cast(COMMENTS)
    comments = F.coalesce(c("route_comments"), none) if "route_comments" in routes.columns else none
    grade = grade_migrate(c("route_grade"))
    pitches = derive.number(c("route_pitches"), 1.0)
    staged = (
        kept.withColumn("_types", types).withColumn("_flat", flat).withColumn("_grade", grade)
        .withColumn("_stars", derive.number(c("route_stars")))
        .withColumn("_votes", derive.number(c("route_votes")))
    )
    texts = ["route_name", "route_grade", "area_name", "route_description", "route_location", "route_fa"]
    return staged.select(
        _text("route_id"), _text("route_name"), _text("route_url"),
        derive.number(c("route_lr")).alias("route_lr"), _text("route_grade"),
        c("_grade.normalized").alias("normalized_grade"), c("_grade.index").alias("grade_numeric"),
        _text("route_protection_grading"), c("_stars").alias("route_stars"),
        c("_votes").alias("route_votes"),
        derive.quality_score(c("_stars"), c("_votes")).alias("quality_score"),
        c("_types").alias("route_type"),
        F.when(pitches == 0, 1.0).otherwise(pitches).alias("route_pitches"),
        derive.number(c("route_length_ft")).alias("route_length_ft"),
        derive.number(c("route_length_meter")).alias("route_length_meter"),
        _text("route_fa"), _text("route_description"), _text("route_location"),
        _text("route_protection"), _text("route_page_views"), _text("route_shared_on"),
        comments.alias("route_comments"), tag_map.alias("route_tags"), c("_flat").alias("tags"), "area_id", "area_name", "area_hierarchy",
        derive.store_path(c("area_hierarchy")).alias("area_hierarchy_path"),
        (pitches > 1).alias("is_multipitch"), has(c("_types"), "Trad").alias("is_trad"),
        has(c("_types"), "Sport").alias("is_sport"),
        derive.search_text([c(t) for t in texts], [c("_types"), c("_flat")]).alias("searchable_text"),
        "route_ord",
    )


def upsert(stored: DataFrame | None, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Set documents by id: the last incoming row per id replaces the stored one."""
    new = last_wins(incoming, [key], [order])
    if stored is None:
        return new
    return stored.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
