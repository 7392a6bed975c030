"""Keep trad and sport routes, drop emptied areas, report statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.functions.tags import eligible


def reduce_nested(areas: DataFrame) -> DataFrame:
    """Nested areas: filter the embedded routes; areas left without any are dropped.
    An area may be cut into parts: one eligible route in any part keeps its first
    part, which carries the area's own fields."""
    kept = F.filter("routes", lambda r: r["route_type"].isNotNull()
                    & ~r["route_type"].startswith("[") & eligible(r["route_type"]))
    reduced = areas.withColumn("routes", kept)
    filled = reduced.filter(F.size("routes") > 0)
    if "part" not in areas.columns:
        return filled
    key = [c for c in ("state", "area_id") if c in areas.columns]
    emptied = reduced.filter((F.size("routes") == 0) & (F.col("part") == 0))
    return filled.unionByName(emptied.join(filled.filter(F.col("part") > 0).select(*key), key, "left_semi"))


def reduce_flat(areas: DataFrame, routes: DataFrame, key: str = "area_id") -> tuple[DataFrame, DataFrame]:
    kept = routes.filter(eligible(F.col("route_type")))
    return areas.join(kept.select(key), key, "left_semi"), kept


def _percent(part: str, whole: str):
    return F.coalesce(F.try_divide(F.col(part) * F.lit(100.0), F.col(whole)), F.lit(0.0))


def reduction_stats(areas: DataFrame, routes: DataFrame, key: str = "area_id",
                    group: str = "state") -> DataFrame:
    """Per group: routes and areas, total, kept and percent. Routes are folded
    per area before areas are counted, so a crowded area costs one row."""
    per_area = routes.groupBy(group, key).agg(
        F.count("*").alias("_n"), F.count_if(eligible(F.col("route_type"))).alias("_kept"))
    r = per_area.groupBy(group).agg(
        F.sum("_n").alias("routes_total"), F.sum("_kept").alias("routes_kept"),
        F.count_if(F.col("_kept") > 0).alias("areas_kept"))
    a = areas.groupBy(group).agg(F.count("*").alias("areas_total"))
    zero = F.lit(0).cast("bigint")
    return a.join(r, group, "left").select(
        group, *[F.coalesce(c, zero).alias(c)
                 for c in ("routes_total", "routes_kept", "areas_total", "areas_kept")],
    ).withColumn("routes_pct", _percent("routes_kept", "routes_total")) \
        .withColumn("areas_pct", _percent("areas_kept", "areas_total"))


def with_grand_total(stats: DataFrame, group: str = "state", label: str = "Total") -> DataFrame:
    """Adds the total row; percentages are recomputed from the sums."""
    sums = [c for c in stats.columns if c != group and not c.endswith("_pct")]
    out = stats.rollup(group).agg(*[F.sum(c).alias(c) for c in sums], F.grouping(group).alias("_g"))
    out = out.withColumn(group, F.when(F.col("_g") == 1, label).otherwise(F.col(group))).drop("_g")
    return out.withColumn("routes_pct", _percent("routes_kept", "routes_total")) \
        .withColumn("areas_pct", _percent("areas_kept", "areas_total"))
