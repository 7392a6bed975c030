"""Filtered route listing: area selection, filter, sort, first rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline import fixed
from crestline.operators.filters import ListingFilter, listing_predicate, path_prefix
from crestline.operators.sorting import LISTING_DEFAULT, first_rows, listing_order


def run(routes: DataFrame, filters: ListingFilter = ListingFilter(), areas: list[str] | None = None,
        option: str = LISTING_DEFAULT[0], reverse: bool = LISTING_DEFAULT[1],
        visible: int = fixed.PAGE_SIZE_WEB, route_id: str | None = None) -> DataFrame:
    """Routes need a tag map, ``area_path`` and the input ordinals. A single
    selected route skips filter and sort."""
    if route_id is not None:
        return routes.filter(F.col("route_id") == route_id)
    chosen = routes.filter(path_prefix(F.col("area_path"), areas or [])).filter(listing_predicate(filters))
    return first_rows(chosen, listing_order(option, reverse), visible)
