"""Columns derived on flatten and on display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crestline import fixed
from crestline.functions.arrays import TAG_MAP, blank_to_null, empty_tags, or_empty

_NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"


def names(hierarchy: Column) -> Column:
    return F.transform(hierarchy, lambda h: h["area_hierarchy_name"])


def web_path(hierarchy: Column) -> Column:
    """Names in stored order joined by `` / ``."""
    return F.array_join(names(hierarchy), " / ")


def store_path(hierarchy: Column) -> Column:
    """Names by level joined by ``/``; equal levels keep their stored order."""
    keyed = F.transform(
        hierarchy,
        lambda h, i: F.struct(h["level"].alias("level"), i.alias("i"),
                              h["area_hierarchy_name"].alias("name")),
    )
    return F.coalesce(
        F.array_join(F.transform(F.array_sort(keyed), lambda h: h["name"]), "/"), F.lit(""))


def levels(hierarchy: Column) -> Column:
    return F.transform(hierarchy, lambda h: F.coalesce(h["level"], F.lit(0)))


def path_prefixes(hierarchy: Column) -> Column:
    """One struct(level, parent, path) per hierarchy level, root parent ``''``."""
    n = names(hierarchy)
    return F.transform(
        n,
        lambda _, i: F.struct(
            (i + 1).alias("level"),
            F.array_join(F.slice(n, F.lit(1), i), " / ").alias("parent"),
            F.array_join(F.slice(n, F.lit(1), i + 1), " / ").alias("path"),
        ),
    )


def flat_tags(tags: Column) -> Column:
    """Per category the tags, then their ``category:tag`` forms; distinct,
    first occurrence kept."""
    per_category = F.transform(
        F.map_entries(tags),
        lambda e: F.concat(
            e["value"],
            F.transform(e["value"], lambda t: F.concat(e["key"], F.lit(":"), t)),
        ),
    )
    return or_empty(F.array_distinct(F.flatten(per_category)))


def display_tags(tags: Column) -> Column:
    return or_empty(F.flatten(F.map_values(tags)))


def type_list(route_type: Column) -> Column:
    """Comma text -> trimmed types without blanks and excluded types."""
    return or_empty(F.filter(
        F.transform(F.split(route_type, ",", -1), lambda t: F.trim(t)),
        lambda t: (t != "") & ~t.isin(fixed.EXCLUDED_TYPES),
    ))


def type_list_any(raw: Column) -> Column:
    """Same for raw JSON text that holds either a string or an array; array
    items are filtered but not trimmed."""
    as_array = F.from_json(raw, "array<string>")
    is_array = raw.startswith("[")
    keep = F.filter(as_array, lambda t: t.isNotNull() & (t != "") & ~t.isin(fixed.EXCLUDED_TYPES))
    return F.when(is_array, or_empty(keep)).otherwise(type_list(raw))


def number(value: Column, default: float = 0.0) -> Column:
    """Leading numeric prefix as double; null or no number gives the default."""
    text = F.regexp_extract(F.coalesce(value.cast("string"), F.lit("")), _NUMBER, 0)
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(float(default)))


def quality_score(stars: Column, votes: Column) -> Column:
    prior = fixed.PRIOR_STARS * fixed.PRIOR_VOTES
    return (stars * votes + F.lit(prior)) / (votes + F.lit(float(fixed.PRIOR_VOTES)))


def search_text(texts: list[Column], arrays: list[Column]) -> Column:
    """Non-empty parts joined by a blank, lower case."""
    parts = [blank_to_null(t) for t in texts]
    parts += [F.filter(or_empty(a), lambda x: x != "") for a in arrays]
    return F.lower(F.concat_ws(" ", *parts))


def tag_map(raw: Column) -> Column:
    """Raw JSON text -> category map; list-shaped or broken text = empty map. A
    single text in place of a list is a list of one."""
    def items(value: Column) -> Column:
        one = F.when(value != "", F.array(value))
        return or_empty(F.coalesce(F.when(value.startswith("["), F.from_json(value, "array<string>")), one))

    categories = F.transform_values(F.from_json(raw, "map<string,string>"), lambda _, v: items(v))
    return F.when(raw.startswith("{"), F.coalesce(categories, empty_tags())).otherwise(empty_tags())


def flat_tags_any(raw: Column) -> Column:
    """Flat tags of raw JSON text: a list passes as it is, a map is flattened."""
    listed = F.filter(F.from_json(raw, "array<string>"), lambda t: t.isNotNull() & (t != ""))
    return F.when(raw.startswith("["), or_empty(F.array_distinct(listed))).otherwise(flat_tags(tag_map(raw)))


def month_start(shared_on: Column) -> Column:
    """``Mon, YYYY`` -> first day of that month, null otherwise."""
    return F.to_date(F.try_to_timestamp(shared_on, F.lit("MMM, yyyy")))


def views_number(views: Column) -> Column:
    return F.replace(views, F.lit(","), F.lit("")).try_cast("bigint")

