"""Null-safe array and map helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG_MAP = "map<string,array<string>>"


def _quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def strings(values: Iterable[str]) -> Column:
    """Literal ``array<string>`` (typed also when empty). Parsed from one text,
    which is much cheaper to build than one column per element."""
    text = ", ".join(_quoted(v) for v in values)
    return F.expr(f"array({text})") if text else F.array().cast("array<string>")


def literal_map(entries: dict) -> Column:
    """Literal map from strings to strings, numbers or string lists."""
    def value(v) -> str:
        return f"array({', '.join(map(_quoted, v))})" if isinstance(v, (list, tuple)) else _quoted(v)

    return F.expr("map(" + ", ".join(f"{_quoted(k)}, {value(v)}" for k, v in entries.items()) + ")")


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def empty_tags() -> Column:
    return F.from_json(F.lit("{}"), TAG_MAP)


def or_empty(arr: Column) -> Column:
    return F.coalesce(arr, empty_strings())


def overlaps(arr: Column, values: Iterable[str]) -> Column:
    """True when ``arr`` holds one of the values; a null on either side is False."""
    return F.coalesce(F.arrays_overlap(arr, strings(values)), F.lit(False))


def has(arr: Column, value) -> Column:
    return F.coalesce(F.array_contains(arr, value), F.lit(False))


def has_all(arr: Column, values: Iterable[str]) -> Column:
    return F.size(F.array_except(strings(values), or_empty(arr))) == 0


def tags_in(tags: Column, category: str) -> Column:
    """Tags of one category, missing category = empty array."""
    return or_empty(F.try_element_at(tags, F.lit(category)))


def union_sorted(a: Column, b: Column) -> Column:
    """Set union in canonical (sorted) order; null counts as empty."""
    return F.array_sort(F.array_union(or_empty(a), or_empty(b)))


def position(values: list[str], item: Column) -> Column:
    """0-based index of ``item`` in a literal list, null when absent."""
    index = F.expr(f"array(NULL, {', '.join(str(i) for i in range(len(values)))})")
    return F.get(index, F.array_position(strings(values), item).cast("int"))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)
