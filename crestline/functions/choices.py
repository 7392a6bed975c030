"""What a choice changes, as columns: file places, grade ranges, sort keys, selected paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crestline import fixed
from crestline.functions.arrays import strings


def located(base: Column, name: Column) -> Column:
    """Base folder and file name joined by one slash; full locations pass."""
    joined = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(name, "^/+", ""))
    return F.when(name.contains("://"), name).otherwise(joined)


def _rank(grade: Column) -> Column:
    """Place in the web scale, -1 for unknown grades."""
    return F.array_position(strings(fixed.WEB_GRADES), grade) - 1


def coupled_range(changed: Column, value: Column, low: Column, high: Column) -> Column:
    """struct(low, high) after ``value`` was chosen as ``changed`` ('min', else the maximum): the other bound
    follows where the range would be empty."""
    lifted = F.when(_rank(value) <= _rank(high), high).otherwise(value)
    lowered = F.when(_rank(value) >= _rank(low), low).otherwise(value)
    is_min = changed == "min"
    return F.struct(F.when(is_min, value).otherwise(lowered).alias("low"), F.when(is_min, lifted).otherwise(value).alias("high"))


def toggled_sort(key: Column, direction: Column, chosen: Column) -> Column:
    """struct(key, direction): the same key flips, a new one starts descending."""
    flips = (key == chosen) & (direction == "desc")
    return F.struct(chosen.alias("key"), F.when(flips, "asc").otherwise("desc").alias("direction"))


def toggled_path(selected: Column, path: Column) -> Column:
    """Without the path where it is selected, else with it at the end."""
    return F.when(F.array_contains(selected, path), F.array_remove(selected, path)).otherwise(F.array_append(selected, path))
