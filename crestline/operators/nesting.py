"""Whole trees as nested records of bounded size.

A branch of at most ``per_part`` areas is one JSON value. Areas with more below them are rows of their own,
whose children follow in parts: by the number of areas in front of a child below the same parent, which the
interval labels give without sorting or numbering the children of one node together.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.operators.intervals import MAX_DEPTH, intervals, paths
from crestline.session import written_table

PER_PART = 1000
_BRANCH = pa.schema([("area_id", pa.string()), ("branch", pa.string()), ("inside", pa.string())])


def _branch(rows: pa.Table) -> pa.Table:
    """One branch as JSON, children in order; its areas come from one group of bounded size."""
    nodes = sorted(rows.to_pylist(), key=lambda r: r["first"])
    made = {}
    for r in nodes:
        made[r["area_id"]] = node = {"area_id": r["area_id"], "area_name": r["area_name"], "children": []}
        if r["parent_id"] in made:
            made[r["parent_id"]]["children"].append(node)
    top = made[nodes[0]["area_id"]]
    texts = [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in (top, top["children"])]
    return pa.Table.from_arrays([pa.array([v]) for v in (top["area_id"], *texts)], schema=_BRANCH)


def nested_roots(nodes: DataFrame, per_part: int = PER_PART, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``nodes`` (area_id, area_name, parent_id) as rows (area_id, area_name, parent_id, part, n_areas, children):
    every root, and every area with more than ``per_part`` areas at or below it. ``children`` is a JSON array
    of nested areas; one that has rows of its own is there without children. A part holds the children that
    begin within ``per_part`` areas, so it has less than twice as many."""
    reached = written_table(paths(nodes, max_depth).select("area_id", "path"), "tree-paths")
    labels = written_table(intervals(nodes, max_depth).withColumn("size", F.col("last") - F.col("first") + 1), "tree-labels")
    large = labels["size"] > per_part
    # the topmost area on the path of each that is small enough
    small = labels.filter(~large).select("area_id")
    tops = reached.select("area_id", F.posexplode("path.id").alias("pos", "above")).join(
        small.withColumnRenamed("area_id", "above"), "above").groupBy("area_id").agg(F.min_by("above", "pos").alias("top"))
    branches = labels.join(tops, "area_id").select("top", "area_id", "area_name", "parent_id", "first").groupBy("top").applyInArrow(
        _branch, "area_id string, branch string, inside string")
    bare = F.to_json(F.struct("area_id", "area_name", F.array().cast("array<string>").alias("children")), {"ignoreNullFields": "false"})
    values = labels.join(branches, "area_id", "left").filter(F.col("branch").isNotNull() | large).withColumn(
        "branch", F.coalesce("branch", bare))
    holder = labels.filter(large).select(F.col("area_id").alias("parent_id"), F.col("first").alias("_start"))
    parts = values.join(holder, "parent_id").withColumn(
        "part", F.floor((F.col("first") - F.col("_start") - 1) / per_part).cast("int")).groupBy("parent_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("first", "branch"))).alias("_c"), F.sum("size").alias("n_areas"))
    texts = F.concat(F.lit("["), F.array_join(F.transform("_c", lambda c: c["branch"]), ","), F.lit("]"))
    wide = parts.select(F.col("parent_id").alias("area_id"), "part", "n_areas", texts.alias("children")).join(
        labels.select("area_id", "area_name", "parent_id"), "area_id")
    whole = values.filter(F.col("parent_id").isNull() & (F.col("size") <= per_part)).select(
        "area_id", "area_name", "parent_id", F.lit(0).alias("part"), (F.col("size") - 1).alias("n_areas"), F.col("inside").alias("children"))
    columns = ["area_id", "area_name", "parent_id", "part", "n_areas", "children"]
    return wide.select(columns).unionByName(whole.select(columns))
