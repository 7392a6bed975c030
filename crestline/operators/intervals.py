"""Interval labels of a tree: what lies below a node is a range of numbers.

Nodes are numbered in preorder (children by name, then id). A node's ``first`` is its number and its ``last``
the largest number below it, so a branch is ``first BETWEEN a.first AND a.last``: two literals that reach the
scan of any table that carries the number and is sorted by it. Branches with equal names stay apart, unlike
with prefixes of path text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.operators.ordinal import global_row_number
from crestline.session import drop_tables, written_table

MAX_DEPTH = 100


def paths(nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``nodes`` (area_id, area_name, parent_id; null for roots) with ``path``, (name, id) from the root on. One join
    a level, whose rows are written; nodes in cycles or below unknown parents are reached from no root and
    left out. A deeper tree is an error."""
    nodes = written_table(nodes.select("area_id", "area_name", "parent_id"), "nodes")
    own = F.struct(F.coalesce("area_name", F.lit("")).alias("name"), F.col("area_id").alias("id"))
    level = written_table(nodes.filter("parent_id IS NULL").withColumn("path", F.array(own)), "level")
    out = level
    for _ in range(max_depth):
        above = level.select(F.col("area_id").alias("parent_id"), F.col("path").alias("_above"))
        # children on the left: those of one wide node may be split
        level = written_table(nodes.filter("parent_id IS NOT NULL").join(above, "parent_id").select(
            "area_id", "area_name", "parent_id", F.concat("_above", F.array(own)).alias("path")), "level")
        if level.isEmpty():
            drop_tables(nodes)
            return out
        out = out.unionByName(level)
    raise ValueError(f"the tree is deeper than {max_depth} levels")


def intervals(nodes: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(area_id, area_name, parent_id, depth, first, last) of every node that a root reaches. Numbers come from one
    range-partitioned sort by path, sizes from a count over all nodes' paths that is merged before its shuffle."""
    found = written_table(paths(nodes, max_depth), "paths")
    sizes = found.select(F.explode("path.id").alias("area_id")).groupBy("area_id").agg(F.count("*").alias("size"))
    numbered = global_row_number(found.select("area_id", "path"), ["path"], "first").drop("path")
    return found.select("area_id", "area_name", "parent_id", F.size("path").alias("depth")).join(numbered, "area_id").join(
        sizes, "area_id").select("*", (F.col("first") + F.col("size") - 1).alias("last")).drop("size")


def within(labels: DataFrame, area_ids: list[str], number: str = "first") -> Column:
    """Whether the column ``number`` lies at or below one of a few selected areas. Their ranges are looked up and
    become literals; a range inside another is left out. No selection and unknown areas match nothing."""
    rows = labels.filter(F.col("area_id").isin(area_ids)).select("first", "last").orderBy("first", F.desc("last")).collect()
    test, end = F.lit(False), 0
    for r in rows:
        if r["last"] > end:
            test, end = test | F.col(number).between(r["first"], r["last"]), r["last"]
    return test


def labelled(rows: DataFrame, labels: DataFrame, key: str = "area_id") -> DataFrame:
    """``rows`` with the number of their area (``area_first``; null for unknown areas), to be stored sorted by it."""
    numbers = labels.select(F.col("area_id").alias(key), F.col("first").alias("area_first"))
    return rows.join(numbers, key, "left")


def walk(edges: DataFrame, start: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(area_id, depth) at or below ``start`` over ``edges`` (area_id, parent_id), by recursive SQL. A walk doesn't enter
    an area that it came through, so cycles end; each area has its least depth."""
    spark, limit = edges.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        found = spark.sql("""
            WITH RECURSIVE walk(area_id, depth, seen) MAX RECURSION LEVEL %d AS (
              SELECT :start, 0, array(:start)
              UNION ALL
              SELECT e.area_id, w.depth + 1, array_append(w.seen, e.area_id)
              FROM walk w JOIN {edges} e ON e.parent_id = w.area_id
              WHERE NOT array_contains(w.seen, e.area_id))
            SELECT area_id, min(depth) AS depth FROM walk GROUP BY area_id""" % max_depth, {"start": start}, edges=edges)
        return written_table(found, "walk")
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)
