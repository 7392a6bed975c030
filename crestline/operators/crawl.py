"""Leaf discovery: pages reachable from a start page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.session import BucketedTable, written_table

COMPACT_EVERY = 8
#: URLs of a wave up to which they are looked up by name, so that only their buckets are read.
FEW = 200


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """URLs reachable from ``start`` over (src_url, dst_url), with the wave that
    found each."""
    return _waves(edges, start)


def discover_leaves(graph: DataFrame, start: DataFrame) -> DataFrame:
    """Leaf pages reachable from ``start``. ``graph`` = (url, is_leaf, links);
    pages are read once, later waves use the narrow graph. Leaves are not left."""
    graph = written_table(graph.select("url", "is_leaf", "links"), "page-graph")
    leaves = graph.filter("is_leaf").select("url")
    edges = graph.filter("NOT is_leaf").select(
        F.col("url").alias("src_url"), F.explode("links").alias("dst_url"))
    return _waves(edges, start).join(leaves, "url", "left_semi").select("url", "wave")


def new_links(links: DataFrame, visited: DataFrame, wave: int) -> DataFrame:
    """The next wave: targets of the links of ``wave`` that were not visited. Links lie in buckets of
    their source and pages in buckets of their URL, as many of both, so only found targets are shuffled."""
    front = visited.filter(F.col("wave") == wave).select(F.col("url").alias("src_url"))
    return links.join(front, "src_url", "left_semi").select(F.col("dst_url").alias("url")).distinct() \
        .join(visited.select("url"), "url", "left_anti").withColumn("wave", F.lit(wave + 1))


def _waves(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Breadth-first waves; links may be cyclic.

    Links and visited pages are bucketed once and never shuffled again; a source's links are bounded by
    its page. Each wave is appended in the shared folder, so a lost executor repeats tasks of one wave. A
    wave of few pages reads the links of their buckets only. The files of visited pages are merged now
    and then.
    """
    buckets = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = BucketedTable(edges.select("src_url", "dst_url"), "links", "src_url", buckets)
    visited = BucketedTable(start.select("url").distinct().withColumn("wave", F.lit(0)), "visited", "url", buckets)
    wave = 0
    while True:
        front = [r[0] for r in visited.read().filter(F.col("wave") == wave).select("url").limit(FEW + 1).collect()]
        if not front:
            break
        out = links.read()
        if len(front) <= FEW:
            out = out.filter(F.col("src_url").isin(front))
        visited.append(new_links(out, visited.read(), wave))
        wave += 1
        if wave % COMPACT_EVERY == 0:
            merged = BucketedTable(visited.read(), "visited", "url", buckets)
            visited.drop()
            visited = merged
    links.drop()
    return visited.forget()
