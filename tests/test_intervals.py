"""Interval labels against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from crestline.operators import intervals


def tree(seed, n=150):
    rng = random.Random(seed)
    # equal names in different branches, several roots
    return [(f"a{i}", rng.choice(["West", "East", "Wall", None]), None if i < 3 else f"a{rng.randrange(0, i)}") for i in range(n)]


def below(rows, start):
    inside = {start}
    grown = True
    while grown:
        new = {i for i, _, p in rows if p in inside} - inside
        grown = bool(new)
        inside |= new
    return inside


def frame(spark, rows):
    return spark.createDataFrame(rows, "area_id string, area_name string, parent_id string")


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_are_branches(spark, seed):
    rows = tree(seed)
    labels = {r["area_id"]: r for r in intervals.intervals(frame(spark, rows).repartition(5)).collect()}
    assert sorted(r["first"] for r in labels.values()) == list(range(1, len(rows) + 1))
    for i in labels:
        inside = {k for k, r in labels.items() if labels[i]["first"] <= r["first"] <= labels[i]["last"]}
        assert inside == below(rows, i)
    # children follow each other by name and id
    for _, _, parent in rows:
        siblings = [(n or "", i) for i, n, p in rows if p == parent]
        assert [i for _, i in sorted(siblings)] == sorted((i for _, i in siblings), key=lambda i: labels[i]["first"])


def test_cycles_and_lost_parents_are_left_out(spark):
    rows = [("r", "R", None), ("a", "A", "r"), ("x", "X", "y"), ("y", "Y", "x"), ("z", "Z", "gone"), ("self", "S", "self")]
    got = intervals.intervals(frame(spark, rows)).collect()
    assert sorted((r["area_id"], r["first"], r["last"], r["depth"]) for r in got) == [("a", 2, 2, 2), ("r", 1, 2, 1)]
    assert intervals.intervals(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        intervals.paths(frame(spark, rows[:2]), max_depth=1)


def test_selection_is_a_literal_range(spark, tmp_path):
    rows = tree(3)
    labels = intervals.intervals(frame(spark, rows))
    routes = spark.range(0, 3000).select(F.concat(F.lit("a"), F.col("id") % 151).alias("area_id"), F.col("id").alias("route_id"))
    intervals.labelled(routes, labels).repartitionByRange(8, "area_first").sortWithinPartitions("area_first").write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    for chosen in (["a1"], ["a1", "a2", "a50"], [], ["none"]):
        got = stored.filter(intervals.within(labels, chosen, "area_first"))
        inside = set().union(*(below(rows, c) for c in chosen if c != "none")) if chosen else set()
        assert {r["area_id"] for r in got.select("area_id").distinct().collect()} == inside
    plan = stored.filter(intervals.within(labels, ["a1"], "area_first"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(area_first" in plan and "LessThanOrEqual(area_first" in plan


def test_wide_node(spark):
    nodes = spark.range(0, 20_000).select(F.col("id").cast("string").alias("area_id"), F.lit("n").alias("area_name"),
                                          F.when(F.col("id") > 0, "0").alias("parent_id"))
    r = intervals.intervals(nodes).agg(F.max("last").alias("last"), F.countDistinct("first").alias("n")).first()
    assert (r["last"], r["n"]) == (20_000, 20_000)


def test_recursive_walk(spark):
    rows = tree(4)
    edges = frame(spark, rows + [("a0", "back", "a140"), ("a5", "self", "a5")]).select("area_id", "parent_id")
    got = {r["area_id"]: r["depth"] for r in intervals.walk(edges, "a0").collect()}
    assert set(got) == below(rows, "a0") | below([*rows, ("a0", "", "a140")], "a0") and got["a0"] == 0
    assert [r["area_id"] for r in intervals.walk(edges, "none").collect()] == ["none"]
