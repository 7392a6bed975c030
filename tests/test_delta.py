"""Enrichment by batches against the whole enrichment over all of them."""

import pytest
from pyspark.sql import functions as F

from crestline import fixed
from crestline.functions.arrays import TAG_MAP
from crestline.operators import enrich
from crestline.plans import delta
from crestline.sources import store

N_AREAS, N_ROUTES = 60, 600


@pytest.fixture(scope="module")
def catalogue(spark):
    areas = spark.range(0, N_AREAS).select(
        F.concat(F.lit("a"), "id").alias("area_id"), F.col("id").alias("area_ord"), F.lit("n").alias("area_name"),
        F.from_json(F.when(F.col("id") % 4 == 0, '{"%s":["approach_long"]}' % fixed.APPROACH).otherwise("{}"), TAG_MAP).alias("area_tags"))
    kind = F.element_at(F.array(*map(F.lit, ("Sport", "Trad", "Boulder"))), (F.col("id") % 3 + 1).cast("int"))
    # a third of all routes in one area
    area = F.when(F.col("id") % 3 == 0, "a1").otherwise(F.concat(F.lit("a"), F.col("id") % N_AREAS))
    routes = spark.range(0, N_ROUTES).select(
        F.concat(F.lit("r"), "id").alias("route_id"), area.alias("area_id"), F.lit(0).cast("long").alias("area_ord"), F.col("id").alias("route_ord"),
        F.lit("name").alias("route_name"), kind.alias("route_type"), F.lit(1).alias("route_pitches"), F.lit(20).alias("route_length_meter"),
        F.lit("R").alias("route_protection_grading"), F.lit(3.5).alias("route_stars"), F.lit(9).cast("long").alias("route_votes"), F.lit("5.9").alias("route_grade"),
        F.from_json(F.lit("{}"), "map<string,int>").alias("route_suggested_ratings"), F.lit("N/A").alias("route_shared_on"),
        F.from_json(F.lit('{"Crack Climbing":["finger"]}'), TAG_MAP).alias("route_tags"))
    return areas, routes


def batch(spark, rows):
    df = spark.createDataFrame([(k, e, t) for k, e, t in rows], "kind string, entity_id string, t string")
    return df.select("kind", "entity_id", F.from_json("t", TAG_MAP).alias("tags"))


BATCHES = [
    [("route", f"r{n}", '{"Difficulty & Safety":["stick_clip","loose_rock"]}') for n in (1, 2, 3, 5)] + [("route", "unknown", "{}")],
    [("area", "a4", '{"%s":["approach_short"]}' % fixed.APPROACH), ("area", "a8", '{"%s":["approach_long"],"Weather & Conditions":["sun_am"]}' % fixed.APPROACH)],
    [("route", "r4", '{"Crack Climbing":["fist"]}'), ("route", "r3", "{}"), ("area", "a1", '{"%s":["approach_none"]}' % fixed.APPROACH), ("area", "a4", "{}")],
]


def tags(df, key, column):
    return {r[0]: r[1] for r in df.select(key, column).collect()}


def test_batches_equal_the_whole_run(spark, catalogue, tmp_path):
    areas, routes = catalogue
    base = str(tmp_path / "c")
    delta.begin(areas, routes, base, parts=20)
    results, merged = {}, []
    for rows in BATCHES:
        merged.append(delta.apply_batch(spark, base, batch(spark, rows)))
        results.update({(k, e): t for k, e, t in rows})
        whole_areas, whole_routes = enrich.enrich(areas, routes, batch(spark, [(*k, t) for k, t in results.items()]))
        got_areas, got_routes = delta.enriched(spark, base)
        assert tags(got_routes, "route_id", "route_tags") == tags(whole_routes, "route_id", "route_tags")
        assert tags(got_routes, "route_id", "llm_tags") == tags(whole_routes, "route_id", "llm_tags")
        assert tags(got_areas, "area_id", "area_tags") == tags(whole_areas, "area_id", "area_tags")
        # the same batch again finds everything in place
        assert delta.apply_batch(spark, base, batch(spark, rows))["parts"] == 0
    of = {a: sum((("a1" if n % 3 == 0 else f"a{n % N_AREAS}") == a) for n in range(N_ROUTES)) for a in ("a1", "a4", "a8")}
    # only named routes, then the routes of the one area whose inherited tags differ, then both
    assert [m["routes"] for m in merged] == [4, of["a4"], of["a1"] + of["a4"]]
    assert [m["areas"] for m in merged] == [0, 2, 2] and merged[0]["parts"] <= 4


def test_only_parts_of_the_batch_are_read(spark, catalogue, tmp_path):
    areas, routes = catalogue
    base = str(tmp_path / "c")
    delta.begin(areas, routes, base, parts=20)
    keys = spark.createDataFrame([("r5",)], "route_id string")
    for name, column in (("places", "route_id"), ("routes", "area_id")):
        rows = store.read_parts(spark, f"{base}/{name}", keys.select(F.col("route_id").alias(column)))
        assert "PartitionFilters: [part" in rows._jdf.queryExecution().executedPlan().toString().replace("isnotnull(", "").replace("PartitionFilters: [(", "PartitionFilters: [")
        assert rows.count() < N_ROUTES / 2


def test_a_batch_that_died_is_applied_again(spark, catalogue, tmp_path, monkeypatch):
    areas, routes = catalogue
    base = str(tmp_path / "c")
    delta.begin(areas, routes, base, parts=20)
    real, calls = store.upsert_parts, []

    def dies(*args, **options):
        calls.append(args[1])
        if len(calls) == 3:  # enriched rows are written, state is not
            raise OSError("lost")
        return real(*args, **options)

    monkeypatch.setattr(store, "upsert_parts", dies)
    with pytest.raises(OSError):
        delta.apply_batch(spark, base, batch(spark, BATCHES[2]))
    monkeypatch.setattr(store, "upsert_parts", real)
    delta.apply_batch(spark, base, batch(spark, BATCHES[2]))
    delta.apply_batch(spark, base, batch(spark, BATCHES[1][:1]))
    results = {(k, e): t for k, e, t in BATCHES[2] + BATCHES[1][:1]}
    _, whole = enrich.enrich(areas, routes, batch(spark, [(*k, t) for k, t in results.items()]))
    assert tags(delta.enriched(spark, base)[1], "route_id", "route_tags") == tags(whole, "route_id", "route_tags")


def test_result_lines_are_parsed_once_and_by_many_tasks(spark, sf):
    from crestline.plans import mapping

    lines = mapping.result_lines(spark, sf)
    # the keys fill one file, their lines many tasks
    assert "REPARTITION_BY_NUM" in lines._jdf.queryExecution().executedPlan().toString()
    plan = enrich.latest_results(enrich.parse_results(lines))._jdf.queryExecution().optimizedPlan().toString()
    # line, object test, categories, tags of a category; each filter on them used to repeat these
    assert plan.count("from_json") == 4 and plan.count("get_json_object") <= 2


def test_documents_are_compared_by_digests(spark, tmp_path, monkeypatch):
    rows = spark.range(40).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") != 3, "x").alias("text"))
    store.upsert_parts(rows, str(tmp_path / "c"), "key", parts=4)
    joined, join = [], type(rows).join
    monkeypatch.setattr(type(rows), "join", lambda self, other, *a: joined.append(other.columns) or join(self, other, *a))
    assert store.upsert_parts(rows, str(tmp_path / "c"), "key") == []
    assert joined == [["key", "_digest"]]
    # a field that only becomes null, and one that only becomes empty, are changes
    for value in (F.lit(None), F.lit("")):
        changed = rows.withColumn("text", F.when(F.col("key") != "5", F.col("text")).otherwise(value))
        assert len(store.upsert_parts(changed, str(tmp_path / "c"), "key")) == 1
        assert store.upsert_parts(changed, str(tmp_path / "c"), "key") == []
