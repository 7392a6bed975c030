import json

import pytest
from pyspark.sql import functions as F

from crestline.functions import derive
from crestline.operators import enrich, extract, flatten, reduction
from crestline.plans import enrichment
from crestline.sources import lines, nested, store

H = [{"level": 2, "area_hierarchy_name": "West", "area_hierarchy_url": "u2"},
     {"level": 1, "area_hierarchy_name": "All Locations", "area_hierarchy_url": "u1"}]


def route(rid, kind="Sport", **more):
    return {"route_id": rid, "route_name": f"Name {rid}", "route_type": kind, "route_grade": "5.9",
            "route_votes": "N/A", "route_stars": 2.5, "route_pitches": 1, "route_tags": [], **more}


AREAS = [
    {"area_id": "a1", "area_name": "One", "area_tags": [], "area_hierarchy": H, "routes": [
        route("r1"), route("r2", "Boulder"), route("r3", "Trad, Aid", route_votes=7, route_tags={"Crack Climbing": ["finger"]})]},
    {"area_id": "a2", "area_name": "Two", "area_tags": {"Approach & Accessibility": ["approach_long"]},
     "area_hierarchy": [], "routes": [route("r4", "Boulder")]},
    {"area_id": "a3", "area_name": "Three", "area_tags": [], "area_hierarchy": H},
]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "west_routes_tagged.json").write_text(json.dumps(AREAS, indent=2))
    (tmp_path / "single.json").write_text(json.dumps({**AREAS[0], "area_id": "s1"}))
    (tmp_path / "broken.json").write_text('[{"area_id": "x"')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "index.json").write_text(json.dumps(
        ["single.json", "gone.json", "broken.json", "west_routes_tagged.json"]))
    return tmp_path


def test_manifest(spark, folder):
    df, skipped = nested.scan_manifest(spark, str(folder / "index.json"), str(folder))
    got = [(r["area_id"], r["file_ord"]) for r in df.orderBy("file_ord", "area_pos").collect()]
    assert skipped == ["gone.json"]
    assert [a for a, _ in got] == ["s1", "a1", "a2", "a3"]


def test_manifest_without_files(spark, tmp_path):
    (tmp_path / "index.json").write_text('["gone.json"]')
    with pytest.raises(nested.NoDataError):
        nested.scan_manifest(spark, str(tmp_path / "index.json"), str(tmp_path))
    (tmp_path / "none.json").write_text("[]")
    with pytest.raises(nested.NoDataError):
        nested.scan_manifest(spark, str(tmp_path / "none.json"), str(tmp_path))


def test_single_file(spark, folder):
    assert nested.scan_single(spark, str(folder / "west_routes_tagged.json")).count() == 3
    with pytest.raises(ValueError):
        nested.scan_single(spark, str(folder / "single.json"))
    with pytest.raises(nested.NoDataError):
        nested.scan_single(spark, str(folder / "empty.json"))


def test_location():
    assert nested.location("s3a://bucket/data/", "x.json") == "s3a://bucket/data/x.json"
    assert nested.location("/data", "s3a://b/x.json") == "s3a://b/x.json"


def test_shapes_and_reduction(spark, folder):
    df = nested.scan_states(spark, str(folder))
    areas, routes = nested.flatten_nested(df)
    assert {r["state"] for r in areas.collect()} == {"west"}
    ids = [r["route_id"] for r in routes.orderBy("area_pos", "route_pos").collect()]
    assert ids == ["r1", "r2", "r3", "r4"]
    typed_areas, typed_routes = enrichment.typed(areas, routes)
    tags = {r["route_id"]: (r["route_tags"], r["route_votes"]) for r in typed_routes.collect()}
    assert tags["r1"] == ({}, None) and tags["r3"] == ({"Crack Climbing": ["finger"]}, 7)
    kept = {r["area_id"]: [x["route_id"] for x in r["routes"]] for r in reduction.reduce_nested(df).collect()}
    assert kept == {"a1": ["r1", "r3"]}
    stats = reduction.with_grand_total(reduction.reduction_stats(areas, routes)).collect()
    total = next(r for r in stats if r["state"] == "Total")
    assert (total["routes_total"], total["routes_kept"], total["areas_total"], total["areas_kept"]) == (4, 2, 3, 1)
    assert total["routes_pct"] == 50.0


def test_stats_without_routes(spark):
    areas = spark.createDataFrame([("x", "a")], "state string, area_id string")
    none = spark.createDataFrame([], "state string, area_id string, route_type string")
    r = reduction.reduction_stats(areas, none).first()
    assert (r["routes_total"], r["routes_pct"], r["areas_pct"]) == (0, 0.0, 0.0)


def test_flat_files(spark, tmp_path):
    (tmp_path / "areas.json").write_text(json.dumps({"areas": [
        {"area_id": "a1", "area_name": "Old", "area_hierarchy": []},
        {"area_id": "a1", "area_name": "One", "area_description": "Sunny", "area_hierarchy": H,
         "area_tags": {"Weather & Conditions": ["sun_am"]}},
        {"area_id": "", "area_name": "No id"}, {"area_id": "a9"}]}))
    (tmp_path / "routes.json").write_text(json.dumps([
        {**route("r1", ["Sport", "TR", "Ice"]), "area_id": "a1"}, {**route("r2", "Trad, Alpine Ice"), "area_id": "a1"},
        {**route("r3", "Trad, Alpine", route_stars="3.5 stars", route_votes=15, route_pitches=0), "area_id": "zz"},
        {**route("r4"), "area_id": ""}]))
    areas, routes = nested.read_flat(spark, str(tmp_path / "areas.json"), str(tmp_path / "routes.json"))
    counts = {r["collection"]: (r["valid"], r["invalid"], r["skipped"])
              for r in flatten.load_counts(areas, routes).collect()}
    assert counts == {"areas": (2, 2, 0), "routes": (2, 1, 1)}
    areas = areas.withColumn("area_tags", derive.tag_map(F.col("area_tags")))
    docs = flatten.project_areas(areas).orderBy("area_ord").collect()
    assert docs[1]["area_hierarchy_path"] == "All Locations/West"
    assert docs[1]["area_tags"] == ["sun_am", "Weather & Conditions:sun_am"]
    assert docs[1]["searchable_text"] == "one sunny sun_am weather & conditions:sun_am"
    routes = routes.withColumn("route_tags", derive.tag_map(F.col("route_tags")))
    out = flatten.project_routes(flatten.attach_area(routes, areas), array_types=True)
    got = {r["route_id"]: r for r in out.collect()}
    assert set(got) == {"r1", "r3"}
    assert got["r1"]["route_type"] == ["Sport", "TR"] and got["r1"]["area_name"] == "One" and got["r1"]["is_sport"]
    r3 = got["r3"]
    assert (r3["area_name"], r3["area_hierarchy"], r3["route_stars"], r3["route_pitches"]) == ("", [], 3.5, 1.0)
    assert r3["quality_score"] == pytest.approx((3.5 * 15 + 12.5) / 20) and not r3["is_multipitch"]


def test_flat_shape_errors(spark, tmp_path):
    (tmp_path / "areas.json").write_text("[]")
    (tmp_path / "routes.json").write_text("{}")
    with pytest.raises(ValueError):
        nested.read_flat(spark, str(tmp_path / "areas.json"), str(tmp_path / "routes.json"))


def test_snapshot_or_empty(spark, folder):
    assert nested.snapshot_or_empty(spark, str(folder / "no_such")).count() == 0
    assert nested.snapshot_or_empty(spark, str(folder / "broken.json")).count() == 0
    whole = nested.read_nested(spark, str(folder / "single.json"))
    assert dict(nested.snapshot_or_empty(spark, str(folder / "no_such")).dtypes) == dict(whole.dtypes)


@pytest.mark.parametrize("name", ["no_such", "broken.json"])
def test_first_run_without_snapshot(spark, folder, tmp_path, name):
    (tmp_path / "b0.jsonl").write_text("")
    df = nested.read_nested(spark, str(folder / "west_routes_tagged.json"))
    _, routes, summary = enrichment.run(spark, df, lines.batch_paths(str(tmp_path), "b0"),
                                        nested.snapshot_or_empty(spark, str(folder / name)))
    assert routes.count() == 4 and summary.first()["routes_total"] == 4


def test_equal_and_odd_file_names(spark, tmp_path):
    names = ["nv/routes.json", "ca/routes.json", "ca/new mexico+1%.json"]
    for n, name in enumerate(names):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps([{**AREAS[0], "area_id": f"x{n}"}]))
    (tmp_path / "index.json").write_text(json.dumps([*names, "ca/gone.json", "no/gone.json"]))
    df, skipped = nested.scan_manifest(spark, str(tmp_path / "index.json"), str(tmp_path))
    assert skipped == ["ca/gone.json", "no/gone.json"]
    assert {r["area_id"]: r["file_ord"] for r in df.collect()} == {"x0": 0, "x1": 1, "x2": 2}
    states = nested.scan_states(spark, str(tmp_path / "ca"), ".json").select("state").distinct().collect()
    assert {r["state"] for r in states} == {"routes", "new mexico+1%"}


def test_large_single_line_is_not_fetched(spark, tmp_path):
    (tmp_path / "one.json").write_text("  " + json.dumps(AREAS * 50))
    assert nested._first_character(spark, str(tmp_path / "one.json")) == "["
    assert nested.scan_single(spark, str(tmp_path / "one.json")).count() == 150


def _parts(spark, per_row):
    """One area with 8 routes, the first 4 boulders, and routes of an unknown area."""
    rows = [("a", i, f"r{i}", "Boulder" if i < 4 else "Sport", '{"A":["t"]}') for i in range(8)] + [("gone", 5, "g", "Sport", "{}")]
    routes = spark.createDataFrame(rows, "area_id string, route_pos int, route_id string, route_type string, route_tags string")
    areas = spark.createDataFrame([("a", "Area"), ("bare", "Bare")], "area_id string, area_name string")
    return extract.nest(areas, routes, per_row)


@pytest.mark.parametrize("per_row", [2, 4, 1000])
def test_parts_of_an_area_are_one_area(spark, tmp_path, per_row):
    store.write_json(_parts(spark, per_row), str(tmp_path / "n"))
    back = nested.read_nested(spark, str(tmp_path / "n"), multi_line=False)
    areas, routes = nested.flatten_nested(reduction.reduce_nested(back))
    assert sorted((r["area_id"], r["area_name"]) for r in areas.collect()) in (
        [("a", "Area"), ("gone", None)],)
    assert sorted(r["route_id"] for r in routes.collect()) == ["g", "r4", "r5", "r6", "r7"]
    old_areas, old = enrichment.typed(*nested.flatten_nested(back))
    assert old_areas.count() == 3
    now = old.select("area_id", "route_id").withColumn("route_tags", F.from_json(F.lit("{}"), "map<string,array<string>>"))
    merged = enrich.merge_route_snapshot(now, old).filter("area_id = 'a'").collect()
    assert [r["route_tags"] for r in merged] == [{"A": ["t"]}] * 8


def test_enrichment_job(spark, folder, tmp_path):
    def res(cid, tags):
        return json.dumps({"custom_id": cid, "response": {"body": {"choices": [
            {"message": {"content": json.dumps({"llm_tags": tags})}}]}}})

    (tmp_path / "b1.jsonl").write_text("\n".join([
        res("r1", {"Difficulty & Safety": ["loose_rock"]}), "", "oops",
        res("area_a1", {"Approach & Accessibility": ["approach_short"]})]))
    (tmp_path / "b2.jsonl").write_text(res("r1", {"Difficulty & Safety": ["stick_clip"]}))
    df = nested.read_nested(spark, str(folder / "west_routes_tagged.json"))
    areas, routes, summary = enrichment.run(spark, df, lines.batch_paths(str(tmp_path), "b1,b2"))
    got = {r["route_id"]: r["route_tags"] for r in routes.collect()}
    pitch = ["single_pitch"]
    assert got["r1"] == {"Difficulty & Safety": ["stick_clip"], "Multi-Pitch, Anchors & Descent": pitch,
                         "Approach & Accessibility": ["approach_short"]}
    assert got["r3"] == {"Crack Climbing": ["finger"], "Multi-Pitch, Anchors & Descent": pitch,
                         "Approach & Accessibility": ["approach_short"]}
    assert got["r4"] == {"Multi-Pitch, Anchors & Descent": pitch, "Approach & Accessibility": ["approach_long"]}
    s = summary.first()
    assert (s["routes_total"], s["routes_eligible"], s["routes_updated"], s["areas_updated"]) == (4, 2, 1, 1)
    # enriching twice changes nothing more
    again, _ = areas, enrich.inherit_tags(routes, areas)
    assert {r["route_id"]: r["route_tags"] for r in _.collect()} == got


def test_versions(spark, tmp_path):
    base = str(tmp_path / "docs")
    old = spark.createDataFrame([("a", 1, 0), ("b", 1, 0)], "id string, v int, ord int")
    assert store.upsert_version(old, base, "id", "ord") == 1
    with pytest.raises(store.TargetExistsError):
        store.upsert_version(old, base, "id", "ord")
    new = spark.createDataFrame([("b", 2, 0), ("b", 3, 1), ("c", 9, 0)], "id string, v int, ord int")
    assert store.upsert_version(new, base, "id", "ord", force=True, cluster_by=["id"]) == 2
    assert {r["id"]: r["v"] for r in store.read_version(spark, base).collect()} == {"a": 1, "b": 3, "c": 9}
    assert {r["id"]: r["v"] for r in store.read_version(spark, base, 1).collect()} == {"a": 1, "b": 1}
    # a version without a success marker does not count
    (tmp_path / "docs" / "v=7").mkdir()
    assert store.versions(spark, base) == [1, 2]
    assert store.area_source(spark, old, base, skip_areas=False) is old
    assert store.area_source(spark, old, base, skip_areas=True).count() == 3


def test_send_in_groups(spark, tmp_path):
    out = str(tmp_path)

    def send(group):
        import os
        import uuid

        with open(os.path.join(out, uuid.uuid4().hex), "w") as f:
            f.write(str(len(group)))

    store.send_in_groups(spark.range(0, 1203, 1, 1), send)
    assert sorted(int(p.read_text()) for p in tmp_path.iterdir()) == [203, 500, 500]


def test_inventory(spark, tmp_path):
    for name, size in (("b.json", 10), ("a.json", 20), ("c.txt", 5)):
        (tmp_path / name).write_text("x" * size)
    files = store.inventory(spark, str(tmp_path))
    assert [(r["name"], r["bytes"]) for r in files.collect()] == [("a.json", 20), ("b.json", 10)]
    assert store.size_totals(files).first()["bytes"] == 30
    outcome = spark.createDataFrame([("ok",), ("ok",), ("failed",)], "status string")
    assert {r["status"]: r["n"] for r in store.outcome_totals(outcome).collect()} == {"ok": 2, "failed": 1}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x")], "area_id string, state string")
    store.write_json(df, store.tagged_name(str(tmp_path / "w.json")))
    assert (tmp_path / "w_tagged.json" / "_SUCCESS").exists()
    store.write_by_root(df, str(tmp_path / "roots"), "https://x.example/area/7/big-wall/")
    assert (tmp_path / "roots" / "root_slug=big-wall").exists()


def test_arrays_that_other_tools_read(spark, tmp_path):
    df = spark.range(0, 250).select(F.concat(F.lit("a{"), "id").alias("area_id"), F.array(F.struct(F.lit('"[').alias("route_id"))).alias("routes"))
    store.write_arrays(df, str(tmp_path / "arrays"), per_file=100)
    store.write_arrays(df, str(tmp_path / "members"), per_file=100, member="areas")
    for name, inside in (("arrays", lambda d: d), ("members", lambda d: d["areas"])):
        files = list((tmp_path / name).glob("file=*/*.txt"))
        rows = [r["area_id"] for f in files for r in inside(json.loads(f.read_text()))]
        assert len(files) == 3 and sorted(rows) == sorted(f"a{{{n}" for n in range(250))
    assert nested.scan_single(spark, str(tmp_path / "arrays"), split_bytes=2000).select("area_id").distinct().count() == 250


def test_unfinished_versions_are_left_alone(spark, tmp_path):
    base = str(tmp_path / "docs")
    df = spark.createDataFrame([("a",)], "id string")
    assert store.write_version(df, base) == 1
    (tmp_path / "docs" / "v=2").mkdir()  # another writer has begun
    assert store.write_version(df, base) == 3 and store.versions(spark, base) == [1, 3]


def _files(path):
    return {f.parent.name: f.name for f in path.glob("of=*/part=*/*.parquet")}


def test_partial_upsert(spark, tmp_path):
    base = str(tmp_path / "docs")
    rows = [(f"d{n}", n, {"t": [str(n)]}) for n in range(200)]
    schema = "id string, v int, tags map<string,array<string>>"
    df = spark.createDataFrame(rows, schema)
    assert len(store.upsert_parts(df, base, "id", parts=20)) == 20
    before = _files(tmp_path / "docs")
    new = spark.createDataFrame([("d3", 9, 0), ("d3", -3, 1), ("new", 7, 0)], "id string, v int, ord int")
    new = new.withColumn("tags", F.from_json(F.lit("{}"), "map<string,array<string>>"))
    touched = store.upsert_parts(new.drop("ord").filter("v <> 9"), base, "id", parts=3)  # the first write fixed the number
    assert len(touched) == 2
    after = _files(tmp_path / "docs")
    assert {p for p in before if before[p] != after[p]} == {f"part={p}" for p in touched}
    got = {r["id"]: r["v"] for r in store.read_parts(spark, base).collect()}
    assert got == {**{i: v for i, v, _ in rows}, "d3": -3, "new": 7}
    # nothing changes, nothing is written
    assert store.upsert_parts(new, base, "id", "ord") == [] and _files(tmp_path / "docs") == after
    # only the parts of the keys are read
    some = store.read_parts(spark, base, spark.createDataFrame([("d3",)], "id string"))
    assert 0 < some.count() < 40 and some.filter("id = 'd3'").first()["v"] == -3
    assert store.undo_parts(spark, base) == touched
    assert {r["id"]: r["v"] for r in store.read_parts(spark, base).collect()} == {i: v for i, v, _ in rows}
    assert store.read_parts(spark, str(tmp_path / "none")) is None


def test_parts_by_another_column(spark, tmp_path):
    base = str(tmp_path / "docs")
    df = spark.range(0, 300).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("string").alias("area"), F.lit(0).alias("v"))
    store.upsert_parts(df, base, "id", by="area", parts=50)
    touched = store.upsert_parts(df.filter("area = '3'").withColumn("v", F.lit(1)), base, "id", by="area", backup=False)
    assert len(touched) == 1
    assert {(r["area"], r["v"]) for r in store.read_parts(spark, base).select("area", "v").distinct().collect()} == {
        (str(n), int(n == 3)) for n in range(7)}


def test_stored_texts_are_derived_behind_the_range_shuffle(spark, tmp_path):
    df = spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("text"))
    seen = []

    def project(rows):
        seen.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return rows.filter("id <> '7'").withColumn("search", F.upper("text"))

    store.write_version(df, str(tmp_path), [F.col("id")], project)
    assert "RepartitionByExpression" in seen[0] and "search" not in seen[0]
    rows = store.read_version(spark, str(tmp_path)).collect()
    assert len(rows) == 49 and {r["search"] for r in rows} == {"X"}


def test_load_derives_documents_last(spark, sf, tmp_path, monkeypatch):
    from crestline.operators import flatten
    from crestline.plans import load
    from crestline.registry import pages_io

    areas, routes = pages_io._flat_load(spark, sf)
    # a later row of each id that is skipped, and one that is equal
    routes = routes.unionByName(routes).unionByName(routes.withColumn("route_type", F.lit("Boulder")).withColumn("route_ord", F.col("route_ord") + 1))
    project, plans = flatten.project_routes, []
    monkeypatch.setattr(flatten, "project_routes", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or project(df))
    counts = {r["collection"]: r for r in load.run(spark, areas, routes, str(tmp_path)).collect()}
    assert len(plans) == 1 and "RepartitionByExpression" in plans[0]
    want = project(flatten.attach_area(routes, areas)).select("route_id", "searchable_text", "area_hierarchy_path").distinct()
    got = store.read_version(spark, f"{tmp_path}/routes").select("route_id", "searchable_text", "area_hierarchy_path")
    assert counts["routes"]["stored"] == got.count() == want.count() > 0
    assert got.exceptAll(want).isEmpty()
