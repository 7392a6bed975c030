import json

import pytest
from pyspark.sql import functions as F

from crestline import fixed
from crestline.functions import derive
from crestline.functions import tags as T
from crestline.functions.arrays import TAG_MAP
from crestline.operators import enrich


def tag_frame(spark, *maps):
    rows = [(i, *[json.dumps(m) for m in ms]) for i, ms in enumerate(maps)]
    n = len(maps[0])
    cols = ", ".join(f"m{i} string" for i in range(n))
    df = spark.createDataFrame(rows, f"i int, {cols}")
    for i in range(n):
        df = df.withColumn(f"m{i}", F.from_json(f"m{i}", TAG_MAP))
    return df.orderBy("i")


def one(spark, expr, **values):
    df = spark.range(1)
    types = {"pitches": "int", "meters": "int", "votes": "int", "stars": "double"}
    for k, v in values.items():
        c = F.lit(v)
        df = df.withColumn(k, c.cast(types[k]) if k in types else c)
    return df.select(expr).first()[0]


@pytest.mark.parametrize("pitches,meters,want", [
    (1, 30, "rope_60m"), (1, 31, "rope_70m"), (1, 35, "rope_70m"), (1, 36, "rope_80m"), (1, 40, "rope_80m"),
    (1, 41, None), (2, 20, None), (None, 20, "rope_60m"), (1, None, None)])
def test_rope(spark, pitches, meters, want):
    assert one(spark, T.rope_tag(F.col("pitches"), F.col("meters")), pitches=pitches, meters=meters) == want


@pytest.mark.parametrize("pitches,want", [(None, "single_pitch"), (1, "single_pitch"), (2, "short_multipitch"),
                                          (4, "short_multipitch"), (5, "long_multipitch")])
def test_pitches(spark, pitches, want):
    assert one(spark, T.pitch_tag(F.col("pitches")), pitches=pitches) == want


@pytest.mark.parametrize("stars,votes,want", [(3.0, 5, "classic_route"), (2.9, 5, None), (3.0, 4, None), (None, 9, None)])
def test_classic(spark, stars, votes, want):
    assert one(spark, T.classic_tag(F.col("stars"), F.col("votes")), stars=stars, votes=votes) == want


@pytest.mark.parametrize("text,want", [
    ("Jan, 2022", None), ("Feb, 2022", "new_routes"), ("Jan, 2023", "new_routes"), ("Dec, 2021", None), ("N/A", None),
    ("", None), (None, None), ("Foo, 2022", None), ("Foo, 2023", "new_routes"), ("Feb, 20x2", None), ("a, b, 2023", None)])
def test_new_routes(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.new_route_tag(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("votes,grade,ratings,want", [
    (5, "5.10a", {"5.10a": 1, "5.10b": 3, "5.9": 1}, "sandbag"),
    (4, "5.10a", {"5.10a": 1, "5.10b": 3}, None),
    (5, "5.10a", {"5.10a": 1, "5.9": 3}, "first_in_grade"),
    (5, "5.10a", {"5.9": 2, "5.11a": 2}, None),
    (5, "5.10a", {"5.10a": 3, "5.11a": 3}, None),
    (5, " 5.10a ", {"V4": 2}, "sandbag"),
    (5, "5.10a", {}, None)])
def test_vote_rule(spark, votes, grade, ratings, want):
    df = spark.createDataFrame([(votes, grade, json.dumps(ratings))], "v int, g string, r string")
    df = df.withColumn("r", F.from_json("r", "map<string,int>"))
    assert df.select(T.vote_tag(F.col("v"), F.col("g"), F.col("r"))).first()[0] == want


def test_validate_keeps_order_and_duplicates(spark):
    got = tag_frame(spark, ({
        "Crack Climbing": ["finger", "nope", "finger", "chimney"], "Bogus": ["finger"],
        "Access & Restrictions": ["seasonal_closure", "seasonal_closure_wet", "closed"],
        "Rope Length": ["rope_90m"]},)).select(T.validate(F.col("m0"))).first()[0]
    assert got == {"Crack Climbing": ["finger", "finger", "chimney"],
                   "Access & Restrictions": ["seasonal_closure", "seasonal_closure_wet"]}


@pytest.mark.parametrize("pitches,text,manual,want", [
    (1, {"Rope Length": ["rope_80m"]}, {"Rope Length": ["rope_60m"]}, {"Rope Length": ["rope_60m"]}),
    (1, {"Rope Length": ["rope_80m"]}, {}, {"Rope Length": ["rope_80m"]}),
    (3, {"Rope Length": ["rope_80m"]}, {"Rope Length": ["rope_60m"]}, {"Rope Length": ["rope_80m"]}),
    (3, {}, {"Rope Length": ["rope_60m"]}, {}),
    (1, {"A": ["z", "y"]}, {"A": ["y", "x"], "B": ["q"]}, {"A": ["x", "y", "z"], "B": ["q"]})])
def test_merge_with_results(spark, pitches, text, manual, want):
    df = tag_frame(spark, (text, manual))
    assert df.select(T.merge_with_results(F.col("m0"), F.col("m1"), F.lit(pitches))).first()[0] == want


def test_merge_without_results_has_no_rope_exception(spark):
    df = tag_frame(spark, ({"Rope Length": ["rope_80m"], "C": ["k", "j"]}, {"Rope Length": ["rope_60m"]}))
    got = df.select(T.merge_without_results(F.col("m0"), F.col("m1"))).first()[0]
    assert got == {"Rope Length": ["rope_60m", "rope_80m"], "C": ["k", "j"]}


def test_stick_clip(spark):
    df = tag_frame(spark, ({fixed.SAFETY: ["stick_clip"]},))
    assert df.select(T.guard_stick_clip(F.col("m0"), F.lit("Trad"))).first()[0] == {fixed.SAFETY: []}
    assert df.select(T.guard_stick_clip(F.col("m0"), F.lit("TR, Sport"))).first()[0] == {fixed.SAFETY: ["stick_clip"]}
    assert df.select(T.guard_stick_clip(F.col("m0"), F.lit("sport"))).first()[0] == {fixed.SAFETY: []}


def result(custom_id, content):
    return json.dumps({"custom_id": custom_id, "response": {"body": {"choices": [{"message": {"content": content}}]}}})


def test_parse_results(spark):
    ok = json.dumps({"llm_tags": {"Crack Climbing": ["finger", "bad"], "Rope Length": "rope_60m"}})
    lines = ["", "   ", "{broken", result("r1", ok), result("r2", ""), result("r3", "not json"),
             result("r4", json.dumps({"llm_tags": ["finger"]})), result("r5", json.dumps({})),
             result("area_a1", ok), result("r1", json.dumps({"llm_tags": {"Crack Climbing": ["chimney"]}})),
             result("r6", '{"llm_tags": {}} and more'), result("r7", "[1]")]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(lines)], "batch_ord int, line_no int, value string")
    parsed = enrich.parse_results(df).cache()
    good = {(r["kind"], r["entity_id"]): r["tags"] for r in enrich.latest_results(parsed).collect()}
    assert good == {("route", "r1"): {"Crack Climbing": ["chimney"]}, ("route", "r5"): {},
                    ("area", "a1"): {"Crack Climbing": ["finger"]}}
    bad = {r["line_no"]: r["reject_reason"] for r in enrich.quarantined(parsed).collect()}
    assert bad == {2: "bad line", 4: "no content", 5: "content is not a JSON object", 6: "tags are not an object",
                   10: "content is not a JSON object", 11: "content is not a JSON object"}
    removed = enrich.rejected_tags(parsed).filter("line_no = 3").collect()
    assert [(r["category"], r["tag"]) for r in removed] == [("Crack Climbing", "bad")]


def test_snapshot_uses_first_area_of_an_id(spark):
    routes = tag_frame(spark, ({"A": ["now"]},), ({},)).select(
        F.lit("a").alias("area_id"), F.concat(F.lit("r"), "i").alias("route_id"), F.col("m0").alias("route_tags"))
    prev = tag_frame(spark, ({"A": ["old"], "B": ["b"]},), ({"C": ["later area"]},), ({"B": ["second"]},))
    prev = prev.select(F.lit("a").alias("area_id"), F.when(F.col("i") == 1, 5).otherwise(0).alias("area_ord"),
                       F.when(F.col("i") == 1, "r1").otherwise("r0").alias("route_id"),
                       F.col("i").alias("route_ord"), F.col("m0").alias("route_tags"))
    got = {r["route_id"]: r["route_tags"] for r in enrich.merge_route_snapshot(routes, prev).collect()}
    assert got == {"r0": {"A": ["now"], "B": ["b"]}, "r1": {}}


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "route_type string")
    r = enrich.run_summary(empty).first()
    assert (r["routes_total"], r["eligible_pct"]) == (0, None)


def test_split_two_fifths(spark):
    reqs = spark.range(1003).select(
        F.lit(1).alias("kind"), F.lit(0).alias("area_ord"), F.col("id").alias("route_ord"),
        F.struct(F.col("id").cast("string").alias("custom_id")).alias("request"))
    got = enrich.split_batches(reqs)
    assert [r["batch_no"] for r in got.orderBy("route_ord").collect()] == [1] * 401 + [2] * 602
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # requests stay where they are
    numbers = enrich.numbered(reqs.select("kind", "area_ord", "route_ord"))
    assert all(r["request_no"] == r["route_ord"] + 1 for r in numbers.collect())
    assert {r["batch_no"] for r in enrich.split_batches(reqs.limit(2)).collect()} == {2}


def test_split_by_a_nested_ordinal(spark):
    reqs = spark.range(10).select(
        F.lit(1).alias("kind"), F.struct(F.lit("f").alias("file"), F.struct((F.col("id") % 2).alias("row")).alias("pos")).alias("area_ord"),
        F.col("id").alias("route_ord"), F.struct("id").alias("request"))
    assert sorted(r["request"]["id"] for r in enrich.split_batches(reqs).filter("batch_no = 1").collect()) == [0, 2, 4, 6]


def test_tag_shapes(spark):
    raw = ['{"A":"one","B":["x","y"]}', '["p","q","p"]', "[]", "{}", "oops", None, '{"A":"","B":[]}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = df.select("i", derive.tag_map(F.col("raw")).alias("m"), derive.flat_tags_any(F.col("raw")).alias("f")).orderBy("i").collect()
    assert [r["m"] for r in got] == [{"A": ["one"], "B": ["x", "y"]}, {}, {}, {}, {}, {}, {"A": [], "B": []}]
    assert [r["f"] for r in got] == [["one", "A:one", "x", "y", "B:x", "B:y"], ["p", "q"], [], [], [], [], []]


def test_split_decision(spark):
    reqs = spark.range(3).select(F.struct("id").alias("request"))
    assert not enrich.split_decision(reqs, "oregon.json").first()["split"]
    assert enrich.split_decision(reqs, "x/California_routes.json").first()["split"]
    assert enrich.split_decision(reqs, max_requests=2).first()["split"]
    assert enrich.split_decision(reqs, bytes_per_request=10, max_bytes=29).first()["split"]


def _sized_requests(spark, sizes, parts=6):
    """Requests whose lines have the given bytes."""
    empty = len('{"custom_id":"r000","body":""}') + 1
    rows = [(0, n, -1, (f"r{n:03}", "x" * (b - empty))) for n, b in enumerate(sizes)]
    return spark.createDataFrame(rows, "kind int, area_ord long, route_ord long, request struct<custom_id:string,body:string>").repartition(parts)


@pytest.mark.parametrize("max_requests,max_bytes", [(1000, 400), (3, 10_000), (4, 300)])
def test_batches_within_both_limits(spark, max_requests, max_bytes):
    import random

    rng = random.Random(max_bytes)
    sizes = [rng.choice([40, 60, 150, 300]) for _ in range(400)]
    got = sorted((r["area_ord"], r["batch_no"]) for r in enrich.cut_batches(_sized_requests(spark, sizes), max_requests, max_bytes).collect())
    assert [n for n, _ in got] == list(range(400))
    numbers = [b for _, b in got]
    assert numbers == sorted(numbers) and set(numbers) == set(range(1, max(numbers) + 1))
    totals = {}
    for n, b in got:
        totals.setdefault(b, []).append(sizes[n])
    assert all(len(t) <= max_requests and sum(t) <= max_bytes for t in totals.values())
    # next fit: two batches that follow each other in a range would not fit into one; ranges add one batch each
    small = sum(len(totals[b]) < max_requests and sum(totals[b]) + totals[b + 1][0] <= max_bytes for b in totals if b + 1 in totals)
    assert small <= 8


def test_a_request_beyond_the_limit_is_an_error(spark):
    with pytest.raises(Exception, match="r001"):
        enrich.cut_batches(_sized_requests(spark, [50, 500, 50]), 10, 400)
    assert enrich.cut_batches(_sized_requests(spark, [50]).limit(0)).collect() == []


def test_a_request_beyond_the_limit_can_be_alone(spark):
    sizes = [50, 500, 50, 60, 700, 800, 40]
    got = enrich.cut_batches(_sized_requests(spark, sizes).coalesce(1), 10, 400, large_alone=True).collect()
    batches = {}
    for r in got:
        batches.setdefault(r["batch_no"], []).append(sizes[r["area_ord"]])
    assert sorted(s for b in batches.values() for s in b) == sorted(sizes)
    assert set(batches) == set(range(1, max(batches) + 1))
    assert all(len(b) == 1 or sum(b) <= 400 for b in batches.values())
    order = [r["batch_no"] for r in sorted(got, key=lambda r: r["area_ord"])]
    assert order == sorted(order)
