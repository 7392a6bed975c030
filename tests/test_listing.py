import json

import pytest
from pyspark.sql import functions as F

from crestline import fixed
from crestline.functions import derive, text
from crestline.functions.arrays import TAG_MAP
from crestline.operators import facets, hierarchy, search, sorting
from crestline.operators import filters as FL
from crestline.plans import listing as plan
from crestline.schemas import HIERARCHY


def places(*names):
    return [(i + 1, n, f"u{i}") for i, n in enumerate(names)]


ROWS = [  # id, name, grade, type, votes, stars, lr, tags, area path names
    ("r0", "Alpha", "5.9", "Sport", 10, 3.0, "2", {fixed.SAFETY: ["sandbag"]}, ("All Locations", "West", "Crag")),
    ("r1", "Beta, The", "5.10a", "Trad, Grade III", 30, 2.0, "1", {fixed.CROWDS: ["classic_route"]}, ("All Locations", "West", "Crag")),
    ("r2", "Gamma", "V4", "TR", 20, 1.0, "x", {}, ("All Locations", "Westfalia", "Far")),
    ("r3", "Delta", "5.12c", "Sport, Boulder", 5, 4.0, "3", {}, ("All Locations", "East", "Wall")),
    ("r4", "Beta ray", "5.11a", "Gradeless, Sport", 30, 2.0, "1", {fixed.SAFETY: ["first_in_grade"]}, ("All Locations", "East", "Wall")),
]


@pytest.fixture(scope="module")
def routes(spark):
    df = spark.createDataFrame(
        [(*r[:7], json.dumps(r[7]), places(*r[8]), i, i) for i, r in enumerate(ROWS)],
        "route_id string, route_name string, route_grade string, route_type string, route_votes int, "
        f"route_stars double, route_lr string, route_tags string, area_hierarchy {HIERARCHY}, area_ord int, route_ord int")
    return FL.with_web_path(df.withColumn("route_tags", F.from_json("route_tags", TAG_MAP))).cache()


def ids(df):
    return [r["route_id"] for r in df.collect()]


def test_default_listing(routes):
    # excluded type drops r3; ties keep input order
    assert ids(plan.run(routes)) == ["r1", "r4", "r2", "r0"]
    assert ids(plan.run(routes, visible=2)) == ["r1", "r4"]
    assert ids(plan.run(routes, route_id="r3")) == ["r3"]


def test_unrankable_grade_passes_all(routes):
    f = FL.ListingFilter("5.10a", "5.10d", ("Trad",), {fixed.CROWDS: ("classic_route",)})
    assert sorted(ids(plan.run(routes, f))) == ["r1", "r2"]
    assert ids(routes.filter(FL.listing_predicate(f, strict=True))) == ["r1"]


def test_type_ignores_grade_words(routes):
    assert sorted(ids(plan.run(routes, FL.ListingFilter(types=("Sport",))))) == ["r0", "r2", "r4"]


def test_exclusion_tags(routes):
    only = FL.ListingFilter(tags={fixed.SAFETY: ("exclude_sandbag",)})
    assert sorted(ids(plan.run(routes, only))) == ["r1", "r2", "r4"]
    both = FL.ListingFilter(tags={fixed.SAFETY: ("exclude_sandbag", "first_in_grade")})
    assert sorted(ids(plan.run(routes, both))) == ["r2", "r4"]


def test_prefix_is_raw_unless_by_segment(routes, spark):
    path = F.col("area_path")
    west = "All Locations / West"
    assert ids(routes.filter(FL.path_prefix(path, [west]))) == ["r0", "r1", "r2"]
    assert ids(routes.filter(FL.path_prefix(path, [west], by_segment=True))) == ["r0", "r1"]
    table = spark.createDataFrame([(west,), ("All Loc",), ("nothing here that is longer than any path of the table",)],
                                  "selected_path string")
    assert sorted(ids(FL.in_selected_areas(routes, table))) == ["r0", "r1", "r2", "r3", "r4"]
    assert sorted(ids(FL.in_selected_areas(routes, table.filter(F.col("selected_path") == west)))) == ["r0", "r1", "r2"]


def test_hook(routes):
    # bounds as given, unrankable grades out
    assert ids(routes.filter(FL.hook_predicate(FL.HOOK_DEFAULT, "BETA"))) == ["r1", "r4"]
    assert ids(routes.filter(FL.hook_predicate(FL.HOOK_DEFAULT, "gamma"))) == []


@pytest.mark.parametrize("option,reverse,want", [
    ("grade", False, ["r2", "r0", "r1", "r4", "r3"]), ("grade", True, ["r3", "r4", "r1", "r0", "r2"]),
    ("stars", False, ["r3", "r0", "r1", "r4", "r2"]), ("votes", True, ["r3", "r0", "r2", "r1", "r4"]),
    ("left_to_right", False, ["r0", "r1", "r2", "r3", "r4"])])
def test_orders(routes, option, reverse, want):
    assert ids(sorting.first_rows(routes, sorting.listing_order(option, reverse))) == want


def test_toggle():
    assert sorting.toggle(("votes", "desc"), "votes") == ("votes", "asc")
    assert sorting.toggle(("votes", "asc"), "votes") == ("votes", "desc")
    assert sorting.toggle(("votes", "asc"), "stars") == ("stars", "desc")


def test_store_keys():
    assert sorting.store_keys("bogus", "desc") == [("quality_score", True), ("route_id", False)]
    assert sorting.store_keys("votes", "asc", has_grade=True) == [
        ("grade_numeric", False), ("route_votes", False), ("route_id", False)]
    assert sorting.store_keys("lr", "desc", text_search=True)[0] == ("quality_score", True)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.range(0, 73).select(
        F.format_string("r%02d", "id").alias("route_id"), (F.col("id") % 5).cast("double").alias("route_votes"),
        (F.col("id") % 7).cast("int").alias("grade_numeric"), F.lit(1.0).alias("quality_score"),
        F.lit(0.0).alias("route_stars"), F.lit(0.0).alias("route_lr"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("slab"))).otherwise(F.array(F.lit("x"))).alias("tags"),
        F.array(F.lit("Sport")).alias("route_type"), F.format_string("a%d", F.col("id") % 12).alias("area_id"),
        F.lit("All/West").alias("area_hierarchy_path"), F.lit(True).alias("is_trad"), F.lit(True).alias("is_sport"),
        F.lit(False).alias("is_multipitch"),
        F.concat(F.lit("rock "), F.col("id").cast("string")).alias("searchable_text")).cache()


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_equal_one_sort(docs, direction):
    f = FL.StoreFilter(tags=("slab",))
    paged = sorting.pages(docs, f, 10, "votes", direction, page_size=9).orderBy("page_no", "page_pos")
    whole = docs.filter(FL.residual_predicate(f)).orderBy(*sorting.store_order("votes", direction))
    assert ids(paged) == ids(whole)


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_keep_null_keys(docs, direction):
    f = FL.StoreFilter()
    some = docs.withColumn("route_votes", F.when(F.col("grade_numeric") > 2, F.col("route_votes")))
    paged = sorting.pages(some, f, 30, "votes", direction, page_size=3).orderBy("page_no", "page_pos")
    assert ids(paged) == ids(some.orderBy(*sorting.store_order("votes", direction)))


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_indexed_pages_equal_one_sort(docs, direction):
    """Every page by its number, with null keys and ties, from one index."""
    f = FL.StoreFilter(tags=("slab",))
    some = docs.withColumn("route_votes", F.when(F.col("grade_numeric") > 2, F.col("route_votes")))
    index = sorting.page_index(some, f, "votes", direction, page_size=8).cache()
    whole = ids(some.filter(FL.residual_predicate(f)).orderBy(*sorting.store_order("votes", direction)))
    assert sorted(r["page_no"] for r in index.collect()) == list(range(1, -(-len(whole) // 8) + 1))
    for n in (1, 2, 3, 5):
        page = sorting.indexed_page(some, index, n, f, "votes", direction, page_size=8)
        assert ids(page.orderBy("page_pos")) == whole[8 * (n - 1):8 * n]
    assert sorting.indexed_page(some, index, 6, f, "votes", direction, page_size=8) is None
    none = FL.StoreFilter(tags=("nothing",))
    assert sorting.page_index(some, none, "votes", direction).collect() == []


def test_pages_say_whether_more_follow(docs):
    f = FL.StoreFilter()
    got = {(r["page_no"], r["has_more"]) for r in sorting.pages(docs, f, 3, "votes", page_size=10).collect()}
    assert got == {(1, True), (2, True), (3, True)}
    got = {(r["page_no"], r["has_more"]) for r in sorting.pages(docs, f, 9, "votes", page_size=10).collect()}
    assert got == {(n, n < 8) for n in range(1, 9)}


def test_page_is_filtered_before_it_is_cut(docs):
    assert sorting.page_frame(docs, FL.StoreFilter(tags=("slab",)), "votes", "desc", page_size=10).count() == 10


def test_many_ids(docs):
    f = FL.StoreFilter(area_ids=tuple(f"a{i}" for i in range(12)))
    assert docs.filter(FL.area_conds(f)).count() == 73


def test_excluded_case(docs):
    assert docs.filter(FL.no_excluded_type(F.col("route_type"), ("sport",))).count() == 0


def test_areas_by_path_has_no_hidden_limit(docs):
    areas = docs.select(F.col("route_id").alias("area_id"), "area_hierarchy_path")
    assert FL.areas_by_path(areas, "All/W").count() == 73
    assert FL.areas_by_path(areas, "All/W", limit=5).count() == 5


def test_nothing_selected_is_everything(spark, docs):
    none = spark.createDataFrame([], "selected_path string")
    routes = docs.withColumn("area_path", F.col("area_hierarchy_path"))
    assert FL.in_selected_areas(routes, none).count() == 73
    assert FL.in_selected_areas(routes, spark.createDataFrame([("All/W",)], "selected_path string")).count() == 73


def test_path_range(docs):
    assert docs.filter(FL.path_range(F.col("area_hierarchy_path"), "All/W")).count() == 73
    assert docs.filter(FL.path_range(F.col("area_hierarchy_path"), "All/X")).count() == 0


def test_text_search(docs):
    assert ids(search.search_routes(docs, "rock 72")) == ["r72"]
    assert search.search_routes(docs, " x ").count() == 0
    many = FL.StoreFilter(area_ids=tuple(f"b{i}" for i in range(11)))
    assert search.search_routes(docs, "rock", many).count() == 0


def test_field_score(spark):
    df = spark.createDataFrame([("Big Wall",), ("wall-big",), ("Cowallbig",), ("Big",)], "t string")
    got = [r[0] for r in df.select(search.field_score(F.col("t"), "big wall")).collect()]
    assert got == [6 + 8 + 10 + 100, 6 + 8 + 10, 6 + 8, -1]


def test_search_listing(routes, spark):
    areas = routes.select("area_ord", "area_hierarchy")
    hits = search.search_listing(areas, routes, "beta").collect()
    assert [(r["type"], r["text"]) for r in hits] == [("route", "The Beta"), ("route", "Beta ray")]
    west = search.search_area_paths(areas, "west").collect()
    # equal scores: children of an earlier parent come first
    assert [r["id"] for r in west] == [
        "All Locations / West", "All Locations / Westfalia", "All Locations / West / Crag",
        "All Locations / Westfalia / Far"]
    assert search.search_listing(areas, routes, "b").count() == 0


def test_edges_and_selection(routes):
    edges = hierarchy.path_edges(routes.select("area_ord", "area_hierarchy"))
    top = [r["path"] for r in hierarchy.children_of(routes.select("area_ord", "area_hierarchy"), "").collect()]
    assert top == ["All Locations"] and edges.count() == 7
    assert hierarchy.toggle_selection(["a"], "b") == ["a", "b"]
    assert hierarchy.toggle_selection(["a", "b"], "a") == ["b"]
    assert hierarchy.remove_selection(["a", "b"], "c") == ["a", "b"]


def test_trees(spark):
    rows = [("root", "All", 0, places()), ("w", "West", 1, places("All")), ("w2", "West", 2, places("Else")),
            ("c", "Crag", 3, places("All", "West"))]
    df = spark.createDataFrame(rows, f"area_id string, area_name string, area_ord int, area_hierarchy {HIERARCHY}")
    got = {r["area_id"]: r["parent_id"] for r in hierarchy.tree_by_depth(df).collect()}
    assert got == {"root": None, "w": "root", "w2": None, "c": "w"}
    named = spark.createDataFrame(
        [("a", "All", 0, places("All")), ("w", "West", 1, places("All", "West")), ("x", "X", 2, places("Gone", "X"))],
        f"area_id string, area_name string, area_ord int, area_hierarchy {HIERARCHY}")
    got = {r["area_id"]: (r["parent_id"], r["is_root"]) for r in hierarchy.tree_by_name(named).collect()}
    assert got == {"a": (None, True), "w": ("a", False)}


def test_curated_facets(routes):
    got = [(r["category"], r["tag"]) for r in facets.curated_facets(routes).orderBy("ord").collect()]
    assert got == [(fixed.CROWDS, "classic_route"), (fixed.SAFETY, "first_in_grade"), (fixed.SAFETY, "exclude_sandbag"),
                   (fixed.SAFETY, "exclude_runout_dangerous"), (fixed.PITCHES, "single_pitch")]


def test_display(spark):
    df = spark.createDataFrame([("Nose, The", 2.5, "x" * 151)], "n string, s double, d string")
    r = df.select(text.display_name(F.col("n")).alias("n"), text.stars_display(F.col("s")).alias("s"),
                  text.preview(F.col("d")).alias("d"),
                  text.title_case(F.lit("o'brien 2nd")).alias("t"),
                  text.short_path(F.lit("All Locations / A very long segment name / B")).alias("p")).first()
    assert (r["n"], tuple(r["s"]), len(r["d"]), r["t"], r["p"]) == (
        "The Nose", (2, 1, 1), 153, "O'Brien 2Nd", "A very long ... / B")


def test_short_location(spark):
    df = spark.createDataFrame([(0, places("All Locations")), (1, places("All Locations", "A")),
                                (2, places("All Locations", "A", "B", "C"))], f"i int, h {HIERARCHY}")
    got = [[x["area_hierarchy_name"] for x in r[0]] for r in
           df.orderBy("i").select(text.short_location(F.col("h"))).collect()]
    assert got == [[], ["A"], ["B", "C"]]


def test_flat_tags(spark):
    df = spark.createDataFrame([('{"B":["x","x"],"A":["y"]}',), ("[]",), (None,)], "r string")
    got = [r[0] for r in df.select(derive.flat_tags(derive.tag_map(F.col("r")))).collect()]
    assert got == [["x", "B:x", "y", "A:y"], [], []]


def test_bounds_reach_the_scan(spark, docs, tmp_path):
    path = str(tmp_path / "docs")
    docs.write.parquet(path)
    f = FL.StoreFilter(min_grade="5.3", is_trad=True, area_path="All/West")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan_text = spark.read.parquet(path).filter(FL.pushed_predicate(f))._jdf.queryExecution().executedPlan().toString()
    for pushed in ("GreaterThanOrEqual(grade_numeric,0)", "EqualTo(is_trad,true)",
                   "GreaterThanOrEqual(area_hierarchy_path,All/West)"):
        assert pushed in plan_text, plan_text
