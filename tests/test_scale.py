"""Plans and hot keys: a third of all rows on one key."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from crestline.operators import extract, hierarchy, ledger, reduction
from crestline.operators.keyed import FEW_KEYS, first_wins, last_wins
from crestline.operators.ordinal import global_row_number
from crestline.plans import extraction
from crestline.plans import mapping as m
from crestline.schemas import HIERARCHY
from crestline.sources.html import with_elements

N = 30_000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 1000).cast("string")))
    return spark.range(0, N, 1, 8).select(key.alias("area_id"), F.col("id").alias("ord"))


def test_winners_fold_before_the_shuffle(hot):
    last, first = last_wins(hot, ["area_id"], ["ord"]), first_wins(hot, ["area_id"], ["ord"])
    assert "partial_max_by" in plan(last) and "partial_min_by" in plan(first)
    assert "Window" not in plan(last)
    assert last.filter("area_id = 'hot'").first()["ord"] == N - 3
    assert first.filter("area_id = 'hot'").first()["ord"] == 0
    assert last.count() == hot.select("area_id").distinct().count()


def test_crowded_area_is_nested_in_parts(spark, hot):
    routes = hot.select("area_id", F.lit("u").alias("area_url"), F.col("ord").cast("int").alias("route_pos"),
                        F.col("ord").cast("string").alias("route_id"))
    areas = hot.select("area_id").distinct()
    out = extract.nest(areas, routes, per_row=500)
    r = out.agg(F.max(F.size("routes")).alias("widest"), F.sum(F.size("routes")).alias("n")).first()
    assert r["widest"] <= 500 and r["n"] == N


def test_statistics_fold_per_area(hot):
    routes = hot.select("area_id", F.lit("s").alias("state"), F.lit("Sport").alias("route_type"))
    stats = reduction.reduction_stats(routes.select("state", "area_id").distinct(), routes)
    assert "partial_count" in plan(stats)
    assert stats.first()["routes_kept"] == N


def test_global_numbers_are_dense_and_ordered(hot):
    out = global_row_number(hot, ["area_id", "ord"], "no", total="n")
    rows = out.collect()
    assert [r["no"] for r in sorted(rows, key=lambda r: (r["area_id"], r["ord"]))] == list(range(1, N + 1))
    assert {r["n"] for r in rows} == {N}


def test_wide_tree_node(spark):
    path = F.array(F.struct(F.lit(1).alias("level"), F.lit("All").alias("area_hierarchy_name"), F.lit("u").alias("area_hierarchy_url")))
    leaves = spark.range(0, 5000).select(F.col("id").cast("string").alias("area_id"), F.lit("x").alias("area_name"),
                                         path.cast(HIERARCHY).alias("area_hierarchy"))
    root = spark.range(1).select(F.lit("root").alias("area_id"), F.lit("All").alias("area_name"),
                                 F.array().cast(HIERARCHY).alias("area_hierarchy"))
    tree = hierarchy.tree_by_depth(leaves.unionByName(root))
    assert tree.filter("parent_id = 'root'").count() == 5000


@pytest.mark.parametrize("name", ["area_prefix_table", "filtered_listing", "enriched_route_tags", "curated_facets",
                                  "search_listing", "area_tree_by_name", "flat_routes", "reduction_totals"])
def test_no_nested_loops_or_windows(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Window", "EvalPython"):
        assert word not in text, word


def test_top_rows_stay_small(spark, sf):
    assert "TakeOrderedAndProject" in plan(entry.queries()["listing_by_votes"](spark, sf))


@pytest.mark.parametrize("name,pushed", [("store_route_by_id", "EqualTo(route_id,42)"),
                                         ("store_flags", "EqualTo(is_multipitch,true)"),
                                         ("stored_routes_by_path", "area_hierarchy_path")])
def test_store_predicates_reach_the_scan(spark, sf, name, pushed):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(entry.queries()[name](spark, sf))
    assert pushed in text[text.index("PushedFilters"):]


def test_pages_are_read_once(spark, sf):
    assert plan(entry.queries()["site_nested_records"](spark, sf)).count("MapInArrow") <= 2  # route and stats pages


def _route_url():
    return F.expr("concat('https://crags.example.org/route/', id, '/r-', id)")


@pytest.fixture(scope="module")
def listed(spark, tmp_path_factory):
    """One list of more routes than are broadcast, in a small file."""
    path = str(tmp_path_factory.mktemp("listed") / "t")
    spark.range(FEW_KEYS + 1).select(F.lit("a").alias("area_id"), F.lit("u").alias("area_url"), F.col("id").cast("int").alias("route_pos"),
                                     _route_url().alias("route_url")).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def test_listed_routes_are_not_broadcast(spark, listed):
    pages = spark.range(FEW_KEYS + 9).select(_route_url().alias("url"), F.lit("<h1>x</h1>").alias("html"))
    routes, stats = extraction.pages_of(listed, pages, pages.withColumn("url", extract.stats_url(F.col("url"))))
    assert routes.count() == stats.count() == FEW_KEYS + 1
    areas = listed.select("area_id", "area_url").distinct()
    text = plan(extract.nest(areas, extract.routes_of_areas(
        listed, with_elements(routes), with_elements(stats, tags=extract.STATS_TAGS))))
    assert "Broadcast" not in text and text.count("MapInArrow") == 2  # each page is parsed once
    few = extraction.pages_of(listed.filter("route_pos < 3"), pages, pages)[0]
    assert "BroadcastHashJoin" in plan(few) and few.count() == 3  # pages are not shuffled for a short list


def test_finished_urls_are_not_broadcast(spark, listed, tmp_path):
    listed.groupBy(F.lit("s").alias("base_url")).agg(F.collect_list("route_url").alias("processed_urls")).write.parquet(f"{tmp_path}/c")
    pages = spark.range(FEW_KEYS + 9).select(_route_url().alias("url"))
    left = ledger.remaining(pages, spark.read.parquet(f"{tmp_path}/c"), "s")
    assert "Broadcast" not in plan(left) and left.count() == 8


def test_site_pages_broadcast_nations_only(spark, sf):
    assert plan(m.site_area_pages(spark, sf)).count("BroadcastHashJoin") == 2  # nations and regions
    assert "Broadcast" not in plan(m.rating_maps(spark, sf))


def test_records_of_odd_routes(spark):
    """Late routes, routes without place or area, areas that come twice or have no id: a first part each."""
    routes = spark.createDataFrame([("a", 0, "r0"), ("a", 5, "r5"), ("late", 4, "r4"), ("none", None, "rn"), ("lost", 1, "r1"), (None, 1, "r2"), (None, 4, "r6")],
                                   "area_id string, route_pos int, route_id string")
    areas = spark.createDataFrame([("a", "A"), ("late", "L"), ("twice", "T"), ("twice", "T"), ("none", "N"), (None, "X")], "area_id string, area_name string")
    got = [(r["area_id"], r["area_name"], r["part"], tuple(x["route_id"] for x in r["routes"])) for r in extract.nest(areas, routes, per_row=3).collect()]
    assert sorted(got, key=str) == sorted([
        ("a", "A", 0, ("r0",)), ("a", "A", 1, ("r5",)), ("late", "L", 0, ()), ("late", "L", 1, ("r4",)), ("none", "N", 0, ()), ("none", "N", None, ("rn",)),
        ("twice", "T", 0, ()), ("twice", "T", 0, ()), ("lost", None, 0, ("r1",)), (None, None, 0, ("r2",)), (None, None, 1, ("r6",)), (None, None, 0, ())], key=str)


def test_deep_crawl_keeps_planning(spark):
    from crestline.operators import crawl

    edges = spark.range(40).selectExpr("cast(id as string) src_url", "cast(id + 1 as string) dst_url")
    got = crawl.reachable(edges, spark.createDataFrame([("0",)], "url string"))
    assert {r["url"]: r["wave"] for r in got.collect()} == {str(n): n for n in range(41)}


def test_stream_state_is_compacted(spark, tmp_path):
    from crestline.streaming import arrivals

    def batch(n, rows):
        spark.createDataFrame([("route", i, n, (k,), {"A": [t]}) for k, (i, t) in enumerate(rows)],
                              "kind string, entity_id string, batch_ord int, line_no struct<row:bigint>, tags map<string,array<string>>") \
            .write.parquet(f"{tmp_path}/s/batch={n}")

    def now():
        return {r["entity_id"]: r["tags"]["A"][0] for r in arrivals.current(spark, f"{tmp_path}/s").collect()}

    batch(0, [("a", "old"), ("b", "b")])
    batch(1, [("a", "new")])
    assert now() == {"a": "new", "b": "b"}
    assert arrivals.compact(spark, f"{tmp_path}/s") == 1
    assert not list((tmp_path / "s").glob("batch=*")) and now() == {"a": "new", "b": "b"}
    batch(2, [("b", "newer")])
    assert now() == {"a": "new", "b": "newer"} and arrivals.compact(spark, f"{tmp_path}/s") == 2
    assert now() == {"a": "new", "b": "newer"}
