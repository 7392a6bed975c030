import pytest
from pyspark.sql import functions as F

from crestline.operators import crawl, extract, ledger
from crestline.sources.html import page_elements, with_elements

AREA = """<html><head><style>h1{}</style><!-- <h1>no</h1> --></head><body><h1> Big <b>Wall</b>
</h1><div class="mb-half small text-warm"><a href="/area/1/all">All Locations</a> <a href="/area/2/north-side">No…</a>
<a href="/area/3/abc-rocks">ABC</a></div>
<div class="max-height max-height-md-0 max-height-xs-400"><div><div><a href="/area/9/x">X</a></div></div>
<a href="https://crags.example.org/area/8/y">Y</a><a href="/area/9/x">X again</a><a href="/forum/1">no</a></div>
<a href="/area/77/outside">outside</a>
<h2>Getting <i>There</i></h2><div class="fr-view wide"> Walk <div>up <b>hill</b></div> now</div>
<table class="description-details"><tr><td>GPS:<td><a target="_blank" href="https://maps.google.com/x">m</a>
<tr><td>Page Views:</td><td>12,345 total &middot; 3/month</td></tr>
<tr><td>Shared By:</td><td>Bo on Mar 4, 2021</td></tr></table>
<div id="access-details-3"></div><div id="access-details-4">No <b>dogs</b></div></body></html>"""

ROUTE = """<h2 class="inline">R <span class="rateYDS">5.10a YDS</span> runout </h2>
<span id="x-starsWithAvgText-9">Avg: 3.4 from 1,234 votes</span><table><tr><td>Type:</td>
<td>Trad, 660 ft (200 m), 6 pitches, Grade IV</td></tr><tr><td>FA:</td><td>Royal <b>R</b></td></tr></table>
<h2>Location</h2><div class="fr-view">left</div><h2>Protection</h2><div class="fr-view">nuts</div>
<h2>Gear</h2><div class="fr-view">cams</div><h2>Description</h2><div class="fr-view">d1</div>
<div class="comment-list"><table class="main-comment"><tr><td><div class="bio">x <a href="/user/1"> Ann </a></div>
<div class="comment-body">Great <p>fun</p></div><span class="comment-time">May 1</span></td></tr></table>
<table class="main-comment"><tr><td><div class="comment-body">See <a href="/user/2">Bo</a></div></td></tr></table></div>"""

STATS = """<h3> Suggested Ratings <small>4</small></h3><table class="table table-striped">
<tr><td>a</td><td>5.9</td></tr><tr><td>b</td><td> 5.9 </td></tr><tr><td>c</td><td>· bad</td></tr>
<tr><td>d</td><td></td></tr><tr><td>e</td><td>5.10a</td></tr></table><h3>Ticks</h3>
<table class="table table-striped"><tr><td>u</td><td>Jan 3, 2021 &middot; Lead &middot; one two three four five six seven
eight nine ten eleven twelve thirteen fourteen <b>fifteen</b></td></tr><tr><td>v</td><td>too short</td></tr></table>"""

URL = "https://crags.example.org/area/5/big-wall"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(URL, AREA), ("r", ROUTE), ("s", STATS), ("empty", ""), ("none", None)]
    return with_elements(spark.createDataFrame(rows, "url string, html string")).cache()


def row(pages, url, *cols):
    return pages.filter(F.col("url") == url).select(*cols).first()


def test_area_record(pages):
    r = extract.area_records(pages.filter(F.col("url") == URL)).first()
    assert r["area_name"] == "big-wall" and r["area_gps"] == "https://maps.google.com/x"
    assert (r["area_page_views"], r["area_shared_on"]) == ("12345", "Mar, 2021")
    assert r["area_access_issues"] == "No dogs"
    assert r["area_description"] == r["area_getting_there"] == "Walkuphillnow"
    assert [(h["level"], h["area_hierarchy_name"]) for h in r["area_hierarchy"]] == [
        (1, "All Locations"), (2, "North Side"), (3, "Abc Rocks"), (4, "Big Wall")]


def test_links_and_title(pages):
    r = row(pages, URL, extract.title().alias("t"), extract.nav_links().alias("l"))
    assert r["t"] == "Big Wall" and r["l"] == ["/area/9/x", "https://crags.example.org/area/8/y"]
    edges = {e["dst_url"] for e in extract.page_links(pages).collect()}
    assert edges == {"https://crags.example.org/area/9/x", "https://crags.example.org/area/8/y"}
    assert row(pages, "empty", extract.title().alias("t"))["t"] == "Unknown Area"
    assert not any(r["is_leaf"] for r in extract.leaf_flags(pages.filter("error IS NULL")).collect())


def test_route_record(pages):
    r = extract.route_details(pages.filter("url = 'r'")).first()
    assert (r["route_grade"], r["route_protection_grading"], r["route_stars"], r["route_votes"]) == (
        "5.10a", "R runout", 3.4, 1234)
    assert (r["route_type"], r["route_pitches"], r["route_length_ft"], r["route_length_meter"]) == (
        "Trad, Grade IV", 6, 660, 200)
    assert (r["route_fa"], r["route_description"], r["route_location"], r["route_protection"]) == (
        "RoyalR", "d1", "left", "cams")
    assert [tuple(c) for c in r["route_comments"]] == [("Ann", "Great fun", "May 1"), ("N/A", "See Bo", "N/A")]


def test_missing_fields(pages):
    r = extract.route_details(pages.filter("url = 'empty'")).first()
    assert (r["route_grade"], r["route_type"], r["route_pitches"], r["route_stars"], r["route_fa"]) == (
        "Unknown", "N/A", 1, None, "N/A")
    assert r["route_comments"] == [] and r["route_page_views"] == "N/A"


@pytest.mark.parametrize("text,want", [
    ("Sport, 80 ft", ("Sport", 1, None, None)), 
    ("Trad, TR, 1 pitch", ("Trad, TR, 1 pitch", 1, None, None)),  # only "pitches" is a count
    ("90 ft (27 m), Sport, 2 Pitches", ("Sport", 2, 90, 27))])
def test_type_line(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(extract.type_line(F.col("t")).alias("x")).first()["x"]) == want


def test_stats(pages):
    r = extract.route_stats(pages.filter("url = 's'")).first()
    assert r["route_suggested_ratings"] == {"5.9": 2, "5.10a": 1}
    assert r["route_tick_comments"].startswith("one two") and r["route_tick_comments"].endswith("fifteen")


def test_bad_page_does_not_stop_others(pages):
    good, failed = ledger.good_and_failed(pages)
    assert good.count() == 4 and failed.first()["url"] == "none"


def test_unclosed_and_quoted():
    els = page_elements('<table id=t><tr data-lr="1"><td>a<td title="x>y">b<tr><td>c</table><div class=q>d')
    assert [(e["tag"], e["texts"], e["nth"]) for e in els if e["tag"] == "td"] == [
        ("td", ["a"], 0), ("td", ["b"], 1), ("td", ["c"], 0)]
    assert els[-1]["texts"] == ["d"]


def test_stats_url(spark):
    df = spark.createDataFrame([("https://x/route/1/route/2",), ("https://x/area/1",)], "u string")
    assert [r[0] for r in df.select(extract.stats_url(F.col("u"))).collect()] == [
        "https://x/route/stats/1/route/2", "https://x/area/1"]


def test_nest_in_parts(spark):
    areas = spark.createDataFrame([("a", "A"), ("b", "B")], "area_id string, area_name string")
    routes = spark.range(0, 2500).select(
        F.lit("a").alias("area_id"), F.lit("u").alias("area_url"), F.col("id").cast("int").alias("route_pos"),
        F.col("id").cast("string").alias("route_id"))
    out = extract.nest(areas, routes).collect()
    parts = {(r["area_id"], r["part"]): [x["route_id"] for x in r["routes"]] for r in out}
    assert [len(parts[k]) for k in sorted(parts)] == [1000, 1000, 500, 0]
    assert parts[("a", 1)][0] == "1000" and parts[("b", 0)] == []


def test_cyclic_discovery(spark):
    graph = spark.createDataFrame([
        ("root", False, ["a", "b", "root"]), ("a", False, ["root", "leaf1", "gone"]), ("b", False, ["a", "leaf2"]),
        ("leaf1", True, ["hidden"]), ("leaf2", True, []), ("hidden", True, []), ("island", True, [])],
        "url string, is_leaf boolean, links array<string>")
    start = spark.createDataFrame([("root",)], "url string")
    got = {r["url"]: r["wave"] for r in crawl.discover_leaves(graph, start).collect()}
    assert got == {"leaf1": 2, "leaf2": 2}
    leaf_only = crawl.discover_leaves(graph, spark.createDataFrame([("leaf2",)], "url string")).collect()
    assert [r["url"] for r in leaf_only] == ["leaf2"]


def test_long_chain_is_compacted(spark):
    edges = spark.range(0, 12).select(F.col("id").cast("string").alias("src_url"),
                                      (F.col("id") + 1).cast("string").alias("dst_url"))
    start = spark.createDataFrame([("0",)], "url string")
    assert crawl.reachable(edges, start).count() == 13


def test_waves_shuffle_found_links_only(spark):
    """Buckets spare links and visited pages the shuffle; few pages read their buckets only."""
    from crestline.session import BucketedTable

    pages = spark.range(0, 20_000).select(F.col("id").cast("string").alias("src_url"), (F.col("id") * 7 % 20_000).cast("string").alias("dst_url"))
    links = BucketedTable(pages, "links", "src_url", 8)
    visited = BucketedTable(pages.select(F.col("src_url").alias("url"), (F.col("src_url").cast("int") % 3).alias("wave")), "visited", "url", 8)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = crawl.new_links(links.read(), visited.read(), 2)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(url" in plan, plan
        few = crawl.new_links(links.read().filter(F.col("src_url").isin(["5"])), visited.read(), 2)
        assert "SelectedBucketsCount: 1 out of 8" in few._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    links.drop()
    assert visited.forget().count() == 20_000  # without its name


def test_wide_waves_of_a_cyclic_graph(spark):
    """Every page links to its children, the root and itself; far more pages than are looked up by name."""
    ids = spark.range(0, 30_000).withColumn("to", F.explode(F.array(
        F.col("id") * 40 + 1, F.col("id") * 40 + 2, F.col("id") * 40 + 39, F.lit(0), F.col("id"))))
    edges = ids.select(F.concat(F.lit("p"), "id").alias("src_url"), F.concat(F.lit("p"), "to").alias("dst_url"))
    got = crawl.reachable(edges, spark.createDataFrame([("p0",)], "url string"))
    want, front, wave = {0: 0}, [0], 0
    while front:
        wave += 1
        front = [t for n in front if n < 30_000 for t in (n * 40 + 1, n * 40 + 2, n * 40 + 39) if t not in want]
        want.update({n: wave for n in front})
    assert {r["url"]: r["wave"] for r in got.collect()} == {f"p{n}": w for n, w in want.items()}
    # 3 children each: several waves are beyond the pages that are looked up
    assert max(want.values()) >= 3


@pytest.mark.parametrize("age,fresh", [("0 00:00:00", True), ("7 23:00:00", True), ("8 00:00:00", False)])
def test_freshness(spark, age, fresh):
    df = spark.sql(f"SELECT timestamp'2024-03-20 12:00:00' AS now, "
                   f"timestamp'2024-03-20 12:00:00' - INTERVAL '{age}' DAY TO SECOND AS at")
    assert df.select(ledger.is_fresh(F.col("at"), F.col("now"))).first()[0] is fresh
    assert df.select(ledger.is_fresh(F.col("at"), F.col("now"), no_cache=True)).first()[0] is False


def test_resume_ignores_other_start(spark):
    todo = spark.createDataFrame([("u1",), ("u2",)], "url string")
    done = spark.createDataFrame([("base", ["u1"]), ("other", ["u2"])], "base_url string, processed_urls array<string>")
    assert [r["url"] for r in ledger.remaining(todo, done, "base").collect()] == ["u2"]


STRAY = """<div class="comment-list"><div class="comment-body">stray</div><span class="comment-time">now</span>
<table class="main-comment"><tr><td><table><tr><td><div class="bio">x <a href="/user/1">Ann</a></div></td></tr></table>
<table><tr><td><div class="comment-body">Inner</div></td></tr></table></td></tr></table>
<table class="main-comment"><tr><td><div class="comment-body">Outer</div>
<table class="main-comment"><tr><td><div class="comment-body">Reply</div></td></tr></table></td></tr></table></div>"""


def test_comment_parts_outside_and_in_inner_tables(spark):
    pages = spark.createDataFrame([("bad", STRAY), ("none", "<p>x"), ("null", None)], "url string, html string")
    rows = {r["url"]: r for r in with_elements(pages).select("url", "error", extract.comments().alias("c")).collect()}
    assert [(c["comment_author"], c["comment_text"]) for c in rows["bad"]["c"]] == [("Ann", "Inner"), ("N/A", "Outer"), ("N/A", "Reply")]
    assert rows["none"]["c"] == [] and rows["null"]["error"]


def test_authors_of_many_comments(spark):
    """A page's authors are found in its one pass; nested boxes of persons have the first user in each."""
    one = '<table class="main-comment"><tr><td><div class="bio"><a href="/x">no</a><a href="/user/{0}"> U{0} </a><a href="/user/z">later</a></div></td></tr></table>'
    html = '<div class="comment-list">' + "".join(one.format(n) for n in range(3000)) + "</div>"
    inner = ('<div class="comment-list"><table class="main-comment"><tr><td><div class="bio">who <div class="bio"><a href="/user/1">In</a></div>'
             '<a href="/user/2">Out</a></div></td></tr></table></div>')
    df = spark.createDataFrame([("many", html), ("nested", inner)], "url string, html string")
    got = {r["url"]: [c["comment_author"] for c in r["c"]] for r in with_elements(df).select("url", extract.comments().alias("c")).collect()}
    assert got == {"many": [f"U{n}" for n in range(3000)], "nested": ["In"]}


def test_resumed_run_parses_what_it_lists(spark, tmp_path):
    """Pages of routes that no remaining area lists are not parsed."""
    from crestline.plans import extraction

    listed = spark.createDataFrame([("https://x/route/1/a",), ("https://x/route/1/a",)], "route_url string")
    routes = spark.createDataFrame([(f"https://x/route/{n}/a", "<p>") for n in range(5)], "url string, html string")
    stats = spark.createDataFrame([(f"https://x/route/stats/{n}/a", "<p>") for n in range(5)], "url string, html string")
    got = extraction.pages_of(listed, routes, stats)
    assert [[r["url"] for r in df.collect()] for df in got] == [["https://x/route/1/a"], ["https://x/route/stats/1/a"]]


def test_listed_tags_only(spark, sf):
    from crestline.plans import mapping as m
    from crestline.sources import html

    pages = [r["html"] for t in ("site_area_pages", "site_route_pages", "site_stats_pages")
             for r in getattr(m, t)(spark, sf).limit(20).collect()]
    pages += ['<h2>x <a href="/user/1">u</a> y</h2><table class="main-comment"><tr data-lr=3><td>a<td>b<div class="bio"><a href="/user/2">v</a>',
              "<div class=q><a>x", ""]
    for tags in (("h3", "table", "td"), ("div", "td"), ("h2", "span"), ("a", "h1")):
        for page in pages:
            whole = page_elements(page)
            assert page_elements(page, tags) == [e for e in whole if e["tag"] in tags]
    els = [page_elements(p) for p in pages[-3:]]
    assert html._arrow([None, *els, None, []]).to_pylist() == [None, *els, None, []]


def test_area_pages_are_dealt_out(spark, sf):
    from crestline.plans import mapping as m

    assert m.site_area_pages(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
