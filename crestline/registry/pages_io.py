"""Page extraction, discovery, fetch cache, files, versioned stores, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from crestline import fixed
from crestline.functions import derive
from crestline.functions.text import slug_to_title, title_case
from crestline.operators import crawl, enrich, extract, filters, flatten, ledger, reduction
from crestline.plans import enrichment as enrichment_plan
from crestline.plans import extraction, load
from crestline.plans import mapping as m
from crestline.plans import reduction as reduction_plan
from crestline.registry import sql as S
from crestline.registry.base import joined, long_tags, query
from crestline.session import scratch_path, written_table
from crestline.sources import arrays, lines, nested, store
from crestline.sources.html import with_elements

_bare = {"with_votes": False}
_SITE = "https://crags.example.org"


def _area_els(spark, sf):
    return with_elements(m.site_area_pages(spark, sf))


def _url(n):
    return f"'{_SITE}/area/' || {n} || '/crag-' || {n}"


# --- given pages ---------------------------------------------------------------

_UNESCAPE = "replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query("page_titles", f"""SELECT page_id, trim({_UNESCAPE.format("regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's')")}) AS title
    FROM pages""")
def _(spark, sf):
    return with_elements(m.table(spark, sf, "pages")).select("page_id", extract.title().alias("title"))


@query("page_hrefs", """SELECT page_id, pos::INTEGER - 1 AS pos, CASE WHEN starts_with(href, 'http') THEN href
      ELSE regexp_extract(url, '^(https?://[^/]+)', 1) || href END AS href FROM (
    SELECT page_id, url, unnest(l) AS href, generate_subscripts(l, 1) AS pos FROM (
      SELECT *, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS l FROM pages))""")
def _(spark, sf):
    links = F.transform(F.filter("els", lambda e: e["tag"] == "a"), lambda e: e["href"])
    return with_elements(m.table(spark, sf, "pages")).select("page_id", "url", F.posexplode(links).alias("pos", "href")) \
        .select("page_id", "pos", extract.absolute(F.col("href"), F.col("url")).alias("href"))


@query("url_keys", "SELECT page_id, md5(url) AS cache_key FROM pages")
def _(spark, sf):
    return m.table(spark, sf, "pages").select("page_id", ledger.cache_key(F.col("url")).alias("cache_key"))


@query("stats_urls", "SELECT route_id, replace(route_url, '/route/', '/route/stats/') AS stats_url FROM routes")
def _(spark, sf):
    return m.routes(spark, sf, **_bare).select("route_id", extract.stats_url(F.col("route_url")).alias("stats_url"))


@query("slug_titles", """SELECT s_suppkey, 'O''Brien Wall ' || s_suppkey || 'Th' AS title, 'Nation ' || s_nationkey AS nation FROM supplier""")
def _(spark, sf):
    return m.table(spark, sf, "supplier").select(
        "s_suppkey", title_case(F.concat(F.lit("o'brien WALL "), "s_suppkey", F.lit("th"))).alias("title"),
        slug_to_title(F.concat(F.lit("https://x.example/area/nation-"), "s_nationkey", F.lit("/"))).alias("nation"))


# --- fetches -------------------------------------------------------------------

@query("fresh_fetches", """SELECT fetch_id FROM pf, (SELECT max(ts) AS now FROM events)
    WHERE floor(date_diff('microsecond', fetched_at, now) / 86400000000.0) <= 7""")
def _(spark, sf):
    now = m.table(spark, sf, "events").agg(F.max("ts").cast("string")).first()[0]
    fresh = ledger.is_fresh(F.col("fetched_at"), F.lit(now).cast("timestamp_ntz"))
    return m.page_fetches(spark, sf).filter(fresh).select("fetch_id")


@query("latest_fetches", "SELECT url, data_type, max(fetch_id) AS fetch_id FROM pf p WHERE fetched_at = "
       "(SELECT max(fetched_at) FROM pf q WHERE q.url = p.url AND q.data_type = p.data_type) GROUP BY ALL")
def _(spark, sf):
    return ledger.latest_fetch(m.page_fetches(spark, sf)).select("url", "data_type", "fetch_id")


# --- derived site --------------------------------------------------------------

@query("site_links", f"""SELECT {_url("s_suppkey")} AS src_url, {_url("c")} AS dst_url FROM
      (SELECT s_suppkey, unnest(range(10 * s_suppkey + 1, 10 * s_suppkey + 11)) AS c FROM supplier), n WHERE c < ns
    UNION ALL SELECT {_url("s_suppkey")}, {_url("((s_suppkey - 1) // 10)")} FROM supplier, n
      WHERE s_suppkey > 0 AND s_suppkey * 10 + 1 < ns""")
def _(spark, sf):
    return extract.page_links(_area_els(spark, sf))


@query("site_leaves", f"SELECT {_url('s_suppkey')} AS url, s_name || ' & more' AS title, s_suppkey * 10 + 1 >= ns AS is_leaf FROM supplier, n")
def _(spark, sf):
    return extract.leaf_flags(_area_els(spark, sf))


def _start(spark, pages):
    return pages.filter(F.col("url") == f"{_SITE}/area/0/crag-0").select("url")


@query("site_discovery", f"""WITH walk(s, wave) AS (SELECT 0::BIGINT, 0 UNION ALL
      SELECT s_suppkey, wave + 1 FROM walk JOIN supplier ON (s_suppkey - 1) // 10 = s AND s_suppkey > 0)
    SELECT {_url("s")} AS url, wave FROM walk, n WHERE s * 10 + 1 >= ns""")
def _(spark, sf):
    els = _area_els(spark, sf)
    return crawl.discover_leaves(extract.page_graph(els), _start(spark, m.site_area_pages(spark, sf)))


@query("site_reachable", f"SELECT {_url('s_suppkey')} AS url FROM supplier")
def _(spark, sf):
    els = _area_els(spark, sf)
    return crawl.reachable(extract.page_links(els), _start(spark, m.site_area_pages(spark, sf))).select("url")


@query("site_area_records", f"""SELECT md5({_url("s_suppkey")}) AS area_id, 'crag-' || s_suppkey AS area_name,
    'https://maps.google.com/?q=' || s_suppkey || ',1' AS area_gps, 'Crag ' || areas.area_name || 'in' || r_name AS area_description,
    'Road ' || s_suppkey AS area_getting_there, CASE WHEN s_suppkey % 3 = 0 THEN 'Closed in spring' ELSE '' END AS area_access_issues,
    CAST(s_suppkey * 37 + 1234 AS VARCHAR) AS area_page_views, 'May, 2020' AS area_shared_on,
    '1 All Locations|2 ' || CASE r_name WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE left(r_name, 1) || lower(substr(r_name, 2)) END
      || '|3 ' || n_name || '|4 Crag ' || s_suppkey AS hierarchy FROM areas""")
def _(spark, sf):
    places = F.transform("area_hierarchy", lambda h: F.concat(h["level"], F.lit(" "), h["area_hierarchy_name"]))
    return extract.area_records(_area_els(spark, sf)).select(
        "area_id", "area_name", "area_gps", "area_description", "area_getting_there", "area_access_issues",
        "area_page_views", "area_shared_on", joined(places, "|").alias("hierarchy"))


_LIST = f"""SELECT md5({_url("(k % ns)")}) AS area_id, (k // ns)::INTEGER AS route_pos, p_name || k AS route_name,
    '{_SITE}/route/' || k || '/r-' || k AS route_url, k::INTEGER AS route_lr
  FROM routes JOIN part ON p_partkey = k, n WHERE (k % ns) * 10 + 1 >= ns"""


@query("site_route_list", _LIST)
def _(spark, sf):
    return extract.route_list(_area_els(spark, sf)).drop("area_url")


_DETAILS = f"""SELECT '{_SITE}/route/' || k || '/r-' || k AS route_url, split_part(route_grade, ' ', 1) AS route_grade,
    route_protection_grading, route_stars, (route_votes + 1000 * (k % 3))::INTEGER AS route_votes,
    route_type, route_pitches, route_length_ft, route_length_meter, route_fa,
    'Climb ' || k || 'thentopout' AS route_description,
    CASE WHEN k % 5 = 0 THEN 'N/A' ELSE route_location END AS route_location,
    CASE WHEN k % 4 = 0 THEN 'cams < 3' ELSE 'bolts' END AS route_protection, CAST(k * 11 + 990 AS VARCHAR) AS route_page_views,
    CASE WHEN route_shared_on = 'N/A' THEN 'N/A' ELSE left(route_shared_on, 3) || ', 2021' END AS route_shared_on FROM rv"""


@query("site_route_details", _DETAILS)
def _(spark, sf):
    return extract.route_details(with_elements(m.site_route_pages(spark, sf))).drop("route_id", "route_comments")


@query("site_comments", f"""SELECT '{_SITE}/route/' || k || '/r-' || k AS route_url, 0 AS pos, 'Ann ' || k AS comment_author,
      'Nice and long' AS comment_text, 'May 1' AS comment_time FROM routes WHERE k % 2 = 0
    UNION ALL SELECT '{_SITE}/route/' || k || '/r-' || k, (CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END), 'N/A', 'ok', 'N/A' FROM routes""")
def _(spark, sf):
    els = with_elements(m.site_route_pages(spark, sf))
    return els.select(F.col("url").alias("route_url"), F.posexplode(extract.comments()).alias("pos", "c")).select(
        "route_url", "pos", "c.*")


@query("site_comments_stray", f"""SELECT '{_SITE}/route/' || k || '/r-' || k AS route_url, 0 AS pos, 'Ann ' || k AS comment_author,
      'Nice and long' AS comment_text FROM routes WHERE k % 2 = 0
    UNION ALL SELECT '{_SITE}/route/' || k || '/r-' || k, (CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END), 'N/A', 'ok' FROM routes""")
def _(spark, sf):
    # parts of a comment that lie outside all comment tables
    stray = '$1<div class="bio">Nobody</div><div class="comment-body">stray</div><span class="comment-time">now</span>'
    pages = m.site_route_pages(spark, sf).withColumn(
        "html", F.regexp_replace("html", r'(<div[^>]*comment-list[^>]*>)', stray))
    return with_elements(pages).select(F.col("url").alias("route_url"), F.posexplode(extract.comments()).alias("pos", "c")).select(
        "route_url", "pos", "c.comment_author", "c.comment_text")


def _stats(spark, sf):
    return extract.route_stats(with_elements(m.site_stats_pages(spark, sf), tags=extract.STATS_TAGS))


_STATS_URL = f"'{_SITE}/route/stats/' || {{0}} || '/r-' || {{0}}"


@query("site_ratings", f"""SELECT {_STATS_URL.format("route_id")} AS stats_url, rating, (votes % 5 + 1)::INTEGER AS votes
    FROM ratings WHERE rating <> ''""")
def _(spark, sf):
    return _stats(spark, sf).select("stats_url", F.explode("route_suggested_ratings").alias("rating", "votes"))


@query("site_ticks", f"""SELECT {_STATS_URL.format("k")} AS stats_url, CASE WHEN 11 + k % 8 + 2 >= 15
    THEN repeat('fine ', (11 + k % 8)::INTEGER) || p_name ELSE '' END AS ticks FROM routes JOIN part ON p_partkey = k""")
def _(spark, sf):
    return _stats(spark, sf).select("stats_url", F.col("route_tick_comments").alias("ticks"))


def _site_records(spark, sf):
    areas, listed = extract.areas_and_lists(_area_els(spark, sf))
    return areas, extract.routes_of_areas(listed, with_elements(m.site_route_pages(spark, sf)),
                                          with_elements(m.site_stats_pages(spark, sf), tags=extract.STATS_TAGS))


@query("site_nested_records", f"""WITH listed AS ({_LIST}), detail AS ({_DETAILS})
    SELECT a.area_id, r.route_name, r.route_lr, d.route_grade, d.route_type FROM
      (SELECT md5({_url("s_suppkey")}) AS area_id FROM supplier) a JOIN listed r USING (area_id) JOIN detail d USING (route_url)""")
def _(spark, sf):
    nested_areas = extract.nest(*_site_records(spark, sf), per_row=7)
    return nested_areas.select("area_id", F.explode("routes").alias("r")).select(
        "area_id", "r.route_name", "r.route_lr", "r.route_grade", "r.route_type")


@query("resume_urls", f"""SELECT {_url("s_suppkey")} AS url FROM supplier WHERE s_suppkey % 3 <> 0""")
def _(spark, sf):
    pages = m.site_area_pages(spark, sf).select("url")
    sup = m.table(spark, sf, "supplier")
    url = F.expr(m.site_url("area", "s_suppkey", "concat('crag-', s_suppkey)"))
    # one checkpoint row per supplier; those of another start URL do not count
    base = F.when(F.col("s_suppkey") % 3 == 0, f"{_SITE}/area/0").otherwise("https://other.example")
    done = sup.select(base.alias("base_url"), F.array(url).alias("processed_urls"))
    return ledger.remaining(pages, done, f"{_SITE}/area/0")


@query("direct_urls", f"SELECT {_url('s_suppkey')} AS url FROM supplier WHERE s_suppkey IN (0, 7)")
def _(spark, sf):
    wanted = spark.createDataFrame([(f"{_SITE}/area/{i}/crag-{i}",) for i in (0, 7)], "url string")
    return ledger.only_urls(m.site_area_pages(spark, sf), wanted).select("url")


# --- files ---------------------------------------------------------------------

def _nested_areas(spark, sf, per_row=1000):
    """Nested areas of the mapping with list- or map-shaped tags as raw text."""
    areas = m.areas(spark, sf).withColumn("area_tags", F.when(F.col("approach").isNull(), "[]").otherwise(
        F.to_json(F.create_map(F.lit(fixed.APPROACH), F.array("approach")))))
    n = m.size(spark, sf, "supplier")
    # part k is route number k div n of its supplier
    routes = m.routes(spark, sf, with_ratings=True).withColumn("route_pos", F.floor(F.col("k") / n).cast("int"))
    return extract.nest(areas, routes.drop("k", "area_ord", "route_ord"), per_row)


# routes of an unknown area keep a record with nothing but its id
_IN_AREAS = "routes LEFT JOIN areas USING (area_id)"


@query("manifest_scan", f"SELECT area_id, route_id, area_name, route_type FROM {_IN_AREAS}")
def _(spark, sf):
    folder = scratch_path(spark, "manifest")
    nested_areas = _nested_areas(spark, sf).drop("area_ord", "approach")
    names = ["west", "east"]
    # the scanned files must be whole folders here: the writer decides on file names
    for i, name in enumerate(names):
        nested_areas.filter((F.hash("area_id") % 2 == 0) == (i == 0)).write.json(f"{folder}/{name}.json")
    spark.createDataFrame([('["west.json","east.json","gone.json"]',)], "value string").coalesce(1) \
        .write.text(f"{folder}/index")
    areas, skipped = nested.scan_manifest(spark, f"{folder}/index", folder, multi_line=False)
    assert skipped == ["gone.json"], skipped
    _, routes = nested.flatten_nested(areas)
    return routes.select("area_id", "route_id", "area_name", "route_type")


@query("array_file_scan", f"""SELECT area_id, area_name, CAST(count(route_id) AS BIGINT) AS n_routes, CAST(sum(route_pitches) AS BIGINT) AS pitches
    FROM areas FULL JOIN routes USING (area_id) GROUP BY ALL""")
def _(spark, sf):
    folder = scratch_path(spark, "arrays")
    store.write_arrays(_nested_areas(spark, sf).drop("area_ord", "approach"), folder)
    # files of about a thousand records, cut into splits of 64 kB
    found = nested.scan_single(spark, folder, split_bytes=1 << 16)
    return found.groupBy("area_id").agg(
        F.max("area_name").alias("area_name"), F.sum(F.size("routes")).alias("n_routes"),
        F.sum(F.aggregate("routes", F.lit(0).cast("bigint"), lambda n, r: n + r["route_pitches"])).alias("pitches")) \
        .withColumn("pitches", F.when(F.col("n_routes") > 0, F.col("pitches")))


@query("flat_files_load", """SELECT route_id, coalesce(area_name, '') AS area_name, coalesce(web_path, '') AS area_path, route_grade, route_type
    FROM routes LEFT JOIN areas USING (area_id)""")
def _(spark, sf):
    folder = scratch_path(spark, "flat")
    store.write_arrays(m.areas(spark, sf).drop("area_ord", "approach"), f"{folder}/areas", member="areas")
    store.write_arrays(m.routes(spark, sf, **_bare).drop("k", "area_ord", "route_ord"), f"{folder}/routes")
    areas, routes = nested.read_flat(spark, f"{folder}/areas", f"{folder}/routes", split_bytes=1 << 16)
    return flatten.attach_area(routes, areas).select(
        "route_id", "area_name", derive.web_path(F.col("area_hierarchy")).alias("area_path"), "route_grade", "route_type")


@query("state_reduction", f"""SELECT coalesce(lower(r_name), 'unknown') AS state, CAST(count(*) AS BIGINT) AS n_routes FROM {_IN_AREAS}
    WHERE {S.ELIGIBLE} GROUP BY r_name""")
def _(spark, sf):
    folder = scratch_path(spark, "states")
    _write_states(spark, sf, folder)
    kept = reduction.reduce_nested(nested.scan_states(spark, folder, multi_line=False))
    return nested.flatten_nested(kept)[1].groupBy("state").agg(F.count("*").alias("n_routes"))


def _write_states(spark, sf, folder):
    nested_areas = _nested_areas(spark, sf).withColumn(
        "state", F.coalesce(F.lower(F.get("area_hierarchy", F.lit(1))["area_hierarchy_name"]), F.lit("unknown"))
    ).drop("area_ord", "approach")
    # one folder <state>_routes_tagged.json for each state, of the fixed regions of the mapping
    states = [r[0] for r in nested_areas.select("state").distinct().collect()]
    for state in states:
        store.write_json(nested_areas.filter(F.col("state") == state).drop("state"), f"{folder}/{state}_routes_tagged.json")


@query("nested_json_roundtrip", f"""SELECT area_id, area_name, CAST(count(route_id) AS BIGINT) AS n_routes,
    CASE WHEN approach IS NULL THEN '' ELSE approach END AS approach FROM areas FULL JOIN routes USING (area_id) GROUP BY ALL""")
def _(spark, sf):
    folder = scratch_path(spark, "tagged")
    store.write_json(_nested_areas(spark, sf).drop("area_ord", "approach"), store.tagged_name(f"{folder}.json"))
    back = nested.snapshot_or_empty(spark, store.tagged_name(f"{folder}.json"), multi_line=False)
    areas, _ = enrichment_plan.typed(*nested.flatten_nested(back))
    n = back.groupBy("area_id").agg(F.sum(F.size("routes")).alias("n_routes"))
    return areas.select("area_id", "area_name", joined(F.coalesce(F.try_element_at(
        "area_tags", F.lit(fixed.APPROACH)), F.array())).alias("approach")).join(n, "area_id")


@query("enrichment_from_files", f"""SELECT route_id, category, array_to_string(tags, ',') AS tags FROM (
    SELECT * FROM enriched WHERE category <> '{fixed.APPROACH}'
    UNION ALL SELECT route_id, '{fixed.APPROACH}', [approach] FROM {_IN_AREAS} WHERE approach IS NOT NULL)""")
def _(spark, sf):
    return _enriched_files(spark, sf, 1000)


def _earlier_nested(spark, sf, per_row):
    """Earlier snapshot: the same areas with the earlier tags of their routes."""
    earlier = m.previous_tags(spark, sf).withColumn("route_pos", F.col("route_ord")).withColumn(
        "area_url", F.lit(None).cast("string")).drop("area_ord", "route_ord")
    earlier = earlier.withColumn("route_pos", F.col("route_pos") + F.lit(2) * F.floor(
        F.col("route_id").cast("bigint") / m.size(spark, sf, "supplier")).cast("int"))
    return extract.nest(m.areas(spark, sf).drop("area_ord", "approach"), earlier, per_row)


def _enriched_files(spark, sf, per_row, first_run=False):
    folder = scratch_path(spark, "enrich")
    store.write_json(_nested_areas(spark, sf, per_row).drop("area_ord", "approach"), f"{folder}/areas")
    if not first_run:
        store.write_json(_earlier_nested(spark, sf, per_row), f"{folder}/earlier")
    results = m.result_lines(spark, sf)
    for batch in (0, 1):
        results.filter(F.col("batch_ord") == batch).select("value").write.text(f"{folder}/results/b{batch}.jsonl")
    _, routes, _ = enrichment_plan.run(
        spark, nested.read_nested(spark, f"{folder}/areas", multi_line=False),
        lines.batch_paths(f"{folder}/results", "b0,b1"),
        nested.snapshot_or_empty(spark, f"{folder}/earlier", multi_line=False))
    return long_tags(routes, "route_id")


_WITH_RESULTS = f"(SELECT route_id FROM result_ids JOIN routes USING (route_id) WHERE {S.ELIGIBLE})"


@query("enrichment_first_run", f"""SELECT route_id, category, array_to_string(tags, ',') AS tags FROM (
    SELECT * FROM enriched WHERE category <> '{fixed.APPROACH}' AND route_id IN {_WITH_RESULTS}
    UNION ALL SELECT route_id, category, list_sort(tags) FROM manual WHERE route_id NOT IN {_WITH_RESULTS}
    UNION ALL SELECT route_id, '{fixed.APPROACH}', [approach] FROM {_IN_AREAS} WHERE approach IS NOT NULL)""")
def _(spark, sf):
    return _enriched_files(spark, sf, 1000, first_run=True)


@query("reduced_nested_parts", f"""SELECT area_id, area_name, CAST(count(*) AS BIGINT) AS n_routes FROM {_IN_AREAS}
    WHERE {S.ELIGIBLE} GROUP BY ALL""")
def _(spark, sf):
    folder = scratch_path(spark, "parts")
    store.write_json(_nested_areas(spark, sf, per_row=3).drop("area_ord", "approach"), folder)
    areas, routes = nested.flatten_nested(reduction.reduce_nested(nested.read_nested(spark, folder, multi_line=False)))
    n = routes.groupBy("area_id").agg(F.count("*").alias("n_routes"))
    return areas.select("area_id", "area_name").join(n, "area_id", "left")


@query("snapshot_merge_parts", "SELECT route_id, category, array_to_string(tags, ',') AS tags FROM previous")
def _(spark, sf):
    folder = scratch_path(spark, "earlier-parts")
    store.write_json(_earlier_nested(spark, sf, per_row=3), folder)
    _, earlier = enrichment_plan.typed(*nested.flatten_nested(nested.snapshot_or_empty(spark, folder, multi_line=False)))
    routes = m.routes(spark, sf, **_bare).withColumn("route_tags", F.from_json(F.lit("{}"), "map<string,array<string>>"))
    return long_tags(enrich.merge_route_snapshot(routes, earlier), "route_id")


@query("manifest_equal_names", f"""SELECT route_id, (1 - coalesce(s_suppkey, 0) % 2)::INTEGER AS file_ord FROM {_IN_AREAS}""")
def _(spark, sf):
    folder = scratch_path(spark, "names")
    nested_areas = _nested_areas(spark, sf)
    for i, state in enumerate(("b", "a")):  # equal names in two folders, with blanks in them
        nested_areas.filter(F.coalesce("area_ord", F.lit(0)) % 2 == 1 - i).drop("area_ord", "approach").write.json(
            f"{folder}/{state}/all routes.json")
    spark.createDataFrame([('["b/all routes.json","a/all routes.json","gone.json"]',)], "value string").coalesce(1) \
        .write.text(f"{folder}/index")
    areas, _ = nested.scan_manifest(spark, f"{folder}/index", folder, multi_line=False)
    return nested.flatten_nested(areas)[1].select("route_id", "file_ord")


# the second run has no results: categories with rule tags are merged again, which sorts them
_TWICE = f"""SELECT route_id, category, array_to_string(CASE WHEN (route_id, category) IN (SELECT (route_id, category) FROM manual)
      THEN list_sort(tags) ELSE tags END, ',') AS tags FROM (
    SELECT * FROM enriched WHERE category <> '{fixed.APPROACH}' AND route_id IN {_WITH_RESULTS}
    UNION ALL SELECT route_id, category, list_sort(tags) FROM manual WHERE route_id NOT IN {_WITH_RESULTS}
    UNION ALL SELECT route_id, '{fixed.APPROACH}', [approach] FROM {_IN_AREAS} WHERE approach IS NOT NULL)"""


@query("enrichment_versions", _TWICE)
def _(spark, sf):
    base = scratch_path(spark, "versions")
    store.write_json(_nested_areas(spark, sf).drop("area_ord", "approach"), f"{base}/in")
    m.result_lines(spark, sf).select("value").write.text(f"{base}/results")
    m.result_lines(spark, sf).select("value").limit(0).write.text(f"{base}/none")
    current = nested.read_nested(spark, f"{base}/in", multi_line=False)
    # the second run has no results; it keeps the tags of the first
    for results in ("results", "none"):
        version = enrichment_plan.run_versions(spark, current, [f"{base}/{results}"], f"{base}/out")
    back = nested.read_nested(spark, f"{base}/out/v={version}", multi_line=False)
    return long_tags(enrichment_plan.typed(*nested.flatten_nested(back))[1], "route_id")


@query("reduction_job", f"""WITH s AS (SELECT coalesce(lower(r_name), 'unknown') AS state, area_id, {S.ELIGIBLE} AS ok FROM {_IN_AREAS}),
    p AS (SELECT state, count(*)::BIGINT AS routes_total, count(*) FILTER (WHERE ok)::BIGINT AS routes_kept,
      count(DISTINCT area_id) FILTER (WHERE ok)::BIGINT AS areas_kept FROM s GROUP BY state)
    SELECT state, routes_total, routes_kept, areas_kept FROM p
    UNION ALL SELECT 'Total', sum(routes_total)::BIGINT, sum(routes_kept)::BIGINT, sum(areas_kept)::BIGINT FROM p""")
def _(spark, sf):
    folder = scratch_path(spark, "reduction")
    _write_states(spark, sf, f"{folder}/in")
    stats = reduction_plan.run(spark, f"{folder}/in", f"{folder}/out", multi_line=False)
    return stats.select("state", "routes_total", "routes_kept", "areas_kept")


@query("extraction_resume", f"""SELECT md5({_url("s_suppkey")}) AS area_id, count(k)::BIGINT AS n_routes FROM supplier, n
    LEFT JOIN routes ON k % ns = s_suppkey AND s_suppkey * 10 + 1 >= ns GROUP BY ALL""")
def _(spark, sf):
    base = scratch_path(spark, "extraction")
    pages = m.site_area_pages(spark, sf)
    others = m.site_route_pages(spark, sf), m.site_stats_pages(spark, sf)
    some = pages.filter(F.crc32("url") % 2 == 0)
    extraction.run(spark, some, *others, base, _SITE)
    extraction.run(spark, pages, *others, base, _SITE)  # takes the rest only
    return extraction.records(spark, base).groupBy("area_id").agg(F.sum(F.size("routes")).alias("n_routes"))


@query("load_job", """SELECT 'areas' AS collection, count(*)::BIGINT AS valid, 0::BIGINT AS invalid, 0::BIGINT AS skipped,
      count(*)::BIGINT AS stored FROM areas
    UNION ALL SELECT 'routes', (SELECT count(*) FROM docs), 0, count(*) - (SELECT count(*) FROM docs), (SELECT count(*) FROM docs)
      FROM routes""")
def _(spark, sf):
    return load.run(spark, *_flat_load(spark, sf), scratch_path(spark, "load"))


def _flat_load(spark, sf):
    from crestline.registry.base import ruled

    areas = m.areas(spark, sf).withColumn("area_tags", F.from_json(F.lit("{}"), "map<string,array<string>>"))
    routes = m.routes(spark, sf, with_text=True, with_ratings=True)
    return areas, enrich.with_manual_tags(routes).withColumnRenamed("manual_tags", "route_tags")


@query("stored_routes_by_path", """SELECT route_id, quality_score FROM docs
    WHERE starts_with(area_hierarchy_path, 'All Locations/ASIA') AND grade_numeric >= 13""")
def _(spark, sf):
    base = scratch_path(spark, "stored")
    load.run(spark, *_flat_load(spark, sf), base)
    rows = store.read_version(spark, f"{base}/routes")
    return rows.filter(filters.path_range(F.col("area_hierarchy_path"), "All Locations/ASIA")
                       & filters.grade_rank_range("5.9", None)).select("route_id", "quality_score")


@query("skip_areas_load", "SELECT route_id, area_name FROM docs")
def _(spark, sf):
    base, (areas, routes) = scratch_path(spark, "skip"), _flat_load(spark, sf)
    load.run(spark, areas, routes.limit(0), base)
    # areas come from the stored collection; the given ones have lost their names
    load.run(spark, areas.withColumn("area_name", F.lit("")), routes, base, force=True, skip_areas=True)
    return store.read_version(spark, f"{base}/routes").select("route_id", "area_name")


@query("areas_by_root", "SELECT 'some-place' AS root_slug, area_id FROM areas")
def _(spark, sf):
    folder = scratch_path(spark, "root")
    store.write_by_root(m.areas(spark, sf).select("area_id"), folder, "https://crags.example.org/area/1/some-place/")
    return spark.read.json(folder).select("root_slug", "area_id")


@query("mapped_categories", """SELECT route_id, CASE WHEN category = 'Rope Length' THEN 'Rope' ELSE category END AS category,
    array_to_string(tags, ',') AS tags FROM manual""")
def _(spark, sf):
    from crestline.functions.tags import map_categories
    from crestline.registry.base import ruled

    mapped = ruled(spark, sf).withColumn("manual_tags", map_categories(F.col("manual_tags"), {"Rope Length": "Rope"}))
    return long_tags(mapped, "route_id", "manual_tags")


@query("upload_outcomes", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return store.outcome_totals(m.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status")))


@query("raw_result_dump", """SELECT custom_id, count(*) AS n FROM (
      SELECT p_partkey::VARCHAR AS custom_id FROM part UNION ALL SELECT p_partkey::VARCHAR FROM part WHERE p_partkey % 15 = 0 AND p_partkey % 10 <> 3
      UNION ALL SELECT 'area_a' || s_suppkey FROM supplier) GROUP BY custom_id""")
def _(spark, sf):
    folder = scratch_path(spark, "raw")
    lines.write_raw(m.result_lines(spark, sf), folder)
    back = arrays.split_records(spark, folder, split_bytes=1 << 16)
    return back.groupBy(F.get_json_object("value", "$.custom_id").alias("custom_id")).agg(F.count("*").alias("n"))


@query("upload_summary", """WITH f AS (SELECT r_name, sum(strlen(area_id) + 1)::BIGINT AS bytes FROM areas GROUP BY r_name)
    SELECT 'routes' AS bucket, count(*) AS total_files, count(*) FILTER (WHERE r_name NOT LIKE 'A%') AS successful,
      count(*) FILTER (WHERE r_name LIKE 'A%') AS failed, sum(bytes)::BIGINT AS bytes FROM f""")
def _(spark, sf):
    files = _state_files(spark, sf).withColumn("name", F.regexp_extract("path", "state=([^/]+)/", 1))
    regions = m.table(spark, sf, "region").filter("r_name LIKE 'A%'")
    errors = regions.select(F.replace("r_name", F.lit(" "), F.lit("_")).alias("name"), F.lit("timeout").alias("error"))
    return store.write_upload_summary(store.upload_outcomes(files, errors), scratch_path(spark, "upload"), "routes")


@query("result_files", """SELECT 'route' AS kind, route_id AS entity_id, category, array_to_string(tags, ',') AS tags
      FROM result_tags UNION ALL SELECT 'area', area_id, category, array_to_string(tags, ',') FROM area_result_tags""")
def _(spark, sf):
    folder = scratch_path(spark, "results")
    all_lines = m.result_lines(spark, sf)
    for batch in (0, 1):
        all_lines.filter(F.col("batch_ord") == batch).select("value").write.text(f"{folder}/b{batch}.jsonl")
    parsed = enrich.parse_results(lines.read_lines(spark, lines.batch_paths(folder, "b0, b1")))
    return enrich.latest_results(parsed).select("kind", "entity_id", F.explode("tags").alias("category", "t")) \
        .select("kind", "entity_id", "category", joined(F.col("t")).alias("tags"))


@query("streamed_results", """SELECT 'route' AS kind, route_id AS entity_id, category, array_to_string(tags, ',') AS tags
      FROM result_tags UNION ALL SELECT 'area', area_id, category, array_to_string(tags, ',') FROM area_result_tags""")
def _(spark, sf):
    from crestline.streaming import arrivals

    folder = scratch_path(spark, "stream")
    all_lines = m.result_lines(spark, sf)
    for batch in (0, 1):
        # the second part arrives later and is merged over the first
        all_lines.filter(F.col("batch_ord") == batch).select("value").write.mode("append").text(f"{folder}/in")
        arrivals.start(spark, f"{folder}/in", f"{folder}/state", f"{folder}/check").awaitTermination()
        if batch == 0:
            arrivals.compact(spark, f"{folder}/state")
    return arrivals.current(spark, f"{folder}/state").select(
        "kind", "entity_id", F.explode("tags").alias("category", "t")).select(
        "kind", "entity_id", "category", joined(F.col("t")).alias("tags"))


@query("request_files", f"""SELECT custom_id, (CASE WHEN rn <= total * 2 // 5 THEN 1 ELSE 2 END) AS batch_no FROM (
    SELECT custom_id, row_number() OVER (ORDER BY kind, area_ord, route_ord) AS rn, count(*) OVER () AS total FROM (
      SELECT 0 AS kind, area_ord, -1 AS route_ord, 'area_' || area_id AS custom_id FROM areas
      UNION ALL SELECT 1, area_ord, route_ord, route_id FROM routes WHERE {S.ELIGIBLE}))""")
def _(spark, sf):
    folder = scratch_path(spark, "requests")
    routes = m.routes(spark, sf, **_bare).withColumn("route_description", F.col("route_name")).withColumn(
        "route_comments", F.lit(None).cast("array<struct<comment_text:string>>")).withColumn(
        "route_tick_comments", F.lit(None).cast("string"))
    lines.write_requests(enrich.split_batches(enrich.all_requests(m.areas(spark, sf), routes)), folder, by_batch=True)
    return spark.read.text(folder).select(F.get_json_object("value", "$.custom_id").alias("custom_id"), "batch_no")


@query("versioned_upsert", """SELECT route_id, 'second' AS origin, 2 AS version FROM routes""")
def _(spark, sf):
    base = scratch_path(spark, "collection")
    r = m.routes(spark, sf, **_bare).select("route_id")
    first = r.withColumn("origin", F.lit("first")).withColumn("ord", F.lit(0))
    store.upsert_version(first, base, "route_id", "ord", cluster_by=["route_id"])
    try:
        store.upsert_version(first, base, "route_id", "ord")
        raise AssertionError("a filled target must be refused")
    except store.TargetExistsError:
        pass
    v = store.upsert_version(first.withColumn("origin", F.lit("second")), base, "route_id", "ord", force=True)
    return store.read_version(spark, base).select("route_id", "origin").withColumn("version", F.lit(v))


_PARTS = 16


@query("partial_upsert", f"""WITH p AS (SELECT route_id, route_grade, k, ('0x' || left(md5(route_id), 8))::BIGINT % {_PARTS} AS part FROM routes),
    touched AS (SELECT DISTINCT part FROM p WHERE k % 400 = 7 AND route_grade <> '')
    SELECT route_id, CASE WHEN k % 400 = 7 THEN '' ELSE route_grade END AS route_grade,
      part IN (SELECT part FROM touched) AS rewritten FROM p""")
def _(spark, sf):
    base = scratch_path(spark, "parted")
    r = m.routes(spark, sf, **_bare).select("route_id", "route_grade", "k")
    store.upsert_parts(r, base, "route_id", parts=_PARTS)

    def files():
        return store.read_parts(spark, base).select("route_id", F.col("_metadata.file_name").alias("file"))

    before = written_table(files(), "files")
    some = r.filter("k % 400 = 7").withColumn("route_grade", F.lit(""))
    store.upsert_parts(some, base, "route_id")
    assert store.upsert_parts(some, base, "route_id") == [], "a repeated run writes nothing"
    now = store.read_parts(spark, base).select("route_id", "route_grade", F.col("_metadata.file_name").alias("file"))
    return now.join(before.withColumnRenamed("file", "old"), "route_id", "left").select(
        "route_id", "route_grade", (~F.col("file").eqNullSafe(F.col("old"))).alias("rewritten"))


def _state_files(spark, sf):
    """Inventory of one file of area ids for each state."""
    folder = scratch_path(spark, "inventory")
    state = F.replace(F.col("area_hierarchy")[1]["area_hierarchy_name"], F.lit(" "), F.lit("_"))
    m.areas(spark, sf).select(state.alias("state"), F.col("area_id").alias("value")).repartition("state").write.partitionBy(
        "state").text(folder)
    return store.inventory(spark, folder, "*.txt")


@query("file_inventory", """SELECT replace(r_name, ' ', '_') AS state, sum(strlen(area_id) + 1)::BIGINT AS bytes,
    sum(strlen(area_id) + 1) / 1048576.0::DOUBLE AS size_mb FROM areas GROUP BY r_name""")
def _(spark, sf):
    return _state_files(spark, sf).select(F.regexp_extract("path", "state=([^/]+)/", 1).alias("state"), "bytes", "size_mb")


@query("file_totals", "SELECT count(DISTINCT r_name) AS files, sum(strlen(area_id) + 1)::BIGINT AS bytes FROM areas")
def _(spark, sf):
    return store.size_totals(_state_files(spark, sf)).select("files", "bytes")


@query("work_ledger", """SELECT 'pending' AS status, CAST(count(*) - (SELECT count(*) FROM supplier WHERE s_suppkey % 3 = 0) AS BIGINT) AS n
      FROM supplier UNION ALL SELECT 'completed', count(*) FROM supplier WHERE s_suppkey % 3 = 0""")
def _(spark, sf):
    sup = m.table(spark, sf, "supplier")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    known = sup.select(F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("input_file"),
                       F.lit("completed").alias("status"), now.alias("added_at"),
                       F.lit("b1").alias("batch_id"), F.lit(None).cast("string").alias("error"))
    files = sup.select(F.col("s_name").alias("input_file"))
    return ledger.status_counts(ledger.add_files(known.dropna(subset=["input_file"]), files.unionByName(files), now))

