"""Flattening, listing filters, sorting, display, store queries, search, trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from crestline import fixed
from crestline.functions import choices, derive, grades, text
from crestline.operators import filters as FL
from crestline.operators import flatten, hierarchy, intervals, nesting, search, sorting
from crestline.plans import listing as listing_plan
from crestline.plans import mapping as m
from crestline.registry import sql as S
from crestline.registry.base import area_docs, joined, listing, query, route_docs, stored_routes
from crestline.session import scratch_path, written_table
from crestline.sources import store

_bare = {"with_votes": False}

# --- flatten -------------------------------------------------------------------


@query("flat_areas", """SELECT area_id, area_name, store_path AS area_hierarchy_path, '1,2,3,4' AS levels,
    coalesce(approach || ',Approach & Accessibility:' || approach, '') AS tags, searchable_text FROM area_docs""")
def _(spark, sf):
    return area_docs(spark, sf).select(
        "area_id", "area_name", "area_hierarchy_path",
        joined(F.col("area_hierarchy_levels").cast("array<string>")).alias("levels"),
        joined(F.col("area_tags")).alias("tags"), "searchable_text")


@query("flat_routes", """SELECT route_id, normalized_grade, grade_numeric, route_stars,
    CAST(route_votes AS DOUBLE) AS route_votes, round(quality_score, 6) AS quality_score,
    array_to_string(types, ',') AS route_type, CAST(route_pitches AS DOUBLE) AS route_pitches,
    coalesce(CAST(route_length_meter AS DOUBLE), 0) AS route_length_meter, CAST(route_lr AS DOUBLE) AS route_lr,
    area_name, area_hierarchy_path, is_trad, is_sport, is_multipitch, array_to_string(tags, ',') AS tags,
    md5(searchable_text) AS text_md5 FROM texts""")
def _(spark, sf):
    return route_docs(spark, sf).select(
        "route_id", "normalized_grade", "grade_numeric", "route_stars", "route_votes",
        F.round("quality_score", 6).alias("quality_score"), joined(F.col("route_type")).alias("route_type"),
        "route_pitches", "route_length_meter", "route_lr", "area_name", "area_hierarchy_path", "is_trad",
        "is_sport", "is_multipitch", joined(F.col("tags")).alias("tags"), F.md5("searchable_text").alias("text_md5"))


@query("route_area_lookup", """SELECT route_id, coalesce(area_name, '') AS area_name, coalesce(web_path, '') AS area_path
    FROM routes LEFT JOIN areas USING (area_id)""")
def _(spark, sf):
    a = m.areas(spark, sf)
    # every area occurs twice, the later row wins
    twice = a.withColumn("area_name", F.lit("old")).withColumn("area_ord", F.col("area_ord") - 10**6).unionByName(a)
    return FL.with_web_path(flatten.attach_area(m.routes(spark, sf, **_bare), twice)).select(
        "route_id", "area_name", "area_path")


@query("numeric_cleaning", """SELECT route_id, CAST(p_size AS DOUBLE) + 0.5 AS prefixed, 7.0::DOUBLE AS fallback
    FROM routes JOIN part ON p_partkey = k""")
def _(spark, sf):
    return m.routes(spark, sf, **_bare).select(
        "route_id", derive.number(F.concat(F.lit(" "), "route_lr", F.lit(".5 ft"))).alias("prefixed"),
        derive.number(F.concat(F.lit("n/a "), "route_lr"), 7).alias("fallback"))


@query("load_counts", """SELECT 'areas' AS collection, CAST(count(*) FILTER (WHERE s_suppkey % 11 <> 0) AS BIGINT) AS valid,
      CAST(count(*) FILTER (WHERE s_suppkey % 11 = 0) AS BIGINT) AS invalid, 0::BIGINT AS skipped FROM areas
    UNION ALL SELECT 'routes', count(*) FILTER (WHERE k % 19 <> 0 AND k % 8 NOT IN (4, 5)),
      count(*) FILTER (WHERE k % 19 = 0), count(*) FILTER (WHERE k % 19 <> 0 AND k % 8 IN (4, 5)) FROM routes""")
def _(spark, sf):
    a = m.areas(spark, sf)
    a = a.withColumn("area_name", F.when(F.col("area_ord") % 11 != 0, F.col("area_name")).otherwise(""))
    r = m.routes(spark, sf, **_bare)
    return flatten.load_counts(a, r.withColumn("route_name", F.when(F.col("k") % 19 != 0, F.col("route_name"))))


@query("document_upsert", """SELECT CAST(k AS VARCHAR) AS route_id, 'second' AS origin FROM routes
    UNION ALL SELECT CAST(k + cnt AS VARCHAR), 'stored' FROM routes, (SELECT count(*) AS cnt FROM routes)""")
def _(spark, sf):
    n = m.size(spark, sf, "part")
    r = m.routes(spark, sf, **_bare).select("k")
    stored = r.select(F.explode(F.array(F.col("k").cast("string"), (F.col("k") + n).cast("string"))).alias("route_id"),
                      F.lit("stored").alias("origin"), F.lit(0).alias("ord"))
    versions = F.array(*[F.struct(F.lit(o).alias("origin"), F.lit(i).alias("ord"))
                         for i, o in ((1, "first"), (2, "second"))])
    incoming = r.select(F.col("k").cast("string").alias("route_id"), F.explode(versions).alias("v")).select(
        "route_id", "v.origin", "v.ord")
    return flatten.upsert(stored, incoming, "route_id", "ord").drop("ord")


# --- listing filters -----------------------------------------------------------

_EXCL = f"list_has_any(string_split(route_type, ', '), {S.lst(fixed.EXCLUDED_TYPES)})"


def _types(sel):
    return ("list_has_any(list_transform(list_filter(string_split(route_type, ', '), "
            f"lambda t: NOT starts_with(t, 'Grade')), lambda t: trim(t)), {S.lst(sel)})")


def _tagged(category, tags, table="manual"):
    return (f"route_id IN (SELECT route_id FROM {table} WHERE category = {S.lit(category)} "
            f"AND list_has_any(tags, {S.lst(tags)}))")


_W = {g: i for i, g in enumerate(fixed.WEB_GRADES)}


def _listing_sql(name, rest, body="SELECT route_id FROM listing"):
    return f"{body} WHERE NOT {_EXCL} AND (web_ix = -1 OR ({rest}))"


@query("filtered_listing", f"""SELECT route_id, route_name, route_grade, route_type, route_votes, route_stars, area_path
    FROM listing WHERE NOT {_EXCL} AND starts_with(area_path, 'All Locations / AMERICA') AND (web_ix = -1 OR (
      web_ix BETWEEN {_W['5.9']} AND {_W['5.11a']} AND {_types(['Trad', 'Sport'])}
      AND {_tagged(fixed.CROWDS, ['classic_route'])}))
    ORDER BY route_votes DESC, area_ord, route_ord LIMIT 100""")
def _(spark, sf):
    f = FL.ListingFilter("5.9", "5.11a", ("Trad", "Sport"), {fixed.CROWDS: ("classic_route",)})
    return listing_plan.run(listing(spark, sf), f, ["All Locations / AMERICA"], "votes").select(
        "route_id", "route_name", "route_grade", "route_type", "route_votes", "route_stars", "area_path")


@query("listing_excluded_types", f"SELECT route_id, {_EXCL} AS excluded FROM routes")
def _(spark, sf):
    return m.routes(spark, sf, **_bare).select("route_id", FL.excluded_type(F.col("route_type")).alias("excluded"))


@query("text_excluded_types", """SELECT route_id, route_type LIKE '%Aid%' OR route_type LIKE '%Boulder%'
    OR route_type LIKE '%Ice%' OR route_type LIKE '%Mixed%' OR route_type LIKE '%Snow%' AS excluded FROM routes""")
def _(spark, sf):
    return m.routes(spark, sf, **_bare).select("route_id", flatten.has_excluded_text(F.col("route_type")).alias("excluded"))


@query("listing_grade_range", _listing_sql("g", f"web_ix BETWEEN {_W['5.10a']} AND {_W['5.11b']}"))
def _(spark, sf):
    return listing(spark, sf).filter(FL.listing_predicate(FL.ListingFilter("5.10-", "5.11"))).select("route_id")


@query("listing_type_match", _listing_sql("t", _types(["Trad"])))
def _(spark, sf):
    return listing(spark, sf).filter(FL.listing_predicate(FL.ListingFilter(types=("Trad",)))).select("route_id")


@query("listing_tag_match", _listing_sql("t", _tagged(fixed.PITCHES, ["single_pitch", "long_multipitch"]) + " AND "
                                         + _tagged(fixed.SAFETY, ["first_in_grade"])))
def _(spark, sf):
    f = FL.ListingFilter(tags={fixed.PITCHES: ("single_pitch", "long_multipitch"), fixed.SAFETY: ("first_in_grade",)})
    return listing(spark, sf).filter(FL.listing_predicate(f)).select("route_id")


@query("listing_exclusion_tags", _listing_sql("t", f"""NOT {_tagged(fixed.SAFETY, ['sandbag'])}
    AND NOT {_tagged(fixed.SAFETY, ['runout_dangerous'])} AND {_tagged(fixed.CROWDS, ['new_routes', 'classic_route'])}"""))
def _(spark, sf):
    f = FL.ListingFilter(tags={fixed.SAFETY: ("exclude_sandbag", "exclude_runout_dangerous"),
                               fixed.CROWDS: ("new_routes", "classic_route")})
    return listing(spark, sf).filter(FL.listing_predicate(f)).select("route_id")


@query("listing_area_prefix", """SELECT route_id FROM listing WHERE starts_with(area_path, 'All Locations / EUROPE')
    OR starts_with(area_path, 'All Locations / ASIA / NATION_1')""")
def _(spark, sf):
    picked = ["All Locations / EUROPE", "All Locations / ASIA / NATION_1"]
    return listing(spark, sf).filter(FL.path_prefix(F.col("area_path"), picked)).select("route_id")


_PREFIXES = """SELECT DISTINCT 'All Locations / ' || r_name || ' / ' || left(n_name, 8) AS selected_path
    FROM nation JOIN region ON n_regionkey = r_regionkey"""


@query("area_prefix_table", f"""SELECT route_id FROM listing WHERE EXISTS
    (SELECT 1 FROM ({_PREFIXES}) p WHERE starts_with(area_path, selected_path))""")
def _(spark, sf):
    n = m.table(spark, sf, "nation").join(
        m.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    picked = n.select(F.concat(F.lit("All Locations / "), "r_name", F.lit(" / "),
                               F.substring("n_name", 1, 8)).alias("selected_path")).distinct()
    r = flatten.attach_area(m.routes(spark, sf, **_bare), m.areas(spark, sf))
    return FL.in_selected_areas(FL.with_web_path(r), picked).select("route_id")


@query("single_route", "SELECT route_id, route_name FROM routes WHERE route_id = '42'")
def _(spark, sf):
    return listing_plan.run(m.routes(spark, sf, **_bare), route_id="42").select("route_id", "route_name")


@query("hook_filter", f"""SELECT route_id, area_id FROM listing WHERE web_ix BETWEEN {_W['5.6']} AND {_W['5.13d']}
    AND (lower(route_name) LIKE '%ring%' OR lower(route_grade) LIKE '%ring%' OR lower(route_type) LIKE '%ring%')
    AND route_type IN ('Sport', 'Trad')""")
def _(spark, sf):
    f = FL.ListingFilter(FL.HOOK_DEFAULT.grade_min, FL.HOOK_DEFAULT.grade_max, ("Sport", "Trad"))
    return listing(spark, sf).filter(FL.hook_predicate(f, "Ring")).select("route_id", "area_id")


# --- sorting -------------------------------------------------------------------

for _option, _key in (("grade", "web_ix"), ("stars", "route_stars DESC"), ("votes", "route_votes DESC")):
    def _sorted(spark, sf, option=_option):
        return sorting.first_rows(listing(spark, sf), sorting.listing_order(option)).select("route_id", "area_id")

    query(f"listing_by_{_option}", f"""SELECT route_id, area_id FROM listing
        ORDER BY {_key}, area_ord, route_ord LIMIT 100""")(_sorted)


@query("listing_left_to_right", """SELECT route_id, area_id FROM routes
    ORDER BY area_ord, CAST(route_lr AS INTEGER) DESC, route_ord LIMIT 200""")
def _(spark, sf):
    return sorting.first_rows(m.routes(spark, sf, **_bare), sorting.listing_order("left_to_right", True), 200).select(
        "route_id", "area_id")


@query("shown_of_total", f"""SELECT least(count(*), 100)::BIGINT AS shown, count(*)::BIGINT AS total
    FROM listing WHERE NOT {_EXCL}""")
def _(spark, sf):
    return sorting.shown_of_total(listing(spark, sf).filter(FL.listing_predicate(FL.ListingFilter())))


# --- display -------------------------------------------------------------------

_SHORT = "CASE WHEN length({0}) > 15 THEN left({0}, 12) || '...' ELSE {0} END"


@query("route_cards", f"""SELECT route_id,
    CASE WHEN ends_with(route_name, ', The') THEN 'The ' || left(route_name, length(route_name) - 5)
      ELSE route_name END AS name,
    CASE WHEN a.area_id IS NULL THEN '' ELSE n_name || ' / ' || l.area_name END AS short_location,
    CASE WHEN a.area_id IS NULL THEN '' ELSE {_SHORT.format("r_name")} || ' / ' || {_SHORT.format("n_name")} || ' / '
      || {_SHORT.format("l.area_name")} END AS short_path,
    replace(l.area_path, ' / ', ' > ') AS crumbs,
    CAST(floor(route_stars) AS INTEGER) AS full_stars,
    CASE WHEN route_stars - floor(route_stars) >= 0.5 THEN 1 ELSE 0 END AS half_stars,
    concat_ws(',', CASE WHEN contains(route_type, 'Trad') THEN 'Trad' END,
      CASE WHEN contains(route_type, 'Sport') THEN 'Sport' END,
      CASE WHEN route_pitches > 1 THEN 'Multipitch' END) AS badges,
    concat_ws(',', rope_tag, pitch_tag, runout_tag, vote_tag, classic_tag, new_tag) AS tags
    FROM listing l LEFT JOIN areas a USING (area_id)""")
def _(spark, sf):
    c = F.col
    types = derive.type_list(c("route_type"))
    star = text.stars_display(c("route_stars"))
    places = F.transform(text.short_location(c("area_hierarchy")), lambda h: h["area_hierarchy_name"])
    return listing(spark, sf).select(
        "route_id", text.display_name(c("route_name")).alias("name"),
        F.array_join(places, " / ").alias("short_location"), text.short_path(c("area_path")).alias("short_path"),
        text.breadcrumb(c("area_hierarchy")).alias("crumbs"), star["full"].alias("full_stars"),
        star["half"].alias("half_stars"),
        joined(text.type_badges(F.array_contains(types, "Trad"), F.array_contains(types, "Sport"),
                                c("route_pitches") > 1)).alias("badges"),
        joined(derive.display_tags(c("route_tags"))).alias("tags"))


@query("description_preview", """SELECT route_id, CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END
    AS preview FROM routes, n JOIN documents ON doc_id = k % nd""")
def _(spark, sf):
    return m.routes(spark, sf, with_votes=False, with_text=True).select(
        "route_id", text.preview(F.col("route_description")).alias("preview"))


# --- document store ------------------------------------------------------------

@query("areas_by_path", """SELECT area_id, store_path AS area_hierarchy_path FROM areas
    WHERE starts_with(store_path, 'All Locations/AFRICA')""")
def _(spark, sf):
    return FL.areas_by_path(area_docs(spark, sf), "All Locations/AFRICA").select("area_id", "area_hierarchy_path")


_STORE = FL.StoreFilter(min_grade="5.9", max_grade="5.12c", is_sport=True, tags=("single_pitch",),
                        excluded_types=("tr",))
_STORE_SQL = """is_sport AND grade_numeric BETWEEN 13 AND 41 AND list_contains(tags, 'single_pitch')"""


@query("store_filter", f"""SELECT route_id FROM texts WHERE {_STORE_SQL} AND NOT list_contains(types, 'TR')""")
def _(spark, sf):
    return stored_routes(spark, sf).filter(FL.pushed_predicate(_STORE) & FL.residual_predicate(_STORE)).select("route_id")


_IDS = tuple(f"a{i}" for i in range(0, 24, 2))


@query("store_area_ids", f"""SELECT route_id, area_id FROM texts WHERE area_id IN {_IDS}""")
def _(spark, sf):
    f = FL.StoreFilter(area_ids=_IDS)
    return stored_routes(spark, sf).filter(FL.area_conds(f)).select("route_id", "area_id")


@query("store_flags", """SELECT route_id FROM texts WHERE is_multipitch AND is_trad""")
def _(spark, sf):
    return stored_routes(spark, sf).filter(FL.flag_conds(FL.StoreFilter(is_multipitch=True, is_trad=True))).select("route_id")


@query("store_excluded_types", """SELECT route_id, NOT list_contains(types, 'Alpine') AS kept FROM texts""")
def _(spark, sf):
    return stored_routes(spark, sf).select(
        "route_id", FL.no_excluded_type(F.col("route_type"), ("alpine",)).alias("kept"))


@query("store_first_page", f"""SELECT route_id, row_number() OVER (ORDER BY grade_numeric DESC, quality_score DESC, route_id)::INTEGER
      AS page_pos, count(*) OVER () > 20 AS has_more FROM texts
    WHERE {_STORE_SQL} AND NOT list_contains(types, 'TR') QUALIFY page_pos <= 20""")
def _(spark, sf):
    return sorting.page_frame(stored_routes(spark, sf), _STORE).select("route_id", "page_pos", "has_more")


@query("store_pages", """SELECT route_id, ((rn - 1) // 20 + 1)::INTEGER AS page_no FROM (
      SELECT route_id, row_number() OVER (ORDER BY route_votes DESC, route_id) AS rn FROM texts WHERE is_trad) WHERE rn <= 60""")
def _(spark, sf):
    docs = stored_routes(spark, sf).select("route_id", "route_votes", "is_trad", "is_sport", "is_multipitch",
                                        "route_type", "tags", "grade_numeric", "area_id", "area_hierarchy_path")
    return sorting.pages(docs, FL.StoreFilter(is_trad=True), 3, "votes").select("route_id", "page_no")


@query("store_page_index", """SELECT page_no, route_id, route_stars FROM (SELECT route_id, route_stars, ((rn - 1) // 20 + 1)::INTEGER AS page_no, rn
      FROM (SELECT route_id, route_stars, row_number() OVER (ORDER BY route_stars DESC, route_id) AS rn FROM texts WHERE is_sport))
    WHERE rn % 20 = 1""")
def _(spark, sf):
    docs = stored_routes(spark, sf).select("route_id", "route_stars", "is_trad", "is_sport", "is_multipitch",
                                        "route_type", "tags", "grade_numeric", "area_id", "area_hierarchy_path")
    return sorting.page_index(docs, FL.StoreFilter(is_sport=True), "stars")


@query("store_page_by_number", """SELECT route_id, (rn - 60)::INTEGER AS page_pos FROM (
      SELECT route_id, row_number() OVER (ORDER BY route_stars DESC, route_id) AS rn FROM texts WHERE is_sport) WHERE rn > 60 AND rn <= 80""")
def _(spark, sf):
    docs = stored_routes(spark, sf).select("route_id", "route_stars", "is_trad", "is_sport", "is_multipitch",
                                        "route_type", "tags", "grade_numeric", "area_id", "area_hierarchy_path")
    sport = FL.StoreFilter(is_sport=True)
    index = written_table(sorting.page_index(docs, sport, "stars"), "page-index")
    return sorting.indexed_page(docs, index, 4, sport, "stars").select("route_id", "page_pos")


@query("store_page_by_tag", """SELECT route_id, row_number() OVER (ORDER BY route_lr::INTEGER, route_id)::INTEGER AS page_pos
    FROM texts WHERE list_contains(tags, 'single_pitch') QUALIFY page_pos <= 20""")
def _(spark, sf):
    f = FL.StoreFilter(tags=("single_pitch",))
    return sorting.page_frame(stored_routes(spark, sf), f, "lr", "asc").select("route_id", "page_pos")


@query("store_areas_by_name", "SELECT area_id, area_name FROM areas")
def _(spark, sf):
    from crestline.sources.store import by_name

    return by_name(area_docs(spark, sf)).select("area_id", "area_name")


@query("store_route_by_id", "SELECT route_id, normalized_grade FROM docs WHERE route_id = '42'")
def _(spark, sf):
    from crestline.sources.store import by_id

    return by_id(stored_routes(spark, sf), "route_id", "42").select("route_id", "normalized_grade")


# --- search --------------------------------------------------------------------

def _score_sql(col, q):
    low, terms = f"lower({col})", q.lower().split()
    parts = [f"{2 * len(t)} + CASE WHEN starts_with({low}, {S.lit(t)}) OR contains({low}, {S.lit(' ' + t)}) OR "
             f"contains({low}, {S.lit('/' + t)}) OR contains({low}, {S.lit('-' + t)}) THEN 5 ELSE 0 END" for t in terms]
    every = " AND ".join(f"contains({low}, {S.lit(t)})" for t in terms)
    return (f"CASE WHEN {every} THEN {' + '.join(parts)} + CASE WHEN contains({low}, {S.lit(q.lower())}) "
            "THEN 100 ELSE 0 END ELSE -1 END")


_EDGES = """edges AS (SELECT parent_path, path, min(area_ord * 100 + level) AS seen FROM (
      SELECT area_ord, level, array_to_string(names[1:level - 1], ' / ') AS parent_path,
        array_to_string(names[1:level], ' / ') AS path
      FROM areas, (SELECT unnest([1, 2, 3, 4]) AS level)) GROUP BY ALL),
  paths AS (SELECT path, min(parent_seen * 1000000000 + seen) AS path_ord FROM edges
    JOIN (SELECT parent_path, min(seen) AS parent_seen FROM edges GROUP BY ALL) USING (parent_path) GROUP BY path)"""
_Q_AREA, _Q_ROUTE, _Q_BOTH = "nation_1 Supplier", "red widget 1", "al 1"


def _shorten(path):
    cut = f"list_transform(list_filter(string_split({path}, ' / '), lambda s: s <> 'All Locations'), lambda s: {_SHORT.format('s')})"
    return f"array_to_string({cut}, ' / ')"


def _area_hits(q):
    return f"""SELECT 'area' AS type, path AS id, {_shorten("path")} AS text, score FROM (
      SELECT *, CAST({_score_sql("path", q)} AS INTEGER) AS score FROM paths) WHERE score > 0
      ORDER BY score DESC, path_ord LIMIT 5"""


def _route_hits(q):
    bonus = " + ".join(f"CASE WHEN contains(lower(area_path), {S.lit(t)}) THEN {len(t)} ELSE 0 END"
                       for t in q.lower().split())
    return f"""SELECT 'route' AS type, route_id AS id, CASE WHEN ends_with(route_name, ', The')
        THEN 'The ' || left(route_name, length(route_name) - 5) ELSE route_name END AS text,
        CAST(ns * 2 + CASE WHEN ns > 0 THEN {bonus} ELSE 0 END AS INTEGER) AS score FROM (
      SELECT *, {_score_sql("route_name", q)} AS ns FROM listing) WHERE ns >= 0 AND score > 0
      ORDER BY score DESC, area_ord, route_ord LIMIT 5"""


@query("area_path_edges", f"WITH {_EDGES} SELECT parent_path, path FROM edges")
def _(spark, sf):
    return hierarchy.path_edges(m.areas(spark, sf)).select("parent_path", "path")


@query("search_area_paths", f"WITH {_EDGES} {_area_hits(_Q_AREA)}")
def _(spark, sf):
    return search.search_area_paths(m.areas(spark, sf), _Q_AREA)


@query("search_route_names", _route_hits(_Q_ROUTE))
def _(spark, sf):
    r = flatten.attach_area(m.routes(spark, sf, **_bare), m.areas(spark, sf))
    return search.search_route_names(r, _Q_ROUTE)


@query("search_listing", f"WITH {_EDGES} (SELECT * FROM ({_area_hits(_Q_BOTH)})) UNION ALL (SELECT * FROM ({_route_hits(_Q_BOTH)}))")
def _(spark, sf):
    areas = m.areas(spark, sf)
    return search.search_listing(areas, flatten.attach_area(m.routes(spark, sf, **_bare), areas), _Q_BOTH)


_Q_DOC = "Supplier america 07"


def _doc_score(q):
    parts = []
    for t in q.lower().split():
        x = S.lit(t)
        parts.append(f"""CASE WHEN contains(lower(area_name), {x}) THEN 10 ELSE 0 END
          + CASE WHEN starts_with(lower(area_name), {x}) THEN 5 ELSE 0 END + CASE WHEN lower(area_name) = {x} THEN 10 ELSE 0 END
          + 3 * len(list_filter(names, lambda h: contains(lower(h), {x})))
          + CASE WHEN contains(lower(area_description), {x}) THEN 2 ELSE 0 END
          + CASE WHEN contains(searchable_text, {x}) THEN 1 ELSE 0 END""")
    return f"CAST({' + '.join(parts)} AS INTEGER)"


@query("search_areas", f"""SELECT area_id, score FROM (SELECT area_id, area_name, {_doc_score(_Q_DOC)} AS score
    FROM area_docs) WHERE score > 0 ORDER BY score DESC, area_name, area_id LIMIT 15""")
def _(spark, sf):
    return search.search_areas(area_docs(spark, sf), _Q_DOC).select("area_id", "score")


@query("search_areas_explained", f"""SELECT area_id, 'Hierarchy match: america (1 matches)|Description match: america'
      || '|Searchable text match: america' AS matches FROM (SELECT *, {_doc_score("america")} AS score FROM area_docs)
    WHERE score > 0 ORDER BY score DESC, area_name, area_id LIMIT 15""")
def _(spark, sf):
    return search.search_areas(area_docs(spark, sf), "america", explain=True).select(
        "area_id", joined(F.col("matches"), "|").alias("matches"))


@query("search_area_fallback", f"""SELECT area_id FROM (SELECT *, {_doc_score("america")} AS score FROM area_docs)
    WHERE score > 0 ORDER BY score DESC, area_name, area_id LIMIT 15""")
def _(spark, sf):
    return search.search_areas_or_names(area_docs(spark, sf), "america").select("area_id")


_WORDS = "contains(searchable_text, 'widget') AND contains(searchable_text, 'sport')"


@query("search_routes", f"""SELECT route_id FROM texts WHERE {_WORDS} AND grade_numeric >= 13 AND is_sport
    ORDER BY quality_score DESC, route_id DESC LIMIT 20""")
def _(spark, sf):
    f = FL.StoreFilter(min_grade="5.9", is_sport=True)
    return search.search_routes(stored_routes(spark, sf), "widget sport", f).select("route_id")


@query("search_routes_by_stars", f"""SELECT route_id FROM texts WHERE {_WORDS} ORDER BY route_stars DESC, route_id DESC LIMIT 20""")
def _(spark, sf):
    return search.search_routes(stored_routes(spark, sf), "widget sport", key="stars").select("route_id")


@query("popular_areas", "SELECT area_id, area_name FROM areas ORDER BY area_name, area_id LIMIT 10")
def _(spark, sf):
    return search.popular_areas(m.areas(spark, sf)).select("area_id", "area_name")


# --- trees ---------------------------------------------------------------------

def _without_self(areas):
    return areas.withColumn("area_hierarchy", F.slice("area_hierarchy", F.lit(1), F.size("area_hierarchy") - 1))


@query("area_tree_by_depth", """WITH t AS (SELECT area_id, area_name, names[1:len(names) - 1] AS up FROM tree_areas)
    SELECT c.area_id, min(p.area_id) AS parent_id, count(p.area_id) = 0 AS is_root FROM t c
    LEFT JOIN t p ON p.area_name = c.up[len(c.up)] AND len(p.up) = len(c.up) - 1 GROUP BY c.area_id""")
def _(spark, sf):
    return hierarchy.tree_by_depth(_without_self(m.areas(spark, sf, tree=True))).drop("area_name")


@query("area_tree_by_name", """WITH p AS (SELECT names[len(names)] AS own, arg_min(area_id, area_ord) AS parent_id
      FROM tree_areas GROUP BY 1)
    SELECT area_id, parent_id, false AS is_root FROM tree_areas JOIN p ON own = names[len(names) - 1]""")
def _(spark, sf):
    return hierarchy.tree_by_name(m.areas(spark, sf, tree=True)).drop("area_name")


@query("area_descendants", """SELECT area_id FROM tree_areas WHERE names[2] = 'ASIA'""")
def _(spark, sf):
    return hierarchy.descendants(m.areas(spark, sf, tree=True), "All Locations / ASIA").select("area_id")


# parents by whole path; the mapping has every name of a path as an area
_TREE = """edges AS (SELECT c.area_id, c.area_name, p.area_id AS parent_id FROM tree_areas c
      LEFT JOIN tree_areas p ON p.names = c.names[1:len(c.names) - 1]),
    path(area_id, ids, steps) AS (SELECT area_id, [area_id], [{'name': area_name, 'id': area_id}] FROM edges WHERE parent_id IS NULL
      UNION ALL SELECT e.area_id, list_append(ids, e.area_id), list_append(steps, {'name': area_name, 'id': e.area_id})
      FROM path JOIN edges e ON e.parent_id = path.area_id)"""


def _edges(spark, sf):
    return hierarchy.tree_by_depth(_without_self(m.areas(spark, sf, tree=True)))


@query("area_intervals", f"""WITH {_TREE}, sizes AS (SELECT id AS area_id, count(*) AS size FROM (SELECT unnest(ids) AS id FROM path) GROUP BY id),
    numbers AS (SELECT area_id, len(ids)::INTEGER AS depth, row_number() OVER (ORDER BY steps) AS first FROM path)
    SELECT area_id, parent_id, depth, first, first + size - 1 AS last FROM numbers JOIN sizes USING (area_id) JOIN edges USING (area_id)""")
def _(spark, sf):
    return intervals.intervals(_edges(spark, sf)).drop("area_name")


_JSON = "'{{\"area_id\":\"' || {0} || '\",\"area_name\":\"' || {1} || '\",\"children\":[' || {2} || ']}}'"


@query("area_nested_roots", f"""WITH leaf AS (SELECT names, names[1:3] AS up, names[1:2] AS root, area_name, area_id, {_JSON.format("area_id", "area_name", "''")} AS j
      FROM tree_areas WHERE len(names) = 4),
    nation AS (SELECT t.names, names[1:2] AS root, t.area_name, t.area_id, {_JSON.format("t.area_id", "t.area_name", "coalesce(c.j, '')")} AS j, coalesce(c.n, 0) + 1 AS n
      FROM tree_areas t LEFT JOIN (SELECT up, string_agg(j, ',' ORDER BY area_name, area_id) AS j, count(*) AS n FROM leaf GROUP BY up) c ON c.up = t.names
      WHERE len(t.names) = 3)
    SELECT t.area_id, t.area_name, 0 AS part, coalesce(c.n, 0)::BIGINT AS n_areas, '[' || coalesce(c.j, '') || ']' AS children FROM tree_areas t
    LEFT JOIN (SELECT root, string_agg(j, ',' ORDER BY area_name, area_id) AS j, sum(n) AS n FROM nation GROUP BY root) c ON c.root = t.names
    WHERE len(t.names) = 2""")
def _(spark, sf):
    # a region is one record as long as no more areas lie below it
    return nesting.nested_roots(_edges(spark, sf), per_part=1_000_000).drop("parent_id")


@query("branch_routes", "SELECT route_id, area_id FROM routes JOIN areas USING (area_id) WHERE names[2] IN ('ASIA', 'EUROPE')")
def _(spark, sf):
    labels = written_table(intervals.intervals(_edges(spark, sf)), "labels")
    base = scratch_path(spark, "labelled")
    store.write_version(intervals.labelled(m.routes(spark, sf, **_bare).select("route_id", "area_id"), labels), base, ["area_first"])
    # regions 2 and 3, and a nation of one of them
    chosen = ["r2", "r3", "n8"]
    return store.read_version(spark, base).filter(intervals.within(labels, chosen, "area_first")).select("route_id", "area_id")


@query("branch_walk", """WITH w(area_id, depth) AS (SELECT 'r2', 0 UNION ALL
      SELECT c.area_id, depth + 1 FROM w JOIN tree_areas p ON p.area_id = w.area_id
      JOIN tree_areas c ON c.names[1:len(c.names) - 1] = p.names) SELECT area_id, depth FROM w""")
def _(spark, sf):
    return intervals.walk(_edges(spark, sf).select("area_id", "parent_id"), "r2")


@query("area_quality", """SELECT count(*) FILTER (WHERE s_suppkey % 11 <> 0)::BIGINT AS valid,
    count(*) FILTER (WHERE s_suppkey % 11 = 0)::BIGINT AS invalid, count(*)::BIGINT AS with_hierarchy FROM areas""")
def _(spark, sf):
    a = m.areas(spark, sf)
    return FL.area_quality_counts(a.withColumn("area_name", F.when(F.col("area_ord") % 11 != 0, F.col("area_name"))))


# --- choices -------------------------------------------------------------------

_CHOSEN = """WITH c AS (SELECT route_id, CASE WHEN k % 2 = 0 THEN 'min' ELSE 'max' END AS changed, web_grade AS value,
      CASE WHEN k % 3 = 0 THEN '5.8' ELSE '5.10c' END AS low, CASE WHEN k % 5 = 0 THEN '5.9' ELSE '5.12a' END AS high FROM ruled),"""
_CHOICE_RANK = "coalesce(list_position({0}, {1}), 0)"


@query("coupled_ranges", f"""{_CHOSEN} r AS (SELECT *, {_CHOICE_RANK.format(S.lst(fixed.WEB_GRADES), "value")} AS v,
      {_CHOICE_RANK.format(S.lst(fixed.WEB_GRADES), "low")} AS l, {_CHOICE_RANK.format(S.lst(fixed.WEB_GRADES), "high")} AS h FROM c)
    SELECT route_id, CASE WHEN changed = 'min' OR v < l THEN value ELSE low END AS low,
      CASE WHEN changed = 'max' OR v > h THEN value ELSE high END AS high FROM r""")
def _(spark, sf):
    k = F.col("k")
    return m.routes(spark, sf, **_bare).select("route_id", choices.coupled_range(
        F.when(k % 2 == 0, "min").otherwise("max"), grades.grade_web(F.col("route_grade")),
        F.when(k % 3 == 0, "5.8").otherwise("5.10c"), F.when(k % 5 == 0, "5.9").otherwise("5.12a")).alias("r")).select("route_id", "r.*")


@query("sort_choices", """SELECT o_orderkey, o_orderstatus AS key, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0
    THEN 'asc' ELSE 'desc' END AS direction FROM orders""")
def _(spark, sf):
    direction = F.when(F.col("o_orderkey") % 2 == 0, "desc").otherwise("asc")
    return m.table(spark, sf, "orders").select("o_orderkey", choices.toggled_sort(
        F.lit("F"), direction, F.col("o_orderstatus")).alias("s")).select("o_orderkey", "s.*")


@query("path_choices", """SELECT area_id, CASE WHEN area_ord % 2 = 0 THEN r_name ELSE r_name || '|' || n_name || '|' || r_name || '/' || n_name END AS selected
    FROM areas""")
def _(spark, sf):
    named = m.areas(spark, sf).withColumn("r", F.col("area_hierarchy")[1]["area_hierarchy_name"]).withColumn(
        "n", F.col("area_hierarchy")[2]["area_hierarchy_name"])
    path = F.concat("r", F.lit("/"), "n")
    before = F.when(F.col("area_ord") % 2 == 0, F.array("r", path)).otherwise(F.array("r", "n"))
    return named.select("area_id", joined(choices.toggled_path(before, path), "|").alias("selected"))


@query("file_places", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 's3a://pages/raw/' || page_id || '.json' END AS place FROM pages""")
def _(spark, sf):
    name = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("/"), "page_id", F.lit(".json")))
    return m.table(spark, sf, "pages").select("page_id", choices.located(F.lit("s3a://pages/raw//"), name).alias("place"))
