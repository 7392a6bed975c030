"""Catalogue tables derived from a generic star schema (part, supplier,
nation, region, lineitem, documents, events).

The rules are deterministic expressions over the whole input tables, so every
catalogue job can be run, timed and checked at any scale. Facts are aggregated
per part before they are joined, so a part that owns a third of all line items
is folded map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline import fixed
from crestline.functions.arrays import strings

GRADE_PICK = [
    "5.3", "5.6-", "5.7", "5.8+", "5.9", "5.9+", "5.10-", "5.10a", "5.10a/b", "5.10",
    "5.10b", "5.10c/d", "5.10d", "5.10+", "5.11a", "5.11", "5.11b PG13", "5.12c",
    "5.13-", "5.14d", "5.2", "5.16a", "V4", "",
]
TYPE_PICK = ["Sport", "Trad", "Trad, Sport", "Trad, Alpine, Grade III", "Boulder",
             "Aid, Trad", "TR", "Sport, TR"]
PROTECTION_PICK = ["", "PG13", "R", "X", "pg13"]
APPROACH_PICK = [None, "approach_none", "approach_short", "approach_moderate", "approach_long"]
RESULT_PICK = [
    '{"llm_tags":{"Route Style & Angle":["slab","vertical"],"Rope Length":["rope_70m"]}}',
    '{"llm_tags":{"Crack Climbing":["finger","finger_tip"],"Crowds & Popularity":["polished_rock"]}}',
    '{"llm_tags":{"Mystery":["x"],"Hold & Movement Type":["reachy"]}}',
    '{"llm_tags":{"Access & Restrictions":["seasonal_closure_wet","closed"]}}',
    '{"llm_tags":{}}',
    '{"llm_tags":{"Difficulty & Safety":["stick_clip","loose_rock"]}}',
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Row count; answered from Parquet footers."""
    return table(spark, sf_dir, name).count()


def pick(values: list, index: Column) -> Column:
    return F.get(strings(values), index.cast("int"))


def level(n: int, name: Column, url: Column) -> Column:
    return F.struct(F.lit(n).alias("level"), name.alias("area_hierarchy_name"),
                    url.alias("area_hierarchy_url"))


def area_url(area_id: Column) -> Column:
    return F.concat(F.lit("https://crags.example.org/area/"), area_id)


def areas(spark: SparkSession, sf_dir: str, tree: bool = False) -> DataFrame:
    """One area per supplier; with ``tree`` also one per nation and region."""
    sup, nat, reg = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    n_sup = size(spark, sf_dir, "supplier")
    s = F.col("s_suppkey")
    placed = nat.join(reg, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    root = level(1, F.lit(fixed.ROOT_NAME), F.lit("https://crags.example.org/areas"))
    region = level(2, F.col("r_name"), area_url(F.concat(F.lit("r"), F.col("r_regionkey"))))
    nation = level(3, F.col("n_name"), area_url(F.concat(F.lit("n"), F.col("n_nationkey"))))

    def shaped(df, area_id, ord_, name, hierarchy, approach):
        return df.select(
            area_id.alias("area_id"), ord_.cast("bigint").alias("area_ord"),
            area_url(area_id).alias("area_url"), name.alias("area_name"),
            F.lit("").alias("area_gps"),
            F.concat(F.lit("Crag "), name, F.lit(" in "), F.col("r_name")).alias("area_description"),
            F.concat(F.lit("Road "), ord_.cast("string")).alias("area_getting_there"),
            hierarchy.alias("area_hierarchy"),
            F.lit("").alias("area_access_issues"),
            (ord_ * 37 + 5).cast("string").alias("area_page_views"),
            F.lit("May, 2020").alias("area_shared_on"),
            F.array().cast("array<struct<comment_author:string,comment_text:string,"
                           "comment_time:string>>").alias("area_comments"),
            approach.alias("approach"),
        )

    leaf_id = F.concat(F.lit("a"), s)
    out = shaped(
        sup.join(placed, F.col("s_nationkey") == F.col("n_nationkey"), "left"),
        leaf_id, s, F.col("s_name"),
        F.array(root, region, nation, level(4, F.col("s_name"), area_url(leaf_id))),
        pick(APPROACH_PICK, s % 5),
    )
    if tree:
        none = F.lit(None).cast("string")
        out = out.unionByName(shaped(
            placed, F.concat(F.lit("n"), F.col("n_nationkey")), F.col("n_nationkey") + n_sup,
            F.col("n_name"), F.array(root, region, nation), none))
        out = out.unionByName(shaped(
            reg, F.concat(F.lit("r"), F.col("r_regionkey")), F.col("r_regionkey") + n_sup + 25,
            F.col("r_name"), F.array(root, region), none))
    return out


def _grade_ix() -> Column:
    return ((F.col("p_partkey") * 7 + F.col("p_size")) % 24).cast("int")


def facts(spark: SparkSession, sf_dir: str, with_ratings: bool) -> DataFrame:
    """Votes, stars and, per slot of the grade list, rating votes of each part.

    One scan and one shuffle: everything is a plain sum per part, combined
    map-side before the exchange. Line numbers only matter modulo the 24 slots.
    """
    li = table(spark, sf_dir, "lineitem")
    qty = F.sum("l_quantity").cast("bigint")
    slot = F.col("l_linenumber") % 24
    counts = [F.sum(F.when(slot == i, 1).otherwise(0)).alias(f"n{i}") for i in range(24)]
    out = li.groupBy(F.col("l_partkey").alias("k")).agg(
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("bigint").alias("route_votes"),
        ((qty % 41).cast("double") / 10).alias("route_stars"), *(counts if with_ratings else []))
    if with_ratings:
        out = out.select("k", "route_votes", "route_stars",
                         F.array(*[f"n{i}" for i in range(24)]).alias("slots"))
    return out


def _histogram() -> Column:
    """Rating -> votes from the slot counts; slot and grade fix the rating."""
    rating = F.transform("slots", lambda n, i: F.struct(
        pick(GRADE_PICK, (_grade_ix() + i - 4 + 24) % 24).alias("rating"), n.cast("int").alias("votes")))
    return F.coalesce(F.map_from_entries(F.filter(rating, lambda r: r["votes"] > 0)),
                      F.from_json(F.lit("{}"), "map<string,int>"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(route_id, rating, votes): one vote per line item."""
    return rating_maps(spark, sf_dir).select(
        "route_id", F.explode("route_suggested_ratings").alias("rating", "votes")).withColumn(
        "votes", F.col("votes").cast("bigint"))


def rating_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram per route; at most one entry per known grade."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey"), "p_size")
    # Parquet packs the keys of all parts into a few megabytes, which would be broadcast
    return part.join(facts(spark, sf_dir, True).hint("merge"), F.col("p_partkey") == F.col("k")).select(
        F.col("p_partkey").cast("string").alias("route_id"), _histogram().alias("route_suggested_ratings"))


def routes(spark: SparkSession, sf_dir: str, with_votes: bool = True,
           with_text: bool = False, with_ratings: bool = False) -> DataFrame:
    n_sup = size(spark, sf_dir, "supplier")
    k, z = F.col("p_partkey"), F.col("p_size")
    meters = F.when(k % 9 != 0, F.lit(12) + z % 35).cast("int")
    month = pick(list(fixed.MONTHS), k % 13)
    out = table(spark, sf_dir, "part")
    extra = []
    if with_votes or with_ratings:
        out = out.join(facts(spark, sf_dir, with_ratings), k == F.col("k"), "left")
        extra += [F.coalesce("route_votes", F.lit(0)).alias("route_votes"),
                  F.coalesce("route_stars", F.lit(0.0)).alias("route_stars")]
        extra += [_histogram().alias("route_suggested_ratings")] if with_ratings else []
    out = out.select(
        k.alias("k"), k.alias("route_ord"), (k % n_sup).alias("area_ord"),
        k.cast("string").alias("route_id"),
        F.concat(F.col("p_name"), F.lit(" "), k,
                 F.when(k % 17 == 0, ", The").otherwise("")).alias("route_name"),
        F.concat(F.lit("https://crags.example.org/route/"), k, F.lit("/"),
                 F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))).alias("route_url"),
        z.cast("string").alias("route_lr"),
        pick(GRADE_PICK, _grade_ix()).alias("route_grade"),
        pick(PROTECTION_PICK, z % 5).alias("route_protection_grading"),
        pick(TYPE_PICK, k % 8).alias("route_type"),
        (F.lit(1) + (z % 7) * (k % 2)).cast("int").alias("route_pitches"),
        (meters * 3).cast("int").alias("route_length_ft"),
        meters.alias("route_length_meter"),
        F.col("p_brand").alias("route_fa"),
        F.concat(F.lit("Sector "), F.col("p_type")).alias("route_location"),
        F.lit("bolts").alias("route_protection"),
        F.lit("").alias("route_page_views"),
        F.when(k % 13 == 12, "N/A").otherwise(
            F.concat(month, F.lit(", "), (F.lit(2018) + z % 7).cast("string"))).alias("route_shared_on"),
        F.when(k % 97 == 0, "missing").otherwise(
            F.concat(F.lit("a"), (k % n_sup).cast("string"))).alias("area_id"),
        *extra,
    )
    return with_texts(out, spark, sf_dir) if with_text else out


def with_texts(routes: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``routes`` with a document as their description. The texts are most of a row: join what is narrow before."""
    n_doc = size(spark, sf_dir, "documents")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id"), F.col("text").alias("route_description"))
    return routes.join(docs, F.col("k") % n_doc == F.col("doc_id"), "left").drop("doc_id")


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Externally produced tag results: (batch_ord, line_no, value = JSON line).

    Some ids come without content, some with broken content, some twice."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")

    def line(custom_id, content):
        return F.to_json(F.struct(custom_id.alias("custom_id"), F.struct(F.struct(F.array(F.struct(
            F.struct(content.alias("content")).alias("message"))).alias("choices")).alias("body")
        ).alias("response")))

    def entry(batch, content):
        return F.struct(F.lit(batch).alias("batch_ord"),
                        line(k.cast("string"), content).alias("value"))

    first = F.when(k % 10 == 3, "").when(k % 11 == 0, "not json").otherwise(pick(RESULT_PICK, k % 6))
    second = F.when((k % 15 == 0) & (k % 10 != 3), entry(1, pick(RESULT_PICK, (k + 1) % 6)))
    lines = F.filter(F.array(entry(0, first), second), lambda e: e.isNotNull())
    # the keys are a few bytes a line, and reading the lines is most of the work
    route = (_spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
             .select(k.alias("line_no"), F.explode(lines).alias("e"))
             .select("e.batch_ord", "line_no", "e.value"))
    approach = pick(APPROACH_PICK, s % 5)
    area = table(spark, sf_dir, "supplier").select(
        F.lit(0).alias("batch_ord"), s.alias("line_no"),
        line(F.concat(F.lit("area_a"), s), F.when(s % 4 == 1, "").otherwise(F.concat(
            F.lit('{"llm_tags":{"Approach & Accessibility":['),
            F.coalesce(F.concat(F.lit('"'), approach, F.lit('"')), F.lit("")),
            F.lit('],"Weather & Conditions":["sun_am"]}}')))).alias("value"))
    return route.unionByName(area)


def previous_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier snapshot of route tags as raw text: some list shaped, some twice."""
    n_sup = size(spark, sf_dir, "supplier")
    k = F.col("p_partkey")
    tags = F.array(
        F.struct(F.lit(0).alias("route_ord"), F.when(k % 5 != 0, "[]").otherwise(
            '{"Crack Climbing":["chimney"],"Crowds & Popularity":["low_crowds"]}').alias("route_tags")),
        F.when(k % 10 == 0, F.struct(F.lit(1).alias("route_ord"),
                                     F.lit('{"Crack Climbing":["offwidth"]}').alias("route_tags"))))
    return table(spark, sf_dir, "part").select(
        F.when(k % 97 == 0, "missing").otherwise(
            F.concat(F.lit("a"), (k % n_sup).cast("string"))).alias("area_id"),
        F.when(k % 97 == 0, -1).otherwise(k % n_sup).alias("area_ord"),
        k.cast("string").alias("route_id"),
        F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("t"),
    ).select("area_id", "area_ord", "route_id", "t.route_ord", "t.route_tags")


def page_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, data_type, fetched_at, fetch_id) from the event stream."""
    n_pages = size(spark, sf_dir, "pages")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    ev = table(spark, sf_dir, "events").select(
        (F.col("event_id") % n_pages).alias("page_id"),
        F.col("event_type").alias("data_type"), F.col("ts").alias("fetched_at"),
        F.col("event_id").alias("fetch_id"))
    return ev.join(pages, "page_id").drop("page_id")




# --- pages of a small web site derived from the tables -------------------------
#
# Area pages form a ten-way tree over the suppliers, inner pages also link back
# to their parent. Leaf pages list the routes of their supplier. Page sizes are
# bounded: ten links, parts per supplier, 24 rating values.

SITE = "https://crags.example.org"


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Deal narrow rows out before each becomes a page, about fifty times as wide, whose reading is most of the
    work: by number, as their few bytes would be put together in few tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def site_url(kind: str, key: str, slug: str) -> str:
    return f"concat('{SITE}/{kind}/', {key}, '/', {slug})"


def site_area_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = size(spark, sf_dir, "supplier")
    sup, nat, reg = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    placed = sup.join(nat.join(reg, F.col("n_regionkey") == F.col("r_regionkey"), "left"),
                      F.col("s_nationkey") == F.col("n_nationkey"), "left")
    rows = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % n).alias("s"), "p_partkey",
        F.expr("concat('<tr data-lr=\"', p_partkey, '\"><td>', '<a href=\"/route/', p_partkey, '/r-', p_partkey,"
               " '\">', p_name, ' <i>', p_partkey, '</i></a></td></tr>')").alias("row"))
    # p_partkey is unique, so every supplier gets the same share of rows
    listed = rows.groupBy("s").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("p_partkey", "row"))), lambda r: r["row"]), "").alias("rows"))
    nav = F.expr(f"""array_join(transform(
        filter(sequence(10 * s_suppkey + 1, 10 * s_suppkey + 10), c -> c < {n}),
        c -> concat('<div class="row"><a href="/area/', c, '/crag-', c, '">Crag ', c, '</a></div>')), '')""")
    back = F.expr(f"""if(s_suppkey = 0, '', concat('<div><a href="{SITE}/area/',
        (s_suppkey - 1) div 10, '/crag-', (s_suppkey - 1) div 10, '">up</a></div>'))""")
    # the rows are several times as large as the file of their parts, so they are never broadcast by its size
    return _spread(placed.join(listed.hint("merge"), F.col("s_suppkey") == F.col("s"), "left"), "s_suppkey").select(
        F.expr(site_url("area", "s_suppkey", "concat('crag-', s_suppkey)")).alias("url"),
        F.col("s_suppkey"),
        (F.col("s_suppkey") * 10 + 1 >= n).alias("leaf"), nav.alias("nav"), back.alias("back"),
        F.coalesce("rows", F.lit("")).alias("rows"), "s_name", "r_name", "r_regionkey", "n_name", "n_nationkey",
    ).select("url", F.expr(f"""concat(
        '<html><head><script>var a = "</div><h1>no</h1>";</script></head><body><h1>\\n ', s_name, ' &amp; more </h1>',
        '<div class="mb-half small text-warm"><a href="{SITE}/route-guide">All Locations</a> &gt; ',
        '<a href="{SITE}/area/', 100 + r_regionkey, '/', lower(replace(r_name, ' ', '-')), '">', substring(r_name, 1, 4), '…</a> ',
        '<a href="/area/', 200 + n_nationkey, '/n">', n_name, '</a></div>',
        '<div class="max-height max-height-md-0 max-height-xs-400">', nav, if(leaf, '', back), '</div>',
        '<table class="description-details"><tr><td>GPS:</td><td><a target="_blank" href="https://maps.google.com/?q=',
        s_suppkey, ',1">map</a></td></tr><tr><td>Page Views:</td><td>', format_number(s_suppkey * 37 + 1234, 0),
        ' total</td></tr><tr><td>Shared By:</td><td><a href="/user/1/b">Bo</a> on May ', 1 + s_suppkey % 28,
        ', 2020</td></tr></table>',
        '<h2>Description</h2><div class="fr-view"><p>Crag ', s_name, '</p><div> in <b>', r_name, '</b></div></div>',
        '<h2>Getting There</h2><div class="fr-view">Road ', s_suppkey, '</div>',
        if(s_suppkey % 3 = 0, '<div id="access-details-1"><p>Closed</p> in spring</div>', ''),
        if(leaf, concat('<table id="left-nav-route-table">', rows, '</table>'), ''), '</body></html>')""").alias("html"))


def site_route_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _spread(routes(spark, sf_dir), "k")
    return r.select(
        F.expr(site_url("route", "k", "concat('r-', k)")).alias("url"),
        F.expr("""concat('<body><h1>', route_name, '</h1><h2 class="inline"><span class="rateYDS">', route_grade,
        ' YDS</span> ', route_protection_grading, ' </h2><span id="starsWithAvgText-', k, '">Avg: ', route_stars,
        ' from ', format_number(route_votes + 1000 * (k % 3), 0), ' votes</span>',
        '<table class="description-details"><tr><td>Type:</td><td>', route_type,
        if(route_length_ft is null, '', concat(', ', route_length_ft, ' ft (', route_length_meter, ' m)')),
        if(route_pitches = 1, '', concat(', ', route_pitches, ' pitches')), '</td></tr><tr><td>FA:</td><td>',
        route_fa, '</td></tr><tr><td>Page Views:</td><td>', format_number(k * 11 + 990, 0),
        ' total</td></tr><tr><td>Shared By:</td><td>Bo on ', split(route_shared_on, ',')[0], ' 7, 2021</td></tr></table>',
        '<h2>Description</h2><div class="fr-view"><p>Climb ', route_id, '</p><div>then <b>top</b> out</div></div>',
        if(k % 5 = 0, '', concat('<h2>Location</h2><div class="fr-view">', route_location, '</div>')),
        '<h2>Protection</h2><div class="fr-view">', route_protection, '</div>',
        if(k % 4 = 0, '<h2>Gear</h2><div class="fr-view">cams &lt; 3</div>', ''),
        '<div class="comment-list">', if(k % 2 = 0, concat('<table class="main-comment"><tr><td><div class="bio">',
        '<a href="/user/', k, '/x"> Ann ', k, ' </a></div><div class="comment-body">Nice <div>and</div> long</div>',
        '<span class="comment-time">May 1</span></td></tr></table>'), ''), '<table class="main-comment"><tr><td>',
        '<div class="comment-body">ok</div></td></tr></table></div></body>')""").alias("html"))


def site_stats_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rated = rating_maps(spark, sf_dir)
    j = part.join(rated, F.col("p_partkey").cast("string") == F.col("route_id"), "left")
    return _spread(j, "p_partkey").select(
        F.expr(f"concat('{SITE}/route/stats/', p_partkey, '/r-', p_partkey)").alias("url"),
        F.expr("""concat('<h3>Suggested Ratings <span>9</span></h3><table class="table table-striped">',
        coalesce(array_join(transform(map_entries(route_suggested_ratings), e -> repeat(concat(
        '<tr><td><a href="/user/1/x">u</a></td><td>', e.key, '</td></tr>'), e.value % 5 + 1)), ''), ''),
        '<tr><td>u</td><td>· skipped</td></tr></table><h3>Ticks</h3><table class="table table-striped">',
        '<tr><td>u</td><td>Jan 3, 2021 · Lead / Onsight · ', repeat('fine ', cast(11 + p_partkey % 8 as int)),
        '<b>', p_name, '</b></td></tr><tr><td>v</td><td>short one</td></tr></table>')""").alias("html"))
