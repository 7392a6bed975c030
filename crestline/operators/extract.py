"""Area and route records from pages, as expressions over page elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline import fixed
from crestline.functions.arrays import or_empty
from crestline.functions.text import slug, slug_to_title, strip
from crestline.schemas import COMMENTS, HIERARCHY
from crestline.session import written_table
from crestline.sources.html import bind, first, following, has_class, inside, joined, select, with_elements

MISSING = "N/A"  # text of a field the page does not have


def els() -> Column:
    return F.col("els")


def tag_is(*names: str):
    return lambda e: e["tag"].isin(*names)


def is_block(e: Column) -> Column:
    return (e["tag"] == "div") & has_class(e, "fr-view")


def contains(c: Column, text: str) -> Column:
    return F.coalesce(c.contains(text), F.lit(False))


# --- page graph ----------------------------------------------------------------

def title() -> Column:
    h1 = first(select(els(), tag_is("h1")))
    return F.when(h1.isNotNull(), strip(h1["raw"])).otherwise("Unknown Area")


def nav_links() -> Column:
    """hrefs with ``/area/`` below the area navigation block."""
    boxes = select(els(), lambda e: (e["tag"] == "div") & has_class(
        e, "max-height", "max-height-md-0", "max-height-xs-400"))
    links = F.flatten(F.transform(boxes, lambda b: inside(
        els(), b, lambda e: (e["tag"] == "a") & contains(e["href"], "/area/"))))
    return or_empty(F.array_distinct(F.transform(links, lambda a: a["href"])))


def route_table() -> Column:
    return first(select(els(), lambda e: (e["tag"] == "table") & (e["id"] == "left-nav-route-table")))


def has_route_links() -> Column:
    return F.coalesce(F.size(inside(els(), route_table(), lambda e: (e["tag"] == "a") & contains(
        e["href"], "/route/"))) > 0, F.lit(False))


def absolute(href: Column, page_url: Column) -> Column:
    """Relative links get scheme and host of the page."""
    base = F.regexp_extract(page_url, r"^(https?://[^/]+)", 1)
    return F.when(href.startswith("http"), href).otherwise(F.concat(base, href))


def page_links(pages_with_els: DataFrame) -> DataFrame:
    """(src_url, dst_url) edges of the area navigation."""
    return pages_with_els.select(F.col("url").alias("src_url"), F.explode(nav_links()).alias("href")) \
        .select("src_url", absolute(F.col("href"), F.col("src_url")).alias("dst_url")).distinct()


def page_graph(pages_with_els: DataFrame) -> DataFrame:
    """(url, is_leaf, links) in one pass over the pages."""
    links = F.transform(nav_links(), lambda h: absolute(h, F.col("url")))
    return pages_with_els.select(
        "url", (has_route_links() & (F.size(links) == 0)).alias("is_leaf"), F.array_distinct(links).alias("links"))


def leaf_flags(pages_with_els: DataFrame) -> DataFrame:
    """Leaf = lists routes and has no child areas."""
    return pages_with_els.select(
        "url", title().alias("title"),
        (has_route_links() & (F.size(nav_links()) == 0)).alias("is_leaf"))


# --- detail rows ---------------------------------------------------------------

def _detail_value(label: str, pattern: str) -> Column:
    """Value of the last detail row labelled ``label`` whose second cell has the pattern."""
    tables = F.transform(select(els(), lambda e: (e["tag"] == "table") & has_class(e, "description-details")),
                         lambda t: t["start"])
    cells = bind(tables, lambda ts: select(els(), lambda e: (e["tag"] == "td") & F.array_contains(ts, e["table"])))
    values = bind(cells, lambda cs: F.transform(
        F.filter(cs, lambda c: (c["nth"] == 0) & contains(joined(c), label)),
        lambda h: joined(first(F.filter(cs, lambda c: (c["row"] == h["row"]) & (c["nth"] == 1))), " ")))
    return F.try_element_at(F.filter(values, lambda v: v.rlike(pattern)), F.lit(-1))


def page_views() -> Column:
    pattern = r"([\d,]+)"
    n = F.regexp_extract(_detail_value("Page Views:", pattern), pattern, 1)
    return F.coalesce(F.replace(n, F.lit(","), F.lit("")), F.lit(MISSING))


def shared_on() -> Column:
    pattern = r"on\s+([A-Za-z]{3})\s+\d{1,2},\s*(\d{4})"
    text = _detail_value("Shared By:", pattern)
    return F.coalesce(F.concat(F.regexp_extract(text, pattern, 1), F.lit(", "),
                               F.regexp_extract(text, pattern, 2)), F.lit(MISSING))


def _labelled(label: str) -> Column:
    """Text of the first cell behind the text ``label``; null without it."""
    cell = first(select(els(), lambda e: (e["tag"] == "td") & F.array_contains(e["texts"], label)))
    return F.when(cell.isNotNull(), joined(following(els(), cell, tag_is("td"))))


def access_issues() -> Column:
    boxes = select(els(), lambda e: (e["tag"] == "div") & F.coalesce(
        e["id"].startswith("access-details-"), F.lit(False)) & (F.size(e["texts"]) > 0))
    return F.array_join(F.transform(boxes, lambda b: joined(b, " ")), " ")


# --- route fields --------------------------------------------------------------

def _grade_element() -> Column:
    return first(select(els(), lambda e: has_class(e, "rateYDS") | has_class(e, "route-type", "Ice")))


def grade() -> Column:
    token = F.get(F.split(strip(joined(_grade_element())), r"\s+"), F.lit(0))
    return F.when(_grade_element().isNotNull(), strip(F.replace(token, F.lit("YDS"), F.lit("")))) \
        .otherwise("Unknown")


def protection_grading() -> Column:
    """Loose text of the heading that holds the grade."""
    heads = bind(_grade_element(), lambda g: F.filter(
        els(), lambda e: (e["tag"] == "h2") & (e["start"] < g["start"]) & (e["end"] > g["start"])))
    return F.coalesce(F.array_join(F.try_element_at(heads, F.lit(-1))["own"], " "), F.lit(""))


def _stars_text() -> Column:
    return joined(first(select(els(), lambda e: (e["tag"] == "span") & contains(e["id"], "starsWithAvgText"))))


def stars() -> Column:
    return F.regexp_extract(_stars_text(), r"Avg: (\d+(\.\d+)?)", 1).try_cast("double")


def votes() -> Column:
    return F.replace(F.regexp_extract(_stars_text(), r"from ([\d,]+)", 1), F.lit(","), F.lit("")).try_cast("int")


def type_line(text: Column) -> Column:
    """struct(type, pitches, ft, meter) of a ``Type:`` value; null text = N/A, 1 pitch."""
    pitch, length = r"(?i)(\d+)\s*pitches?", r"(?i)\d+\s*ft"
    full = r"(\d+)\s*ft\s*\((\d+)\s*m\)"

    def parse(items: Column) -> Column:
        rest = F.filter(items, lambda i: ~i.rlike(pitch))
        last_pitch = F.try_element_at(F.filter(items, lambda i: i.rlike(pitch)), F.lit(-1))
        last_length = F.try_element_at(F.filter(rest, lambda i: i.rlike(length)), F.lit(-1))
        kind = F.array_join(F.filter(rest, lambda i: ~i.rlike(length)), ", ")
        return F.struct(
            F.coalesce(kind, F.lit(MISSING)).alias("type"),
            F.coalesce(F.regexp_extract(last_pitch, pitch, 1).try_cast("int"), F.lit(1)).alias("pitches"),
            F.regexp_extract(last_length, full, 1).try_cast("int").alias("ft"),
            F.regexp_extract(last_length, full, 2).try_cast("int").alias("meter"))

    return bind(F.transform(F.split(text, ",", -1), lambda i: strip(i)), parse)


def first_ascent() -> Column:
    return F.coalesce(_labelled("FA:"), F.lit(MISSING))


def section(*titles: str) -> Column:
    """Text block behind the last heading whose first matching title is one of
    ``titles``; headings count for the earliest of the four section words."""
    words = ["Description", "Location", "Protection", "Gear"]
    heads = select(els(), tag_is("h2"))

    def matches(h: Column) -> Column:
        text = h["raw"]
        cond = F.lit(False)
        earlier = F.lit(False)
        for w in words:
            if w in titles:
                cond = cond | (contains(text, w) & ~earlier)
            earlier = earlier | contains(text, w)
        return cond

    head = F.try_element_at(F.filter(heads, matches), F.lit(-1))
    return F.coalesce(joined(following(els(), head, is_block)), F.lit(MISSING))


def comments() -> Column:
    """Author, text and time of each comment table."""
    box = first(select(els(), lambda e: (e["tag"] == "div") & has_class(e, "comment-list")))
    inner = inside(els(), box, lambda e: e["tag"].isin("table", "div", "span"))

    def by_table(found: Column, text) -> Column:
        """Map from the start of a comment table to the text of the first such
        element in it, also below inner tables; elements outside have no place."""
        return F.map_from_entries(F.transform(
            F.filter(found, lambda e: e["box"].isNotNull() & (e["box_nth"] == 0)),
            lambda e: F.struct(e["box"], text(e))))

    def build(parts: Column) -> Column:
        tables = F.filter(parts, lambda e: (e["tag"] == "table") & has_class(e, "main-comment"))

        def named(tag: str, cls: str) -> Column:
            return F.filter(parts, lambda e: (e["tag"] == tag) & F.coalesce(e["cls"] == cls, F.lit(False)))

        authors = by_table(named("div", "bio"), lambda b: strip(b["user"]))
        texts = by_table(named("div", "comment-body"), lambda e: joined(e, " "))
        times = by_table(named("span", "comment-time"), lambda e: joined(e, " "))

        def value(m: Column, t: Column) -> Column:
            return F.coalesce(F.try_element_at(m, t["start"]), F.lit(MISSING))

        maps = F.struct(authors.alias("authors"), texts.alias("texts"), times.alias("times"))
        return bind(maps, lambda m: F.transform(tables, lambda t: F.struct(
            value(m["authors"], t).alias("comment_author"), value(m["texts"], t).alias("comment_text"),
            value(m["times"], t).alias("comment_time"))))

    return F.coalesce(bind(inner, build), F.array().cast(COMMENTS))


def _second_cells(heading: str, sep: str) -> Column:
    """Second cells of the striped table behind the first h3 starting ``heading``."""
    h3 = first(select(els(), lambda e: (e["tag"] == "h3") & joined(e).startswith(heading)))
    table = following(els(), h3, lambda e: (e["tag"] == "table") & F.coalesce(
        e["cls"] == "table table-striped", F.lit(False)))
    cells = bind(table, lambda t: select(
        els(), lambda e: (e["tag"] == "td") & (e["table"] == t["start"]) & (e["nth"] == 1)))
    return F.transform(cells, lambda c: joined(c, sep))


def suggested_ratings() -> Column:
    """Histogram of the rating cells; blank cells and cells starting with a dot skip."""
    cells = F.filter(_second_cells("Suggested Ratings", ""), lambda r: (r != "") & ~r.startswith("·"))
    counted = bind(cells, lambda c: F.transform(F.array_distinct(c), lambda r: F.struct(
        r, F.size(F.filter(c, lambda x: x == r)))))
    return F.coalesce(F.map_from_entries(counted), F.from_json(F.lit("{}"), "map<string,int>"))


def clean_tick(text: Column) -> Column:
    """Without dates and climb type, single blanks."""
    t = F.regexp_replace(text, r"\b[A-Za-z]{3}\s+\d{1,2},\s*\d{4}\b", "")
    t = F.regexp_replace(t, r"·.*?·", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def tick_comments() -> Column:
    """Ticks of 15 or more words, in order, joined by a blank."""
    ticks = F.transform(_second_cells("Ticks", " "), clean_tick)
    long = F.filter(ticks, lambda t: (t != "") & (F.size(F.split(t, " ")) >= fixed.MIN_TICK_WORDS))
    return F.coalesce(F.array_join(long, " "), F.lit(""))


def stats_url(route_url: Column) -> Column:
    """First ``/route/`` becomes ``/route/stats/``."""
    return F.regexp_replace(route_url, r"^(.*?)/route/", "$1/route/stats/")


# --- records -------------------------------------------------------------------

def hierarchy() -> Column:
    """Breadcrumb links with level = position, current area last; short, cut or
    empty names are taken from the link."""
    box = first(select(els(), lambda e: (e["tag"] == "div") & F.coalesce(
        e["cls"] == "mb-half small text-warm", F.lit(False))))
    links = inside(els(), box, lambda e: e["tag"] == "a")

    def crumb(a: Column, i: Column) -> Column:
        raw = joined(a)
        from_url = (raw == "") | raw.endswith("…") | (F.length(raw) < 5)
        return F.struct((i + 1).alias("level"),
                        F.when(from_url, slug_to_title(a["href"])).otherwise(raw).alias("area_hierarchy_name"),
                        a["href"].alias("area_hierarchy_url"))

    def here(n: Column) -> Column:
        return F.struct((n + 1).alias("level"), slug_to_title(F.col("url")).alias("area_hierarchy_name"),
                        F.col("url").alias("area_hierarchy_url"))

    return F.when(box.isNotNull(), bind(links, lambda ls: F.concat(
        F.transform(ls, lambda a, i: crumb(a, i)), F.array(here(F.size(ls)))))).otherwise(
        F.array().cast(HIERARCHY))


def gps() -> Column:
    """Map link of a ``GPS:`` row."""
    rows = select(els(), lambda e: (e["tag"] == "tr") & contains(joined(e), "GPS:"))
    links = F.transform(rows, lambda r: first(inside(
        els(), r, lambda e: (e["tag"] == "a") & (e["target"] == "_blank") & e["href"].isNotNull()))["href"])
    return F.coalesce(first(F.filter(links, lambda h: contains(h, "maps.google.com"))), F.lit(MISSING))


def area_records(pages_with_els: DataFrame, *more: Column) -> DataFrame:
    """One area record per page, with ``more`` columns; the id is a digest of the
    URL, so reruns agree."""
    there = first(select(els(), lambda e: (e["tag"] == "h2") & contains(e["raw"], "Getting There")))
    return pages_with_els.select(
        F.md5("url").alias("area_id"), F.col("url").alias("area_url"), slug(F.col("url")).alias("area_name"),
        gps().alias("area_gps"),
        F.coalesce(joined(first(select(els(), is_block))), F.lit(MISSING)).alias("area_description"),
        F.coalesce(joined(following(els(), there, is_block)), F.lit(MISSING)).alias("area_getting_there"),
        F.lit("[]").alias("area_tags"), hierarchy().alias("area_hierarchy"),
        access_issues().alias("area_access_issues"), page_views().alias("area_page_views"),
        shared_on().alias("area_shared_on"), comments().alias("area_comments"), *more)


def _route_links() -> Column:
    """(name, href, lr) of the links in the route table."""
    links = bind(route_table(), lambda t: select(
        els(), lambda e: (e["tag"] == "a") & (e["table"] == t["start"]) & (e["nth"] == 0)))
    return F.transform(links, lambda a: F.struct(joined(a).alias("name"), a["href"].alias("href"), a["lr"].alias("lr")))


def _listed(areas: DataFrame) -> DataFrame:
    """Route rows of (area_id, area_url, links)."""
    return areas.select("area_id", "area_url", F.posexplode("links").alias("route_pos", "a")).select(
        "area_id", "area_url", "route_pos", F.col("a.name").alias("route_name"),
        absolute(F.col("a.href"), F.col("area_url")).alias("route_url"),
        F.coalesce(F.col("a.lr").try_cast("int"), F.lit(0)).alias("route_lr"))


def route_list(pages_with_els: DataFrame) -> DataFrame:
    """Rows of the route table, in list order (route_pos)."""
    return _listed(pages_with_els.select(
        F.md5("url").alias("area_id"), F.col("url").alias("area_url"), _route_links().alias("links")))


def areas_and_lists(pages_with_els: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``area_records`` and ``route_list`` of the same pages, which are read once: the
    parsed rows are written, and both come from there."""
    parsed = written_table(area_records(pages_with_els, _route_links().alias("links")), "parsed-areas")
    return parsed.drop("links"), _listed(parsed)


def route_details(pages_with_els: DataFrame) -> DataFrame:
    """Fields of a route page, keyed by its URL."""
    t = F.col("_type")
    return pages_with_els.withColumn("_type", type_line(_labelled("Type:"))).select(
        F.col("url").alias("route_url"), F.md5("url").alias("route_id"), grade().alias("route_grade"),
        protection_grading().alias("route_protection_grading"), stars().alias("route_stars"),
        votes().alias("route_votes"), t["type"].alias("route_type"), t["pitches"].alias("route_pitches"),
        t["ft"].alias("route_length_ft"), t["meter"].alias("route_length_meter"),
        first_ascent().alias("route_fa"), section("Description").alias("route_description"),
        section("Location").alias("route_location"),
        section("Protection", "Gear").alias("route_protection"),
        page_views().alias("route_page_views"), shared_on().alias("route_shared_on"),
        comments().alias("route_comments"))


#: What ``route_stats`` looks at.
STATS_TAGS = ("h3", "table", "td")


def route_stats(pages_with_els: DataFrame) -> DataFrame:
    """Histogram and tick text of a statistics page, keyed by its URL."""
    return pages_with_els.select(F.col("url").alias("stats_url"),
                                 suggested_ratings().alias("route_suggested_ratings"),
                                 tick_comments().alias("route_tick_comments"))


def routes_of_areas(listed: DataFrame, route_els: DataFrame, stats_els: DataFrame) -> DataFrame:
    """Rows of ``route_list`` with the details and statistics of each route; the
    position of the list wins over the one of the detail page. What comes out of a page pass
    has no known size, so it is never broadcast."""
    stats = route_stats(stats_els)
    out = listed.join(route_details(route_els).hint("merge"), "route_url", "left")
    return out.withColumn("stats_url", stats_url(F.col("route_url"))) \
        .join(stats.hint("merge"), "stats_url", "left").drop("stats_url")


def nest(areas: DataFrame, routes: DataFrame, per_row: int = 1000) -> DataFrame:
    """Area records with embedded routes. A record holds at most ``per_row``
    routes; a larger area continues in further records of the same id (``part``),
    so no group grows with the data. Reading back explodes all parts. Routes of
    an area that has no record keep a record with nothing but its id. ``routes`` are
    read once, since a page pass may be behind them."""
    fields = [c for c in routes.columns if c not in ("area_id", "area_url", "route_pos")]
    # an area without routes, or with none in its first part, gets an empty first part: a null
    # among its routes, which the list drops. Null ids equal none, so theirs stays apart
    unplaced = F.col("area_id").isNull() | F.coalesce(F.col("route_pos") >= per_row, F.lit(True))
    rows = routes.withColumn("_empty", F.explode(F.when(unplaced, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    placed = rows.select(
        "area_id", F.when(F.col("_empty"), 0).otherwise(F.floor(F.col("route_pos") / per_row)).cast("int").alias("part"),
        F.when(~F.col("_empty"), F.struct("route_pos", *fields)).alias("_r"))
    none = areas.select("area_id", F.lit(0).alias("part"), F.lit(None).cast(placed.schema["_r"].dataType).alias("_r"))
    apart = F.col("area_id").isNull() & F.col("_r").isNull()
    packed = placed.unionByName(none).groupBy("area_id", "part", apart.alias("_apart")).agg(F.array_sort(
        F.collect_list("_r"), lambda a, b: a["route_pos"] - b["route_pos"]).alias("_r"))
    packed = packed.withColumn("routes", F.transform("_r", lambda r: F.struct(
        *[r[f].alias(f) for f in fields]))).drop("_r", "_apart")
    # parts are the left side: those of one crowded area may be split; areas that were written
    # show their compressed size, which says little about a broadcast
    return packed.join(areas.hint("merge"), "area_id", "left")


__all__ = ["with_elements", "area_records", "route_list", "route_details", "route_stats",
           "areas_and_lists", "routes_of_areas", "nest", "page_links", "page_graph", "leaf_flags"]
