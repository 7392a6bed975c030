"""Relevance scoring. Scores are sums of plain columns; the top rows come from
``orderBy().limit()``, which keeps k rows per task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline import fixed
from crestline.functions.arrays import has_all
from crestline.functions.derive import web_path
from crestline.functions.text import display_name, long_enough, query_terms, short_path
from crestline.operators.filters import (
    StoreFilter, all_of, any_of, area_conds, flag_conds, grade_rank_range)
from crestline.operators.hierarchy import area_paths
from crestline.operators.sorting import store_order


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def points(cond: Column, n: int) -> Column:
    return F.when(cond, n).otherwise(0)


def field_score(text: Column, query: str) -> Column:
    """-1 unless every term occurs; else 2 per term character, 5 for a term at
    a word start, 100 when the whole query text occurs."""
    low, terms = F.lower(text), query_terms(query)
    starts = [low.startswith(t) | any_of([low.contains(s + t) for s in " /-"]) for t in terms]
    score = total([F.lit(2 * len(t)) + points(s, 5) for t, s in zip(terms, starts)])
    whole = points(low.contains(query.lower()), 100)
    return F.when(all_of([low.contains(t) for t in terms]), score + whole).otherwise(-1)


def search_area_paths(areas: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Best distinct area paths: type, id, text, score, ord."""
    paths = area_paths(areas)
    if not long_enough(query):
        paths = paths.limit(0)
        score = F.lit(0)
    else:
        score = field_score(F.col("path"), query)
    return (
        paths.withColumn("score", score).filter(F.col("score") > 0)
        .orderBy(F.desc("score"), "path_ord").limit(k)
        .select(F.lit("area").alias("type"), F.col("path").alias("id"),
                short_path(F.col("path")).alias("text"), "score")
    )


def search_route_names(routes: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Twice the name score plus the length of terms found in the area path."""
    if not long_enough(query):
        routes, score = routes.limit(0), F.lit(0)
    else:
        name = field_score(F.col("route_name"), query)
        path = F.lower(F.coalesce(web_path(F.col("area_hierarchy")), F.lit("")))
        bonus = total([points(path.contains(t), len(t)) for t in query_terms(query)])
        score = F.when(name < 0, -1).otherwise(name * 2 + F.when(name > 0, bonus).otherwise(0))
    return (
        routes.withColumn("score", score).filter(F.col("score") > 0)
        .orderBy(F.desc("score"), "area_ord", "route_ord").limit(k)
        .select(F.lit("route").alias("type"), F.col("route_id").alias("id"),
                display_name(F.col("route_name")).alias("text"), "score")
    )


def search_listing(areas: DataFrame, routes: DataFrame, query: str, k: int = 5) -> DataFrame:
    """Best areas and routes in one list, by score; areas first on ties."""
    both = search_area_paths(areas, query, k).unionByName(search_route_names(routes, query, k))
    return both.orderBy(F.desc("score"), "type", "id")


def names_with(term: str) -> Column:
    """Number of hierarchy names that contain the term."""
    names = F.transform("area_hierarchy", lambda h: F.lower(h["area_hierarchy_name"]))
    return F.coalesce(F.size(F.filter(names, lambda n: n.contains(term))), F.lit(0))


def area_weight(query: str) -> tuple[Column, Column]:
    """(score, match explanations) summed over the terms, any term may match."""
    name = F.lower(F.coalesce("area_name", F.lit("")))
    desc = F.lower(F.coalesce("area_description", F.lit("")))
    text = F.lower(F.coalesce("searchable_text", F.lit("")))
    scores, notes = [], []
    for t in query_terms(query):
        in_tree = names_with(t)
        tests = [
            (name.contains(t), 10, F.concat(F.lit(f"Name match: {t} in "), name)),
            (name.startswith(t), 5, F.lit(f"Name starts with: {t}")),
            (name == t, 10, F.lit(f"Name exact match: {t}")),
            (desc.contains(t), 2, F.lit(f"Description match: {t}")),
            (text.contains(t), 1, F.lit(f"Searchable text match: {t}")),
        ]
        scores += [points(cond, n) for cond, n, _ in tests] + [in_tree * 3]
        why = [F.when(cond, note) for cond, _, note in tests]
        why.insert(3, F.when(in_tree > 0, F.concat(
            F.lit(f"Hierarchy match: {t} ("), in_tree.cast("string"), F.lit(" matches)"))))
        notes += why
    explained = F.filter(F.array(*notes), lambda n: n.isNotNull()) if notes else F.array()
    return total(scores), explained


def search_areas(areas: DataFrame, query: str, k: int = 15, explain: bool = False) -> DataFrame:
    """Weighted search over area documents, best ``k``; ties by name, then id.
    ``explain`` skips unnamed areas and adds the match details."""
    if not long_enough(query):
        return areas.limit(0)
    score, notes = area_weight(query)
    out = areas.withColumn("score", score)
    if explain:
        out = out.filter(F.coalesce("area_name", F.lit("")) != "").withColumn("matches", notes)
    return out.filter(F.col("score") > 0).orderBy(F.desc("score"), "area_name", "area_id").limit(k)


def search_areas_or_names(areas: DataFrame, query: str, k: int = 15) -> DataFrame:
    """Explained search. A plain search of names as a fallback could add nothing: a
    name that holds the whole query holds each of its terms and scores already."""
    return search_areas(areas, query, k, explain=True)


def search_routes(routes: DataFrame, query: str, filters: StoreFilter = StoreFilter(),
                  key: str = "quality", direction: str = "desc",
                  page_size: int = fixed.PAGE_SIZE_STORE) -> DataFrame:
    """Text search over route documents; all terms must occur, and every
    predicate applies before the page is cut."""
    if not long_enough(query):
        return routes.limit(0)
    order = store_order(key, direction, text_search=True)
    words = all_of([F.col("searchable_text").contains(t) for t in query_terms(query)])
    rest = words & grade_rank_range(filters.min_grade, filters.max_grade) & flag_conds(filters) \
        & has_all(F.col("tags"), filters.tags)
    return routes.filter(rest & area_conds(filters)).orderBy(*order).limit(page_size)


def popular_areas(areas: DataFrame, n: int = 10) -> DataFrame:
    return areas.orderBy("area_name", "area_id").limit(n)
