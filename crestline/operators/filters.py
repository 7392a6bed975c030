"""Predicates and filter specifications of the two front ends."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline import fixed
from crestline.functions.arrays import has, has_all, or_empty, overlaps, tags_in
from crestline.functions.derive import web_path
from crestline.functions.grades import grade_sub_rank, grade_web, grade_web_rank, web_rank

PATH_END = "\uf8ff"  # sorts behind every name


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


# --- in-memory listing ---------------------------------------------------------

@dataclass(frozen=True)
class ListingFilter:
    """Grade bounds ('' = open), types (Trad, Sport), tags by category."""

    grade_min: str = ""
    grade_max: str = ""
    types: tuple[str, ...] = ()
    tags: dict[str, tuple[str, ...]] = field(default_factory=dict)


# Defaults of the search hook and of the grade panel when it is switched on.
HOOK_DEFAULT = ListingFilter("5.6", "5.13d")
GRADE_PANEL_ON = ListingFilter("5.10a", "5.11a")
GRADE_PANEL_OFF = ListingFilter()


def excluded_type(route_type: Column) -> Column:
    """One ``, ``-separated element is exactly an excluded type."""
    return overlaps(F.split(route_type, ", ", -1), fixed.EXCLUDED_TYPES)


def type_match(route_type: Column, selected: tuple[str, ...]) -> Column:
    """Any selected type among the elements; elements starting ``Grade`` ignored."""
    known = [t for t in selected if t in ("Trad", "Sport")]
    if not selected:
        return F.lit(True)
    if not known:
        return F.lit(False)
    types = F.transform(
        F.filter(F.split(route_type, ", ", -1), lambda t: ~t.startswith("Grade")),
        lambda t: F.trim(t))
    return overlaps(types, known)


def tag_match(tags: Column, selected: dict[str, tuple[str, ...]]) -> Column:
    """AND over categories, OR inside one; exclusion entries of the safety
    category only remove routes."""
    conds = []
    for category, chosen in selected.items():
        mine = tags_in(tags, category)
        plain = [t for t in chosen if t not in fixed.EXCLUSION_TAGS]
        if category == fixed.SAFETY:
            conds += [~has(mine, fixed.EXCLUSION_TAGS[t]) for t in chosen if t in fixed.EXCLUSION_TAGS]
        if plain:
            conds.append(overlaps(mine, plain))
    return all_of(conds)


def grade_bounds(rank: Column, low: str, high: str) -> Column:
    """Bounds in web rank; an empty or unrankable bound is open."""
    conds = []
    for text, keep in ((low, lambda b: rank >= b), (high, lambda b: rank <= b)):
        if text:
            bound = web_rank(grade_web(F.lit(text)))
            conds.append((bound == -1) | keep(bound))
    return all_of(conds)


def listing_predicate(f: ListingFilter, strict: bool = False, rank: Column | None = None) -> Column:
    """Exclusion, grade, type and tag filter. An unrankable grade passes the
    last three unless ``strict``. Tables that store the web rank pass it as ``rank``."""
    c = F.col
    rank = grade_web_rank(c("route_grade")) if rank is None else rank
    rest = grade_bounds(rank, f.grade_min, f.grade_max) & type_match(c("route_type"), f.types) \
        & tag_match(c("route_tags"), f.tags)
    return ~excluded_type(c("route_type")) & (rest if strict else ((rank == -1) | rest))


def path_prefix(path: Column, selected: list[str], by_segment: bool = False) -> Column:
    """Path starts with a selected path; nothing selected = everything.
    ``by_segment`` does not match in the middle of a segment."""
    if not selected:
        return F.lit(True)
    if by_segment:
        return any_of([(path == p) | path.startswith(p + " / ") for p in selected])
    return any_of([path.startswith(p) for p in selected])


def in_selected_areas(routes: DataFrame, selections: DataFrame, path: str = "area_path",
                      selected: str = "selected_path") -> DataFrame:
    """Prefix semi join against a table of selections, as equi joins.

    Only distinct area paths are compared: each is cut to every length that
    occurs among the selections and looked up. The list of lengths is bounded
    by the longest path, not by the number of selections. Nothing selected =
    everything, as in ``path_prefix``.
    """
    selections = selections.filter(F.col(selected).isNotNull())
    lengths = [r[0] for r in selections.select(F.length(selected)).distinct().collect()]
    if not lengths:
        return routes
    heads = (
        routes.select(path).distinct()
        .select(path, F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("_n"))
        .filter(F.length(path) >= F.col("_n"))
        .select(path, F.substring(F.col(path), F.lit(1), F.col("_n")).alias(selected))
    )
    hits = heads.join(selections.select(selected), selected, "left_semi").select(path)
    return routes.join(hits, path, "left_semi")


def with_web_path(routes: DataFrame) -> DataFrame:
    return routes.withColumn("area_path", web_path(F.col("area_hierarchy")))


def hook_predicate(f: ListingFilter, query: str = "") -> Column:
    """Search hook: substring of name, grade or type; bounds are looked up as
    given; the type must equal a selected text; tags AND over categories."""
    c = F.col
    rank = grade_web_rank(c("route_grade"))
    low, high = web_rank(F.lit(f.grade_min)), web_rank(F.lit(f.grade_max))
    conds = [(rank >= low) & (rank <= high)]
    if query:
        q = query.lower()
        conds.append(any_of([F.lower(c(n)).contains(q) for n in ("route_name", "route_grade", "route_type")]))
    if f.types:
        conds.append(c("route_type").isin(list(f.types)))
    conds += [overlaps(tags_in(c("route_tags"), cat), ts) for cat, ts in f.tags.items() if ts]
    return all_of(conds)


# --- document store ------------------------------------------------------------

@dataclass(frozen=True)
class StoreFilter:
    min_grade: str | None = None
    max_grade: str | None = None
    tags: tuple[str, ...] = ()
    excluded_types: tuple[str, ...] = ()
    area_ids: tuple[str, ...] = ()
    area_path: str | None = None
    is_multipitch: bool = False
    is_trad: bool = False
    is_sport: bool = False

    @property
    def has_grade(self) -> bool:
        return bool(self.min_grade or self.max_grade)


def path_range(path: Column, prefix: str) -> Column:
    """Key range of a path prefix."""
    return (path >= prefix) & (path < prefix + PATH_END)


def areas_by_path(areas: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    """Areas below a path, by path and id; all of them unless a limit is asked for."""
    found = areas.filter(path_range(F.col("area_hierarchy_path"), prefix)).orderBy("area_hierarchy_path", "area_id")
    return found if limit is None else found.limit(limit)


def grade_rank_range(low: str | None, high: str | None) -> Column:
    conds = []
    if low:
        conds.append(F.col("grade_numeric") >= grade_sub_rank(F.lit(low)))
    if high:
        conds.append(F.col("grade_numeric") <= grade_sub_rank(F.lit(high)))
    return all_of(conds)


def flag_conds(f: StoreFilter) -> Column:
    wanted = [n for n in ("is_multipitch", "is_trad", "is_sport") if getattr(f, n)]
    return all_of([F.col(n) for n in wanted])


def area_conds(f: StoreFilter) -> Column:
    """Ids win over the path."""
    if f.area_ids:
        return F.col("area_id").isin(list(f.area_ids))
    return path_range(F.col("area_hierarchy_path"), f.area_path) if f.area_path else F.lit(True)


def no_excluded_type(route_type: Column, excluded: tuple[str, ...]) -> Column:
    """Array form, whatever the case."""
    if not excluded:
        return F.lit(True)
    return ~overlaps(F.transform(or_empty(route_type), lambda t: F.lower(t)), [t.lower() for t in excluded])


def pushed_predicate(f: StoreFilter) -> Column:
    return area_conds(f) & flag_conds(f) & grade_rank_range(f.min_grade, f.max_grade)


def residual_predicate(f: StoreFilter) -> Column:
    return has_all(F.col("tags"), f.tags) & no_excluded_type(F.col("route_type"), f.excluded_types)


# --- areas ---------------------------------------------------------------------

def area_quality_counts(areas: DataFrame) -> DataFrame:
    """Areas with and without a name, areas with a hierarchy."""
    named = F.coalesce("area_name", F.lit("")) != ""
    return areas.agg(F.count_if(named).alias("valid"), F.count_if(~named).alias("invalid"),
                     F.count_if(F.size("area_hierarchy") > 0).alias("with_hierarchy"))
