"""Sort orders, limits and keyset pages. Every order ends in a unique key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline import fixed
from crestline.functions.grades import grade_web_rank
from crestline.operators.filters import StoreFilter, pushed_predicate, residual_predicate
from crestline.operators.ordinal import global_row_number
from crestline.session import written_table

INPUT_ORDER = ["area_ord", "route_ord"]
STORE_KEYS = {"grade": "grade_numeric", "stars": "route_stars", "votes": "route_votes",
              "quality": "quality_score", "lr": "route_lr"}
LISTING_DEFAULT = ("votes", False)
STORE_DEFAULT = ("quality", "desc")


def listing_order(option: str, reverse: bool = False) -> list[Column]:
    """Order of the in-memory listing. Grade and left-to-right run upwards,
    stars and votes downwards; ``reverse`` flips. Ties keep input order."""
    c = F.col
    ties = [c(n).asc() for n in INPUT_ORDER]
    if option == "grade":
        rank = grade_web_rank(c("route_grade"))
        return [rank.desc() if reverse else rank.asc(), *ties]
    if option in ("stars", "votes"):
        v = F.coalesce(c(f"route_{option}").cast("string").try_cast("double"), F.lit(0.0))
        return [v.asc() if reverse else v.desc(), *ties]
    if option == "left_to_right":
        # areas stay in input order, routes of one area go by their position
        lr = F.coalesce(c("route_lr").cast("string").try_cast("int"), F.lit(0))
        return [c("area_ord").asc(), lr.desc() if reverse else lr.asc(), c("route_ord").asc()]
    return ties


def first_rows(df: DataFrame, order: list[Column], visible: int = fixed.PAGE_SIZE_WEB) -> DataFrame:
    """The first ``visible`` rows; grow it by a page to show more."""
    return df.orderBy(*order).limit(visible)


def shown_of_total(df: DataFrame, visible: int = fixed.PAGE_SIZE_WEB) -> DataFrame:
    n = F.count("*")
    return df.agg(F.least(n, F.lit(visible)).cast("bigint").alias("shown"), n.alias("total"))


def toggle(current: tuple[str, str], key: str) -> tuple[str, str]:
    """Same key flips, a new key starts descending."""
    return key, "asc" if current == (key, "desc") else "desc"


def store_keys(key: str, direction: str, has_grade: bool = False,
               text_search: bool = False) -> list[tuple[str, bool]]:
    """(column, descending) list. A grade filter puts the grade first; text
    search has no left-to-right order; unknown keys mean quality."""
    desc = direction == "desc"
    known = {k: v for k, v in STORE_KEYS.items() if not (text_search and k == "lr")}
    wanted = known.get(key, known["quality"])
    cols = [known["grade"]] if has_grade else []
    if wanted not in cols:
        cols.append(wanted)
    # listing pages tie by id upwards, text search by id in the key's direction
    return [(c, desc) for c in cols] + [("route_id", desc if text_search else False)]


def store_order(key: str, direction: str, has_grade: bool = False,
                text_search: bool = False) -> list[Column]:
    return [F.col(c).desc() if d else F.col(c).asc()
            for c, d in store_keys(key, direction, has_grade, text_search)]


def after(keys: list[tuple[str, bool]], cursor: dict, inclusive: bool = False) -> Column:
    """Rows strictly behind the cursor in the mixed-direction order (``inclusive``: also the
    one at it), where nulls come first upwards and last downwards."""
    def behind(name: str, desc: bool, or_same: bool) -> Column:
        c, v = F.col(name), cursor[name]
        if v is None:
            return F.lit(True) if or_same and not desc else c.isNull() if or_same else F.lit(False) if desc else c.isNotNull()
        if desc:
            return ((c <= v) if or_same else (c < v)) | c.isNull()
        return (c >= v) if or_same else (c > v)

    out, same = F.lit(False), F.lit(True)
    for name, desc in keys:
        out = out | (same & behind(name, desc, False))
        same = same & F.col(name).eqNullSafe(F.lit(cursor[name]))
    return behind(*keys[0], True) & (out | same if inclusive else out)  # the leading bound can be pushed to the scan


@dataclass
class Page:
    rows: DataFrame
    cursor: dict | None
    has_more: bool


def page_frame(routes: DataFrame, filters: StoreFilter, key: str = "quality", direction: str = "desc",
               cursor: dict | None = None, page_size: int = fixed.PAGE_SIZE_STORE) -> DataFrame:
    """One page with ``page_pos`` and ``has_more``, lazily; all predicates apply
    before the cut, so pages are full."""
    keys = store_keys(key, direction, filters.has_grade)
    order = [F.col(c).desc() if d else F.col(c).asc() for c, d in keys]
    rows = routes.filter(pushed_predicate(filters) & residual_predicate(filters))
    if cursor:
        rows = rows.filter(after(keys, cursor))
    # at most page_size + 1 rows reach the window
    head = rows.orderBy(*order).limit(page_size + 1)
    return head.withColumn("page_pos", F.row_number().over(Window.orderBy(*order))) \
        .withColumn("has_more", F.count("*").over(Window.partitionBy()) > page_size) \
        .filter(F.col("page_pos") <= page_size)


def fetch_page(routes: DataFrame, filters: StoreFilter, key: str = "quality", direction: str = "desc",
               cursor: dict | None = None, page_size: int = fixed.PAGE_SIZE_STORE) -> Page:
    """One page with its cursor, computed once; one key reaches the driver."""
    rows = written_table(page_frame(routes, filters, key, direction, cursor, page_size), "page")
    names = [c for c, _ in store_keys(key, direction, filters.has_grade)]
    last = rows.orderBy(F.desc("page_pos")).select(*names, "has_more").limit(1).collect()
    if not last:
        return Page(rows, None, False)
    return Page(rows, {n: last[0][n] for n in names}, bool(last[0]["has_more"]))


def pages(routes: DataFrame, filters: StoreFilter, n_pages: int, key: str = "quality",
          direction: str = "desc", page_size: int = fixed.PAGE_SIZE_STORE) -> DataFrame:
    """The first pages appended to each other, with ``page_no``: one job over the rows that are shown."""
    order = store_order(key, direction, filters.has_grade)
    rows = routes.filter(pushed_predicate(filters) & residual_predicate(filters)).orderBy(*order).limit(n_pages * page_size + 1)
    place = F.row_number().over(Window.orderBy(*order)) - 1
    total = F.count("*").over(Window.partitionBy())
    return rows.withColumn("_place", place).withColumn("page_pos", (F.col("_place") % page_size + 1).cast("int")) \
        .withColumn("page_no", F.floor(F.col("_place") / page_size).cast("int") + 1) \
        .withColumn("has_more", total > F.col("page_no") * page_size).filter(F.col("page_no") <= n_pages).drop("_place")


def page_index(routes: DataFrame, filters: StoreFilter, key: str = "quality", direction: str = "desc",
               page_size: int = fixed.PAGE_SIZE_STORE) -> DataFrame:
    """(page_no, first key columns) of every page, by one pass: the key columns are sorted by range once, and rows
    in front of a range are counted, not gathered. To be stored next to the collection it was made from."""
    keys = store_keys(key, direction, filters.has_grade)
    names = [c for c, _ in keys]
    rows = routes.filter(pushed_predicate(filters) & residual_predicate(filters)).select(*names)
    numbered = global_row_number(rows, [F.col(c).desc() if d else F.col(c).asc() for c, d in keys], "_no")
    return numbered.filter((F.col("_no") - 1) % page_size == 0).select(
        (F.floor((F.col("_no") - 1) / page_size) + 1).cast("int").alias("page_no"), *names)


def indexed_page(routes: DataFrame, index: DataFrame, page_no: int, filters: StoreFilter, key: str = "quality",
                 direction: str = "desc", page_size: int = fixed.PAGE_SIZE_STORE) -> DataFrame | None:
    """Page ``page_no`` with ``page_pos``, read from its first key on without the pages before it; None beyond
    the last page. ``index`` is ``page_index`` of the same arguments."""
    keys = store_keys(key, direction, filters.has_grade)
    first = index.filter(F.col("page_no") == page_no).limit(1).collect()
    if not first:
        return None
    order = [F.col(c).desc() if d else F.col(c).asc() for c, d in keys]
    rows = routes.filter(pushed_predicate(filters) & residual_predicate(filters)).filter(after(keys, first[0].asDict(), inclusive=True))
    return rows.orderBy(*order).limit(page_size).withColumn("page_pos", F.row_number().over(Window.orderBy(*order)))
