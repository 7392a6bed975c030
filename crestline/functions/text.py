"""Display and string helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crestline import fixed


def strip(c: Column) -> Column:
    """Trim every kind of leading and trailing white space."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def query_terms(query: str) -> list[str]:
    """Lower-cased, trimmed, white-space separated search terms."""
    return query.lower().split()


def long_enough(query: str | None) -> bool:
    """Searches need two characters after trimming."""
    return bool(query) and len(query.strip()) >= 2


def query_terms_column(query: Column) -> Column:
    """Search terms for a table of queries; too short a query gives none."""
    q = strip(F.lower(query))
    return F.when(F.length(q) >= 2, F.split(q, r"\s+")).otherwise(F.array().cast("array<string>"))


def display_name(name: Column) -> Column:
    """``X, The`` -> ``The X``."""
    return F.when(
        name.endswith(", The"),
        F.concat(F.lit("The "), name.substr(F.lit(1), F.length(name) - 5)),
    ).otherwise(name)


def short_path(path: Column) -> Column:
    """Drop the root segment; cut segments over 15 characters to 12 + dots."""
    parts = F.filter(F.split(path, " / ", -1), lambda s: s != fixed.ROOT_NAME)
    cut = F.transform(
        parts,
        lambda s: F.when(F.length(s) > 15, F.concat(F.substring(s, 1, 12), F.lit("..."))).otherwise(s),
    )
    return F.array_join(cut, " / ")


def short_location(hierarchy: Column) -> Column:
    """Last two hierarchy levels below the root, as structs."""
    kept = F.filter(hierarchy, lambda h: h["area_hierarchy_name"] != fixed.ROOT_NAME)
    return F.slice(kept, F.greatest(F.size(kept) - 1, F.lit(1)), F.lit(2))


def preview(text: Column, size: int = 150) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest
    (so ``o'brien 2nd`` gives ``O'Brien 2Nd``)."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                             F.lower(r.substr(F.lit(2), F.length(r))))),
        "",
    )


def slug_to_title(url: Column) -> Column:
    slug = F.substring_index(F.regexp_replace(url, r"/+$", ""), "/", -1)
    return title_case(F.replace(slug, F.lit("-"), F.lit(" ")))


def slug(url: Column) -> Column:
    return F.substring_index(F.regexp_replace(url, r"/+$", ""), "/", -1)


def stars_display(stars: Column) -> Column:
    """struct(full, half, empty) out of four."""
    full = F.floor(stars).cast("int")
    half = F.when(F.pmod(stars, F.lit(1.0)) >= 0.5, 1).otherwise(0)
    return F.struct(full.alias("full"), half.alias("half"),
                    F.greatest(F.lit(4) - full - half, F.lit(0)).alias("empty"))


def type_badges(is_trad: Column, is_sport: Column, is_multipitch: Column) -> Column:
    badges = F.array(F.when(is_trad, "Trad"), F.when(is_sport, "Sport"),
                     F.when(is_multipitch, "Multipitch"))
    return F.filter(badges, lambda b: b.isNotNull())


def breadcrumb(hierarchy: Column, sep: str = " > ") -> Column:
    names = F.transform(hierarchy, lambda h: h["area_hierarchy_name"])
    return F.array_join(F.filter(names, lambda n: n.isNotNull() & (n != "")), sep)
