"""Tag map columns: validation, rules, merges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crestline import fixed
from crestline.functions.arrays import has, literal_map, or_empty, tags_in, union_sorted
from crestline.functions.grades import grade_head, head_key
from crestline.functions.text import strip


def allowed(category: Column, tag: Column) -> Column:
    """Tag is in the vocabulary of its category, or a seasonal closure variant."""
    known = has(F.try_element_at(literal_map(fixed.TAG_VOCABULARY), category), tag)
    return known | ((category == fixed.ACCESS) & F.coalesce(
        tag.startswith(fixed.CLOSURE_PREFIX), F.lit(False)))


def validate(tags: Column) -> Column:
    """Drop unknown categories, unknown tags and categories left empty; order
    and duplicates of the rest are kept."""
    kept = F.transform_values(tags, lambda c, ts: F.filter(or_empty(ts), lambda t: allowed(c, t)))
    return F.map_filter(kept, lambda c, ts: F.size(ts) > 0)


def eligible(route_type: Column) -> Column:
    """Trad or sport, any case, anywhere in the type text."""
    t = F.lower(F.coalesce(route_type, F.lit("")))
    return t.contains("trad") | t.contains("sport")


# --- rule tags ---------------------------------------------------------------

def rope_tag(pitches: Column, meters: Column) -> Column:
    single = F.coalesce(pitches, F.lit(1)) == 1
    return F.when(single & (meters <= 30), "rope_60m").when(
        single & (meters <= 35), "rope_70m").when(single & (meters <= 40), "rope_80m")


def pitch_tag(pitches: Column) -> Column:
    p = F.coalesce(pitches, F.lit(1))
    return F.when(p >= 5, "long_multipitch").when(p > 1, "short_multipitch").otherwise("single_pitch")


def runout_tag(protection: Column) -> Column:
    return F.when(F.upper(protection).isin(fixed.RUNOUT_RATINGS), "runout_dangerous")


def vote_tag(votes: Column, grade: Column, ratings: Column) -> Column:
    """Compare the votes for harder, easier and exactly the official grade."""
    # transform steps bind a value once instead of once per use
    heads = F.transform(F.map_entries(ratings), lambda e: F.struct(
        e["key"].alias("grade"), grade_head(e["key"]).alias("head"), e["value"].cast("bigint").alias("n")))
    rated = F.transform(heads, lambda h: F.struct(
        h["grade"].alias("grade"), head_key(h["head"]).alias("key"), h["n"].alias("n")))
    official = strip(F.coalesce(grade, F.lit("")))
    asked = F.transform(F.transform(
        F.array(official), lambda g: F.struct(g.alias("grade"), grade_head(g).alias("head"))),
        lambda o: F.struct(o["grade"].alias("grade"), head_key(o["head"]).alias("key")))
    zero = F.lit(0).cast("bigint")

    def judge(o: Column) -> Column:
        def step(acc: Column, e: Column) -> Column:
            other = e["grade"] != o["grade"]
            return F.struct(
                (acc["higher"] + F.when(other & (e["key"] > o["key"]), e["n"]).otherwise(0)).alias("higher"),
                (acc["lower"] + F.when(other & (e["key"] < o["key"]), e["n"]).otherwise(0)).alias("lower"),
                (acc["same"] + F.when(other, 0).otherwise(e["n"])).alias("same"))

        start = F.struct(zero.alias("higher"), zero.alias("lower"), zero.alias("same"))
        return F.aggregate(rated, start, step, lambda s: F.when(
            (s["higher"] > s["same"]) & (s["higher"] > s["lower"]), "sandbag").when(
            (s["lower"] > s["same"]) & (s["lower"] > s["higher"]), "first_in_grade"))

    enough = F.coalesce(votes, F.lit(0)) >= fixed.MIN_VOTES
    return F.when(enough, F.get(F.transform(asked, judge), F.lit(0)))


def classic_tag(stars: Column, votes: Column) -> Column:
    return F.when((F.coalesce(stars, F.lit(0)) >= fixed.CLASSIC_STARS)
                  & (F.coalesce(votes, F.lit(0)) >= fixed.MIN_VOTES), "classic_route")


def new_route_tag(shared_on: Column) -> Column:
    """Shared after January 2022; needs exactly one comma and a whole year."""
    parts = F.split(strip(F.coalesce(shared_on, F.lit(""))), ",", -1)
    year = strip(F.get(parts, F.lit(1))).try_cast("int")
    months = literal_map(fixed.MONTHS)
    month = F.coalesce(F.try_element_at(months, strip(F.get(parts, F.lit(0)))), F.lit(0))
    return F.when((F.size(parts) == 2) & ((year > 2022) | ((year == 2022) & (month > 1))),
                  "new_routes")


def manual_tags(pitches: Column, meters: Column, protection: Column, stars: Column,
                votes: Column, grade: Column, ratings: Column, shared_on: Column) -> Column:
    """Category map of all rule tags, categories in rule order, empty ones left out."""
    def found(*tags: Column) -> Column:
        return F.filter(F.array(*tags), lambda t: t.isNotNull())

    entries = F.array(
        F.struct(F.lit(fixed.ROPE), found(rope_tag(pitches, meters))),
        F.struct(F.lit(fixed.PITCHES), found(pitch_tag(pitches))),
        F.struct(F.lit(fixed.SAFETY), found(runout_tag(protection), vote_tag(votes, grade, ratings))),
        F.struct(F.lit(fixed.CROWDS), found(classic_tag(stars, votes), new_route_tag(shared_on))),
    )
    return F.map_from_entries(F.filter(entries, lambda e: F.size(e["col2"]) > 0))


# --- merges ------------------------------------------------------------------

def map_categories(tags: Column, mapping: dict[str, str] | None = None) -> Column:
    """Rename categories; identity unless a mapping is given."""
    if not mapping:
        return tags
    lookup = literal_map(mapping)
    return F.transform_keys(tags, lambda c, _: F.coalesce(F.try_element_at(lookup, c), c))


def merge_with_results(text_tags: Column, manual: Column, pitches: Column) -> Column:
    """Union per category; for the rope length of a single pitch a rule value
    replaces the text value, multi-pitch routes keep the text value."""
    single = F.coalesce(pitches, F.lit(1)) == 1
    merged = F.map_zip_with(
        text_tags, manual,
        lambda c, t, m: F.when(c == fixed.ROPE, F.when(single, F.coalesce(m, t)).otherwise(t))
        .when(t.isNull(), m).when(m.isNull(), t).otherwise(union_sorted(t, m)),
    )
    return F.map_filter(merged, lambda c, ts: ts.isNotNull())


def merge_without_results(existing: Column, manual: Column) -> Column:
    """Union per category, no rope length exception."""
    return F.map_zip_with(
        existing, manual,
        lambda c, e, m: F.when(m.isNull(), e).otherwise(union_sorted(e, m)))


def keep_previous(current: Column, previous: Column) -> Column:
    """Earlier tags survive for categories absent now."""
    return F.map_zip_with(current, previous, lambda c, now, old: F.coalesce(now, old))


def with_category(tags: Column, category: str, values: Column) -> Column:
    """Append values to a category, skipping those already there."""
    now = tags_in(tags, category)
    extended = F.create_map(F.lit(category), F.concat(now, F.array_except(values, now)))
    return F.when(
        F.size(values) > 0,
        F.map_zip_with(tags, extended, lambda c, old, new: F.coalesce(new, old)),
    ).otherwise(tags)


def guard_stick_clip(tags: Column, route_type: Column) -> Column:
    """Only types naming ``Sport`` keep the tag; the category stays even if emptied."""
    return F.when(
        F.coalesce(route_type, F.lit("")).contains("Sport"), tags,
    ).otherwise(F.transform_values(
        tags,
        lambda c, ts: F.when(c == fixed.SAFETY, F.array_remove(ts, "stick_clip")).otherwise(ts)))
