"""Four grade semantics, kept apart by name.

``grade_tuple``    comparison of suggested votes
``grade_migrate``  rank stored on flattened routes
``grade_web``      rank used by the in-memory listing
``grade_sub``      rank used for bounds of store queries
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crestline import fixed
from crestline.functions.arrays import literal_map, position, strings
from crestline.functions.text import strip

_TUPLE = r"^5\.\d+[+-]?[a-d]?"
_FORM = r"^5\.\d+[a-d]?[/+\-]?[a-d]?\z"
_FORM_PARTS = [r"^5\.\d+[a-d]?", r"^5\.\d+[a-d]?[+-]", r"^5\.\d+[a-d]?/[a-d]"]


def grade_head(grade: Column) -> Column:
    """Leading ``5.<n><modifier><letter>`` of a grade, ``''`` without one."""
    return F.regexp_extract(F.coalesce(grade, F.lit("")), _TUPLE, 0)


def _parts(head: Column) -> dict[str, Column]:
    return {
        "minor": F.substring(F.translate(head, "+-abcd", ""), 3, 99).try_cast("bigint"),
        "modifier": F.when(head.contains("-"), 0).when(head.contains("+"), 2).otherwise(1).cast("bigint"),
        "letter": F.greatest(F.ascii(F.right(head, F.lit(1))) - F.lit(96), F.lit(0)).cast("bigint"),
    }


def grade_tuple(grade: Column) -> Column:
    """(minor, modifier, letter); unparseable grades are 999 in all three."""
    head = grade_head(grade)
    unknown = F.lit(999).cast("bigint")
    return F.struct(*[F.when(head == "", unknown).otherwise(c).alias(n) for n, c in _parts(head).items()])


def head_key(head: Column) -> Column:
    """One number that orders like the tuple; modifier and letter stay below 100."""
    p = _parts(head)
    return F.when(head == "", F.lit(9_999_999).cast("bigint")).otherwise(
        p["minor"] * 10_000 + p["modifier"] * 100 + p["letter"])


def is_higher(suggested: Column, official: Column) -> Column:
    return head_key(grade_head(suggested)) > head_key(grade_head(official))


def is_lower(suggested: Column, official: Column) -> Column:
    return head_key(grade_head(suggested)) < head_key(grade_head(official))


def grade_migrate(grade: Column) -> Column:
    """struct(normalized, index) against the flatten scale.

    Tried in order: the first word itself, its base grade, base with plus or
    minus, base with a second letter. An exact hit skips the other forms."""
    scale = fixed.FLATTEN_GRADES
    token = strip(F.substring_index(F.coalesce(grade, F.lit("")), " ", 1))
    shaped = F.regexp_extract(F.lower(token), _FORM, 0)  # '' unless the whole word is a grade
    forms = [token] + [F.regexp_extract(shaped, p, 0) for p in _FORM_PARTS]
    index = F.coalesce(*[position(scale, f) for f in forms])
    return F.struct(F.coalesce(F.get(strings(scale), index), token).alias("normalized"),
                    F.coalesce(index, F.lit(0)).alias("index"))


def grade_web(grade: Column) -> Column:
    """Normal form of the listing; unchanged when no rule applies."""
    g = F.coalesce(grade, F.lit(""))
    plain = F.regexp_extract(g, r"^5\.(\d+)\z", 1)
    base = g.substr(F.lit(1), F.length(g) - 1)
    low = base.isin("5.6", "5.7", "5.8", "5.9")
    return (
        F.when(g == "", "")
        .when(plain != "",
              F.when(F.length(F.ltrim(plain, F.lit("0"))) >= 2, F.concat(g, F.lit("b"))).otherwise(g))
        .when(g.endswith("-"), F.when(low, base).otherwise(F.concat(base, F.lit("a"))))
        .when(g.endswith("+"), F.when(low, base).otherwise(F.concat(base, F.lit("d"))))
        .when(g.contains("/"), F.substring_index(g, "/", 1))
        .otherwise(g)
    )


def web_rank(normalized: Column) -> Column:
    """Index in the web scale, -1 when absent."""
    return F.coalesce(position(fixed.WEB_GRADES, normalized), F.lit(-1))


def grade_web_rank(grade: Column) -> Column:
    return web_rank(grade_web(grade))


def grade_sub(grade: Column) -> Column:
    """Loose normal form: substring tests, hardest family first."""
    g = strip(F.lower(F.coalesce(grade, F.lit(""))))
    out = F.when(g == "", "5.0")
    letter = (F.when(g.contains("a"), "a").when(g.contains("b"), "b")
              .when(g.contains("c"), "c").when(g.contains("d"), "d").otherwise("a"))
    for n in range(10, 16):
        out = out.when(g.contains(f"5.{n}"), F.concat(F.lit(f"5.{n}"), letter))
    for n in range(10):
        out = out.when(g.contains(f"5.{n}"), f"5.{n}")
    return out.otherwise("5.0")


def _sub_ranks() -> dict[str, int]:
    """Rank of every value ``grade_sub`` can return: exact entry, else first
    entry with that prefix, else 0."""
    domain = [f"5.{n}" for n in range(10)]
    domain += [f"5.{n}{x}" for n in range(10, 16) for x in "abcd"]
    scale = fixed.FLATTEN_GRADES
    return {
        g: scale.index(g) if g in scale
        else next((i for i, s in enumerate(scale) if s.startswith(g)), 0)
        for g in domain
    }


SUB_RANKS = _sub_ranks()


def grade_sub_rank(grade: Column) -> Column:
    norm = grade_sub(grade)
    return F.coalesce(F.try_element_at(literal_map(SUB_RANKS), norm), F.lit(0))


def is_harder(a: Column, b: Column) -> Column:
    return grade_sub_rank(a) > grade_sub_rank(b)


def in_range(grade: Column, low: Column, high: Column) -> Column:
    return grade_sub_rank(grade).between(grade_sub_rank(low), grade_sub_rank(high))


def couple_range(changed: str, value: str, low: str, high: str) -> tuple[str, str]:
    """Range picker: raising the minimum above the maximum lifts the maximum,
    and the reverse. Unknown grades rank -1."""
    rank = {g: i for i, g in enumerate(fixed.WEB_GRADES)}
    at = rank.get(value, -1)
    if changed == "min":
        return value, high if at <= rank.get(high, -1) else value
    return (low if at >= rank.get(low, -1) else value), value
