"""SQL text shared by the checking SQL of all queries.

``CTES`` restates the table mapping of :mod:`crestline.plans.mapping` in SQL.
"""

from __future__ import annotations

from crestline import fixed
from crestline.plans import mapping as m


def lit(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def pick(values, ix: str) -> str:
    return f"list_extract({lst(values)}, CAST({ix} AS BIGINT) + 1)"


def pos(values, x: str) -> str:
    return f"list_position({lst(values)}, {x}) - 1"


def web(g: str) -> str:
    low = "('5.6','5.7','5.8','5.9')"
    base = f"left({g}, length({g}) - 1)"
    return f"""CASE WHEN {g} = '' THEN ''
      WHEN regexp_matches({g}, '^5\\.\\d+$') THEN CASE WHEN CAST(substr({g}, 3) AS BIGINT) >= 10
           THEN {g} || 'b' ELSE {g} END
      WHEN ends_with({g}, '-') THEN CASE WHEN {base} IN {low} THEN {base} ELSE {base} || 'a' END
      WHEN ends_with({g}, '+') THEN CASE WHEN {base} IN {low} THEN {base} ELSE {base} || 'd' END
      WHEN contains({g}, '/') THEN split_part({g}, '/', 1) ELSE {g} END"""


def web_rank(x: str) -> str:
    return f"CAST(coalesce({pos(fixed.WEB_GRADES, x)}, -1) AS INTEGER)"


def sub(g: str) -> str:
    s = f"lower(trim({g}))"
    letter = (f"CASE WHEN contains({s}, 'a') THEN 'a' WHEN contains({s}, 'b') THEN 'b' "
              f"WHEN contains({s}, 'c') THEN 'c' WHEN contains({s}, 'd') THEN 'd' ELSE 'a' END")
    whens = [f"WHEN contains({s}, '5.{n}') THEN '5.{n}' || {letter}" for n in range(10, 16)]
    whens += [f"WHEN contains({s}, '5.{n}') THEN '5.{n}'" for n in range(10)]
    return f"CASE WHEN {s} = '' THEN '5.0' {' '.join(whens)} ELSE '5.0' END"


def sub_rank(x: str) -> str:
    scale = lst(fixed.FLATTEN_GRADES)
    return (f"CAST(coalesce(list_position({scale}, {x}) - 1, list_position(list_transform({scale}, "
            f"lambda e: starts_with(e, {x})), true) - 1, 0) AS INTEGER)")


FORM = "^5\\.(\\d+)([a-dA-D])?([/+\\-])?([a-dA-D])?$"


def migrate(g: str) -> tuple[str, str]:
    """(normalized, index) SQL."""
    t = f"trim(split_part({g}, ' ', 1))"
    num, a, mod, b = (f"regexp_extract({t}, '{FORM}', {i})" for i in (1, 2, 3, 4))
    base = f"('5.' || {num} || lower({a}))"
    forms = [t, f"CASE WHEN {num} <> '' THEN {base} END",
             f"CASE WHEN {num} <> '' AND {mod} IN ('+', '-') THEN {base} || {mod} END",
             f"CASE WHEN {num} <> '' AND {mod} = '/' AND {b} <> '' THEN {base} || '/' || lower({b}) END"]
    scale = lst(fixed.FLATTEN_GRADES)
    norm = ", ".join(f"CASE WHEN list_contains({scale}, {f}) THEN {f} END" for f in forms)
    ix = ", ".join(f"list_position({scale}, {f}) - 1" for f in forms)
    return f"coalesce({norm}, {t})", f"CAST(coalesce({ix}, 0) AS INTEGER)"


def order_key(g: str) -> str:
    """Number that orders like (minor, modifier, letter)."""
    r = "'^5\\.(\\d+)([+-]?)([a-d]?)'"
    mod, letter = f"regexp_extract({g}, {r}, 2)", f"regexp_extract({g}, {r}, 3)"
    return (f"CASE WHEN regexp_matches({g}, {r}) THEN CAST(regexp_extract({g}, {r}, 1) AS BIGINT) * 10000"
            f" + CASE {mod} WHEN '-' THEN 0 WHEN '+' THEN 200 ELSE 100 END"
            f" + CASE WHEN {letter} = '' THEN 0 ELSE ascii({letter}) - 96 END ELSE 99999999 END")


ELIGIBLE = "(contains(lower(route_type), 'trad') OR contains(lower(route_type), 'sport'))"
_norm, _ix = migrate("route_grade")
_areas = "'https://crags.example.org/area/'"

CTES = f"""
n AS (SELECT (SELECT count(*) FROM supplier) AS ns, (SELECT count(*) FROM documents) AS nd,
             (SELECT count(*) FROM pages) AS np),
areas AS (
  SELECT 'a' || s_suppkey AS area_id, s_suppkey AS area_ord, {_areas} || 'a' || s_suppkey AS area_url,
    s_name AS area_name, r_name, n_name, 'Crag ' || s_name || ' in ' || r_name AS area_description,
    'Road ' || s_suppkey AS area_getting_there, CAST(s_suppkey * 37 + 5 AS VARCHAR) AS area_page_views,
    'All Locations / ' || r_name || ' / ' || n_name || ' / ' || s_name AS web_path,
    'All Locations/' || r_name || '/' || n_name || '/' || s_name AS store_path,
    ['All Locations', r_name, n_name, s_name] AS names,
    {pick(m.APPROACH_PICK, "s_suppkey % 5")} AS approach, s_suppkey
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
tree_areas AS (
  SELECT area_id, area_ord, area_name, names FROM areas
  UNION ALL SELECT 'n' || n_nationkey, n_nationkey + ns, n_name, ['All Locations', r_name, n_name]
    FROM nation LEFT JOIN region ON n_regionkey = r_regionkey, n
  UNION ALL SELECT 'r' || r_regionkey, r_regionkey + ns + 25, r_name, ['All Locations', r_name] FROM region, n),
area_docs AS (
  SELECT *, lower(concat_ws(' ', area_name, area_description, approach,
    '{fixed.APPROACH}:' || approach)) AS searchable_text FROM areas),
routes AS (
  SELECT p_partkey AS k, p_partkey AS route_ord, p_partkey % ns AS area_ord, CAST(p_partkey AS VARCHAR) AS route_id,
    p_name || ' ' || p_partkey || CASE WHEN p_partkey % 17 = 0 THEN ', The' ELSE '' END AS route_name,
    'https://crags.example.org/route/' || p_partkey || '/' || replace(p_name, ' ', '-') AS route_url,
    CAST(p_size AS VARCHAR) AS route_lr, (p_partkey * 7 + p_size) % 24 AS grade_ix,
    {pick(m.GRADE_PICK, "(p_partkey * 7 + p_size) % 24")} AS route_grade,
    {pick(m.PROTECTION_PICK, "p_size % 5")} AS route_protection_grading,
    {pick(m.TYPE_PICK, "p_partkey % 8")} AS route_type,
    CAST(1 + (p_size % 7) * (p_partkey % 2) AS INTEGER) AS route_pitches,
    CASE WHEN p_partkey % 9 <> 0 THEN CAST((12 + p_size % 35) * 3 AS INTEGER) END AS route_length_ft,
    CASE WHEN p_partkey % 9 <> 0 THEN CAST(12 + p_size % 35 AS INTEGER) END AS route_length_meter,
    p_brand AS route_fa, 'Sector ' || p_type AS route_location, 'bolts' AS route_protection,
    CASE WHEN p_partkey % 13 = 12 THEN 'N/A' ELSE {pick(list(fixed.MONTHS), "p_partkey % 13")}
      || ', ' || (2018 + p_size % 7) END AS route_shared_on,
    CASE WHEN p_partkey % 97 = 0 THEN 'missing' ELSE 'a' || (p_partkey % ns) END AS area_id
  FROM part, n),
votes AS (
  SELECT l_partkey AS k, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS route_votes,
    CAST(CAST(sum(l_quantity) AS BIGINT) % 41 AS DOUBLE) / 10 AS route_stars
  FROM lineitem GROUP BY l_partkey),
rv AS (
  SELECT routes.*, coalesce(route_votes, 0) AS route_votes, coalesce(route_stars, 0.0) AS route_stars
  FROM routes LEFT JOIN votes USING (k)),
ratings AS (
  SELECT route_id, rating, CAST(count(*) AS BIGINT) AS votes FROM (
    SELECT route_id, {pick(m.GRADE_PICK, "(grade_ix + l_linenumber - 4 + 24) % 24")} AS rating
    FROM lineitem JOIN routes ON l_partkey = k) GROUP BY route_id, rating),
skew AS (
  SELECT r.route_id,
    coalesce(sum(CASE WHEN rating <> trim(route_grade) AND {order_key("rating")} > {order_key("trim(route_grade)")}
        THEN votes END), 0) AS higher,
    coalesce(sum(CASE WHEN rating <> trim(route_grade) AND {order_key("rating")} < {order_key("trim(route_grade)")}
        THEN votes END), 0) AS lower,
    coalesce(sum(CASE WHEN rating = trim(route_grade) THEN votes END), 0) AS same
  FROM routes r LEFT JOIN ratings USING (route_id) GROUP BY r.route_id),
ruled AS (
  SELECT rv.*, higher, lower, same,
    CASE WHEN route_pitches <> 1 THEN NULL WHEN route_length_meter <= 30 THEN 'rope_60m'
      WHEN route_length_meter <= 35 THEN 'rope_70m' WHEN route_length_meter <= 40 THEN 'rope_80m' END AS rope_tag,
    CASE WHEN route_pitches >= 5 THEN 'long_multipitch' WHEN route_pitches > 1 THEN 'short_multipitch'
      ELSE 'single_pitch' END AS pitch_tag,
    CASE WHEN upper(route_protection_grading) IN ('PG13', 'R', 'X') THEN 'runout_dangerous' END AS runout_tag,
    CASE WHEN route_votes >= 5 THEN CASE WHEN higher > same AND higher > lower THEN 'sandbag'
      WHEN lower > same AND lower > higher THEN 'first_in_grade' END END AS vote_tag,
    CASE WHEN route_stars >= 3 AND route_votes >= 5 THEN 'classic_route' END AS classic_tag,
    CASE WHEN route_shared_on <> 'N/A' AND (CAST(right(route_shared_on, 4) AS INTEGER) > 2022
      OR (CAST(right(route_shared_on, 4) AS INTEGER) = 2022 AND left(route_shared_on, 3) <> 'Jan'))
      THEN 'new_routes' END AS new_tag,
    {web("route_grade")} AS web_grade
  FROM rv JOIN skew USING (route_id)),
rule_tags AS (
  SELECT route_id, 'Rope Length' AS category, 1 AS cat_ord, list_filter([rope_tag], lambda x: x IS NOT NULL) AS tags FROM ruled
  UNION ALL SELECT route_id, '{fixed.PITCHES}', 2, [pitch_tag] FROM ruled
  UNION ALL SELECT route_id, '{fixed.SAFETY}', 3, list_filter([runout_tag, vote_tag], lambda x: x IS NOT NULL) FROM ruled
  UNION ALL SELECT route_id, '{fixed.CROWDS}', 4, list_filter([classic_tag, new_tag], lambda x: x IS NOT NULL) FROM ruled),
manual AS (SELECT * FROM rule_tags WHERE len(tags) > 0),
flat AS (
  SELECT route_id, coalesce(list_distinct_ordered, []) AS tags FROM (
    SELECT r.route_id, flatten(list(list_concat(m.tags, list_transform(m.tags, lambda t: m.category || ':' || t))
      ORDER BY m.cat_ord) FILTER (WHERE m.route_id IS NOT NULL)) AS list_distinct_ordered
    FROM routes r LEFT JOIN manual m USING (route_id) GROUP BY r.route_id)),
listing AS (
  SELECT ruled.*, {web_rank("web_grade")} AS web_ix,
    coalesce(a.web_path, '') AS area_path, coalesce(a.area_name, '') AS area_name
  FROM ruled LEFT JOIN (SELECT area_id, area_name, web_path FROM areas) a USING (area_id)),
docs AS (
  SELECT l.*, {_norm} AS normalized_grade, {_ix} AS grade_numeric,
    (route_stars * route_votes + 12.5) / (route_votes + 5.0) AS quality_score,
    list_filter(list_transform(string_split(route_type, ','), lambda t: trim(t)), lambda t: t <> ''
      AND NOT list_contains({lst(fixed.EXCLUDED_TYPES)}, t)) AS types,
    flat.tags, replace(area_path, ' / ', '/') AS area_hierarchy_path,
    d.text AS route_description
  FROM listing l JOIN flat USING (route_id), n LEFT JOIN documents d ON d.doc_id = k % nd
  WHERE NOT (contains(route_type, 'Aid') OR contains(route_type, 'Boulder') OR contains(route_type, 'Ice')
    OR contains(route_type, 'Mixed') OR contains(route_type, 'Snow'))),
texts AS (
  SELECT docs.*, list_contains(types, 'Trad') AS is_trad, list_contains(types, 'Sport') AS is_sport,
    route_pitches > 1 AS is_multipitch,
    lower(concat_ws(' ', nullif(route_name, ''), nullif(route_grade, ''), nullif(area_name, ''),
      nullif(route_description, ''), nullif(route_location, ''), nullif(route_fa, ''),
      nullif(array_to_string(types, ' '), ''), nullif(array_to_string(tags, ' '), ''))) AS searchable_text
  FROM docs)
"""
# results: one accepted line per id, by construction of the mapping
_result_tags = {
    0: [("Route Style & Angle", ["slab", "vertical"]), ("Rope Length", ["rope_70m"])],
    1: [("Crack Climbing", ["finger"]), ("Crowds & Popularity", ["polished_rock"])],
    2: [("Hold & Movement Type", ["reachy"])],
    3: [("Access & Restrictions", ["seasonal_closure_wet"])],
    4: [],
    5: [("Difficulty & Safety", ["stick_clip", "loose_rock"])],
}
_cases = " UNION ALL ".join(
    f"SELECT {i} AS c, {lit(cat)} AS category, {lst(tags)} AS tags"
    for i, entries in _result_tags.items() for cat, tags in entries)
CTES += f""",
result_ids AS (
  SELECT route_id, k, CASE WHEN k % 15 = 0 THEN (k + 1) % 6 ELSE k % 6 END AS c FROM routes
  WHERE k % 10 <> 3 AND (k % 15 = 0 OR k % 11 <> 0)),
result_tags AS (SELECT route_id, category, tags FROM result_ids JOIN ({_cases}) USING (c)),
area_result_tags AS (
  SELECT area_id, '{fixed.APPROACH}' AS category, [approach] AS tags FROM areas
    WHERE s_suppkey % 4 <> 1 AND approach IS NOT NULL
  UNION ALL SELECT area_id, 'Weather & Conditions', ['sun_am'] FROM areas WHERE s_suppkey % 4 <> 1),
previous AS (
  SELECT route_id, category, [tag] AS tags FROM routes, (VALUES ('Crack Climbing', 'chimney'),
    ('Crowds & Popularity', 'low_crowds')) v(category, tag) WHERE k % 5 = 0),
assigned AS (
  SELECT r.route_id, coalesce(t.category, mt.category) AS category,
    CASE WHEN coalesce(t.category, mt.category) = 'Rope Length' THEN
        CASE WHEN route_pitches = 1 THEN coalesce(mt.tags, t.tags) ELSE t.tags END
      WHEN t.tags IS NULL THEN mt.tags WHEN mt.tags IS NULL THEN t.tags
      ELSE list_sort(list_distinct(list_concat(t.tags, mt.tags))) END AS tags
  FROM (SELECT route_id, category FROM result_tags UNION SELECT route_id, category FROM manual) c
  JOIN routes r USING (route_id) JOIN result_ids USING (route_id)
  LEFT JOIN result_tags t ON t.route_id = r.route_id AND t.category = c.category
  LEFT JOIN manual mt ON mt.route_id = r.route_id AND mt.category = c.category
  WHERE {ELIGIBLE}
  UNION ALL
  SELECT r.route_id, c.category,
    CASE WHEN mt.tags IS NULL THEN p.tags ELSE list_sort(list_distinct(list_concat(coalesce(p.tags, []), mt.tags))) END
  FROM (SELECT route_id, category FROM previous UNION SELECT route_id, category FROM manual) c
  JOIN routes r USING (route_id)
  LEFT JOIN previous p ON p.route_id = r.route_id AND p.category = c.category
  LEFT JOIN manual mt ON mt.route_id = r.route_id AND mt.category = c.category
  WHERE NOT ({ELIGIBLE} AND r.route_id IN (SELECT route_id FROM result_ids))),
enriched AS (
  SELECT a.route_id, a.category,
    CASE WHEN a.category = '{fixed.SAFETY}' AND NOT contains(route_type, 'Sport')
      THEN list_filter(a.tags, lambda t: t <> 'stick_clip') ELSE a.tags END AS tags
  FROM assigned a JOIN routes USING (route_id) WHERE a.tags IS NOT NULL
  UNION ALL
  SELECT route_id, t.category, t.tags FROM routes JOIN area_result_tags t USING (area_id)
  WHERE t.category = '{fixed.APPROACH}'),
pf AS (
  SELECT url, event_type AS data_type, ts AS fetched_at, event_id AS fetch_id
  FROM events, n JOIN pages ON page_id = event_id % np)
"""


def full(body: str) -> str:
    """Body below the shared CTEs; its own leading WITH continues their list."""
    body = body.strip()
    more = f", {body[5:]}" if body.startswith("WITH ") else body
    return f"WITH RECURSIVE {CTES}{more}"
