"""Explicit schemas. Columns whose JSON shape varies are declared as raw text."""

from __future__ import annotations

HIERARCHY = ("array<struct<level:int,area_hierarchy_name:string,"
             "area_hierarchy_url:string>>")
COMMENTS = "array<struct<comment_author:string,comment_text:string,comment_time:string>>"

# route_lr, stars, votes may hold a number or text ("N/A"); *_tags a list or a
# map; route_type a comma text or an array: all read as raw text.
_ROUTE_FIELDS = [
    ("route_id", "string"), ("route_name", "string"), ("route_url", "string"),
    ("route_lr", "string"), ("route_grade", "string"),
    ("route_protection_grading", "string"), ("route_stars", "string"),
    ("route_votes", "string"), ("route_type", "string"), ("route_pitches", "int"),
    ("route_length_ft", "int"), ("route_length_meter", "int"), ("route_fa", "string"),
    ("route_description", "string"), ("route_location", "string"),
    ("route_protection", "string"), ("route_page_views", "string"),
    ("route_shared_on", "string"), ("route_tags", "string"),
    ("route_composite_tags", "array<string>"), ("route_comments", COMMENTS),
    ("route_suggested_ratings", "map<string,int>"), ("route_tick_comments", "string"),
    ("manual_tags", "string"), ("llm_tags", "string"),
]
_AREA_FIELDS = [
    ("area_id", "string"), ("area_url", "string"), ("area_name", "string"),
    ("area_gps", "string"), ("area_description", "string"),
    ("area_getting_there", "string"), ("area_tags", "string"),
    ("area_hierarchy", HIERARCHY), ("area_access_issues", "string"),
    ("area_page_views", "string"), ("area_shared_on", "string"),
    ("area_comments", COMMENTS),
]


def _struct(fields) -> str:
    return "struct<" + ",".join(f"{n}:{t}" for n, t in fields) + ">"


def _ddl(fields) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields)


ROUTE_COLUMNS = [n for n, _ in _ROUTE_FIELDS]
AREA_COLUMNS = [n for n, _ in _AREA_FIELDS]
AREA = _ddl(_AREA_FIELDS)
ROUTE = _ddl(_ROUTE_FIELDS)
NESTED_AREA = _ddl(_AREA_FIELDS + [("routes", f"array<{_struct(_ROUTE_FIELDS)}>")])
FLAT_ROUTE = _ddl(_ROUTE_FIELDS + [("area_id", "string")])
FLAT_AREA_FILE = f"areas array<{_struct(_AREA_FIELDS)}>"

RESULT = ("custom_id string, response struct<body:struct<choices:array<struct<"
          "message:struct<content:string>>>>>")
RESULT_CONTENT = "llm_tags map<string,array<string>>"
LEDGER = "input_file string, status string, added_at timestamp, batch_id string, error string"
CHECKPOINT = "base_url string, processed_urls array<string>, timestamp timestamp"
