"""Fixed domain values.

Everything in this module is data that results depend on: tag vocabulary,
grade scales, word lists, thresholds, templates.  No logic lives here.
"""

# --- fixed values: tag vocabulary, category -> allowed tags -----------------
TAG_VOCABULARY = {
    "Weather & Conditions": [
        "sun_am", "sun_pm", "tree_filtered_sun_am", "tree_filtered_sun_pm",
        "sunny_all_day", "shady_all_day", "dries_fast", "dry_in_rain",
        "seepage_problem", "windy_exposed",
    ],
    "Access & Restrictions": ["seasonal_closure"],
    "Crowds & Popularity": ["low_crowds", "classic_route", "polished_rock", "new_routes"],
    "Difficulty & Safety": [
        "stick_clip", "loose_rock", "rope_drag_warning", "runout_dangerous",
        "sandbag", "first_in_grade",
    ],
    "Approach & Accessibility": [
        "approach_none", "approach_short", "approach_moderate", "approach_long",
    ],
    "Multi-Pitch, Anchors & Descent": [
        "single_pitch", "short_multipitch", "long_multipitch", "bolted_anchor",
        "walk_off", "tricky_rappel",
    ],
    "Route Style & Angle": [
        "slab", "vertical", "gentle_overhang", "steep_roof", "tower_climbing", "sporty_trad",
    ],
    "Crack Climbing": ["finger", "thin_hand", "wide_hand", "offwidth", "chimney", "layback"],
    "Hold & Movement Type": [
        "reachy", "dynamic_moves", "pumpy_sustained", "technical_moves",
        "powerful_bouldery", "pockets_holes", "small_edges", "slopey_holds",
    ],
    "Rope Length": ["rope_60m", "rope_70m", "rope_80m"],
}
ACCESS = "Access & Restrictions"
CROWDS = "Crowds & Popularity"
SAFETY = "Difficulty & Safety"
APPROACH = "Approach & Accessibility"
PITCHES = "Multi-Pitch, Anchors & Descent"
ROPE = "Rope Length"
CLOSURE_PREFIX = "seasonal_closure_"

# --- fixed values: grade scales, easiest to hardest -------------------------
FLATTEN_GRADES = [
    "5.3", "5.4", "5.5",
    "5.6-", "5.6", "5.6+",
    "5.7-", "5.7", "5.7+",
    "5.8-", "5.8", "5.8+",
    "5.9-", "5.9", "5.9+",
    "5.10-", "5.10a", "5.10a/b", "5.10", "5.10b", "5.10b/c", "5.10c", "5.10c/d", "5.10d", "5.10+",
    "5.11-", "5.11a", "5.11a/b", "5.11", "5.11b", "5.11b/c", "5.11c", "5.11c/d", "5.11d", "5.11+",
    "5.12-", "5.12a", "5.12a/b", "5.12", "5.12b", "5.12b/c", "5.12c", "5.12c/d", "5.12d", "5.12+",
    "5.13-", "5.13a", "5.13a/b", "5.13", "5.13b", "5.13b/c", "5.13c", "5.13c/d", "5.13d", "5.13+",
    "5.14-", "5.14a", "5.14a/b", "5.14", "5.14b", "5.14b/c", "5.14c", "5.14c/d", "5.14d", "5.14+",
    "5.15-", "5.15a", "5.15a/b", "5.15", "5.15b", "5.15b/c", "5.15c", "5.15c/d", "5.15d", "5.15+",
    "5.16-", "5.16a", "5.16a/b", "5.16", "5.16b", "5.16b/c", "5.16c", "5.16c/d", "5.16d", "5.16+",
]
# The web listing ranks nine easier grades below the flatten scale.
WEB_GRADES = ["Easy", "1st", "2nd", "3rd", "4th", "5th", "5.0", "5.1", "5.2"] + FLATTEN_GRADES
# Picker lists: web picker (35 entries) and store picker (31, without 5.16).
WEB_PICKER_GRADES = [
    "5.3", "5.4", "5.5", "5.6", "5.7", "5.8", "5.9",
    "5.10a", "5.10b", "5.10c", "5.10d",
    "5.11a", "5.11b", "5.11c", "5.11d",
    "5.12a", "5.12b", "5.12c", "5.12d",
    "5.13a", "5.13b", "5.13c", "5.13d",
    "5.14a", "5.14b", "5.14c", "5.14d",
    "5.15a", "5.15b", "5.15c", "5.15d",
    "5.16a", "5.16b", "5.16c", "5.16d",
]
STORE_PICKER_GRADES = [g for g in WEB_PICKER_GRADES if not g.startswith("5.16")]

# --- fixed values: route types, months, protection ratings ------------------
EXCLUDED_TYPES = ["Aid", "Boulder", "Ice", "Mixed", "Snow"]
MONTHS = {
    "Jan": 1, "Feb": 2, "Mar": 3, "Apr": 4, "May": 5, "Jun": 6,
    "Jul": 7, "Aug": 8, "Sep": 9, "Oct": 10, "Nov": 11, "Dec": 12,
}
RUNOUT_RATINGS = ["PG13", "R", "X"]
ROOT_NAME = "All Locations"

# --- fixed values: thresholds ------------------------------------------------
PRIOR_VOTES, PRIOR_STARS = 5, 2.5
MIN_VOTES, CLASSIC_STARS = 5, 3
PAGE_SIZE_WEB, PAGE_SIZE_STORE, SCAN_LIMIT_STORE = 100, 20, 100
FRESH_DAYS = 7
MIN_TICK_WORDS = 15
BYTES_PER_REQUEST, MAX_BATCH_BYTES, MAX_BATCH_REQUESTS = 6500, 200_000_000, 25_000
#: Bytes that the external service takes as one file.
MAX_UPLOAD_BYTES = 209_715_200

# --- fixed values: curated facet menu (category, tag, label, always shown) --
FACET_MENU = [
    (CROWDS, "low_crowds", "Less Crowded", False),
    (CROWDS, "classic_route", "Classic Route", False),
    (CROWDS, "new_routes", "New Route (since 2022)", False),
    (SAFETY, "first_in_grade", "Good for Breaking into Grade", True),
    (SAFETY, "exclude_sandbag", "Exclude Sandbag Routes", True),
    (SAFETY, "exclude_runout_dangerous", "Exclude Dangerous Routes", True),
    (PITCHES, "single_pitch", "Single Pitch", True),
    (PITCHES, "short_multipitch", "Short (2-4 pitches)", False),
    (PITCHES, "long_multipitch", "Long (5+ pitches)", False),
    *[("Crack Climbing", t, t.replace("_", " "), False)
      for t in ["finger", "thin_hand", "wide_hand", "offwidth", "chimney"]],
    *[(c, t, t.replace("_", " "), False)
      for c in ["Route Style & Angle", "Hold & Movement Type", "Weather & Conditions"]
      for t in TAG_VOCABULARY[c]],
    *[(ROPE, t, t.replace("rope_", ""), False) for t in TAG_VOCABULARY[ROPE]],
]
EXCLUSION_TAGS = {"exclude_sandbag": "sandbag", "exclude_runout_dangerous": "runout_dangerous"}

# --- fixed values: tag request format ---------------------------------------
ROUTE_REQUEST_TEXT = (
    "\nRoute Description: %s\nRoute Location: %s\nRoute Type: %s"
    "\nRoute Protection: %s\nComments: %s %s\n"
)
AREA_REQUEST_TEXT = (
    "\nArea Description: %s\nGetting There: %s\nAccess Issues: %s"
    "\nPage Views: %s\nArea Share Date: %s\nComments: %s\n"
)
REQUEST_METHOD, REQUEST_PATH = "POST", "/v1/chat/completions"
REQUEST_SETTINGS = {"model": "gpt-4o-mini", "temperature": 0.3, "max_tokens": 500,
                    "top_p": 0.95, "n": 1}
