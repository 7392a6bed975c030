"""Tag enrichment: result parsing, merges, inheritance, requests, summary."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from crestline import fixed, schemas
from crestline.functions import tags as T
from crestline.functions.arrays import empty_tags, or_empty, tags_in
from crestline.functions.text import strip
from crestline.operators.keyed import first_wins, last_wins
from crestline.operators.ordinal import global_row_number
from crestline.session import written_table

AREA_PREFIX = "area_"
_REQUEST_ORDER = ("kind", "area_ord", "route_ord")


# --- results -------------------------------------------------------------------

def _once(value: Column) -> Column:
    """``value`` as a generated column: filters on it are not pushed below, where they would repeat its
    expression for each use."""
    return F.explode(F.array(value))


def parse_results(lines: DataFrame) -> DataFrame:
    """Result lines (batch_ord, line_no, value) -> one row per non-blank line:
    custom_id, kind, entity_id, raw_tags, tags (validated), reject_reason."""
    content = F.get(F.col("r.response.body.choices"), F.lit(0))["message"]["content"]
    raw = F.get_json_object("content", "$.llm_tags")
    is_object = F.from_json("content", "map<string,string>").isNotNull() & strip(
        F.col("content")).endswith("}")
    by_category = F.from_json("raw", "map<string,string>")
    reason = (F.when(F.col("custom_id").isNull(), "bad line")
              .when(F.coalesce("content", F.lit("")) == "", "no content")
              .when(~F.coalesce(is_object, F.lit(False)), "content is not a JSON object")
              .when(~F.coalesce(raw, F.lit("{}")).startswith("{"), "tags are not an object"))
    return (
        lines.filter(strip(F.col("value")) != "")
        .select("batch_ord", "line_no", "value", _once(F.from_json("value", schemas.RESULT)).alias("r"))
        .select("batch_ord", "line_no", "value", F.col("r.custom_id").alias("custom_id"),
                content.alias("content"))
        .select("*", _once(F.struct(F.coalesce(raw, F.lit("{}")).alias("raw"), reason.alias("reject_reason"))).alias("j"))
        .select("batch_ord", "line_no", "value", "custom_id", "content", "j.raw", "j.reject_reason")
        .withColumn("raw_tags", F.when(
            F.col("reject_reason").isNull(),
            F.transform_values(by_category, lambda c, v: or_empty(F.from_json(v, "array<string>")))))
        .withColumn("tags", T.validate(F.col("raw_tags")))
        .withColumn("kind", F.when(F.col("custom_id").startswith(AREA_PREFIX), "area").otherwise("route"))
        .withColumn("entity_id", F.when(
            F.col("kind") == "area", F.expr(f"substring(custom_id, {len(AREA_PREFIX) + 1})"))
            .otherwise(F.col("custom_id")))
        .drop("raw", "content")
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNull())


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNotNull()).select(
        "batch_ord", "line_no", "custom_id", "reject_reason", "value")


def latest_results(parsed: DataFrame) -> DataFrame:
    """The last accepted line per id wins."""
    good = accepted(parsed).select("kind", "entity_id", "batch_ord", "line_no", "tags")
    return last_wins(good, ["kind", "entity_id"], ["batch_ord", "line_no"]).select(
        "kind", "entity_id", "tags")


def rejected_tags(parsed: DataFrame) -> DataFrame:
    """Complement of validation: one row per removed category or tag."""
    pairs = accepted(parsed).select(
        "batch_ord", "line_no", "custom_id", F.explode("raw_tags").alias("category", "tags"))
    known = F.col("category").isin(list(fixed.TAG_VOCABULARY))
    bad = F.filter("tags", lambda t: ~T.allowed(F.col("category"), t))
    unknown = pairs.filter(~known).withColumn("tag", F.lit(None).cast("string"))
    removed = pairs.filter(known).withColumn("tag", F.explode(bad))
    cols = ["batch_ord", "line_no", "custom_id", "category", "tag"]
    return unknown.select(*cols).unionByName(removed.select(*cols))


# --- rules ---------------------------------------------------------------------

def with_manual_tags(routes: DataFrame) -> DataFrame:
    c = F.col
    return routes.withColumn("manual_tags", T.manual_tags(
        c("route_pitches"), c("route_length_meter"), F.coalesce("route_protection_grading", F.lit("")),
        c("route_stars"), c("route_votes"), c("route_grade"), c("route_suggested_ratings"),
        c("route_shared_on")))


# --- merges --------------------------------------------------------------------

def merge_area_snapshot(areas: DataFrame, previous: DataFrame) -> DataFrame:
    """Earlier area tags for categories absent now; the first earlier row per id wins.
    ``previous`` = (area_id, area_ord, area_tags map)."""
    prev = first_wins(previous.select("area_id", "area_ord", "area_tags"), ["area_id"], ["area_ord"]) \
        .select("area_id", F.col("area_tags").alias("_prev"))
    return areas.join(prev, "area_id", "left").withColumn(
        "area_tags", T.keep_previous(F.col("area_tags"), F.coalesce("_prev", empty_tags()))).drop("_prev")


def merge_route_snapshot(routes: DataFrame, previous: DataFrame) -> DataFrame:
    """Same for routes, matched by (area_id, route_id) inside the first earlier
    area of that id. ``previous`` = (area_id, area_ord, route_id, route_ord, route_tags map)."""
    key = ["area_id", "route_id"]
    prev = previous.select(*key, "area_ord", "route_ord", "route_tags")
    first_area = prev.groupBy("area_id").agg(F.min("area_ord").alias("area_ord"))
    prev = first_wins(prev.join(first_area, ["area_id", "area_ord"], "left_semi"), key,
                      ["area_ord", "route_ord"]).select(*key, F.col("route_tags").alias("_prev"))
    return routes.join(prev, key, "left").withColumn(
        "route_tags", T.keep_previous(F.col("route_tags"), F.coalesce("_prev", empty_tags()))).drop("_prev")


def assign_area_tags(areas: DataFrame, results: DataFrame) -> DataFrame:
    """New results replace the area's tags wholesale."""
    new = results.filter(F.col("kind") == "area").select(
        F.col("entity_id").alias("area_id"), F.col("tags").alias("_new"))
    return apply_area_tags(areas.join(new, "area_id", "left"), "_new")


def apply_area_tags(areas: DataFrame, new: str) -> DataFrame:
    """``assign_area_tags`` of rows that carry their results in the column ``new``."""
    return areas.withColumn("area_updated", F.col(new).isNotNull()) \
        .withColumn("area_tags", F.coalesce(new, "area_tags")).drop(new)


def assign_route_tags(routes: DataFrame, results: DataFrame) -> DataFrame:
    """Three outcomes per route: eligible with results, eligible without, not eligible.
    Adds llm_tags, route_tags and route_updated; needs manual_tags."""
    new = results.filter(F.col("kind") == "route").select(
        F.col("entity_id").alias("route_id"), F.col("tags").alias("_new"))
    return apply_route_tags(routes.join(new, "route_id", "left"), "_new")


def apply_route_tags(routes: DataFrame, new: str) -> DataFrame:
    """``assign_route_tags`` of rows that carry their results in the column ``new``."""
    hit = T.eligible(F.col("route_type")) & F.col(new).isNotNull()
    return (
        routes.withColumn("route_updated", hit)
        .withColumn("llm_tags", F.when(hit, F.col(new)))
        .withColumn("route_tags", F.when(
            F.col("route_updated"),
            T.merge_with_results(F.col(new), F.col("manual_tags"), F.col("route_pitches")))
            .otherwise(T.merge_without_results(F.col("route_tags"), F.col("manual_tags"))))
        .drop(new)
    )


def inherit_tags(routes: DataFrame, areas: DataFrame,
                 categories: tuple[str, ...] = (fixed.APPROACH,)) -> DataFrame:
    """Append the area's tags of the given categories to its routes.

    Routes stay on the left, so adaptive execution splits an area that owns a
    large share of them; only areas that have such tags take part.
    """
    for category in categories:
        given = areas.select("area_id", "area_ord", tags_in(F.col("area_tags"), category).alias("_area")) \
            .filter(F.size("_area") > 0)
        given = first_wins(given, ["area_id"], ["area_ord"]).drop("area_ord")
        routes = routes.join(given, "area_id", "left").withColumn(
            "route_tags", T.with_category(F.col("route_tags"), category, or_empty(F.col("_area")))
        ).drop("_area")
    return routes


def guard_stick_clip(routes: DataFrame) -> DataFrame:
    return routes.withColumn("route_tags", T.guard_stick_clip(F.col("route_tags"), F.col("route_type")))


def stick_clip_removals(before: DataFrame) -> DataFrame:
    """Routes that lose the tag, one row each (run evidence)."""
    has_tag = F.array_contains(tags_in(F.col("route_tags"), fixed.SAFETY), "stick_clip")
    sport = F.coalesce("route_type", F.lit("")).contains("Sport")
    return before.filter(has_tag & ~sport).select("route_id", "route_name")


def enrich(areas: DataFrame, routes: DataFrame, results: DataFrame,
           previous_areas: DataFrame | None = None, previous_routes: DataFrame | None = None,
           inherited: tuple[str, ...] = (fixed.APPROACH,)) -> tuple[DataFrame, DataFrame]:
    """Whole enrichment of flat areas and routes (both with a tag map column)."""
    if previous_areas is not None:
        areas = merge_area_snapshot(areas, previous_areas)
    if previous_routes is not None:
        routes = merge_route_snapshot(routes, previous_routes)
    # rules set no area tags: the area's rule map is always empty
    areas = assign_area_tags(areas.withColumn("manual_tags", empty_tags()), results)
    routes = assign_route_tags(with_manual_tags(routes), results)
    return areas, guard_stick_clip(inherit_tags(routes, areas, inherited))


def run_summary(routes: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """One row: totals, eligible share, skipped, updated routes (and areas)."""
    ok = T.eligible(F.col("route_type"))
    updated = F.count_if("route_updated") if "route_updated" in routes.columns else F.lit(0)
    out = routes.agg(F.count("*").alias("routes_total"), F.count_if(ok).alias("routes_eligible"),
                     updated.cast("bigint").alias("routes_updated"))
    if areas is not None:
        both = out.unionByName(areas.agg(F.count_if("area_updated").alias("areas_updated")),
                               allowMissingColumns=True)
        out = both.agg(*[F.sum(c).alias(c) for c in both.columns])
    return out.withColumn("routes_skipped", F.col("routes_total") - F.col("routes_eligible")) \
        .withColumn("eligible_pct", F.try_divide(
            F.col("routes_eligible") * F.lit(100.0), F.col("routes_total")))


# --- requests ------------------------------------------------------------------

def _comments(col: str) -> Column:
    texts = F.transform(F.col(col), lambda c: F.coalesce(c["comment_text"], F.lit("")))
    return F.coalesce(F.array_join(texts, " "), F.lit(""))


def _text(template: str, *parts: Column) -> Column:
    return F.format_string(template, *[F.coalesce(p, F.lit("")) for p in parts])


def _request(custom_id: Column, prompt: str, text: Column, settings: dict) -> Column:
    def message(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    s = {**fixed.REQUEST_SETTINGS, **settings}
    body = F.struct(
        F.lit(s["model"]).alias("model"),
        F.array(message("system", F.lit(prompt)), message("user", text)).alias("messages"),
        *[F.lit(s[k]).alias(k) for k in ("temperature", "max_tokens", "top_p", "n")])
    return F.struct(custom_id.alias("custom_id"), F.lit(fixed.REQUEST_METHOD).alias("method"),
                    F.lit(fixed.REQUEST_PATH).alias("url"), body.alias("body"))


def route_requests(routes: DataFrame, prompt: str = "", **settings) -> DataFrame:
    """Requests of eligible routes: (kind, area_ord, route_ord, request)."""
    c = F.col
    text = _text(fixed.ROUTE_REQUEST_TEXT, c("route_description"), c("route_location"),
                 c("route_type"), c("route_protection"), c("route_tick_comments"),
                 _comments("route_comments"))
    return routes.filter(T.eligible(c("route_type"))).select(
        F.lit(1).alias("kind"), "area_ord", "route_ord",
        _request(c("route_id").cast("string"), prompt, text, settings).alias("request"))


def area_requests(areas: DataFrame, prompt: str = "", **settings) -> DataFrame:
    c = F.col
    text = _text(fixed.AREA_REQUEST_TEXT, c("area_description"), c("area_getting_there"),
                 c("area_access_issues"), c("area_page_views"), c("area_shared_on"),
                 _comments("area_comments"))
    return areas.select(
        F.lit(0).alias("kind"), "area_ord", F.lit(-1).cast("bigint").alias("route_ord"),
        _request(F.concat(F.lit(AREA_PREFIX), c("area_id")), prompt, text, settings).alias("request"))


def all_requests(areas: DataFrame, routes: DataFrame, area_prompt: str = "",
                 route_prompt: str = "", **settings) -> DataFrame:
    """Areas first, then eligible routes in area order (kind, area_ord, route_ord)."""
    return area_requests(areas, area_prompt, **settings).unionByName(
        route_requests(routes, route_prompt, **settings))


def split_decision(requests: DataFrame, input_name: str = "", force_names=("california",),
                   max_requests: int = fixed.MAX_BATCH_REQUESTS,
                   bytes_per_request: int = fixed.BYTES_PER_REQUEST,
                   max_bytes: int = fixed.MAX_BATCH_BYTES) -> DataFrame:
    """One row: number of requests, estimated and real bytes, whether to split."""
    forced = any(n in input_name.lower() for n in force_names)
    n = F.col("n_requests")
    return requests.agg(
        F.count("*").alias("n_requests"),
        F.coalesce(F.sum(F.length(F.to_json("request")) + 1), F.lit(0)).cast("bigint").alias("real_bytes"),
    ).withColumn("estimated_bytes", n * bytes_per_request).withColumn(
        "split", F.lit(forced) | (n > max_requests) | (F.col("estimated_bytes") > max_bytes))


def split_batches(requests: DataFrame) -> DataFrame:
    """First floor(2n/5) requests in order are batch 1, the rest batch 2. Only the
    order columns are shuffled, to find the last key of batch 1; requests stay
    where they are and compare with it."""
    last = numbered(requests.select(*_REQUEST_ORDER)).filter(
        F.col("request_no") == F.floor(F.col("_all") * 2 / 5)).select(*_REQUEST_ORDER).first()
    if last is None:
        return requests.withColumn("batch_no", F.lit(2))
    key = F.struct(*_REQUEST_ORDER)
    cut = F.struct(*[_literal(v).cast(requests.schema[c].dataType).alias(c) for c, v in zip(_REQUEST_ORDER, last)])
    return requests.withColumn("batch_no", F.when(key <= cut, 1).otherwise(2))


def cut_batches(requests: DataFrame, max_requests: int = fixed.MAX_BATCH_REQUESTS,
                max_bytes: int = fixed.MAX_UPLOAD_BYTES, large_alone: bool = False) -> DataFrame:
    """``requests`` with ``batch_no`` (from 1): as many batches as are needed so that none has more than
    ``max_requests`` requests or ``max_bytes`` bytes of its file (one JSON line each), in request order. A
    request that is larger on its own is an error; with ``large_alone`` it is a batch of its own, whole.

    Requests are range partitioned and sorted once; each range is cut by next fit, one request after the
    other, and begins a batch, so a batch never needs two ranges. The batches of earlier ranges (one row a
    range) are then added.
    """
    line_bytes = F.octet_length(F.to_json("request")) + 1
    refused = F.raise_error(F.concat(F.lit(f"a request has more than {max_bytes} bytes: "), F.col("request.custom_id")))
    size = line_bytes if large_alone else F.when(line_bytes <= max_bytes, line_bytes).otherwise(refused)
    rows = requests.withColumn("_bytes", size.cast("bigint"))
    rows = rows.repartitionByRange(*_REQUEST_ORDER).sortWithinPartitions(*_REQUEST_ORDER).withColumn(
        "_range", F.spark_partition_id()).withColumn("_batch", F.lit(0).cast("bigint"))

    def next_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = size = no = 0
        for batch in batches:
            numbers = []
            for b in batch.column("_bytes").to_pylist():
                if n == max_requests or n and size + b > max_bytes:
                    n, size, no = 0, 0, no + 1
                n, size = n + 1, size + b
                numbers.append(no)
            yield batch.set_column(batch.schema.get_field_index("_batch"), "_batch", pa.array(numbers, pa.int64()))

    cut = written_table(rows.mapInArrow(next_fit, rows.schema), "cut-requests")
    # one row for each range: bounded by the number of shuffle partitions
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("_range").agg((F.max("_batch") + 1).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return cut.join(F.broadcast(offsets), "_range").withColumn("batch_no", F.col("_before") + F.col("_batch") + 1).drop(
        "_range", "_batch", "_before", "_bytes")


def _literal(value) -> Column:
    """A value of a row, also a nested one, as a literal."""
    if isinstance(value, Row):
        return F.struct(*[_literal(v).alias(n) for n, v in value.asDict().items()])
    return F.lit(value)


def numbered(requests: DataFrame) -> DataFrame:
    """``requests`` (the order columns and narrow others) with their number in
    order and the number of all."""
    return global_row_number(requests, list(_REQUEST_ORDER), "request_no", total="_all")
