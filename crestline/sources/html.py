"""Page table -> elements of each page.

Balanced nesting cannot be matched with regular expressions, so one small
Arrow-batched pass lists the elements of a page in document order. Everything
that gives them a meaning is a Spark expression over that array.
"""

from __future__ import annotations

import gc
import html as _html
import re
import sys
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# the page pass travels with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ELEMENT = ("struct<tag:string,start:int,end:int,id:string,cls:string,href:string,target:string,"
           "lr:string,table:int,row:int,nth:int,box:int,box_nth:int,raw:string,user:string,texts:array<string>,own:array<string>>")
ELEMENTS = f"array<{ELEMENT}>"

# possessive repeats: a page with stray quotes must not cause backtracking
_TOKEN = re.compile(
    r"<!--.*?-->|<(script|style)\b.*?</\1\s*+>|"
    r"<(/?)([a-zA-Z][\w-]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>", re.S | re.I)
_ATTR = re.compile(r"([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_KEPT = {"h1", "h2", "h3", "a", "table", "tr", "td"}
_KEPT_IF_NAMED = {"div", "span"}  # only with an id or a class
_RAW = {"h1", "h2", "a"}  # these also keep their unstripped text
_IMPLIED_END = {"td": {"td"}, "tr": {"td", "tr"}}  # an open cell or row ends at the next one
_COMMENT_TABLE = "main-comment"
_VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed"}


_NONE: dict[str, str] = {}


def _parsed_attributes(attrs: str) -> dict[str, str]:
    a = {k.lower(): x or y or z for k, x, y, z in _ATTR.findall(attrs)}
    return {k: _html.unescape(v) if "&" in v else v for k, v in a.items()}


_seen_attributes: dict[str, dict[str, str]] = {}


def _attributes(attrs: str) -> dict[str, str]:
    """Attributes of a tag. Pages of a site repeat most of them, so a bounded number of short ones is kept."""
    a = _seen_attributes.get(attrs)
    if a is None:
        a = _parsed_attributes(attrs)
        if len(attrs) <= 100:
            if len(_seen_attributes) >= 4096:
                _seen_attributes.clear()
            _seen_attributes[attrs] = a
    return a


def page_elements(page: str, tags: tuple[str, ...] | None = None) -> list[dict]:
    """Kept elements (with ``tags``, those of these names) in document order with their stripped text pieces; ``own``
    holds the pieces directly below a heading. ``table`` and ``row`` are the
    starts of the enclosing table and row, ``nth`` counts equal tags in the row
    (cells, links) or equal tags and classes in the table; ``box`` is the start
    of the innermost enclosing comment table and ``box_nth`` counts equal tags
    and classes in it; links carry the ``data-lr`` of their row, and the box of a person (class ``bio``) the
    text of its first link to a user. With these, lookups stay linear in page size."""
    out: list[dict] = []
    seen: dict[tuple, int] = {}
    stack: list[tuple[str, dict | None]] = []
    tables: list[dict] = []
    boxes: list[dict] = []  # the open comment tables among them
    rows: list[dict] = []
    people: list[dict] = []  # the open boxes of persons
    raw: list[str] = []  # all text pieces as they are
    pieces: list[str] = []  # stripped, non-empty
    owner: list[dict | None] = []  # innermost kept element of each piece, if directly open
    spans: list[tuple[dict, int, int]] = []  # element, its first piece, its first raw piece
    # others also need tables, rows and, for the person of a box, links
    kept = _KEPT if tags is None else _KEPT & {*tags, "table", "tr", *(("a",) if "div" in tags else ())}
    named = _KEPT_IF_NAMED if tags is None else _KEPT_IF_NAMED & {*tags}

    def finish(i: int, end: int) -> None:
        """Close the stack from level ``i``; text ranges end here."""
        for tag, el in stack[i:]:
            if el is not None:
                el["end"] = end
                el["_to"], el["_raw_to"] = len(pieces), len(raw)
                if tag == "table":
                    closed = tables.pop()
                    if boxes and boxes[-1] is closed:
                        boxes.pop()
                elif tag == "tr":
                    rows.pop()
                elif people and people[-1] is el:
                    people.pop()
        del stack[i:]

    at = 0
    for m in _TOKEN.finditer(page):
        start, stop = m.span()
        if start > at:
            piece = page[at:start]
            piece = _html.unescape(piece) if "&" in piece else piece
            raw.append(piece)
            piece = piece.strip()
            if piece:
                pieces.append(piece)
                owner.append(stack[-1][1] if stack else None)
        at = stop
        _, closing, tag, attrs = m.groups()
        if not tag:
            continue
        tag = tag.lower()
        if tag in _VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    finish(i, start)
                    break
            continue
        if tag in _IMPLIED_END:
            while stack and stack[-1][0] in _IMPLIED_END[tag]:
                finish(len(stack) - 1, start)
        el = None
        if tag in kept or (tag in named and attrs):
            a = _attributes(attrs) if attrs else _NONE
            if tag in kept or "id" in a or "class" in a:
                table, row = tables[-1] if tables else None, rows[-1] if rows else None
                el = {"tag": tag, "start": start, "end": len(page), "id": a.get("id"),
                      "cls": a.get("class"), "href": a.get("href"), "target": a.get("target"),
                      "lr": a.get("data-lr"), "table": table and table["start"],
                      "row": row and row["start"]}
                if tag == "a":
                    el["lr"] = row and row["lr"]
                place = (el["row"], tag) if tag in ("a", "td") else (el["table"], tag, el["cls"])
                el["nth"] = seen[place] = seen.get(place, -1) + 1
                el["box"] = boxes[-1]["start"] if boxes else None
                place = ("box", el["box"], tag, el["cls"])
                el["box_nth"] = seen[place] = seen.get(place, -1) + 1
                if tags is None or tag in tags:
                    out.append(el)
                if tags is None or tag in tags or tag == "a":
                    spans.append((el, len(pieces), len(raw)))
                if tag == "table":
                    tables.append(el)
                    if _COMMENT_TABLE in (el["cls"] or "").split():
                        boxes.append(el)
                elif tag == "tr":
                    rows.append(el)
                elif tag == "div" and el["cls"] == "bio":
                    people.append(el)
                elif tag == "a" and "/user/" in (el["href"] or ""):
                    for box in people:
                        box.setdefault("user", el)
        if attrs.endswith("/"):
            if el is not None:
                stack.append((tag, el))
                finish(len(stack) - 1, stop)
        else:
            stack.append((tag, el))
    if at < len(page):
        raw.append(_html.unescape(page[at:]))
        if raw[-1].strip():
            pieces.append(raw[-1].strip())
            owner.append(stack[-1][1] if stack else None)
    finish(0, len(page))
    for el, i, r in spans:
        j, q, tag = el.pop("_to"), el.pop("_raw_to"), el["tag"]
        el["texts"] = pieces[i:j]
        el["raw"] = "".join(raw[r:q]) if tag in _RAW else None
        el["own"] = [p for p, o in zip(pieces[i:j], owner[i:j]) if o is el] if tag == "h2" else []
    for el in out:
        link = el.get("user")
        el["user"] = link and link["raw"]
    return out


PAGES_PER_BATCH = 64  # pages whose elements are held in memory at a time
_FIELDS = [(n, pa.int32() if n in ("start", "end", "table", "row", "nth", "box", "box_nth") else
            pa.list_(pa.string()) if n in ("texts", "own") else pa.string())
           for n in ("tag", "start", "end", "id", "cls", "href", "target", "lr", "table", "row", "nth",
                     "box", "box_nth", "raw", "user", "texts", "own")]
_ARROW = pa.list_(pa.struct(_FIELDS))


def _arrow(pages: list[list[dict] | None]) -> pa.Array:
    """Elements of pages, column by column: a fraction of the time that Arrow takes over a list of dicts."""
    flat = [e for els in pages if els is not None for e in els]
    ends = list(accumulate(0 if els is None else len(els) for els in pages))
    # a page that can't be read has a null offset
    offsets = [None if els is None else end - len(els) for els, end in zip(pages, ends)]
    columns = [pa.array([e[n] for e in flat], t) for n, t in _FIELDS]
    return pa.ListArray.from_arrays(pa.array([*offsets, len(flat)], pa.int32()), pa.StructArray.from_arrays(
        columns, fields=[pa.field(n, t) for n, t in _FIELDS])).cast(_ARROW)


def with_elements(pages: DataFrame, html_col: str = "html", tags: tuple[str, ...] | None = None) -> DataFrame:
    """Replace the HTML text by the array ``els``. A page that cannot be read
    gets null elements and the message in ``error``. With ``tags``, the page is read whole
    but only elements of these names are passed on."""
    keep = [c for c in pages.columns if c != html_col]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in keep]
        + [f"els {ELEMENTS}", "error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # elements hold no cycles; walking them over and over is a quarter of the time
        try:
            yield from read(batches)
        finally:
            gc.enable()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, PAGES_PER_BATCH) for b in batches for i in range(0, b.num_rows, PAGES_PER_BATCH)):
            els, errors = [], []
            for page in batch.column(html_col).to_pylist():
                try:
                    els.append(page_elements(page, tags))
                    errors.append(None)
                except Exception as exc:  # one bad page must not stop the others
                    els.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], _arrow(els), pa.array(errors, pa.string())],
                names=[*keep, "els", "error"])

    return pages.select(*keep, html_col).mapInArrow(run, schema)


# --- selectors -----------------------------------------------------------------

def select(els: Column, cond) -> Column:
    return F.filter(els, cond)


def first(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), lambda v: fn(v)), F.lit(0))


def inside(els: Column, outer: Column, cond) -> Column:
    """Elements strictly below ``outer`` that satisfy ``cond``."""
    return bind(outer, lambda o: F.filter(
        els, lambda e: (e["start"] > o["start"]) & (e["start"] < o["end"]) & cond(e)))


def following(els: Column, anchor: Column, cond) -> Column:
    """First element behind the start of ``anchor`` that satisfies ``cond``."""
    return bind(anchor, lambda a: first(F.filter(els, lambda e: (e["start"] > a["start"]) & cond(e))))


def has_class(e: Column, *classes: str) -> Column:
    """All class names present, in any order."""
    cond = e["cls"].isNotNull()
    for c in classes:  # the text is split only where the name occurs in it
        cond = cond & e["cls"].contains(c) & F.array_contains(F.split(e["cls"], r"\s+"), c)
    return F.coalesce(cond, F.lit(False))


def joined(e: Column, sep: str = "") -> Column:
    """Text pieces joined by ``sep``."""
    return F.array_join(e["texts"], sep)
