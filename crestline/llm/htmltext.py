"""Main text of HTML pages by smoothed text-to-tag ratios.

The standard library's parser streams a page's events into lines: a block element starts and ends a
line. A line knows its text, its number of tags and the region it lies in: the outermost article or
main element, else the nearest container. Lines inside menus, headers, footers, asides and hidden elements
hold no text. Elements that are only named like adverts, sidebars, notices or comments, and forms, are kept
with a mark until the page is read. A marked element is content if it holds a landmark (an article or main;
one at least half as long as the longest that lies in no marked element), or if elements of its name hold
ten times the prose (text outside of links) that is known to be outside of them, or all of it; the others'
text is taken out. The logarithm of text to tags per line, on which one very long line weighs little, is
smoothed with a Gaussian; a two-cluster threshold over these values marks the dense lines. Content are all
lines of the articles and mains, unless these hold next to nothing of the dense text; else all lines of the
innermost container around all dense lines.

Defined results: a null or empty page has an empty text; a page without any dense line gives the innermost
container around all text; markup that the parser refuses is read as text. Work and memory per page are
linear in its length, rows are independent.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm.common import query, small_batches, table

SIGMA = 1.0
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page.
UNREAD = frozenset("audio button canvas head iframe input noscript object script select style svg template textarea "
                   "title video".split())
SIDE = frozenset("aside dialog footer menu nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
#: Words of class names and ids that mark what is not the article.
MARKS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs byline comment comments consent "
    "cookie cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promoted promotion recommended related replies reply respond share "
    "sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget widgets".split())
#: Words beside a marker word in one name that make it a property of the layout.
LAYOUT = frozenset("allow allowed closed disabled enabled has hide no open show with without".split())
#: A marked element is content if its prose is at least so long, and so many times that of what is around it.
LEAST, TIMES = 200, 10
REPEATED = frozenset("dd dt li option td th tr".split())
LANDMARKS = frozenset(("article", "main"))
CONTAINERS = frozenset("blockquote body div dl ol section table td th ul".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ODD_DECLARATION = re.compile(r"<!\[(?!(?:temp|cdata|ignore|include|rcdata|if|else|endif)\b)", re.I)


SOFT, HARD = 1, 2


def _marked(value: str) -> bool:
    """Whether a class or id has a name with a marker word; names such as has-sidebar or comments-open
    tell the layout of what they mark."""
    for name in value.split():
        parts = {p.lower() for p in NAME_PARTS.findall(name)}
        if parts & MARKS and not parts & LAYOUT:
            return True
    return False


def _side(tag: str, attrs: list, in_landmark: bool) -> int:
    """HARD: never the article; SOFT: by its name or as a form it is not, unless its text says otherwise."""
    if tag in SIDE or tag == "header" and not in_landmark:
        return HARD
    found = SOFT if tag == "form" else 0
    for name, value in attrs:
        value = value or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
            return HARD
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return HARD
        if name == "role" and value.lower() == "form":
            found = SOFT
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and _marked(value):
            found = SOFT
        if name in ("class", "id") and tag == "article" and any(
                re.search(r"comment|reply", n, re.I) and not LAYOUT & {p.lower() for p in NAME_PARTS.findall(n)}
                for n in value.split()):
            found = SOFT
    return found


class Lines(HTMLParser):
    """Streams a page into lines (text, tags, region) and trees of regions and marked elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: Of each line: its texts as (mark, whether in a link, text), its tags and its region.
        self.lines: list[tuple[list[tuple[int, bool, str]], int, int]] = []
        self.text: list[tuple[int, bool, str]] = []
        self.tags = self.region = self.side = self.unread = self.mark = 0
        self.landmark = self.link = False
        # region -> region around it, whether it is a landmark, and the mark it lies in; 0 is the page
        self.above, self.is_landmark, self.within = [0], [False], [0]
        # marked element -> marked element around it, its name, and the landmark it lies in
        self.outer, self.names, self.scope = [0], [""], [0]
        # open elements that matter: (tag, region, landmark, side, unread, mark) to return to
        self.open: list[tuple[str, int, bool, int, int, int]] = []
        self.count: dict[str, int] = {}

    def _end_line(self) -> None:
        if self.text or self.tags:
            self.lines.append((self.text, self.tags, self.region))
        self.text, self.tags = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body":  # also where the head was never closed
            self.unread = 0
        if tag in BLOCKS:
            self._end_line()
            if self.open and (self.open[-1][0] == "p" or tag in REPEATED and self.open[-1][0] == tag):
                self._leave(self.open[-1][0])  # its end tag is optional
        self.tags += 1
        if tag == "br":
            self.text.append((self.mark, self.link, " "))
        if tag == "a":
            self.link = any(name == "href" for name, _ in attrs)
        side = _side(tag, attrs, self.landmark) if attrs or tag in SIDE or tag in ("header", "form") else 0
        if tag in VOID or not (side or tag in UNREAD or tag in CONTAINERS or tag in LANDMARKS or self.count.get(tag)):
            return
        self.open.append((tag, self.region, self.landmark, self.side, self.unread, self.mark))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.side += side == HARD
        self.unread += tag in UNREAD
        if side == SOFT and not self.side:
            self.outer.append(self.mark)
            self.names.append(" ".join([tag, *(f"{n}={v}" for n, v in attrs if n in ("class", "role"))]))
            self.scope.append(self.region if self.landmark else 0)
            self.mark = len(self.outer) - 1
        if not self.landmark and not self.side and (tag in CONTAINERS or tag in LANDMARKS):
            self.landmark = tag in LANDMARKS and side != SOFT
            self.above.append(self.region)
            self.is_landmark.append(self.landmark)
            self.within.append(self.mark)
            self.region = len(self.above) - 1

    def _leave(self, tag: str) -> None:
        name = None
        while name != tag:
            name, *before = self.open.pop()
            self.count[name] -= 1
        self._end_line()
        self.region, self.landmark, self.side, self.unread, self.mark = before

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        if tag == "a" or tag in BLOCKS:
            self.link = False
        self.tags += 1
        if self.count.get(tag):
            self._leave(tag)

    def handle_data(self, data: str) -> None:
        if not self.side and not self.unread:
            self.text.append((self.mark, self.link, data))

    def close(self) -> None:
        super().close()
        self._end_line()


def parsed(html: str) -> Lines:
    html = ODD_DECLARATION.sub("&lt;![", html)
    try:
        page = Lines()
        page.feed(html)
        page.close()
    except AssertionError:  # a declaration the parser refuses
        page = Lines()
        page.feed(html.replace("<!", "&lt;!"))
        page.close()
    return page


def content_marks(page: Lines) -> list[bool]:
    """Whether each marked element is content after all (see above); 0, the page itself, is."""
    n = len(page.outer)
    own = [0] * n  # prose, that is text outside of links, by the innermost mark around it
    inside: dict[tuple[int, int], int] = {}  # the same by mark and landmark
    landmarks: dict[int, int] = {}  # prose of each landmark
    for texts, _, region in page.lines:
        for mark, link, text in texts:
            size = 0 if link else len("".join(text.split()))
            own[mark] += size
            if page.is_landmark[region]:
                inside[mark, region] = inside.get((mark, region), 0) + size
                landmarks[region] = landmarks.get(region, 0) + size
    held = [0] * n  # the longest landmark of each mark
    for region, size in landmarks.items():
        held[page.within[region]] = max(held[page.within[region]], size)
    free_landmark = held[0]
    whole = own[:]
    for mark in range(n - 1, 0, -1):  # inner ones come after outer ones
        whole[page.outer[mark]] += whole[mark]
        held[page.outer[mark]] = max(held[page.outer[mark]], held[mark])
    alike: dict[tuple[int, int, str], int] = {}  # elements of one name in one place count together
    for mark in range(1, n):
        key = page.outer[mark], page.scope[mark], page.names[mark]
        alike[key] = alike.get(key, 0) + whole[mark]
    around = [0] * n  # prose of the marks around that are content, of the landmark only if it lies in one
    content = [True] * n
    for mark in range(1, n):
        outer, scope = page.outer[mark], page.scope[mark]
        around[mark] = inside.get((outer, scope), 0) if scope else own[outer]
        if page.scope[outer] == scope:
            around[mark] += around[outer]
        content[mark] = content[outer]
        if content[outer] and not (held[mark] and 2 * held[mark] >= free_landmark):
            size, rest = alike[outer, scope, page.names[mark]], around[mark]
            content[mark] = size > 0 and (rest == 0 or size >= LEAST and size >= TIMES * rest)
    return content


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    return np.convolve(np.pad(ratios, reach), kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """Middle between the means of two clusters, from the extremes on until they stay."""
    low, high = float(values.min()), float(values.max())
    for _ in range(32):
        cut = (low + high) / 2
        above = values > cut
        if not above.any() or above.all():
            break
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _texts(page: Lines, content: list[bool]) -> list[tuple[str, int, int]]:
    """(text, tags, region) of each line, without the text of marked elements that are not content."""
    joined = ((" ".join("".join(text for mark, _, text in texts if content[mark]).split()), tags, region)
              for texts, tags, region in page.lines)
    return [line for line in joined if line[0] or line[1]]


def _lowest_common(page: Lines, regions: list[int]) -> int:
    """The innermost region around all ``regions``; a region has a higher number than those around it."""
    seen = set(regions)
    heap = [-r for r in seen]
    heapq.heapify(heap)
    while len(heap) > 1:
        up = page.above[-heapq.heappop(heap)]
        if up not in seen:
            seen.add(up)
            heapq.heappush(heap, -up)
    return -heap[0]


def main_text(html: str | None) -> str:
    """The page's main text: its blocks in order, joined by an empty line."""
    page = parsed(html or "")
    content = content_marks(page)
    lines = _texts(page, content)
    if not any(text for text, *_ in lines):  # nothing but marked elements and links in them
        lines = _texts(page, [True] * len(content))
        if not any(text for text, *_ in lines):
            return ""
    ratios = np.array([len(text) / max(1, tags) for text, tags, _ in lines])
    values = smoothed(np.log1p(ratios))
    dense = (values >= threshold(values)) & (ratios > 0)
    read = outside = 0  # text of landmarks, those in marked elements without weight, and dense text elsewhere
    for (text, _, r), d in zip(lines, dense):
        if page.is_landmark[r]:
            read += len(text) * (1 if page.within[r] else TIMES)
        elif d:
            outside += len(text)
    if read and read >= outside:
        chosen = [text for text, _, r in lines if page.is_landmark[r]]
    else:
        around = _lowest_common(page, [r for (text, _, r), d in zip(lines, dense) if (d if dense.any() else text)])
        inside = [False] * len(page.above)
        for r in range(len(inside)):
            inside[r] = r == around or inside[page.above[r]]
        chosen = [text for text, _, r in lines if inside[r]]
    return "\n\n".join(text for text in chosen if text)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; no shuffle."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], schema=_OUT)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")


@query("op6_main_text")
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
