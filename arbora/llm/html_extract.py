"""HTML extraction: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The page goes through the standard library's streaming parser. Its events
are gathered into lines, one for each block of the page, with the block's text
length and its count of tags. The text-to-tag ratios, smoothed by a Gaussian
kernel, are split into two clusters (content, rest) by a threshold found with
one-dimensional 2-means. Lines in elements that never hold main text (menus,
headers, footers, forms, adverts, ...) have ratio 0. The content lines vote,
by their text length, for the enclosing region: the article or main element,
else the innermost element that holds nearly all of the content mass. The
contract asks for the whole article, so every line of the region outside
excluded elements is main text, however short: the clusters choose the region
and not single lines.

An element is excluded for its tag or role, or for a class or id that says
nothing else (``sidebar``, ``cookie-notice``, ``ad-box``, but not
``no-sidebar`` or ``page-header-fixed``); a class never excludes an element
that holds an article or main element. All passes are linear in the page.

Defined cases: null and empty html give an empty text; broken markup is
parsed as far as it goes, at any depth; text outside any element counts as a
block of the page; repeated pages give equal rows; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from arbora.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that run on within a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements whose text is never shown or never main text.
SKIP = frozenset("head title script style noscript template iframe object svg canvas nav header footer aside form button select textarea option dialog menu".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Words of a class or id that tell an element outside the main text, and words that may stand beside them.
_SKIP_WORDS = re.compile(r"^(ads?|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|sidebar|nav|navbar|navigation|menu|breadcrumbs?|header|footer|masthead|comments?|commentlist|disqus|respond|reply|replies|cookies?|consent|gdpr|notice|notices|popup|modal|overlay|newsletter|subscribe|subscription|share|sharing|social|related|widget|toolbar|login|signup|form)$", re.I)
_PLAIN_WORDS = frozenset("area bar box block button buttons container content list links item items section wrapper wrap inner outer top bottom left right main site global primary secondary side slot unit group row post posts".split())
REGIONS = frozenset(["article", "main"])
#: Blocks that end an open paragraph.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class _Node:
    """An element. hard: excluded for what it is; soft: for a class or id, unless it holds a region."""

    __slots__ = ("tag", "parent", "hard", "soft", "skip", "last", "region", "number")

    def __init__(self, tag, parent, hard, soft, number):
        self.tag, self.parent, self.hard, self.soft, self.number = tag, parent, hard, soft, number
        self.skip, self.last, self.region = False, number, tag in REGIONS and not hard


def _says_skip(value: str) -> bool:
    """Whether one of the names in a class or id tells of nothing but an element outside the main text."""
    for name in value.split():
        parts = [x for x in re.split(r"[-_]+", name) if x]
        skips = [bool(_SKIP_WORDS.match(x)) for x in parts]
        if any(skips) and all(x or y.lower() in _PLAIN_WORDS for x, y in zip(skips, parts, strict=True)):
            return True
    return False


def _excluded(tag: str, attrs: list) -> tuple[bool, bool]:
    """(hard, soft) of an element."""
    hard = tag in SKIP
    soft = False
    for name, value in attrs:
        if name in ("class", "id"):
            soft = soft or bool(value) and tag not in REGIONS and tag not in ("body", "html") and _says_skip(value)
        elif name == "role":
            hard = hard or bool(value) and value.lower() in SKIP_ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            hard = True
    return hard, soft


_P_STOPS = ("body", "article", "main", "div", "section", "td", "li", "blockquote")


class _Lines(HTMLParser):
    """Lines of a page: (text, tags, element); elements in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [_Node("", None, False, False, 0)]
        self.open = [self.nodes[0]]
        self.places: dict[str, list[int]] = {}  # where the open elements of each tag stand in open
        self.lines: list[tuple[str, int, _Node]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.owner = self.nodes[0]

    def cut(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.owner))
                self.tags = 0
            self.parts = []

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        hard, soft = _excluded(tag, attrs)
        if tag not in INLINE or hard or soft:
            self.cut()
        if tag in _ENDS_P:
            self._close("p", _P_STOPS)
        if tag == "li":
            self._close("li", ("ul", "ol", "menu"))
        if tag not in VOID:
            node = _Node(tag, self.open[-1], hard, soft, len(self.nodes))
            self.nodes.append(node)
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag, stops=()):
        """Close the innermost open element of a tag and what is open in it, unless a stop lies between."""
        places = self.places
        if not places.get(tag):
            return
        at = places[tag][-1]
        if any(places.get(x) and places[x][-1] > at for x in stops):
            return
        if tag not in INLINE or any(x.hard or x.soft for x in self.open[at:]):
            self.cut()
        for node in self.open[at:]:
            places[node.tag].pop()
        del self.open[at:]

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self.cut()
        if tag not in VOID:
            # an inline end tag does not close the block around it
            self._close(tag, _ENDS_P if tag in INLINE else ())

    def handle_data(self, data):
        if not self.parts:
            if data.isspace():
                return
            self.owner = self.open[-1]
        self.parts.append(data)

    def settle(self):
        """Say of each element whether it is excluded, and which elements it holds."""
        for node in reversed(self.nodes[1:]):
            up = node.parent
            up.last = max(up.last, node.last)
            up.region = up.region or node.region
        for node in self.nodes[1:]:
            node.skip = node.parent.skip or node.hard or (node.soft and not node.region)


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """values under a Gaussian kernel of three sigmas a side, renormalised at the ends."""
    r = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - r), min(len(values), i + r + 1)
        w = kernel[lo - i + r : hi - i + r]
        out.append(sum(a * b for a, b in zip(w, values[lo:hi], strict=True)) / sum(w))
    return out


def threshold(values: list[float]) -> float:
    """The boundary of two clusters of values (2-means from the extremes)."""
    low, high = min(values), max(values)
    for _ in range(50):
        cut = (low + high) / 2
        a, b = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not a or not b:
            return cut
        low, high, was = sum(a) / len(a), sum(b) / len(b), (low, high)
        if (low, high) == was:
            break
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """The main text of a page: blocks in page order, joined by one space."""
    if not html:
        return ""
    p = _Lines()
    p.feed(html)
    p.close()
    p.cut()
    p.settle()
    lines = p.lines
    shown = [not owner.skip for _, _, owner in lines]
    if not any(shown):
        return ""
    ratios = [len(text) / max(1, tags) if ok else 0.0 for (text, tags, _), ok in zip(lines, shown, strict=True)]
    smooth = smoothed(ratios)
    limit = threshold(smooth)
    content = [i for i, v in enumerate(smooth) if shown[i] and v >= limit] or [i for i, ok in enumerate(shown) if ok]
    region = _region(p.nodes, [(lines[i][2], len(lines[i][0])) for i in content])
    return " ".join(text for (text, _, owner), ok in zip(lines, shown, strict=True) if ok and region.number <= owner.number <= region.last)


def _region(nodes: list[_Node], content: list[tuple[_Node, int]], share: float = 0.8) -> _Node:
    """The article or main element with the most content; else the innermost element with `share` of it."""
    mass = [0] * len(nodes)
    for node, n in content:
        mass[node.number] += n
    for node in reversed(nodes[1:]):
        mass[node.parent.number] += mass[node.number]
    total = mass[0]
    named = [x for x in nodes if x.tag in REGIONS and 2 * mass[x.number] >= total]
    if named:
        return max(named, key=lambda x: (x.tag == "article", mass[x.number], x.number))
    # those that hold so much lie within each other: the last one is the innermost
    best = max((x for x in nodes if mass[x.number] >= share * total), key=lambda x: x.number)
    # a single paragraph or heading is not a region: its container is
    while best.parent is not None and best.tag not in ("div", "section", "td", "body", "html", ""):
        best = best.parent
    return best


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    rows = pages.select(id_col, url_col, html_col)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(table(spark, sf_dir, "pages"))


SQL: dict[str, str] = {}
