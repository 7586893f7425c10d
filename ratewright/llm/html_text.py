"""Main text of web pages by line-block distribution.

A page is stripped of markup into lines, one for each block element's stretch of text. A line's length is the text it
has outside links; it is zero in menus, adverts, forms and the like, which tags, roles and class names give away, and
outside articles and main where a page marks one. What is marked is kept whole. Elsewhere sums of lengths over a sliding
window of lines rise at a surge point, where the window first holds more than the bar, and fall at a dive point; the main
text goes from the first surge to the last dive, with all that lies between. The bar is BAR characters (none, if no window
exceeds it).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import slices

WINDOW = 3
BAR = 80

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW = {"script", "style", "template", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "meter", "output", "progress", "q",
    "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
AWAY = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "noscript", "svg", "math", "object", "canvas", "audio", "video", "head", "fieldset", "datalist", "option"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "tablist", "status"}
#: Parts of class names and ids that mark what is not article text.
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adslot", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "paywall", "sidebar", "menu", "nav", "navbar", "navigation",
    "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "reply", "replies", "respond", "disqus", "share", "sharing", "social", "related", "recommended", "recommendations", "widget",
    "pagination", "pager", "search", "toolbar", "masthead", "topbar", "skip", "disclaimer",
}
#: Parts that mark a wrapper of the page, whatever else its name says.
WRAPPERS = {"with", "has", "no", "content", "main", "page", "wrapper", "container", "layout", "site", "body", "article"}
#: Parts that hold even beside those, unless the name only says whether the page has such a part.
STRONG = {"comment", "comments", "sidebar", "footer", "menu", "cookie", "newsletter", "related", "share"}


def _is_away(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's text is no article text."""
    if tag in AWAY or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id"):
            for word in value.split():
                parts = set(re.split(r"[-_]+|(?<=[a-z])(?=[0-9])", word))
                if parts & NAMES and not parts & WRAPPERS:
                    return True
                if tag != "article" and parts & STRONG and not parts & {"with", "has", "no"}:
                    return True
    return False


class Line:
    __slots__ = ("text", "links", "part", "away")

    def __init__(self, part: int, away: bool):
        self.text: list[str] = []
        self.links, self.part, self.away = 0, part, away


def lines_of(page: str) -> list[Line]:
    """Lines in page order; ``part`` is 0 outside articles, else the outermost article's number (main's is -1)."""
    out = [Line(0, False)]
    open_: list[tuple[str, bool, int, bool]] = []  # tag, away, part, in a link
    articles, at, end = 0, 0, len(page)
    away, part, link = False, 0, False

    def put(raw: str) -> None:
        nonlocal out
        if raw:
            line = out[-1]
            if line.away != away or line.part != part:
                out.append(line := Line(part, away))
            text = html.unescape(raw)
            line.text.append(text)
            if link:
                line.links += len(text.strip())

    while at < end:
        m = MARKUP.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        closing, tag, attributes = m[1] or m[4], (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        if not tag:
            continue
        if tag not in INLINE:
            out.append(Line(part, away))
        if closing:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    del open_[i:]
                    break
        elif tag in RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        elif tag not in VOID:
            if tag in ("article", "main") and away and not any(a and t in AWAY for t, a, _, _ in open_):
                # An advert or notice that was never closed ends where the article begins.
                open_ = [x for x in open_ if not x[1]]
                away, part = False, open_[-1][2] if open_ else 0
            here = away or _is_away(tag, attributes, part != 0)
            if tag == "article" and part <= 0 and not here:
                articles += 1
                part = articles
            elif tag == "main" and part == 0 and not here:
                part = -1
            open_.append((tag, here, part, link or tag == "a"))
        away, part, link = open_[-1][1:] if open_ else (False, 0, False)
    return out


def _stretches(lengths: list[int], bar: int) -> list[tuple[int, int]]:
    """From each surge point to its dive point: bounds of lines whose windows hold more than the bar."""
    out, begin, n = [], None, len(lengths)
    total = sum(lengths[:WINDOW])
    for i in range(n + 1):
        above = i < n and total > bar
        if above and begin is None:
            begin = i
        elif not above and begin is not None:
            out.append((begin, min(i + WINDOW - 1, n)))
            begin = None
        if i < n:
            total += (lengths[i + WINDOW] if i + WINDOW < n else 0) - lengths[i]
    return out


def main_text(page: str | None) -> str:
    """The page's main text: blocks in order, white space made single."""
    lines = [(" ".join("".join(x.text).split()), x) for x in lines_of(page or "")]
    lines = [(t, x) for t, x in lines if t and not x.away]
    if any(x.part for _, x in lines):
        return " ".join(t for t, x in lines if x.part)
    # At the outer ends a line that is half links is a list of links.
    lengths = [0 if 2 * x.links > len(t) else len(t) - x.links for t, x in lines]
    chosen = _stretches(lengths, BAR) or _stretches(lengths, 0)
    kept = [i for a, b in chosen for i in range(a, b) if lengths[i]]
    return " ".join(t for t, _ in lines[kept[0] : kept[-1] + 1]) if kept else ""


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of each page's whole html.

    A null or empty page, or one without article text, has an empty text. Repeated rows come out alike; null keys and urls
    stay; an empty table gives an empty one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("text"))
    out = rows.mapInArrow(run, f"key {kind[key]}, url {kind[url]}, text string, n_chars long")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
