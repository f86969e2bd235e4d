"""Operator 4, main text of web pages by line-block distribution.

1. *Strip markup.*  One pass over the tags: scripts, styles, comments and the
   like go; every block element (and <br>) ends a line; character references
   are decoded and white space inside a line becomes one space.  A line
   remembers whether it lies in a region that never holds the article
   (navigation, header, footer, sidebar, form, or an element whose class, id
   or role says advert, cookie notice, comments, related links ...), and how
   much of it is link text.
2. *Distribution.*  Lines in such a region are left out.  The weight of the
   others is their text length, outside a named article without link text.
   Weights are summed over sliding windows of ``WINDOW`` lines.
3. *Surge and dive.*  A span starts where the sum first rises above ``SURGE``
   characters and ends where the windows dive to 0; short lines right before
   or after that point, such as a heading or a last one-word paragraph, have
   weight and so keep the sum above 0.  The text of all spans is kept, with
   the linked lines between their first and last line with weight.  If no
   span surges (a very short article), the span with the largest sum is taken.
   Lines of an article pass the distribution too, all of them with weight: a
   span is what lies between the article's first and last line.
   Names are matched as whole class tokens ("sidebar", "site-footer", but not
   "has-sidebar" or "search-page"), on containers alone: a heading, a paragraph
   or an inline element that is called "recommendations" or "navy" is text,
   unless its class is a whole advert name ("ad", "advert", "sponsored").  A form or a layout name ("sidebar") around
   the article does not count if the article holds more text than the lines
   outside of such regions; without an article, the one such region with most
   text is opened if no other line surges.

Defined cases: null and empty pages, and pages without text, give an empty
string.  Unclosed and stray tags do not matter: an end tag closes the nearest
open element of its name and what lies open inside it, a block start tag closes
an open <p>, a new list item, term, cell, row or option the one before it, and
all of them bring back what held outside of the closed element.
Each row is judged alone, so repeated rows and null ids need nothing special.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yearlink.llm import common as C

WINDOW = 3  # lines summed
SURGE = 40  # characters of a window that start a span

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?",
    re.S,
)
_DROPPED = frozenset("script style noscript template svg math iframe object canvas textarea select option button head title".split())
_RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noscript"))
_ASIDE = frozenset("nav header footer aside form dialog menu".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![\w-])(hidden)(?![\w-])")
# names of regions that may be a page's layout, and of those that never hold the article
_LAYOUT = re.compile(r"banner|notice|popup|modal|nav|navbar|navigation|menu|menubar|sidebar|masthead|toolbar|widgets?|search|login|signup|subscribe")
_NEVER = re.compile(
    r"ads?|adverts?|advertisements?|advertising|adbox|sponsors?|sponsored|promos?|promoted|promotions?|cookies?|consent|gdpr|newsletter|breadcrumbs?|footer|comments?|disqus|respond|replies|reply"
    r"|related|recommended|recommendations?|share|sharing|social|pagination|pager"
)
# what else the name of such a region may hold
_WITH = re.compile(
    r"\d+(?:x\d+)?|site|main|primary|secondary|global|top|bottom|box|list|section|links?|posts?|articles?|items?|icons?|slot|unit|block|buttons?"
    r"|bar|text|label|area|inner|content|wrap|wrapper|container|form|stories|thread|title|us|policy|message"
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
# elements that are a piece of text whatever their id or class says, but for these
_TEXT = frozenset(
    "h1 h2 h3 h4 h5 h6 p pre blockquote a abbr b bdi bdo cite code dfn em i kbd mark q s samp small span strong sub sup time u var".split()
)
_ADVERT = re.compile(r"ads?|adverts?|advertisements?|advertising|adbox|sponsored")
# a start tag closes an open element of these names, up to one of the scopes
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_P_SCOPE = frozenset("button td th caption table object".split())
_SPACES = re.compile(r"\s+")


def _attributes(text: str) -> dict[str, str]:
    out = {}
    for m in _ATTR.finditer(text):
        if m[5]:
            out["hidden"] = "hidden"
        else:
            out.setdefault(m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4])
    return out


def _named(names: str) -> int:
    """1 if a class token names a region of the layout, 2 one that never holds the article."""
    found = 0
    for name in names.lower().split():
        parts = [p for p in re.split("[_-]+", name) if p]
        never = [bool(_NEVER.fullmatch(p)) for p in parts]
        known = [a or bool(_LAYOUT.fullmatch(p)) for a, p in zip(never, parts, strict=True)]
        if any(known) and all(k or _WITH.fullmatch(p) for k, p in zip(known, parts, strict=True)):
            found = max(found, 1 + any(never))
    return found


def _outside(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    """Whether an element's content is no article text: 2 if never, 1 if its
    element may yet be a wrapper of the page, 0 if not."""
    if tag in _ASIDE and tag != "form":
        return 0 if tag == "header" and in_article else 2  # an article's own header holds its heading
    form = int(tag == "form")
    if not attrs or tag in ("html", "body", "article", "main"):
        return form
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
        return 2
    if attrs.get("role") in _ROLES:
        return 1 if form else 2
    if tag in _TEXT:
        return 2 if any(_ADVERT.fullmatch(name) for name in attrs.get("class", "").lower().split()) else 0
    return max(form, *(_named(attrs.get(k, "")) for k in ("class", "id")))


class _Lines:
    """Text lines of a page: (text, weight, in_article, level, region).  Level 0
    is in no excluded region, 1 in one that may be a wrapper (``region`` counts
    these), more is out."""

    def __init__(self):
        self.lines: list[tuple[str, int, bool, int, int]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.in_article = False
        self.level = self.region = 0

    def text(self, raw: str, link: bool) -> None:
        s = _html.unescape(raw) if "&" in raw else raw
        self.parts.append(s)
        if link:
            self.linked += len(s.strip())

    def end(self) -> None:
        if self.parts:
            s = _SPACES.sub(" ", "".join(self.parts)).strip()
            if s:
                # a linked line of the article is text
                weight = len(s) if self.in_article else max(len(s) - self.linked, 0)
                self.lines.append((s, weight, self.in_article, self.level, self.region))
            self.parts, self.linked = [], 0


class _Open:
    """Open elements, each with what held outside of it: (tag, level, in the
    article, in a link); and how many of each name are open."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool, bool]] = []
        self.count: dict[str, int] = {}

    def push(self, tag: str, level: int, article: bool, link: bool) -> None:
        self.stack.append((tag, level, article, link))
        self.count[tag] = self.count.get(tag, 0) + 1

    def cut(self, i: int) -> tuple[int, bool, bool]:
        """Close element ``i`` and all inside it; what held outside of it."""
        state = self.stack[i][1:]
        for tag, *_ in self.stack[i:]:
            self.count[tag] -= 1
        del self.stack[i:]
        return state

    def close(self, names, scope=()) -> tuple[int, bool, bool] | None:
        """Close the outermost run of elements called ``names`` above the
        nearest element of ``scope``."""
        if not any(self.count.get(x) for x in names):
            return None
        found = None
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i][0]
            if tag in scope:
                break
            if tag in names:
                found = i
                if not scope:
                    break
        return None if found is None else self.cut(found)


_OUT = 1000  # level of what never is article text


def text_lines(page: str) -> list[tuple[str, int, bool, int, int]]:
    out = _Lines()
    open_ = _Open()
    level, article, link = 0, False, False
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            out.text(page[at:], link)
            break
        if m.start() > at:
            out.text(page[at : m.start()], link)
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            out.end()
        if m[1]:
            level, article, link = open_.close((tag,)) or (level, article, link)
        elif tag in _DROPPED:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            if close is not None:
                at = close.end()
            elif tag in _RAW:
                at = n
        elif tag not in _VOID and not m[0].endswith("/>"):
            attrs = _attributes(m[3]) if m[3] and not m[3].isspace() else {}
            if tag in _BLOCK:
                level, article, link = open_.close(("p",), _P_SCOPE) or (level, article, link)
            if tag in _CLOSES:
                level, article, link = open_.close(*_CLOSES[tag]) or (level, article, link)
            open_.push(tag, level, article, link)
            if tag in ("article", "main") or attrs.get("role") == "main":
                article, level = True, level if level >= _OUT else min(level, 1)
            how = _outside(tag, attrs, article)
            if how:
                if not level:
                    out.region += 1
                level = _OUT if how == 2 or article else min(level + 1, _OUT - 1)
            link = link or tag == "a"
        out.level, out.in_article = level, article
    out.end()
    return out.lines


def _sums(lines: list[tuple]) -> list[int]:
    return [sum(x[1] for x in lines[i : i + WINDOW]) for i in range(len(lines))]


def main_text(page: str | None) -> str:
    """The article of a page: its blocks, one a line."""
    found = text_lines(page or "")
    lines = [x for x in found if not x[3]]
    named, wrapped = [x for x in lines if x[2]], [x for x in found if x[2] and x[3] == 1]
    if not named and sum(x[1] for x in wrapped) > sum(x[1] for x in lines):
        named = wrapped
    if named:
        lines = named
    if not named and max(_sums(lines), default=0) <= SURGE:
        regions: dict[int, list] = {}
        for x in found:
            if x[3] == 1 and not x[2]:
                regions.setdefault(x[4], []).append(x)
        most = max(regions.values(), key=lambda r: sum(x[1] for x in r), default=[])
        if max(_sums(most), default=0) > SURGE:
            lines = most
    weights, sums = [x[1] for x in lines], _sums(lines)
    spans, i = [], 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        j = i
        while j < len(sums) and sums[j]:
            j += 1
        spans.append((i, min(j + WINDOW - 1, len(sums)), max(sums[i:j])))
        i = j
    chosen = [s for s in spans if s[2] > SURGE] or sorted(spans, key=lambda s: -s[2])[:1]
    kept: dict[int, None] = {}
    for a, b, _ in sorted(chosen):
        heavy = [k for k in range(a, b) if weights[k]]
        kept |= dict.fromkeys(range(heavy[0], heavy[-1] + 1))
    return "\n".join(lines[k][0] for k in kept)


def _extract(batches):
    for b in C.slices(batches, "html", rows=512):
        texts = [main_text(p) for p in b.column(2).to_pylist()]
        made = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.record_batch(made, names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""
    C.prepare(pages.sparkSession)
    plain = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    return plain.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
