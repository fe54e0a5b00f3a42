"""Main text of web pages by line-block distribution.

Markup is stripped into lines: one per block of text, and ``WIDTH`` empty lines wherever a boilerplate element (menu,
header, footer, sidebar, notice, advert, form, comments) was.  A line weighs the characters of its text outside links;
consecutive lines of links alone weigh nothing, as ``WIDTH`` empty lines, once they have ``WIDTH`` links.
The sums over ``WIDTH`` consecutive lines rise from zero where a run of text begins and fall to zero where it ends
(dive); the text between is a section, and it surges if a sum reaches ``SURGE`` or a paragraph or heading is in it.
The main text is every section, whatever its weight, of the outermost article and main elements, or where these hold
less than half of the text that surges, of the smallest element that holds all of it: an advert in mid-article, a title
or a tail outside an inner element costs nothing.  Without an article element, bare text (no paragraph or heading) before
and after the element that holds nearly all of it is cut off where it is light.  Names of classes and ids tell
boilerplate only on containers; inside an article only unmistakable ones, and never on its sections.  A form, a page
header or an element with a mistakable name that holds most of the page's text is a wrapper, not boilerplate: the page
is read again with it as one.

Defined results: null, empty and text-free pages and pages of link lists alone give the empty text; unclosed tags,
attributes, comments and entities are read as browsers do; a page in plain text is one section; very long unbroken
texts are one line; repeated pages give repeated rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window, and empty lines in place of a boilerplate element: a run of text always dives there.
WIDTH = 3
#: Characters outside links in a window that make a section running text without a paragraph or heading in it.
SURGE = 30
#: Bare text of fewer characters at the edges of a page without article elements is cut off.
EDGE = 120
#: Part of the prose that the element beyond whose edges is cut must hold.
HOLDS = 0.9
#: An element taken for boilerplate with more than this multiple of the text left is a wrapper.
WRAPS = 4
#: Part of a line's letters and digits that is outside links; a line with less is a line of links.
PROSE_SHARE = 1 / 3
#: Elements whose content is never text of the page.
UNSEEN = {"script", "style", "template", "noscript", "svg", "math", "iframe", "object", "head", "title", "select", "textarea",
          "button", "canvas", "audio", "video", "map", "datalist", "applet", "noframes"}
#: Elements that are never part of an article.
SIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "alertdialog", "menu", "menubar"}
#: Elements that a class or id may name as boilerplate, outside and inside of an article.
NAMED = {"div", "section", "header", "ul", "ol", "dl", "li", "table", "tr", "td", "center", "details", "figure", "a"}
NAMED_INSIDE = {"div", "ul", "ol", "dl", "table", "center"}
#: Words of a class or id that name a boilerplate element.
SIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|menubar|breadcrumbs?|"
    r"sidebar|side|rail|footer|masthead|topbar|site-?header|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|"
    r"comments?|commentlist|disqus|replies|respond|discussion|share|sharing|social|newsletter|subscribe|subscription|signup|"
    r"login|search|related|recommended|recommendations|widget|pagination|pager|toolbar|skip|paywall|form)(?=$|[\s_-])", re.I)
#: Those of them that name no part of an article either.
SURE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|nav|navbar|navigation|menubar|breadcrumbs?|sidebar|masthead|topbar|"
    r"site-?header|cookies?|consent|gdpr|popup|modal|comments?|commentlist|disqus|share|sharing|newsletter|subscribe|signup|login|"
    r"recommended|recommendations|widget|pagination|pager|toolbar|paywall)(?=$|[\s_-])", re.I)
#: Those of them that never name what wraps a page.
NEVER_WRAPS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|cookies?|consent|gdpr|popup|comments?|commentlist|disqus|replies|respond|footer|"
                         r"newsletter|related|recommended|recommendations|share|sharing|breadcrumbs?)(?=$|[\s_-])", re.I)
#: Words of a class or id that name an article's container; such an element is kept whatever else its name says.
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|content|body)(?=$|[\s_-])", re.I)
MAIN = {"article", "main"}
#: Words that name an article and nothing around it.
OWN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story)(?=$|[\s_-])", re.I)
BLOCK = {"html", "body", "p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "h1", "h2", "h3", "h4", "h5", "h6",
         "ul", "ol", "li", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "blockquote", "pre", "figure",
         "figcaption", "form", "fieldset", "address", "details", "summary", "hr", "br", "center", "dir", "menu", "hgroup", "legend", "dialog"}
CELL = {"td", "th"}
#: Elements that mark running text, however short.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that may be the whole of an article.
CONTAINERS = {"body", "div", "section", "article", "main", "table", "td", "center"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: A start tag of these ends an open element of the same group inside the nearest list, table or block.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "body", "div", "section", "article", "main", "aside", "nav", "form", "header", "footer", "blockquote"}

#: Attributes up to the end of the tag; quotes count only where a value begins.
_REST = r"""(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+"""
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|$))|<(script|style|textarea|title|template|noscript|iframe|noframes)\b" + _REST + r">.*?(?:</\1\s*>|$)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)(" + _REST + r")(?:>|$)|<[!?/][^>]*(?:>|$)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s=>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")


def _attributes(text: str) -> dict[str, str]:
    if not text.strip(" /"):
        return {}
    return {k.lower(): v[1:-1] if v[:1] in ("\"", "'") else v for k, v in reversed(_ATTRIBUTE.findall(text))}


#: Verdicts on an element: text of the page, boilerplate unless it wraps the page, boilerplate.
TEXT, SOFT, HARD = 0, 1, 2


def _verdict(tag: str, attrs: dict[str, str], in_main: bool, in_section: bool) -> int:
    if tag in SIDE:
        return SOFT if tag in ("form", "fieldset") else HARD
    if tag == "header" and not in_main and not in_section:
        return SOFT
    if tag in ("html", "body"):
        return TEXT
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return HARD
    role = attrs.get("role", "").lower()
    if role in ROLES:
        return SOFT if role in ("form", "search", "complementary") else HARD
    if tag not in (NAMED_INSIDE if in_main else NAMED):
        return TEXT
    words = SURE_WORDS if in_main or tag == "section" else SIDE_WORDS
    for name in (attrs.get("class", ""), attrs.get("id", "")):
        name = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name)
        if words.search(name) and not (MAIN_WORDS.search(name) and not re.search(r"comment|advert|share|related|footer|header|nav", name, re.I)):
            return HARD if NEVER_WRAPS.search(name) else SOFT
    return TEXT


class Lines:
    """The lines of a page: text, weight and the innermost container (its number in order of the page, 0: the page)."""

    def __init__(self, page: str, wrappers: frozenset[int] = frozenset()):
        """``wrappers``: places of start tags that are not boilerplate whatever they look like."""
        self.wrappers = wrappers
        self.soft: dict[int, list[int]] = {}  # place of an outermost soft element -> characters outside links, articles in it
        self.text: list[str] = []
        self.weight: list[int] = []
        self.links: list[int] = []  # links of a line of links, 0 in any other
        self.prose: list[bool] = []  # in a paragraph or heading
        self.container: list[int] = []
        self.parent = [0]  # container -> the one around it
        self.core = [False]  # container -> it is or lies in an article, a main element or one named so
        self.outer = [False]  # container -> it is or lies in an article or main element
        self.own = [False]  # container -> it is or lies in an article or an element named as one
        self._parts: list[str] = []
        self._plain: list[str] = []
        self._stack: list[tuple[str, int, int]] = []  # tag, verdict, container
        self._side = self._unseen = self._links = self._linked = self._prose = 0
        self._soft: int | None = None  # the outermost boilerplate element around, if it may be a wrapper
        self._of_header = False
        self._hard = 0
        self._fresh = False
        self._read(page)
        self._end_line()
        self._dive()

    def _here(self) -> int:
        return self._stack[-1][2] if self._stack else 0

    def _end_line(self) -> None:
        if self._parts:
            line = " ".join(html.unescape("".join(self._parts)).split())
            if line:
                plain = " ".join(html.unescape("".join(self._plain)).split())
                of_links = self._linked and sum(map(str.isalnum, plain)) < PROSE_SHARE * sum(map(str.isalnum, line))
                self.text.append(line)
                self.weight.append(0 if of_links else len(plain))
                self.links.append(self._linked if of_links else 0)
                self.prose.append(self._prose > 0)
                self.container.append(self._here())
            self._parts, self._plain, self._linked = [], [], 0

    def _dive(self) -> None:
        """Makes ``WIDTH`` empty lines of every run of link lines outside articles that has as many links."""
        at, end = 0, len(self.text)
        rows: list[tuple] = []
        while at < end:
            to = at
            while to < end and self.links[to] and not self.own[self.container[to]]:
                to += 1
            if sum(self.links[at:to]) >= WIDTH:
                rows += [("", 0, 0, False, -1)] * WIDTH
            else:
                to = max(to, at + 1)
                rows += zip(self.text[at:to], self.weight[at:to], self.links[at:to], self.prose[at:to], self.container[at:to])
            at = to
        self.text, self.weight, self.links, self.prose, self.container = map(list, zip(*rows)) if rows else ([], [], [], [], [])

    def _gap(self) -> None:
        for _ in range(WIDTH):
            self.text.append("")
            self.weight.append(0)
            self.links.append(0)
            self.prose.append(False)
            self.container.append(-1)

    def _say(self, text: str) -> None:
        if self._soft is not None and not (self._hard or self._unseen or self._links):
            self.soft[self._soft][0] += len("".join(text.split()))
        if text and not (self._side or self._unseen):
            self._parts.append(text)
            if not self._links:
                self._plain.append(text)
            elif self._fresh and not text.isspace():
                self._linked += 1
                self._fresh = False

    def _pop(self, to: int) -> None:
        for tag, side, _ in reversed(self._stack[to:]):
            if tag in BLOCK or side:
                self._end_line()
            self._side -= side > 0
            self._hard -= side == HARD
            if not self._side:
                self._soft = None
            self._unseen -= tag in UNSEEN
            self._links -= tag == "a"
            self._prose -= tag in PROSE
        del self._stack[to:]

    def _open(self, tag: str, attrs: dict[str, str], at: int) -> None:
        if tag in BLOCK and tag != "br":
            for i in range(len(self._stack) - 1, -1, -1):  # a block ends an open paragraph
                if self._stack[i][0] == "p":
                    self._pop(i)
                    break
                if self._stack[i][0] in SCOPE:
                    break
        if tag in IMPLIED:
            for i in range(len(self._stack) - 1, -1, -1):
                if self._stack[i][0] in IMPLIED[tag]:
                    self._pop(i)
                    break
                if self._stack[i][0] in SCOPE or tag in CELL and self._stack[i][0] == "tr":
                    break
        if tag in BLOCK:
            self._end_line()
        elif tag in CELL:
            if self._linked >= WIDTH and not "".join(self._plain).strip():
                self._end_line()  # a cell of links beside the article's
            self._say(" ")
        if tag in VOID:
            return
        here = self._here()
        in_section = tag == "header" and any(t == "section" for t, _, _ in self._stack)
        side = TEXT if at in self.wrappers else _verdict(tag, attrs, self.core[here], in_section)
        if side and not self._side:
            self._end_line()
            self._gap()
            if side == SOFT:
                self._soft, self._of_header = at, tag == "header"
                self.soft[at] = [0, 0]
        if self._soft is not None and not self._hard and side != HARD and (tag in MAIN or tag == "h1" and not self._of_header):
            self.soft[self._soft][1] += 1
        if tag in CONTAINERS:
            if tag not in CELL:
                self._end_line()
            main = tag in MAIN or attrs.get("role", "").lower() in ("main", "article")
            named = tag in ("div", "section", "td") and MAIN_WORDS.search(attrs.get("class", "") + " " + attrs.get("id", ""))
            self.parent.append(here)
            self.core.append(self.core[here] or main or bool(named))
            self.outer.append(self.outer[here] or main)
            self.own.append(self.own[here] or tag == "article" or bool(named and OWN_WORDS.search(attrs.get("class", "") + " " + attrs.get("id", ""))))
            here = len(self.parent) - 1
        self._side += side > 0
        self._hard += side == HARD
        self._unseen += tag in UNSEEN
        self._links += tag == "a"
        self._fresh = self._fresh or tag == "a"  # a link that has no text yet
        self._prose += tag in PROSE
        self._stack.append((tag, side, here))

    def _close(self, tag: str) -> None:
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == tag:
                self._pop(i)
                return
            if self._stack[i][0] in SCOPE and tag not in BLOCK:
                return  # a stray inline end tag does not end its surroundings
        if tag == "p":
            self._end_line()

    def _read(self, page: str) -> None:
        at = 0
        for m in _TOKEN.finditer(page):
            self._say(page[at:m.start()])
            at = m.end()
            if m[3] is None:
                continue
            tag = m[3].lower()
            if m[2]:
                self._close(tag)
            elif tag not in UNSEEN or tag not in VOID:
                self._open(tag, _attributes(m[4]), m.start())
                if m[4].endswith("/") and tag in UNSEEN and tag not in VOID:
                    self._close(tag)
        self._say(page[at:])


def sections(weight: list[int], width: int = WIDTH) -> list[tuple[int, int]]:
    """[surge, dive) of every run of lines whose windows of ``width`` lines keep weight."""
    sums = [sum(weight[i:i + width]) for i in range(len(weight))]
    out, surge = [], None
    for i, s in enumerate(sums):
        if s and surge is None:
            surge = i
        elif not s and surge is not None:
            out.append((surge, i))
            surge = None
    if surge is not None:
        out.append((surge, len(sums)))
    return out


def _read_page(page: str) -> Lines:
    """The lines of a page, read again for as long as something that looked like boilerplate turns out to wrap it."""
    wrappers: frozenset[int] = frozenset()
    while True:
        lines = Lines(page, wrappers)
        left = sum(lines.weight)
        in_main = any(lines.outer[c] and w for c, w in zip(lines.container, lines.weight) if c >= 0)
        around = [at for at, (weight, articles) in lines.soft.items() if not in_main and weight and (articles or weight > WRAPS * left)]
        if not around:
            return lines
        # the heaviest alone: whether others wrap something is seen with its text in place
        wrappers |= {max(around, key=lambda at: lines.soft[at][0])}


def _cut_edges(kept: list[int], lines: Lines, holds: list[bool]) -> list[int]:
    """Lines without the light bare text before the first and after the last line of a paragraph, a heading, an article or the
    element that holds nearly all."""
    sure = [k for k, i in enumerate(kept) if lines.prose[i] or lines.outer[lines.container[i]] or holds[lines.container[i]]]
    if not sure:
        return kept
    first, last = sure[0], sure[-1] + 1
    light = lambda part: sum(len(lines.text[i]) for i in part) < EDGE
    return (kept[:first] if not light(kept[:first]) else []) + kept[first:last] + (kept[last:] if not light(kept[last:]) else [])


def main_text(page: str | None) -> str:
    """The blocks of the article, joined by line ends."""
    if not page:
        return ""
    lines = _read_page(page)
    # one or two links alone still stand between their neighbours
    weight = [w or (1 if t else 0) for w, t in zip(lines.weight, lines.text)]
    found = sections(weight)
    if not found:
        return ""
    n = len(lines.parent)
    heavy = [0] * n
    surging = [(a, b) for a, b in found if any(lines.prose[a:b]) or max(sum(weight[i:i + WIDTH]) for i in range(a, b)) >= SURGE]
    for a, b in surging or found:
        for i in range(a, b):
            if lines.text[i]:
                heavy[lines.container[i]] += lines.weight[i]
    outer = [c for c, o in enumerate(lines.outer) if o]
    if 2 * sum(heavy[c] for c in outer) >= sum(heavy) and any(heavy[c] for c in outer):
        return "\n".join(lines.text[i] for a, b in found for i in range(a, b) if lines.text[i] and lines.outer[lines.container[i]])
    for c in range(n - 1, 0, -1):  # a container's text counts for those around it
        heavy[lines.parent[c]] += heavy[c]

    def within(share: float) -> list[bool]:
        """Containers inside the smallest that holds that part of the text; those that do lie in each other."""
        best = max((c for c, w in enumerate(heavy) if w and w >= share * heavy[0]), default=0)
        inside = [c == best for c in range(n)]
        for c in range(best + 1, n):
            inside[c] = inside[lines.parent[c]]
        return inside
    inside, holds = within(1), within(HOLDS)
    kept = [i for a, b in found for i in range(a, b) if lines.text[i] and inside[lines.container[i]]]
    return "\n".join(lines.text[i] for i in _cut_edges(kept, lines, holds))


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            text = [main_text(p) for p in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()),
                                              pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars (code points of the text)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_extractor, "page_id long, url string, text string, n_chars long")
