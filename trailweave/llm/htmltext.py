"""Main text of web pages by line-block distribution.

A page becomes a row of lines, one a block element, each with its text, its weight (characters outside links) and
the zone it lies in. Lines in menus, headers, footers, sidebars, notices, adverts, forms and comments are taken out. The
weights of the others are summed over sliding windows of lines; where the sums surge over a threshold a
block of text starts, where they dive to nothing it ends, and the lines between are kept. Where a page marks
articles that hold most of its text, the windows run over their lines, and every article with a surge is kept from its first line to its last.

A page is read once, and what an element closes is found by counters and by stacks of open blocks, so time is linear in its length.
"""
from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SURGE, LINES = 80, 3

# Element names and the words that mark page parts in class, id and role.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr
ul""".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object embed canvas audio video map select textarea button datalist".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ZONES = frozenset("nav header footer aside form menu dialog search".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
PARTS = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners
nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager
header masthead topbar toolbar footer foot colophon copyright bottombar
sidebar sidebars aside rail widget widgets related recommended recommendations
notice notices cookie cookies consent gdpr alert alerts popup modal overlay paywall newsletter subscribe subscription signup
share sharing social comment comments commentlist disqus replies reply respond discussion reactions
form login search skip""".split())
#: Words that may stand beside those in a name that marks a part (site-header, ad_box); any other word makes the name mean something else.
BESIDE = frozenset("""area bar block blocks bottom box button buttons col column container count desktop first global group inner item items
last left link links list lower main middle mobile module outer page panel post primary right row secondary section site slot small sticky
tab title toggle top unit upper user web wrap wrapper""".split())
#: A part so named by class or id, or one of these elements, that holds more than this share of a page's text wraps it and is no part.
WRAPPERS, MOST = frozenset({"form", "header"}), 0.8
#: An element so named may wrap a whole page, so its own words don't make it a part.
WHOLE = frozenset("html body article main".split())

MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
                    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?(?=[\s\"'/]|$)", re.I)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
#: Opening one of these ends an open paragraph; a list item or table cell ends its open sibling.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset({"ul", "ol", "dl", "table"})


def names_part(token: str) -> bool:
    """Whether a class or id names a page part: its words are those of a part and, beside them, of a place or box."""
    words = WORD.findall(token)
    return any(w in PARTS for w in words) and all(w in PARTS or w in BESIDE for w in words)


def part_kind(name: str, attrs: str) -> int:
    """0 no page part, 1 one that a page may also be wrapped in, 2 one in any case: by element, role, hiding, class or id."""
    kind = 0
    if name in ZONES:
        kind = 1 if name in WRAPPERS else 2
    for key, a, b, c in ATTRIBUTE.findall(attrs) if attrs else ():
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "") or key == "role" and value in ROLES:
            return 2
        if key in ("class", "id") and name not in WHOLE and not kind and any(map(names_part, value.split())):
            kind = 1
    return kind


class Line(NamedTuple):
    """A line's text, its characters outside links, the innermost page part and the outermost article it lies in (0 for none)."""

    text: str
    weight: int
    part: int
    article: int


class Page:
    """The lines of a page and its parts: for each part the one around it and whether it may be a wrapper."""

    def __init__(self, page: str) -> None:
        self.lines: list[Line] = []
        self.around, self.wraps = [0], [False]
        self.read(page)

    def read(self, page: str) -> None:
        stack: list[tuple[str, bool, bool]] = []  # name, is a part, is an article
        blocks: list[int] = []  # places in the stack of block elements
        siblings: list[int] = []  # and of list and table elements
        opened: Counter[str] = Counter()
        unclosed: set[str] = set()  # hidden elements that no closing tag follows any more
        part, articles, article = 0, 0, 0
        text: list[str] = []
        linked = 0

        def end_line() -> None:
            nonlocal linked
            if text:
                line = SPACE.sub(" ", html.unescape("".join(text))).strip()
                if line:
                    self.lines.append(Line(line, max(0, len(line) - linked), part, article if articles else 0))
                text.clear()
            linked = 0

        def pop_to(k: int) -> None:
            nonlocal part, articles
            while len(stack) > k:
                name, is_part, main = stack.pop()
                opened[name] -= 1
                if is_part:
                    part = self.around[part]
                articles -= main
            for places in (blocks, siblings):
                while places and places[-1] >= k:
                    places.pop()

        at, size = 0, len(page)
        while at < size:
            found = MARKUP.search(page, at)
            if not found:
                text.append(page[at:])
                break
            piece = page[at:found.start()]
            if piece:
                text.append(piece)
                if opened["a"]:
                    linked += len(piece)
            at = found.end()
            if found["cdata"]:
                text.append(html.escape(found["cdata"], quote=False))
            name = found["name"]
            if not name:
                continue
            name = name.lower()
            attrs = found["attrs"]
            if name in HIDDEN and not found["close"]:
                if name in VOID or attrs.endswith("/") and name in ("svg", "math", "object"):
                    continue
                closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I)
                end = None if name in unclosed else closing.search(page, at)
                if end:
                    at = end.end()
                    continue
                unclosed.add(name)
                if name == "head":
                    body = re.compile(r"<body\b", re.I).search(page, at)
                    at = body.start() if body else at
                elif name in RAW:
                    at = size
                continue
            if name == "br":
                text.append(" ")
                continue
            if name in BLOCKS:
                end_line()
            if found["close"]:
                if opened[name] > 0:
                    k = len(stack) - 1
                    while stack[k][0] != name:
                        k -= 1
                    pop_to(k)
                continue
            if name in BLOCKS and blocks and stack[blocks[-1]][0] == "p":
                pop_to(blocks[-1])
            if name in SIBLINGS:
                ends = SIBLINGS[name]
                k = next((i for i in reversed(siblings) if stack[i][0] in ends or stack[i][0] in LISTS), None)
                if k is not None and stack[k][0] in ends:
                    pop_to(k)
            if name in VOID:
                continue
            kind, main = part_kind(name, attrs), name in MAIN or 'role="main"' in attrs
            if name == "header" and (articles or main):
                kind = 0  # the heading of the article itself
            if name in BLOCKS:
                blocks.append(len(stack))
            if name in LISTS or name in SIBLINGS:
                siblings.append(len(stack))
            if kind:
                self.around.append(part)
                self.wraps.append(kind == 1)
                part = len(self.around) - 1
            if main:
                article += not articles
                articles += 1
            stack.append((name, kind > 0, main))
            opened[name] += 1
        end_line()

    def outside_parts(self) -> list[Line]:
        """The lines in no page part; a part that a page is wrapped in is none."""
        held = [0] * len(self.around)
        for line in self.lines:
            held[line.part] += len(line.text)
        for k in range(len(held) - 1, 0, -1):
            held[self.around[k]] += held[k]
        inside = [False] * len(held)
        for k in range(1, len(held)):
            inside[k] = inside[self.around[k]] or not (self.wraps[k] and held[k] > MOST * held[0])
        return [line for line in self.lines if not inside[line.part]]


def main_text(page: str | None, surge: int = SURGE, width: int = LINES) -> str:
    lines = Page(page or "").outside_parts()
    own = [line for line in lines if line.article]
    marked = bool(own) and 2 * sum(x.weight for x in own) >= sum(x.weight for x in lines)
    lines = own if marked else lines
    weights = [line.weight for line in lines]
    total = [0, *accumulate(weights)]
    last = len(lines)
    sums = [total[min(last, i + width // 2 + 1)] - total[max(0, i - width // 2)] for i in range(last)]
    least = max(1, min(surge, max(sums, default=0)))
    if marked:
        surging = {line.article for line, s in zip(lines, sums) if s >= least} or {line.article for line in lines}
        return "\n\n".join(line.text for line in lines if line.article in surging)
    kept: list[str] = []
    i = done = 0
    while i < last:
        if sums[i] < least:
            i += 1
            continue
        first = i  # surge: back to the first weighted line of the rise
        while first > done and weights[first - 1] > 0 and sums[first - 1] > 0:
            first -= 1
        end = i
        while end + 1 < last and sums[end + 1] > 0:  # dive: the sum falls to nothing
            end += 1
        while weights[end] == 0:  # the fall reaches a little beyond the last text
            end -= 1
        while weights[first] == 0:
            first += 1
        kept += [line.text for line in lines[first:end + 1]]
        i = done = end + 1
    return "\n\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text string, n_chars long), a row per input row.

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
    two newlines in page order. A null or empty page, or one without main text, gives the empty string. Broken
    markup (open elements, a cut tail) is read as far as it goes. Null ids and urls pass; other columns are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col)).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
