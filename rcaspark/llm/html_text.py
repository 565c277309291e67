"""Main text of web pages by line-block distribution.

Markup is stripped and every block element becomes a line. Lengths of lines are summed over a sliding window; the
text surges where a window's sum first reaches a share of the page's own mean line length and dives where the window is empty
again, on every page and inside articles, too. The region with most text is the main one; another is kept if it is
about as dense, stands in the same element, or if both are in articles. Windows end at the bounds of an article or main
element, and the rest of an article that a kept region holds most of is kept with it.

Lines that are mostly links have no length. What markup names otherwise is a hint: text inside menus, headers of the
page, footers, sidebars, adverts, forms, comments of readers and the like is blank, unless it holds half of the page's
text or an article. Inside an article, words of classes count for containers alone, not for paragraphs, headings or
list items; adverts and comments of readers go, and what is named otherwise goes if it is mostly links or thinner than
the article's lines are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Lines per window, and the least sum of a window where text surges, in mean lengths of the page's lines.
WINDOW, SURGE = 5, 0.3
#: Least mean line length of a further region, in that of the main one.
DENSITY = 0.5
#: Markup's hints are not heard where an element holds this share of the page's text; a footer, menu, advert or the like
#: is heard all the same on a page that has an article elsewhere.
HOLDS = 0.5
#: A line whose text is mostly links is blank.
LINK_SHARE = 0.7

# HTML's elements without text of their own, without end tags, and inside a line.
RAW = {"script", "style", "template", "noscript", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var", "wbr", "img", "input",
}
#: Never text of the page, and text of other kinds than the article's.
HIDDEN = {"button", "select", "option", "datalist", "head", "svg", "canvas", "audio", "video", "object", "map"}
BOILERPLATE = {"nav", "footer", "aside", "form", "dialog", "menu", "fieldset", "search"}
#: Boilerplate outside of an article only.
OUTSIDE = {"header", "figcaption", "math"}
ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu",
    "menubar", "toolbar", "status",
}
#: Words of classes and ids: never of an article's text, and those that articles use for parts of theirs, too.
FOREIGN = set(
    "ad ads adv advert adverts advertisement adbox adslot nav navbar navigation menu breadcrumb breadcrumbs cookie "
    "cookies consent gdpr popup modal newsletter subscribe subscription signup login comment comments reply replies "
    "respond disqus pagination pager".split())
#: The ones among them that are heard inside an article whatever the text is like.
ALWAYS = set("ad ads adv advert adverts advertisement adbox adslot comment comments reply replies respond disqus".split())
#: Elements whose text is an article's own where they stand in one, whatever their classes say.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "pre", "blockquote", "figcaption", "caption", "span"}
HINTS = FOREIGN | set(
    "sponsor sponsored promo promotion banner sidebar side rail widget widgets footer header masthead topbar notice "
    "alert overlay share sharing social related recommended recommendations toc skip copyright legal disclaimer "
    "toolbar search".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


def _hint(name: str, attributes: str, parent: _Element) -> str | None:
    """What markup says of an element: it is "hidden", "foreign", or "doubtful" for a word that articles use, too.

    An article's own words are not heard, unless it is inside of something foreign, as readers' comments are.
    """
    if name in HIDDEN:
        return "hidden"
    found = "foreign" if name in BOILERPLATE or (name in OUTSIDE and parent.article is None) else None
    inside = parent.article is not None
    for key, *values in _ATTRIBUTE.findall(attributes) if attributes and name not in ("html", "body") else ():
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return "hidden"
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "hidden"
        words = set(re.split(r"[^a-z0-9]+", value)) if key in ("class", "id") and not (inside and name in PROSE) else set()
        marked = name in ("article", "main") and not parent.foreign
        if (key == "role" and value in ROLES) or ((ALWAYS if inside else FOREIGN) & words and not marked):
            found = "foreign"
        elif HINTS & words and not marked:
            found = found or "doubtful"
    return found


class _Element:
    """An element: what markup says of it, and the text found in it."""

    def __init__(self, name: str, parent: _Element | None, hint: str | None):
        self.name, self.parent, self.hint = name, parent, hint
        self.size, self.linked, self.lines = 0, 0.0, 0
        self.holds_article = self.blank = False
        self.hidden = hint == "hidden" or (parent is not None and parent.hidden)
        self.foreign = hint == "foreign" or (parent is not None and parent.foreign)
        self.article = parent.article if parent else None
        if name in ("article", "main") and hint is None and self.article is None:
            self.article = self
            while parent and not parent.holds_article:
                parent.holds_article, parent = True, parent.parent


def _judge(elements: list[_Element]) -> None:
    """Sums up the text of ``elements``, parents first, and says which are blank."""
    for element in reversed(elements):
        if element.parent:
            element.parent.size += element.size
            element.parent.linked += element.linked
            element.parent.lines += element.lines
    for element in elements:
        element.blank = element.hidden or (element.parent is not None and element.parent.blank)
        heard = element.size < HOLDS * elements[0].size or (element.hint == "foreign" and elements[0].holds_article)
        if element.hint and not element.holds_article and heard:
            doubt, whole = element.hint == "doubtful" and element.article is not None, element.article
            thin = doubt and element.size * whole.lines < DENSITY * whole.size * element.lines
            element.blank |= not doubt or thin or element.linked > LINK_SHARE * element.size


def lines_of(page: str) -> list[tuple[str, bool, _Element]]:
    """(text, is mostly links, last open element) for each block of a page, in order; white space is single blanks.

    An element that was left open ends with the nearest enclosing one that is
    closed. An unclosed tag or comment at the end of a page is dropped.
    """
    lines: list[tuple[str, bool, _Element]] = []
    parts: list[str] = []
    linked = total = 0
    root = _Element("", None, None)
    open_, elements = [root], [root]
    links, at = False, 0

    def flush():
        nonlocal linked, total
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text and not open_[-1].hidden:
            lines.append((text, linked > LINK_SHARE * total, open_[-1]))
            open_[-1].size += len(text)
            open_[-1].lines += 1
            open_[-1].linked += len(text) * linked / total if total else 0
        parts.clear()
        linked = total = 0

    def take(text: str):
        nonlocal linked, total
        parts.append(text)
        total += len(text.strip())
        linked += len(text.strip()) if links else 0

    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            rest = page[at:]
            take(rest[: m.start()] if (m := re.search(r"<[/!?A-Za-z]", rest)) else rest)
            break
        take(page[at : token.start()])
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            flush()
        if name == "a":
            links = not token[1]
        if token[1]:
            if name in INLINE and name != "span":
                continue
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].name == name:
                    if name in INLINE and any(x.hint for x in open_[i:]):  # a span
                        flush()
                    del open_[i:]
                    break
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not token[3].endswith("/") and (name not in INLINE or name == "span"):
            hint = _hint(name, token[3], open_[-1])
            if hint and name in INLINE:
                flush()
            open_.append(_Element(name, open_[-1], hint))
            elements.append(open_[-1])
    flush()
    _judge(elements)
    return lines


def _regions(articles: list[_Element | None], lengths: list[int], window: int, bound: float) -> list[tuple[int, int]]:
    """(first line, line after the last) of each region; blank lines have no length."""
    regions, start = [], None
    ends = [0] * len(lengths)  # where the article, or the lines between two of them, ends
    for i in reversed(range(len(lengths))):
        ends[i] = ends[i + 1] if i + 1 < len(lengths) and articles[i] is articles[i + 1] else i + 1
    for i, end in enumerate(ends):
        total = sum(lengths[i : min(i + window, end)])
        if start is None and total >= bound and lengths[i]:
            start = i  # surge
        elif start is not None and total == 0:
            regions.append((start, i))  # dive: nothing in the whole window
            start = None
        if start is not None and i + 1 == end:
            regions.append((start, end))
            start = None
    return regions


def main_text(page: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    """The page's article as one line; empty for null, empty and wordless pages."""
    found = lines_of(page or "")
    lengths = [0 if linked or e.blank else len(text) for text, linked, e in found]
    filled = [x for x in lengths if x]
    bound = surge * sum(filled) / len(filled) if filled else 1
    articles = [e.article for _, _, e in found]
    regions = _regions(articles, lengths, window, bound)
    if not regions:
        return ""

    def density(region: tuple[int, int]) -> float:
        own = [x for x in lengths[slice(*region)] if x]
        return sum(own) / len(own) if own else 0.0

    main = max(regions, key=lambda r: sum(lengths[slice(*r)]))
    dense, beside = DENSITY * density(main), {e.parent for _, _, e in found[slice(*main)] if not e.blank} - {None}
    beside = {e for e in beside if e.name not in ("", "html", "body")}

    def kept(region: tuple[int, int]) -> bool:
        if region == main or (articles[main[0]] and articles[region[0]]) or density(region) >= dense:
            return True
        return any(e.parent in beside for _, _, e in found[slice(*region)] if not e.blank)

    taken = {i for r in regions if kept(r) for i in range(*r)}
    # The rest of an article that the windows have found most of.
    own: dict[_Element, list[int]] = {}
    for i, article in enumerate(articles):
        if article is not None:
            own.setdefault(article, []).append(i)
    for places in own.values():
        if sum(lengths[i] for i in places if i in taken) > HOLDS * sum(lengths[i] for i in places):
            taken.update(places)
    return " ".join(found[i][0] for i in sorted(taken) if not found[i][2].blank)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Null and empty pages give an empty text. Repeated rows are each extracted,
    other columns are ignored, and an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(x) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text,
                                "n_chars": [len(x) for x in text]})

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
