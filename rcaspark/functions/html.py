"""Main text of web pages."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of kept tags by prefix, so that e.g. ``pre`` counts as ``p``, and the words a text must exceed.
KEPT = {0: r"h[1-6]|p", 1: r"h[1-6]|p|div"}
MIN_WORDS = 10

_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote center div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SILENT = frozenset(("script", "style", "template"))


class _Blocks(HTMLParser):
    """Text of every kept element in opening order, nested ones included in their parents; all rules in one pass."""

    def __init__(self, rules: Sequence[int]):
        super().__init__(convert_charrefs=True)
        self.keep = [re.compile(KEPT[rule]) for rule in rules]
        self.open: list[tuple[str, list[str] | None]] = []
        self.texts: list[list[list[str]]] = [[] for _ in rules]

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS and any(name == "p" for name, _ in self.open):
            self._close("p")
        kept = [texts for keep, texts in zip(self.keep, self.texts) if keep.match(tag)]
        text = [] if kept else None
        for texts in kept:
            texts.append(text)
        if tag not in _EMPTY:
            self.open.append((tag, text))

    def handle_endtag(self, tag):
        if any(name == tag for name, _ in self.open):
            self._close(tag)

    def _close(self, tag):
        while self.open and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        if not any(name in _SILENT for name, _ in self.open):
            for _, text in self.open:
                if text is not None:
                    text.append(data)


def _contents(page: str, rules: Sequence[int]) -> list[str]:
    parser = _Blocks(rules)
    parser.feed(page)
    parser.close()
    out = []
    for blocks in parser.texts:
        texts = ("".join(t).strip() for t in blocks)
        out.append("\n".join(t for t in texts if len(t.split()) > MIN_WORDS).strip())
    return out


def main_contents(html: Column) -> Column:
    """struct(narrow, wide): headings and paragraphs of more than ten words, one per line; wide takes div as well.

    A page is parsed once for both.
    """
    @F.pandas_udf("narrow string, wide string")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame([_contents(page or "", (0, 1)) for page in s], columns=["narrow", "wide"], dtype=object)

    return extract(html)
