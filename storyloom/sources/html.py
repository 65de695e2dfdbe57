"""Text and title of HTML pages: one line for each innermost block."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Block elements, heading elements, and elements without an end tag.
BLOCKS = frozenset("p div li blockquote h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Element:
    """An open or closed element: its tag, and which part of the page's text it holds."""

    __slots__ = ("end", "has_block", "start", "tag")

    def __init__(self, tag: str, start: int):
        self.tag, self.start, self.end, self.has_block = tag, start, None, False


class _Page(HTMLParser):
    """Collects the text of blocks without a nested block; nothing closes an element but its own end tag.

    All text lies in one list in the order of the page, and elements hold places of it, so the work grows with the page's length.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Element] = []
        self.of_tag: Counter[str] = Counter()  # how many of each tag are open
        self.open_blocks: list[_Element] = []
        self.blocks: list[_Element] = []
        self.titles: list[_Element] = []
        self.text: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        if tag in VOID:
            return
        element = _Element(tag, len(self.text))
        self.open.append(element)
        self.of_tag[tag] += 1
        if tag in BLOCKS:
            if self.open_blocks:  # those around it hold that one already
                self.open_blocks[-1].has_block = True
            self.open_blocks.append(element)
            self.blocks.append(element)
        if tag in HEADINGS or tag == "title":
            self.titles.append(element)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1
        while self.of_tag[tag]:
            last = self.open.pop()
            self.of_tag[last.tag] -= 1
            last.end = len(self.text)
            if last.tag in BLOCKS:
                self.open_blocks.pop()
            if last.tag == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)

    def line(self, element: _Element) -> str:
        return " ".join("".join(self.text[element.start : element.end]).split())


def extract(html: str | None) -> tuple[str, str | None]:
    """(text, title). The title is the first h1 to h3, else the title element; a blank one is null."""
    page = _Page()
    page.feed(html or "")
    page.close()
    leaves = [b for b in page.blocks if not b.has_block]
    lines = [page.line(b) for b in leaves] if leaves else [" ".join(t.split()) for t in page.text]
    headings = [n for n in page.titles if n.tag in HEADINGS] or [n for n in page.titles if n.tag == "title"]
    return "\n".join(line for line in lines if line), (page.line(headings[0]) or None) if headings else None


def page_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, title, text) of each page."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [extract(h) for h in batch[html]]
            yield pd.DataFrame({key: batch[key], "title": [t for _, t in found], "text": [b for b, _ in found]})

    return pages.select(key, html).mapInPandas(parse, f"{key} {dict(pages.dtypes)[key]}, title string, text string")
