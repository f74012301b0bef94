"""HTML to lightly marked text, for splitting into sections."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd

from siltstone.functions.arrow import series

# What is kept, what is dropped, and how a kept element is written.
KEPT = {"h2": "\n## {}\n", "h3": "\n### {}\n", "h4": "\n### {}\n", "p": "{}", "li": "- {}"}
DROPPED_TAGS = {"script", "style"}
DROPPED_CLASSES = {("div", "wp-caption"), ("span", "et_bloom_bottom_trigger")}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class _Reader(HTMLParser):
    """Collects text for every open kept element, so nested ones each get theirs, in the order they open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str] | None, bool]] = []
        self.found: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag, attrs):  # noqa: ANN001
        if tag in CLOSES_P:
            self._end("p", set(CLOSES_P - {"p"}) | {"li"})
        if tag == "li":
            self._end("li", {"ul", "ol"})
        if tag in VOID:
            return
        classes = (dict(attrs).get("class") or "").split()
        dropped = tag in DROPPED_TAGS or any((tag, c) in DROPPED_CLASSES for c in classes)
        dropped = dropped or bool(self.open and self.open[-1][2])
        parts: list[str] | None = None
        if tag in KEPT and not dropped:
            parts = []
            self.found.append((tag, parts))
        self.open.append((tag, parts, dropped))

    def _end(self, tag: str, limit: set[str]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return
            if self.open[k][0] in limit:
                return

    def handle_endtag(self, tag):  # noqa: ANN001
        self._end(tag, set())

    def handle_data(self, data):  # noqa: ANN001
        if (text := data.strip()) and not (self.open and self.open[-1][2]):
            for _, parts, _ in self.open:
                if parts is not None:
                    parts.append(text)


def structured_text(page: str | None) -> str:
    """Headings, paragraphs and list items, one a line, headings marked; an item's paragraph counts for both."""
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    lines = [KEPT[tag].format(text) for tag, parts in reader.found if (text := re.sub(r"\s+", " ", " ".join(parts)).strip())]
    return "\n".join(lines).strip()


@series("string")
def html_to_text(pages: pd.Series) -> pd.Series:
    return pages.map(structured_text)


@series("string")
def unescape_html(titles: pd.Series) -> pd.Series:
    return titles.map(lambda t: None if t is None else unescape(t))
