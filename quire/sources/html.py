"""Text blocks of HTML pages: outermost p, h1-h6, li, blockquote, td, th, dt, dd."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame

BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote td th dt dd".split())
SKIP = frozenset("script style template".split())


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.tag, self.depth, self.text, self.skip = "", 0, [], 0
        self.title: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag in SKIP:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag in BLOCKS:
            if self.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or self.tag == tag == "li" and self.depth == 0:
                self._close()
            if self.tag:
                self.depth += tag == self.tag
            else:
                self.tag, self.depth, self.text = tag, 1, []

    def handle_endtag(self, tag):
        if tag in SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == self.tag:
            self.depth -= 1
            if not self.depth:
                self._close()

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif self.tag and not self.skip:
            self.text.append(data)

    def _close(self):
        text = "".join(self.text).strip()
        if text:
            self.out.append((self.tag, text))
        self.tag, self.text = "", []


def blocks_of(html: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """Title (first heading, else the title element) and the blocks."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    if p.tag:
        p._close()
    head = next((t for k, t in p.out if k[0] == "h" and k[1:].isdigit()), None)
    return head or ("".join(p.title).strip() or None), p.out


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row a block: number, tag, kind (heading or text) and text; pages without blocks give none."""

    def run(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            rows = []
            for k, h in zip(pdf[key], pdf[html]):
                rows += [(k, i, tag, "heading" if tag[0] == "h" else "text", text) for i, (tag, text) in enumerate(blocks_of(h)[1])]
            yield pd.DataFrame(rows, columns=[key, "seg", "tag", "kind", "source"])

    return pages.select(key, html).mapInPandas(run, f"{key} bigint, seg int, tag string, kind string, source string")
