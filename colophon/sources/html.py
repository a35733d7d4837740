"""HTML pages as Markdown: headings, paragraphs, list items and links stay; scripts, styles and images go."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Writer(HTMLParser):
    SILENT = ("script", "style", "head", "noscript")
    BLOCK = ("p", "div", "br", "ul", "ol", "table", "tr", "article", "section", "nav")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.quiet = 0
        self.links: list[str | None] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.quiet += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n* ")
        elif tag == "a":
            self.links.append(dict(attrs).get("href"))
            self.out.append("[")
        elif tag in self.BLOCK:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.quiet = max(0, self.quiet - 1)
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop() or ''})")

    def handle_data(self, data):
        if not self.quiet:
            self.out.append(data)


def to_markdown(html: str | None) -> str:
    w = _Writer()
    w.feed(html or "")
    w.close()
    lines = [" ".join(line.split()) for line in "".join(w.out).split("\n")]
    return "\n".join(line for i, line in enumerate(lines) if line or (i and lines[i - 1])).strip()


@F.pandas_udf(T.StringType())
def html_to_markdown(html: pd.Series) -> pd.Series:
    return html.map(to_markdown)
