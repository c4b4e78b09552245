"""List pages to links: those of the page's own host whose path fits, inside a headline element, each URL once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "source_id string, position int, url string, headline string"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.links: list[list] = []
        self.open: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag not in _VOID:
            self.stack.append((tag, a.get("class") or ""))
        if tag == "a" and a.get("href"):
            near = self.stack[-7:-1]
            headline = any(t in ("h1", "h2", "h3", "h4") or re.search(r"headline|title", c, re.I) for t, c in near)
            self.open = [a["href"], headline, ""]

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.open:
            self.links.append(self.open)
            self.open = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[2] += data


def links(html: str | None, base: str, path: str) -> list[tuple[str, str]]:
    p = _Links()
    p.feed(html or "")
    out: dict[str, str] = {}
    for href, headline, text in p.links:
        url = urljoin(base, href).split("#")[0]
        title = " ".join(text.split())
        if headline and len(title) > 10 and urlsplit(url).netloc == urlsplit(base).netloc and re.search(path, urlsplit(url).path):
            out.setdefault(url, title)
    return list(out.items())


def entries(pages: DataFrame, path: str) -> DataFrame:
    """``pages`` has source_id, url and html; ``path`` is a pattern for the paths of articles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, k, u, t) for s, base, h in zip(b["source_id"], b["url"], b["html"]) for k, (u, t) in enumerate(links(h, base or "", path))]
            yield pd.DataFrame(rows, columns=["source_id", "position", "url", "headline"])

    return pages.select("source_id", "url", "html").mapInPandas(run, SCHEMA)
