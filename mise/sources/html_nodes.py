"""HTML product-node extraction for the store results pages.

Self-contained (standard library and pandas only): it is shipped to the Python
workers by value, so executors do not need this package installed.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd

HIT_COLUMNS = ["ingrediente", "supermercado", "fecha_scrape", "rank", "name", "price_text", "link"]


# The elements of HTML that have no end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class ProductPage(HTMLParser):
    """Collects the product nodes of a page: (name, price text, link)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.products = []
        self.stack: list[tuple[str, set]] = []
        self.open: dict[str, int] = {}      # open elements by name
        self.cur = None          # the open product node: [depth, name, price, link]
        self.field = None        # ('name' | 'price', depth, text parts) being read

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        a = dict(attrs)
        cls = set((a.get("class") or "").split())
        self.stack.append((tag, cls))
        self.open[tag] = self.open.get(tag, 0) + 1
        depth = len(self.stack)
        if self.cur is None:
            if "product-item" in cls or {"item", "product"} <= cls:
                self.cur = [depth, None, None, None]
            return
        in_name_box = any({"product", "name"} <= c for _, c in self.stack[:-1])
        if self.field is None and self.cur[1] is None and (
                "product-item-link" in cls or (tag == "a" and in_name_box)):
            self.field = ("name", depth, [])
        elif self.field is None and self.cur[2] is None and "price" in cls:
            self.field = ("price", depth, [])
        if tag == "a" and "product-item-link" in cls and self.cur[3] is None:
            self.cur[3] = a.get("href") or ""

    def handle_startendtag(self, tag, attrs):
        if tag not in VOID:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        """Close the innermost open element of this name and all that are open inside it; an
        end tag without a start is ignored."""
        if self.open.get(tag):
            while self.close_innermost() != tag:
                pass

    def close(self):
        super().close()
        while self.stack:
            self.close_innermost()

    def close_innermost(self) -> str:
        depth = len(self.stack)
        if self.field is not None and depth == self.field[1]:
            kind, _, buf = self.field
            self.cur[1 if kind == "name" else 2] = "".join(buf).strip()
            self.field = None
        if self.cur is not None and depth == self.cur[0]:
            self.products.append(tuple(self.cur[1:]))
            self.cur = None
        tag = self.stack.pop()[0]
        self.open[tag] -= 1
        return tag

    def handle_data(self, data):
        if self.field is not None:
            self.field[2].append(data)


def html_products(html: str | None) -> list[tuple]:
    if not html:
        return []
    p = ProductPage()
    p.feed(html)
    p.close()
    return p.products


def extract_batches(batches):
    """mapInPandas body: one output row per product node of each page."""
    for pdf in batches:
        rows = []
        for ing, sm, day, html in zip(pdf["ingrediente"], pdf["supermercado"], pdf["fecha_scrape"], pdf["html"]):
            for rank, (name, price, link) in enumerate(html_products(html), 1):
                rows.append((ing, sm, day, rank, name, price, link))
        yield pd.DataFrame(rows, columns=HIT_COLUMNS)
