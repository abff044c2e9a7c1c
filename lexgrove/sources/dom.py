"""Forest from tree documents: one row in, the nodes of its tree out, by an iterative walk in the task."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SCHEMA = "page_id long, node long, parent long, tag string, depth int, child_ord int, n_chars long"


class _Walk(HTMLParser):
    """Numbers elements in preorder; an end tag closes what is open above its element, a stray one nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.children: list[int] = [0]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.children[-1] += 1
        self.rows.append([len(self.rows), self.open[-1] if self.open else None, tag, len(self.open), self.children[-1], 0])
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)
            self.children.append(0)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]][2] == tag:
                del self.open[k:], self.children[k + 1 :]
                return

    def handle_data(self, data: str) -> None:
        if self.open:
            self.rows[self.open[-1]][5] += len(data)


def dom_forest(pages: DataFrame, ident: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, node, parent, tag, depth, child_ord, n_chars): the element tree of each page, nodes in preorder."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for page, text in zip(pdf["page_id"], pdf["html"], strict=True):
                w = _Walk()
                w.feed(text or "")
                w.close()
                out += [(page, *r) for r in w.rows]
            yield pd.DataFrame(out, columns=["page_id", "node", "parent", "tag", "depth", "child_ord", "n_chars"]).astype({"parent": "Int64"})

    return pages.select(F.col(ident).alias("page_id"), F.col(html).alias("html")).mapInPandas(walk, SCHEMA)
