"""Visible text and tables of HTML pages.

Built-in expressions can't follow nested tags or decode entities, so the standard parser runs in Arrow batches; all
that comes after it is expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that are left out with all they hold; any tag with "context" in its name is too.
DROPPED = {"script", "style", "meta", "head", "xbrli", "xbrldi", "xlink", "link", "dei", "us-gaap", "iso4217", "ix:header", "ix:references", "ix:resources"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CELLS = {"td", "th"}


class _Page(HTMLParser):
    def __init__(self, page: str):
        super().__init__()
        self.nodes, self.tables, self.open, self.dropped = [], [], [], []
        self.feed(page)
        self.close()

    def _close(self, tags: set[str], within: set[str]) -> None:
        """Ends open elements up to one of ``tags``, unless one of ``within`` comes first."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                del self.open[k:]
            elif self.open[k][0] not in within:
                continue
            break

    def updatepos(self, i, j):
        return j  # nobody asks for line numbers, which the parser would count at each tag

    def handle_starttag(self, tag, attrs):
        if self.dropped and self.dropped[0] == "head" and tag == "body":
            self.dropped = []
        if tag in VOID:
            return
        if self.dropped or tag in DROPPED or "context" in tag:
            if not self.dropped or tag == self.dropped[0]:
                self.dropped.append(tag)
            return
        made: list = []
        if tag == "table":
            self.tables.append(made)
        elif tag == "tr":
            self._close({"tr"}, {"table"})
            for kind, rows in self.open:
                if kind == "table":
                    rows.append(made)
        elif tag in CELLS:
            self._close(CELLS, {"tr", "table"})
            for kind, cells in self.open:
                if kind == "tr":
                    cells.append(made)
        else:
            return
        self.open.append((tag, made))

    def handle_endtag(self, tag):
        if self.dropped:
            if tag == self.dropped[0]:
                self.dropped.pop()
        elif tag == "table":
            self._close({tag}, set())
        elif tag == "tr" or tag in CELLS:
            self._close({tag}, {"table"})

    def handle_data(self, data):
        if self.dropped:
            return
        self.nodes.append(data)
        for kind, parts in self.open:
            if kind in CELLS:
                parts.append(data.strip())


def _tables_of(page: _Page) -> list[list[list[str]]]:
    found = []
    for table in page.tables:
        rows = [["".join(cell) for cell in row] for row in table]
        rows = [r for r in rows if any(r)]
        if len(rows) >= 2:
            found.append(rows)
    return found


#: Pages whose parts are held at a time; a batch of Arrow may have many more.
PAGES = 256


def _in_slices(batches: Iterator[pd.Series], of: Callable[[pd.Series], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What ``of`` makes of ``PAGES`` pages at a time."""
    for pages in batches:
        for k in range(0, max(1, len(pages)), PAGES):
            yield of(pages.iloc[k : k + PAGES])


def page_tables(page: str | None) -> list[list[list[str]]]:
    return _tables_of(_Page(page or ""))


def parsed(html: Column) -> Column:
    """struct<text, tables> from one pass of the parser.

    ``text``: text nodes joined by line ends, with runs of blanks and of blank lines shortened; null stays null.
    ``tables``: tables of two or more rows as rows of stripped cell texts, without empty rows; a nested table also counts
    within the one around it. A null page has none.
    """

    def of(pages: pd.Series) -> pd.DataFrame:
        read = [None if p is None else _Page(p) for p in pages]
        return pd.DataFrame({"nodes": [None if p is None else "\n".join(p.nodes) for p in read], "tables": [[] if p is None else _tables_of(p) for p in read]})

    @F.pandas_udf("nodes string, tables array<array<array<string>>>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _in_slices(batches, of)

    return F.transform(F.array(parse(html)), lambda p: F.struct(*_shown(p)))[0]


def _shown(p: Column) -> list[Column]:
    short = F.regexp_replace(F.regexp_replace(p["nodes"], r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return [F.regexp_replace(short, r"(?U)^\s+|\s+$", "").alias("text"), p["tables"].alias("tables")]


def parsed_or_errors(html: Column, most_cells: int = 1_000_000) -> Column:
    """``parsed`` with text_error and tables_error: what the parser, or the collection of tables, raised on a page. The page
    then has no text and no tables, or no tables; other pages of the batch are as they would be alone. Tables of over
    ``most_cells`` cells are an error: as an outer table has its inner ones' cells too, deep nesting could give any number."""

    def of(page: str | None) -> tuple:
        if page is None:
            return None, [], None, None
        try:
            read = _Page(page)
        except (AssertionError, ValueError, RecursionError) as e:
            return None, [], f"{type(e).__name__}: {e}"[:200], None
        try:
            if sum(len(row) for table in read.tables for row in table) > most_cells:
                raise ValueError("too many cells in nested tables")
            return "\n".join(read.nodes), _tables_of(read), None, None
        except (AssertionError, ValueError, RecursionError) as e:
            return "\n".join(read.nodes), [], None, f"{type(e).__name__}: {e}"[:200]

    @F.pandas_udf("nodes string, tables array<array<array<string>>>, text_error string, tables_error string")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _in_slices(batches, lambda pages: pd.DataFrame([of(p) for p in pages], columns=["nodes", "tables", "text_error", "tables_error"]))

    return F.transform(F.array(parse(html)), lambda p: F.struct(*_shown(p), p["text_error"].alias("text_error"), p["tables_error"].alias("tables_error")))[0]


def visible_text(html: Column) -> Column:
    """The ``text`` of ``parsed``."""
    return parsed(html)["text"]


def tables(html: Column) -> Column:
    """The ``tables`` of ``parsed``."""
    return parsed(html)["tables"]
