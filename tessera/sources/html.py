"""Tables of web pages: one row for each cell, spans expanded, ragged rows padded, links kept.

Pages arrive as rows ``url, html``. Each page is parsed by itself in the task that holds it; everything after the cells is joins and windows.
Nested tables are returned beside their outer ones. A page table with overlapping spans, or with a span that is no number, is left out
and reported in ``status``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.grouped import by_row
from tessera.sources.tables import CANDIDATES, Corpus

LINKS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("href", T.StringType())]))
CELLS = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("table", T.IntegerType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("value", T.StringType()),
        T.StructField("header", T.BooleanType()),
        T.StructField("links", LINKS),
        T.StructField("status", T.StringType()),
    ]
)
#: Stands for the page's own address where a link of an encyclopedia to its own page has none.
SELF = "\0self"
_NUMBER = re.compile(r"\d+")
_SILENT = {"script", "style", "noscript"}


class _Cell:
    def __init__(self, header: bool, rowspan: int | None, colspan: int | None):
        self.header, self.rowspan, self.colspan = header, rowspan, colspan
        self.text, self.links, self.open = "", [], []

    def finished(self) -> tuple[str, list[tuple[int, int, str]]]:
        text = self.text[:-1] if self.text.endswith(" ") else self.text
        return text, [(min(s, len(text)), min(e, len(text)), h) for s, e, h in self.links]


class _Reader(HTMLParser):
    """Collects the rows of every table; an unclosed cell or row ends where the next begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[_Cell]]] = []
        self.stack: list[dict] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = dict(attrs)
        if tag in _SILENT:
            self.silent += 1
        elif tag == "table":
            self.tables.append([])
            self.stack.append({"rows": self.tables[-1], "cell": None})
        elif self.stack:
            top = self.stack[-1]
            if tag == "tr":
                top["cell"] = None
                top["rows"].append([])
            elif tag in ("td", "th"):
                if not top["rows"]:
                    top["rows"].append([])
                top["cell"] = _Cell(tag == "th", _span(own.get("rowspan")), _span(own.get("colspan")))
                top["rows"][-1].append(top["cell"])
            elif top["cell"] is not None:
                if tag in ("br", "hr"):
                    top["cell"].text += "\n"
                elif tag == "a":
                    itself = "selflink" in (own.get("class") or "").split()
                    top["cell"].open.append((len(top["cell"].text), own["href"] or "" if "href" in own else SELF if itself else ""))

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "table" and self.stack:
            self.stack.pop()
        elif self.stack and (cell := self.stack[-1]["cell"]) is not None:
            if tag in ("td", "th", "tr"):
                self.stack[-1]["cell"] = None
            elif tag == "a" and cell.open:
                start, href = cell.open.pop()
                cell.links.append((start, len(cell.text.rstrip(" ")), href))

    def handle_data(self, data: str) -> None:
        if self.stack and not self.silent and (cell := self.stack[-1]["cell"]) is not None and data.strip():
            cell.text += " ".join(data.split()) + " "


def _span(value: str | None) -> int | None:
    """The first number of an attribute; 1 without one; None (the table is left out) for text without digits."""
    if not value:
        return 1
    found = _NUMBER.search(value)
    return max(1, int(found[0])) if found else None


def expanded(rows: list[list[_Cell]]) -> tuple[str, list[list[_Cell | None]]]:
    """Each cell copied over its spans. Status ``ok``, ``bad span``, ``overlap`` or ``too wide``; rows that a span would add at the end are not.

    A table is as wide as the row that has the most cells, counting those that hang into it from above. A last cell that would go on beyond is cut there; any
    other makes the table too wide.
    """
    if any(cell.rowspan is None or cell.colspan is None for row in rows for cell in row):
        return "bad span", []
    widths = [len(row) for row in rows]
    for r, row in enumerate(rows):
        for cell in row:
            for down in range(r + 1, min(len(rows), r + cell.rowspan)):
                widths[down] += 1
    limit = max(widths, default=0)
    grid: list[dict[int, _Cell]] = [{} for _ in rows]
    for r, row in enumerate(rows):
        c = 0
        for k, cell in enumerate(row):
            while c in grid[r]:
                c += 1
            for at in range(c, min(c + cell.colspan, max(limit, c + 1))):
                if at in grid[r]:
                    return "overlap", []
                for down in range(r, min(len(rows), r + cell.rowspan)):
                    grid[down][at] = cell
                c = at + 1
            if c >= limit and k < len(row) - 1:
                return "too wide", []
    width = max((max(g, default=-1) + 1 for g in grid), default=0)
    return "ok", [[g.get(c) for c in range(width)] for g in grid]


def _absolute(url: str, href: str) -> str:
    if href == SELF:
        return url if (urlsplit(url).hostname or "").endswith("wikipedia.org") else ""
    return urljoin(url, href) if href.startswith("/") else href


def tables_of(url: str, html: str | None) -> Iterator[tuple]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    for number, rows in enumerate(reader.tables):
        status, grid = expanded(rows)
        if status != "ok":
            yield url, number, None, None, None, None, None, status
        for r, row in enumerate(grid):
            for c, cell in enumerate(row):
                text, links = cell.finished() if cell else ("", [])
                yield url, number, r, c, text, bool(cell and cell.header), [(s, e, _absolute(url, h)) for s, e, h in links], "ok"


def html_cells(pages: DataFrame) -> DataFrame:
    """``url, table, row, col, value, header, links, status`` of every cell of every table of ``pages`` (url, html)."""
    return by_row(pages.select("url", "html"), tables_of, CELLS)


def linked_cells(cells: DataFrame, sitelinks: DataFrame) -> DataFrame:
    """``url, table, row, col, start, end, href, entity_id``: every link, with the entity its address stands for (``sitelinks``: href, entity_id)."""
    each = cells.where("status = 'ok'").select("url", "table", "row", "col", F.explode("links").alias("x")).select("url", "table", "row", "col", "x.*")
    return each.join(sitelinks, "href", "left").select("url", "table", "row", "col", "start", "end", "href", "entity_id")


def title_of(url: Column) -> Column:
    """The page title that an encyclopedia's address names."""
    return F.replace(F.url_decode(F.regexp_extract(url, r"/wiki/([^?#]+)", 1)), F.lit("_"), F.lit(" "))


def linked_tables(cells: DataFrame, sitelinks: DataFrame, by_title: bool = False) -> Corpus:
    """Page tables as a corpus: the first row is the header, every link a link of its cell in the order in which links end, the page the context.

    ``sitelinks``: href, entity_id, or with ``by_title`` title, entity_id. A table's id is its page's address and number; a link to an unknown page has no entity.
    """
    key = "title" if by_title else "href"
    known = sitelinks.select(F.col(key).alias("key"), "entity_id")
    named = cells.where("status = 'ok'").withColumn("table_id", F.concat("url", F.lit("#"), F.col("table").cast("string")))
    of = lambda c: title_of(c) if by_title else c
    columns = named.where("row = 0").select("table_id", F.col("col").cast("long").alias("col"), F.col("value").alias("name"))
    body = named.where("row > 0").withColumn("row", (F.col("row") - 1).cast("long")).withColumn("col", F.col("col").cast("long"))
    each = body.select("table_id", "row", "col", F.posexplode(F.array_sort(F.transform("links", lambda x: F.struct(x["end"].alias("end"), (-x["start"]).alias("up"), x["href"].alias("href"))))).alias("nr", "x"))
    each = each.select("table_id", "row", "col", "nr", (-F.col("x.up")).cast("int").alias("start"), F.col("x.end").alias("end"), F.col("x.href").alias("url"), of(F.col("x.href")).alias("key")).join(known, "key", "left")
    candidates = F.when(F.col("entity_id").isNotNull(), F.array(F.struct("entity_id", F.lit(1.0).alias("prob")))).otherwise(F.array().cast(CANDIDATES))
    links = each.select("table_id", "row", "col", "nr", "start", "end", "url", "entity_id", candidates.cast(CANDIDATES).alias("candidates"))
    pages = named.select("table_id", "url").distinct().withColumn("key", of(F.col("url"))).join(known, "key", "left")
    return Corpus(body.select("table_id", "row", "col", "value"), columns, links, pages.select("table_id", "entity_id", title_of(F.col("url")).alias("title")))
