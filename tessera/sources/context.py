"""What a page says around its tables: the headings that lead to a table, and the text before and after it.

Each page is parsed by itself in the task that holds it, into the items around each of its tables under the headings that lead there.
An item is a text with the tags around it, innermost first, or a number of line breaks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.grouped import by_row

#: Elements that begin a line of their own, that say nothing, that are not looked into, that end what comes after a table, and headings.
BLOCK = set("address article aside blockquote body br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section table ul".split())
SILENT = set("noscript script style".split())
CLOSED = {"table"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
LEVEL_ENDS = CLOSED | HEADINGS
#: Elements without an end tag.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())

ITEM = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("value", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("hrefs", T.MapType(T.IntegerType(), T.StringType())),
        T.StructField("n_lines", T.IntegerType()),
    ]
)
_ROWS = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("table", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("heading", T.StringType()),
        T.StructField("content_before", T.ArrayType(ITEM)),
        T.StructField("content_after", T.ArrayType(ITEM)),
    ]
)


@dataclass
class Node:
    """An element, or a text (without a tag)."""

    tag: str | None = None
    text: str = ""
    href: str | None = None
    children: list[Node] = field(default_factory=list)
    parent: Node | None = None

    def descendants(self) -> Iterator[Node]:
        """Itself and all below, in document order."""
        yield self
        for c in self.children:
            yield from c.descendants()

    def post_order(self) -> Iterator[Node]:
        for c in self.children:
            yield from c.post_order()
        yield self


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("body")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "head", "body"):
            return
        if tag == "p" and self.at.tag == "p" or tag == "li" and self.at.tag == "li":
            self.at = self.at.parent or self.root
        node = Node(tag, href=dict(attrs).get("href") or "" if tag == "a" else None, parent=self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        at = self.at
        while at is not self.root and at.tag != tag:
            at = at.parent
        if at is not self.root:
            self.at = at.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(Node(text=data, parent=self.at))


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


@dataclass
class Item:
    id: int = -1
    value: str = ""
    tags: list[str] = field(default_factory=list)
    hrefs: dict[int, str] = field(default_factory=dict)
    n_lines: int = 0

    def as_row(self) -> dict:
        return {"id": self.id, "value": self.value, "tags": self.tags, "hrefs": list(self.hrefs.items()), "n_lines": self.n_lines}


def flatten(node: Node) -> list[Item]:
    """The texts of an element and the line breaks between its blocks.

    Numbers are given in document order; a text that is all an element holds goes under the element's. A block within an inline element stands beside it, so the inline
    element's tag is not among those of the block's texts.
    """
    numbers = iter(range(1 << 30))
    out: list[Item] = []

    def said(own: Node, number: int, text: str, path: list[tuple[Node, int]]) -> None:
        around = [*path, (own, number)] if own.tag is not None else path
        tags, hrefs, in_block = [], {}, False
        for element, n in reversed(around):
            block = element.tag in BLOCK
            if block or not in_block:
                tags.append(element.tag)
                if element.href is not None and not block:
                    hrefs[n] = element.href
            in_block |= block
        out.append(Item(number, text, tags, hrefs))

    def walk(own: Node, path: list[tuple[Node, int]], begun: int) -> None:
        number = next(numbers)
        if own.tag is None:
            said(own, number, own.text, path)
            return
        inside = [] if own.tag in CLOSED else [c for c in own.children if c.tag not in SILENT]
        first = len(out) if own.tag in BLOCK else begun
        if len(inside) == 1 and inside[0].tag is None:
            if inside[0].text or own.tag not in BLOCK:
                said(own, number, inside[0].text, path)
        elif not inside and own.tag not in BLOCK:
            said(own, number, "", path)
        else:
            for c in inside:
                walk(c, [*path, (own, number)], first)
                if c.tag in BLOCK:
                    out.append(Item(n_lines=1))
        if own.tag in BLOCK and len(out) > first and out[-1].n_lines:
            out.pop()

    walk(node, [], 0)
    return out


def compact(items: list[Item], merge_blank: bool = True) -> list[Item]:
    """Blank texts as the line breaks they hold, and line breaks beside each other as one. Texts stay apart even where their tags agree."""
    out: list[Item] = []
    for item in items:
        if merge_blank and not item.n_lines and item.id >= 0 and not item.value.strip():
            item = Item(n_lines=item.value.count("\n"))
        blank = item.id < 0
        if blank and out and out[-1].id < 0:
            out[-1] = Item(n_lines=out[-1].n_lines + item.n_lines)
        else:
            out.append(item)
    return out


def _without_rest(node: Node, keep: Node) -> Node:
    """The ancestors of ``keep`` with all that comes before it."""
    chain, at = [], keep
    while at.parent is not None:
        parent = Node(at.parent.tag, href=at.parent.href)
        parent.children = at.parent.children[: next(i for i, c in enumerate(at.parent.children) if c is at)]
        chain.append(parent)
        at = at.parent
    for inner, outer in zip(chain, chain[1:], strict=False):
        outer.children = [*outer.children, inner]
    return chain[-1]


def _after(keep: Node) -> Node | None:
    """The parent of ``keep`` with what follows it, up to the next table or heading; None if nothing follows."""
    siblings = keep.parent.children
    at = next(i for i, c in enumerate(siblings) if c is keep) + 1
    if at == len(siblings):
        return None
    end = next((i for i in range(at, len(siblings)) if siblings[i].tag in LEVEL_ENDS), len(siblings))
    return Node(keep.parent.tag, href=keep.parent.href, children=siblings[at:end])


def sections(before: list[Item]) -> list[tuple[int, str, list[Item]]]:
    """``level, heading, items`` of every heading that a list of items holds, in order; level 0 is what stands before the first."""
    out: list[tuple[int, str, list[Item]]] = [(0, "", [])]
    open_heading = ""
    for item in before:
        heading = next((t for t in item.tags if t in HEADINGS), "")
        if not heading:
            out[-1][2].append(item)
        elif heading == open_heading:
            out[-1] = (out[-1][0], out[-1][1] + item.value, out[-1][2])
        else:
            out.append((int(heading[1:]), item.value, []))
        open_heading = heading
    return out


def around(url: str, html: str | None) -> Iterator[tuple]:
    root = parse(html)
    for number, table in enumerate(n for n in root.descendants() if n.tag == "table"):
        before = compact(flatten(_without_rest(root, table)))
        rest = _after(table)
        after = compact(flatten(rest)) if rest is not None else []
        found = sections(before)
        nearer = len(HEADINGS) + 1
        for pos, (level, heading, items) in reversed(list(enumerate(found))):
            if level < nearer:
                yield url, number, pos, level, heading, [i.as_row() for i in items], [i.as_row() for i in after] if pos == len(found) - 1 else []
                nearer = level


def table_contexts(pages: DataFrame) -> DataFrame:
    """``url, table, pos, level, heading, content_before, content_after``: for every table of ``pages`` (url, html) the headings that lead to it, outermost first.

    Of all headings before a table those count that no later one of the same level or above cuts off: seen from the table upwards, levels fall.
    """
    return by_row(pages.select("url", "html"), around, _ROWS)


def as_json(contexts: DataFrame) -> DataFrame:
    """``url, table, value``: a table's context as JSON, and with ``from_json`` back again."""
    one = F.struct("pos", "level", "heading", "content_before", "content_after")
    return contexts.groupBy("url", "table").agg(F.to_json(F.array_sort(F.collect_list(_sortable(one)))).alias("value"))


def _sortable(one: Column) -> Column:
    """Maps cannot be compared, so their entries stand in their place while rows are put in order."""
    listed = lambda items: F.transform(items, lambda i: i.withField("hrefs", F.map_entries(i["hrefs"])))
    return one.withField("content_before", listed(one["content_before"])).withField("content_after", listed(one["content_after"]))


def from_json(texts: DataFrame) -> DataFrame:
    item = "struct<id:int,value:string,tags:array<string>,hrefs:array<struct<key:int,value:string>>,n_lines:int>"
    schema = f"array<struct<pos:int,level:int,heading:string,content_before:array<{item}>,content_after:array<{item}>>>"
    each = texts.select("url", "table", F.explode(F.from_json("value", schema)).alias("x")).select("url", "table", "x.*")
    back = lambda c: F.transform(c, lambda i: i.withField("hrefs", F.map_from_entries(i["hrefs"])))
    return each.withColumn("content_before", back(F.col("content_before"))).withColumn("content_after", back(F.col("content_after")))


def text_of(items: Column) -> Column:
    """The plain text of a list of items."""
    return F.array_join(F.transform(items, lambda i: F.when(i["id"] < 0, F.repeat(F.lit("\n"), i["n_lines"])).otherwise(i["value"])), "")
