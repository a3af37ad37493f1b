"""Queries over web pages that Spark writes from the star-schema tables: spans, nested tables, links, and headings around tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans import star
from tessera.plans.registry import query
from tessera.session import shared_folder, staged
from tessera.sources import archives, context, html


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _joined(rows: DataFrame, key: str, order: list[str], html_of: Column) -> DataFrame:
    """``key, rows``: the HTML of each key's rows, in order."""
    listed = rows.select(key, F.struct(*order, html_of.alias("html")).alias("x"))
    return listed.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["html"]), "").alias("rows"))


_ORDERS = """, o as (select *, row_number() over (partition by o_custkey order by o_orderpriority, o_orderkey) as r, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) as k,
        count(*) over (partition by o_custkey, o_orderpriority) as n from orders)"""


def _spanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``url, html``: a customer's orders as a table. A priority's cell spans its orders, one head spans two columns, and some rows end early."""
    own = Window.partitionBy("o_custkey", "o_orderpriority")
    orders = star.read(spark, sf_dir, "orders").withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")))
    orders = orders.withColumn("k", F.row_number().over(own.orderBy("o_orderkey"))).withColumn("n", F.count("*").over(own))
    head = F.when(F.col("k") == 1, _text('<td rowspan="', F.col("n"), ' rows"><span>', F.col("o_orderpriority"), "</span></td>")).otherwise("")
    last = F.when((F.col("r") == 1) | (F.col("o_orderkey") % 3 != 0), _text("<td> ", F.col("o_orderkey") % 5, "\n </td>")).otherwise("")
    row = _text("<tr>", head, "<td><b>o", F.col("o_orderkey"), "</b> of<br>", F.col("o_orderstatus"), "</td><td>&lt;", F.col("o_orderdate").cast("date"), "&gt;", "</td>", last, "</tr>")
    rows = _joined(orders, "o_custkey", ["r"], row)
    return rows.select(_text("http://shop.test/c/", F.col("o_custkey")).alias("url"), _text("<html><body><table><thead><tr><th>Priority<th>Order<th colspan=2>Day and rank</tr></thead><tbody>", F.col("rows"), "</tbody></table></body></html>").alias("html"))


@query(
    _ORDERS
    + """ select 'http://shop.test/c/' || o_custkey as url, cast(r as bigint) as "row", cast(c as bigint) as col, case c when 0 then o_orderpriority when 1 then 'o' || o_orderkey || ' of ' || chr(10) || o_orderstatus when 2 then '<' || cast(cast(o_orderdate as date) as varchar) || '>'
        else case when r = 1 or o_orderkey % 3 <> 0 then cast(o_orderkey % 5 as varchar) else '' end end as value, false as header from o, range(4) x(c)
    union all select distinct 'http://shop.test/c/' || o_custkey, 0, cast(c as bigint), ['Priority', 'Order', 'Day and rank', 'Day and rank'][c + 1], true from o, range(4) x(c)"""
)
def html_spans(spark, sf_dir):
    """Cells copied over their spans, ragged rows filled up, texts of inline elements and line breaks."""
    found = html.html_cells(_spanned(spark, sf_dir)).where("status = 'ok'")
    return found.select("url", "row", "col", "value", "header")


@query(
    """, p as (select n_nationkey as k, 'http://n.test/' || n_nationkey as url, n_name as name, n_regionkey as r from nation)
    select url, cast(0 as bigint) as "table", 'ok' as status, 'outer ' || name as cells from p union all select url, 1, 'ok', 'inner ' || name || '|' || r from p
    union all select url, 2, ['ok', 'bad span', 'overlap', 'too wide'][k % 4 + 1], case when k % 4 = 0 then 'a|b' end from p"""
)
def html_nested(spark, sf_dir):
    """A table in a cell of another, and tables that cannot be laid out, with the reason."""
    nation = star.read(spark, sf_dir, "nation")
    nested = _text("<table><caption>two</caption><tr><td>outer <table><tr><td>inner ", F.col("n_name"), "</td><td>", F.col("n_regionkey"), "</td></tr></table>", F.col("n_name"), "</td></tr></table>")
    odd = F.array(*[F.lit(x) for x in ("<tr><td>a<td rowspan=''>b</tr>", "<tr><td colspan='all'>a</td></tr>", "<tr><td>a</td><td rowspan=2>b</td></tr><tr><td colspan=2>c</td></tr>", "<tr><td>a</td><td colspan=2>b</td><td>c</td></tr>")])
    pages = nation.select(_text("http://n.test/", F.col("n_nationkey")).alias("url"), _text(nested, "<table><style>td {}</style>", odd[(F.col("n_nationkey") % 4).cast("int")], "</table>").alias("html"))
    cells = html.html_cells(pages)
    listed = F.array_sort(F.collect_list(F.when(F.col("row").isNotNull(), F.struct("row", "col", "value"))))
    return cells.groupBy("url", "table", "status").agg(listed.alias("x")).select("url", "table", "status", F.when(F.size("x") > 0, F.array_join(F.transform("x", lambda c: c["value"]), "|")).alias("cells"))


_SUPPLIERS = """, s as (select s_nationkey as k, 'https://en.wikipedia.org/wiki/N_' || s_nationkey as url, 'Supplier ' || s_suppkey as name, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as r from supplier)"""


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages of nations that list their suppliers with links, and the entities of the pages that are known: those of even suppliers and of the nations."""
    supplier = star.read(spark, sf_dir, "supplier")
    row = _text('<tr><td>The <b><a href="/wiki/S_', F.col("s_suppkey"), '">Supplier ', F.col("s_suppkey"), '</a></b> of <a class="mw-selflink selflink">here</a></td><td><a href="http://x.test/', F.col("s_suppkey"), '">a</a><a>b</a></td></tr>')
    rows = _joined(supplier, "s_nationkey", ["s_suppkey"], row)
    pages = rows.select(_text("https://en.wikipedia.org/wiki/N_", F.col("s_nationkey")).alias("url"), _text("<table><tr><th>Name</th><th>Else</th></tr>", F.col("rows"), "</table>").alias("html"))
    known = supplier.where("s_suppkey % 2 = 0").select(_text("https://en.wikipedia.org/wiki/S_", F.col("s_suppkey")).alias("href"), _text("S", F.col("s_suppkey")).alias("entity_id"))
    nations = star.read(spark, sf_dir, "nation").select(_text("https://en.wikipedia.org/wiki/N_", F.col("n_nationkey")).alias("href"), _text("N", F.col("n_nationkey")).alias("entity_id"))
    return pages, known.unionByName(nations)


@query(
    _SUPPLIERS
    + """ select url || '#0' as table_id, r as "row", cast(0 as bigint) as col, cast(0 as bigint) as nr, cast(4 as bigint) as "start", cast(4 + length(name) as bigint) as "end", 'https://en.wikipedia.org/wiki/S_' || s_suppkey as url, case when s_suppkey % 2 = 0 then 'S' || s_suppkey end as entity_id from s
    union all select url || '#0', r, 0, 1, 8 + length(name), 12 + length(name), url, 'N' || k from s union all select url || '#0', r, 1, 0, 0, 1, 'http://x.test/' || s_suppkey, null from s union all select url || '#0', r, 1, 1, 2, 3, '', null from s"""
)
def html_links(spark, sf_dir):
    """Page tables as linked tables: addresses made absolute, links to the page itself, the entities behind them."""
    pages, known = _linked(spark, sf_dir)
    corpus = html.linked_tables(staged(html.html_cells(pages), "cells"), known)
    return corpus.links.select("table_id", "row", "col", "nr", "start", "end", "url", "entity_id")


@query(_SUPPLIERS + """ select distinct url || '#0' as table_id, 'N' || k as entity_id, 'N ' || k as title, 'Name|Else' as columns, cast(count(*) over (partition by k) * 2 as bigint) as n_cells from s""")
def html_linked_tables(spark, sf_dir):
    """The tables of the same pages: heads, size, and the page's own entity with the title its address names, looked up by title."""
    pages, known = _linked(spark, sf_dir)
    titles = known.select(html.title_of(F.col("href")).alias("title"), "entity_id")
    corpus = html.linked_tables(staged(html.html_cells(pages), "cells"), titles, by_title=True)
    heads = corpus.columns.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "name"))), lambda x: x["name"]), "|").alias("columns"))
    return corpus.contexts.join(heads, "table_id").join(corpus.shape().select("table_id", "n_cells"), "table_id").select("table_id", "entity_id", "title", "columns", "n_cells")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of which pages are made, over all tasks of a shuffle: a small file, read by a task or two, makes pages that take long to parse."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``url, html``: a page for each customer with headings of three levels before a table, one of which a later one cuts off, and text around."""
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    body = _text("<h1>Customers</h1><p>All.</p><h3>Cut off</h3><p>Gone.</p><h2>Customer <i>", c, '</i></h2><div>Lives in <b>N<a href="/n/', n, '">', n, "</a></b>.<script>no()</script></div><h3>Orders</h3><p>Of ", c, ":</p><table><tr><td>x</td></tr></table><p>See <i>also</i> N", n, ".</p><h2>Next</h2><p>Not here.</p>")
    return _dealt(star.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").select(_text("http://shop.test/c/", c).alias("url"), _text("<html><head><title>t</title></head><body>", body, "</body></html>").alias("html"))


_HEADINGS = """, h as (select 'http://shop.test/c/' || c_custkey as url, c_custkey as c, c_nationkey as n from customer)"""


@query(
    _HEADINGS
    + """ select url, cast(1 as bigint) as level, 'Customers' as heading, chr(10) || 'All.' || chr(10) as before, '' as after from h
    union all select url, 2, 'Customer ' || c, chr(10) || 'Lives in N' || n || '.' || chr(10), '' from h union all select url, 3, 'Orders', chr(10) || 'Of ' || c || ':', 'See also N' || n || '.' from h"""
)
def html_headings(spark, sf_dir):
    """The headings that lead to a table, and the text under each and after the table, kept as JSON and read back."""
    kept = staged(context.as_json(context.table_contexts(_headed(spark, sf_dir))), "contexts")
    found = context.from_json(kept).where("level > 0")
    return found.select("url", "level", "heading", context.text_of(F.col("content_before")).alias("before"), context.text_of(F.col("content_after")).alias("after"))


@query(
    _HEADINGS
    + """ select url, x.value, x.tags, x.href from (select url, unnest([{'value': chr(10) || '{1}', 'tags': '', 'href': ''}, {'value': 'Lives in ', 'tags': 'div>body', 'href': ''}, {'value': 'N', 'tags': 'b>div>body', 'href': ''},
        {'value': cast(n as varchar), 'tags': 'a>b>div>body', 'href': '/n/' || n}, {'value': '.', 'tags': 'div>body', 'href': ''}, {'value': chr(10) || '{1}', 'tags': '', 'href': ''}]) as x from h)"""
)
def html_items(spark, sf_dir):
    """The pieces of text under a heading, each with the elements it stands in and the address of a link."""
    found = context.table_contexts(_headed(spark, sf_dir)).where("level = 2").select("url", F.explode("content_before").alias("i"))
    value = F.when(F.col("i.id") < 0, F.format_string("\n{%d}", F.col("i.n_lines"))).otherwise(F.col("i.value"))
    return found.select("url", value.alias("value"), F.array_join("i.tags", ">").alias("tags"), F.array_join(F.map_values("i.hrefs"), ",").alias("href"))


@query("""select 'urn:page:' || page_id as name, url, 'response' as kind, md5(coalesce(html, '')) as digest, cast(octet_length(encode(coalesce(html, ''))) as bigint) as bytes from pages""")
def pages_archive(spark, sf_dir):
    """All pages written as archives and read again by the data source, archive by archive."""
    at = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    own = star.read(spark, sf_dir, "pages").select(_text("urn:page:", F.col("page_id")).alias("name"), "url", "html")
    archives.write_archives(own.repartition(3), at)
    archives.register(spark)
    found = archives.pages(spark.read.format("page_archive").load(at))
    return found.select("name", "url", "kind", F.md5("html").alias("digest"), F.octet_length("html").cast("long").alias("bytes"))
