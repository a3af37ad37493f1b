"""Tables of pages written inline: spans, ragged rows, nested tables, links."""

import pyarrow as pa

from tessera.sources import html

PAGE = """<table><tr><th>Name<th colspan=2>Place</tr>
<tr><td rowspan="2"><b><a href="/wiki/A">A</a></b> one<br>two<td>x<td>y</tr><tr><td>z</td></tr></table>
<table><tr><td>in<table><tr><td>nested</td></tr></table></td></tr></table>
<table><tr><td colspan="no">bad</td></tr></table>
<table><tr><td>a</td><td rowspan=2>b</td></tr><tr><td colspan=2>c</td></tr></table>"""


def test_cells(spark):
    pages = spark.createDataFrame([("http://h.org/p", PAGE), ("http://h.org/q", None)], "url string, html string")
    cells = html.html_cells(pages).collect()
    first = {(r["row"], r["col"]): r["value"] for r in cells if r["table"] == 0}
    assert first == {(0, 0): "Name", (0, 1): "Place", (0, 2): "Place", (1, 0): "A one \ntwo", (1, 1): "x", (1, 2): "y", (2, 0): "A one \ntwo", (2, 1): "z", (2, 2): ""}
    assert [r["value"] for r in cells if r["table"] == 2] == ["nested"]
    assert {r["table"]: r["status"] for r in cells if r["status"] != "ok"} == {3: "bad span", 4: "overlap"}
    links = html.linked_cells(html.html_cells(pages), spark.createDataFrame([("http://h.org/wiki/A", "Q1")], "href string, entity_id string")).collect()
    assert {(r["row"], r["start"], r["end"], r["entity_id"]) for r in links} == {(1, 0, 1, "Q1"), (2, 0, 1, "Q1")}


def test_cells_leave_a_task_in_bounded_batches(monkeypatch):
    from tessera.operators import grouped

    monkeypatch.setattr(grouped, "ROWS", 7)
    sizes = []

    class Pages:
        def mapInArrow(self, run, schema):
            pages = pa.RecordBatch.from_pydict({"url": ["u", "v"], "html": ["<table>" + "<tr><td><a href='/x'>a</a><td>b</tr>" * 20 + "</table>"] * 2})
            sizes.extend(b.num_rows for b in run([pages]))

    grouped.by_row(Pages(), html.tables_of, html.CELLS)
    assert sum(sizes) == 80 and max(sizes) == 7


def test_pages_of_a_small_file_are_parsed_by_many_tasks(spark, tmp_path):
    from tessera.plans import pages

    spark.range(50).selectExpr("id as c_custkey", "id % 25 as c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert pages._headed(spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
