"""From files to files: configuration, selectors by name, archives, parsers and corpora on disk."""

import gzip

import pytest
from pyspark.sql import functions as F

from tessera import annotate
from tessera.functions import text
from tessera.operators import candidate_graph as graph
from tessera.operators import numeric
from tessera.operators import evidence as ev
from tessera.sources import archives, tables

EDGES = "table_id string, src string, dst string, pred string, prob double"


@pytest.fixture(scope="module")
def likely(spark):
    own = [("col:0", "stmt:a", "p", 0.9), ("stmt:a", "col:1", "p", 0.9), ("stmt:a", "col:2", "q", 0.8), ("col:0", "stmt:b", "r", 0.6), ("stmt:b", "col:1", "r", 0.6), ("col:1", "stmt:c", "s", 0.7), ("stmt:c", "col:0", "s", 0.7)]
    return spark.createDataFrame([("t", *e) for e in own], EDGES)


BEST = {("col:0", "stmt:a"), ("stmt:a", "col:1"), ("stmt:a", "col:2")}
BACK = {("col:1", "stmt:c"), ("stmt:c", "col:0")}


@pytest.mark.parametrize(("name", "expected"), [("steiner_tree", BEST), ("steiner_forest", BEST), ("arborescence", BEST), ("branching", BEST), ("simplepath", BEST), ("pairwise", BEST | BACK)])
def test_selectors_by_name(spark, likely, name, expected):
    pages = spark.createDataFrame([], "table_id string, node string")
    if name == "branching":  # which leaves open what of a circle it gives up
        likely = likely.where("src != 'stmt:c'")
    chosen = annotate.SELECTORS[name](likely, pages, annotate.Config())
    assert {(r["src"], r["dst"]) for r in chosen.collect()} == expected
    assert "prob" in chosen.columns


def test_a_configuration_is_checked_first(spark):
    with pytest.raises(ValueError, match="no selector"):
        annotate.annotate(None, None, annotate.Config(selector="best"))
    with pytest.raises(ValueError, match="no rules"):
        annotate.annotate(None, None, annotate.Config(disabled=("NONE",)))
    with pytest.raises(ValueError, match="no stores"):
        annotate.Knowledge.of(spark, other=None)
    own = annotate.Config(disabled=("REL_PRIOR_NEG",), weights={"REL_HEADER_SIMILARITY": 3.0}).model()
    assert "REL_PRIOR_NEG" not in own.rules and own.weights["REL_HEADER_SIMILARITY"] == 3.0


def _corpus(spark):
    cells = [("a", r, c, v) for r, row in enumerate([('x "1"', "Q, 2"), ("", "line\ntwo")]) for c, v in enumerate(row)]
    links = [("a", 0, 0, 0, 0, 5, "u", "Q1", [("Q1", 1.0)]), ("a", 0, 1, 0, 0, 4, "v", None, [("Q2", 0.5), ("Q3", 0.25)])]
    link = f"table_id string, row long, col long, nr int, start int, end int, url string, entity_id string, candidates {tables.CANDIDATES}"
    return tables.Corpus(spark.createDataFrame(cells, "table_id string, row long, col long, value string"), spark.createDataFrame([("a", 0, "n, 0"), ("a", 1, 'n "1"')], "table_id string, col long, name string"), spark.createDataFrame(links, link), spark.createDataFrame([("a", "Q9", "T")], "table_id string, entity_id string, title string"))


def test_corpora_come_back_as_they_were_written(spark, tmp_path):
    own = _corpus(spark)
    rows = lambda df, *columns: sorted(map(repr, df.select(*columns).collect()))
    tables.write_json_corpus(own, f"{tmp_path}/json")
    tables.write_csv_corpus(own, f"{tmp_path}/csv")
    cells, links = tables.csv_patterns(f"{tmp_path}/csv")
    for read in (tables.read_corpus(spark, f"{tmp_path}/json/*.json"), tables.read_csv_corpus(spark, cells, links=links)):
        assert rows(read.cells, "table_id", "row", "col", "value") == rows(own.cells, "table_id", "row", "col", "value")
        assert rows(read.columns, "table_id", "col", "name") == rows(own.columns, "table_id", "col", "name")
        assert rows(read.candidates(), "table_id", "row", "col", "entity_id", "prob") == rows(own.candidates(), "table_id", "row", "col", "entity_id", "prob")


def test_many_tables_share_files(spark, tmp_path):
    cells = spark.range(200).select(F.col("id").cast("string").alias("table_id"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"), F.concat(F.lit("v"), "id").alias("value"))
    columns = spark.range(201).select(F.col("id").cast("string").alias("table_id"), F.lit(0).cast("long").alias("col"), F.lit("n").alias("name"))  # one more has no rows
    links = cells.limit(0).select("table_id", "row", "col", F.lit(0).alias("nr"), F.from_json(F.lit("{}"), tables.LINK).alias("l")).select("table_id", "row", "col", "nr", "l.*")
    tables.write_csv_corpus(tables.Corpus(cells, columns, links, None), f"{tmp_path}/csv")
    assert sum(p.is_file() for p in tmp_path.rglob("*") if not p.name.startswith((".", "_"))) <= 20
    cut, beside = tables.csv_patterns(f"{tmp_path}/csv")
    read = tables.read_csv_corpus(spark, cut, links=beside)
    assert read.links.count() == 0 and read.linked_cells().count() == 200 and read.columns.count() == 201
    assert {(r["table_id"], r["value"]) for r in read.cells.collect()} == {(str(i), f"v{i}") for i in range(200)}


def test_tables_and_links_in_folders_that_name_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "LINES", 2)
    for table, text in (("a", "x,y\n1\n2,3,4\n\n5,6\n"), ("b", "x\n7\n")):
        (tmp_path / f"t={table}").mkdir()
        (tmp_path / f"t={table}" / "one.csv").write_text(text)
    for table, text in (("a", "1\t2\t\tQ1:0.5\tQ2\r\n\n2\t1\tQ3\n0\t1\tQ4\n 1\t2\thttp://www.wikidata.org/entity/Q5:0.25"), ("c", "0\t0\tQ6")):
        (tmp_path / f"{table}.tsv").write_text(text)
    read = tables.read_csv_corpus(spark, f"{tmp_path}/t={{table_id}}/*.csv", links=f"{tmp_path}/{{table_id}}.tsv")
    links = lambda of: {(r["table_id"], r["row"], r["col"], r["nr"], r["end"], r["entity_id"], tuple((c["entity_id"], c["prob"]) for c in r["candidates"] or [])) for r in of.collect()}
    own = {("a", 1, 2, 0, 1, None, (("Q1", 0.5), ("Q2", 1.0))), ("a", 2, 1, 2, 1, "Q3", (("Q3", 1.0),)), ("a", 1, 2, 4, 1, "Q5", (("Q5", 1.0),))}
    assert links(read.links) == own | {("a", 0, 1, 3, None, "Q4", (("Q4", 1.0),))}  # no such cell
    without = {("a", r, c, None, None, None, ()) for r, c in ((0, 0), (1, 0), (1, 1), (2, 0))} | {("b", 0, 0, None, None, None, ())}
    assert links(read.linked_cells()) == own | without
    assert {tuple(r) for r in read.cells.collect()} == {("a", 0, 0, "1"), ("a", 1, 0, "2"), ("a", 1, 1, "3"), ("a", 1, 2, "4"), ("a", 2, 0, "5"), ("a", 2, 1, "6"), ("b", 0, 0, "7")}


def test_an_empty_file_is_told(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("")
    with pytest.raises(Exception, match="table b is empty"):
        tables.read_csv(spark, f"{tmp_path}/*.csv")[0].collect()


def _record(kind, rid, body, **more):
    head = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, "WARC-Record-ID": f"<{rid}>", **more, "Content-Length": len(body)}.items())
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def test_archives_in_splits_with_segments_and_revisits(spark, tmp_path):
    text_of = "é" * 10 + "WARC/1.0\r\n\r\n" + "x" * 20
    body = text_of.encode()
    first = _record("response", "r1", body[:3], **{"WARC-Target-URI": "http://a", "WARC-Segment-Number": 1}) + _record("continuation", "r1b", body[3:9], **{"WARC-Segment-Number": 2, "WARC-Segment-Origin-ID": "<r1>"})
    second = _record("continuation", "r1c", body[9:], **{"WARC-Segment-Number": 3, "WARC-Segment-Origin-ID": "<r1>"}) + _record("revisit", "r2", b"", **{"WARC-Target-URI": "http://b", "WARC-Refers-To": "<r1>"}) + _record("response", "r3", b"", **{"WARC-Target-URI": "http://c"})
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(first))
    (tmp_path / "two.warc").write_bytes(second)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    archives.register(spark)
    chunks = spark.read.format("page_archive").load(str(tmp_path))
    assert chunks.rdd.getNumPartitions() == 2
    assert {(r["name"], r["url"], r["kind"], r["html"]) for r in archives.pages(chunks).collect()} == {("r1", "http://a", "response", text_of), ("r2", "http://b", "revisit", text_of), ("r3", "http://c", "response", "")}
    (tmp_path / "two.warc").write_bytes(second[:-8])
    with pytest.raises(Exception, match="ends after|begins with"):
        (tmp_path / "bad.warc").write_bytes(_record("response", "r4", b"cut short")[:-8])
        spark.read.format("page_archive").load(f"file:{tmp_path}").collect()


def test_archives_opened_in_a_way_of_ones_own(spark):
    content = _record("response", "k1", b"<p>k</p>", **{"WARC-Target-URI": "http://k"})

    class InMemory(archives.PageArchives):
        @classmethod
        def name(cls):
            return "in_memory"

        def listed(self, path):
            return [f"{path}-{i}" for i in range(3)]

        def opened(self, folder, path):
            import io

            return io.BytesIO(content)

    archives.register(spark, InMemory)
    assert spark.read.format("in_memory").load("k").count() == 3


def test_pages_are_fetched_once_and_problems_told(spark):
    def fetch(url):
        if url.endswith("bad"):
            raise OSError("gone")
        return f"<p>{url}</p>"

    urls = spark.createDataFrame([("a",), ("a",), ("bad",), (None,)], "url string")
    assert {tuple(r) for r in archives.fetched(urls, fetch).collect()} == {("a", "<p>a</p>", None), ("bad", None, "OSError: gone")}


def test_parsers_by_name(spark):
    text.register_parser("first digit", number=lambda c: F.regexp_extract(c, "[0-9]", 0).try_cast("double"))
    cells = spark.createDataFrame([("12 km",)], "value string")
    assert text.parsed(cells).first()["number"] == 12.0 and text.parsed(cells, numbers="first digit").first()["number"] == 1.0
    with pytest.raises(ValueError, match="already"):
        text.register_parser("first digit", number=text.parse_number)
    with pytest.raises(ValueError, match="no parser"):
        text.parsed(cells, dates="none")


def test_drawings(spark, likely):
    columns = spark.createDataFrame([("t", 0, 'a "b"')], "table_id string, col long, name string")
    dot = graph.as_dot(likely, columns).first()["dot"]
    assert '"col:0" [label="a \'b\' (column 0)", shape=plaintext, style=filled, fillcolor=gold];' in dot and '"stmt:a" -> "col:2" [label="q"];' in dot and dot.startswith("digraph {") and dot.endswith("}")


def test_statistics_can_be_merged(spark):
    own = [("p", None, x) for x in (1.0, 2.0, 2.5, None)] + [("p", "q", 4.0)]
    whole = lambda *parts: sorted(map(repr, numeric.moments(numeric.merged(*[numeric.statistics(spark.createDataFrame(p, "prop string, qual string, number double")) for p in parts])).collect()))
    assert whole(own) == whole(own[:2], own[2:])


def test_ranges_that_are_not_declared(spark):
    types = spark.createDataFrame([(1, "n", c) for c in ("top", "mid", "low", "other")], "table_id long, node string, class string")
    incoming = spark.createDataFrame([(1, "n", "p"), (1, "n", "free")], "table_id long, node string, prop string")
    closure = ev.ancestors(spark.createDataFrame([("low", "mid"), ("mid", "top")], "child string, parent string"))
    found = ev.not_range(types, incoming, spark.createDataFrame([("p", "mid")], "prop string, class string"), closure)
    assert {tuple(r) for r in found.collect()} == {("p", "top"), ("p", "other")}
