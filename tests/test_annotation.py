"""Kernels and operators of annotation on small cases: closed forms, exhaustive search, fixtures and round trips."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import matchers, text
from tessera.operators import candidate_graph as graph
from tessera.operators import data_graph, model, models, steiner
from tessera.operators import evidence as ev
from tessera.operators.rules import Model, Rule, infer, lit
from tessera.sources import context, html, tables

PAGE = """<html><body><div id="app">
      <h3>Hello world</h3>
      <p>This is a paragraph. <b>This is bold text.</b></p>
    </div></body></html>"""


def _model(for_weight, against):
    own = Model({"HAS": 1, "RIGHT": 1}, frozenset({"RIGHT"}))
    own.add("for", Rule((lit("HAS", "x"),), lit("RIGHT", "x")), for_weight)
    own.add("prior", Rule((), ~lit("RIGHT", "x")), against)
    return own


@pytest.mark.parametrize(("weights", "expected"), [((0.8, 0.1), 0.889), ((0.5, 0.2), 0.714)])
def test_inference_of_two_rules(spark, weights, expected):
    evidence = spark.createDataFrame([(1, "a")], "table_id long, a0 string")
    targets = spark.createDataFrame([(1, "a"), (1, "b")], "table_id long, a0 string")
    found = {r["arguments"][0]: r["truth"] for r in infer(_model(*weights), {"HAS": evidence}, {"RIGHT": targets}).collect()}
    assert found["a"] == pytest.approx(expected, abs=1e-3) and found["b"] == pytest.approx(0.0, abs=2e-3)


def test_rules_are_checked():
    own = _model(1, 1)
    with pytest.raises(ValueError, match="already"):
        own.add("for", Rule((), lit("RIGHT", "x")), 1)
    with pytest.raises(ValueError, match="arguments"):
        own.add("other", Rule((lit("HAS", "x", "y"),), lit("RIGHT", "x")), 1)
    with pytest.raises(ValueError, match="no rules"):
        own.without(["none"])
    with pytest.raises(ValueError, match="no data"):
        own.check({}, {})
    assert own.without(["for"]).used_predicates() == {"RIGHT"}
    own.extend({"more": (Rule((lit("ALSO", "x"),), ~lit("RIGHT", "x")), 0.5)}, {"ALSO": 1})
    assert own.weights["more"] == 0.5 and "ALSO" in own.used_predicates()


def test_coupled_rules_against_a_grid(spark):
    """Two atoms that exclude each other, by search over a grid of truths."""
    own = Model({"F": 2, "OUT": 2, "RIGHT": 1}, frozenset({"RIGHT"}))
    own.add("for", Rule((lit("F", "x", "y"),), lit("RIGHT", "x")), 2.0)
    own.add("out", Rule((lit("OUT", "x", "y"), lit("RIGHT", "x")), ~lit("RIGHT", "y"), (("x", "y"),)), 3.0)
    own.add("prior", Rule((), ~lit("RIGHT", "x")), 1.0)
    evidence = {"F": spark.createDataFrame([(1, "a", "-", 0.9), (1, "b", "-", 0.8)], "table_id long, a0 string, a1 string, truth double"), "OUT": spark.createDataFrame([(1, "a", "b"), (1, "a", "a")], "table_id long, a0 string, a1 string")}
    targets = {"RIGHT": spark.createDataFrame([(1, "a"), (1, "b")], "table_id long, a0 string")}
    found = {r["arguments"][0]: r["truth"] for r in infer(own, evidence, targets).collect()}
    cost = lambda a, b: 2 * (max(0, 0.9 - a) ** 2 + max(0, 0.8 - b) ** 2) + 3 * max(0, a + b - 1) ** 2 + a * a + b * b
    best = min(itertools.product([i / 400 for i in range(401)], repeat=2), key=lambda x: cost(*x))
    assert (found["a"], found["b"]) == pytest.approx(best, abs=4e-3)


def test_the_models_have_their_rules():
    assert len(models.default_model().rules) == 19 and models.default_model().weights["REL_NOT_FUNC_DEPENDENCY"] == 100
    assert len(models.base_model().rules) == 16 and models.base_model().weights["CASCADING_ERROR_2"] == 2


def _every_tree(graph_, terminals):
    """All edge sets that are a directed tree over the terminals with statements' values, by brute force."""
    edges = sorted(graph_.weights)
    for n in range(1, len(edges) + 1):
        for own in itertools.combinations(edges, n):
            into = {}
            for e in own:
                into.setdefault(e[1], []).append(e)
            nodes = {x for e in own for x in e[:2]}
            roots = [x for x in nodes if x not in into]
            if len(roots) != 1 or any(len(v) > 1 for v in into.values()) or not set(terminals) <= nodes or steiner.has_cycle(own):
                continue
            if roots[0].startswith("stmt:") or graph_.completed(frozenset(own)) != frozenset(own):
                continue
            leaves = nodes - {e[0] for e in own}
            if all(x in terminals or any(e[1] == x and e[2] == graph_.into[e[0]][0][2] for e in own if e[0].startswith("stmt:")) for x in leaves):
                yield frozenset(own)


def test_steiner_trees_against_all_trees():
    rng = random.Random(3)
    for _ in range(40):
        weights = {}
        for s in range(rng.randint(2, 4)):
            u, v, w = rng.sample(range(4), 3)
            weights[f"col:{u}", f"stmt:{s}", f"p{s}"] = rng.randint(10, 20) / 10
            weights[f"stmt:{s}", f"col:{v}", f"p{s}"] = rng.randint(10, 20) / 10
            if rng.random() < 0.5:
                weights[f"stmt:{s}", f"col:{w}", "q"] = rng.randint(10, 20) / 10
        own = steiner.Graph(weights)
        terminals = sorted(n for n in own.nodes() if n.startswith("col:"))
        found = steiner.best_tree(own, terminals, 500, 500)
        trees = list(_every_tree(own, terminals))
        if found is None:
            assert not trees
        elif trees:
            least = min(own.weight(t) / len(t) for t in trees)
            assert own.weight(found) / len(found) <= least + 1e-9
            assert set(terminals) <= {n for e in found for n in e[:2]} and not steiner.has_cycle(found)


def test_selection_of_one_table(spark):
    edges = [("col:0", "stmt:a", "p", 0.9), ("stmt:a", "col:1", "p", 0.9), ("stmt:a", "col:2", "q", 0.8), ("col:0", "stmt:b", "r", 0.6), ("stmt:b", "col:2", "r", 0.6), ("col:2", "stmt:c", "s", 0.7), ("stmt:c", "ent:N", "s", 0.7), ("col:1", "stmt:d", "t", 0.5)]
    df = spark.createDataFrame([(1, *e) for e in edges], "table_id long, src string, dst string, pred string, prob double")
    tree = {(r["src"], r["dst"]) for r in steiner.select_steiner(df).collect()}
    assert tree == {("col:0", "stmt:a"), ("stmt:a", "col:1"), ("stmt:a", "col:2")}
    pages = spark.createDataFrame([(1, "ent:N")], "table_id long, node string")
    assert {(r["src"], r["dst"]) for r in steiner.select_steiner(df, pages).collect()} == tree | {("col:2", "stmt:c"), ("stmt:c", "ent:N")}
    extra = spark.createDataFrame([(1, "ent:N")], "table_id long, node string")
    assert {(r["src"], r["dst"]) for r in steiner.steiner_trees(df, extra).collect()} >= {("stmt:c", "ent:N")}
    paths = {(r["src"], r["dst"]) for r in steiner.simple_paths(df, pages).collect()}
    assert paths == tree | {("col:2", "stmt:c"), ("stmt:c", "ent:N")}
    loose = {(r["src"], r["dst"]) for r in steiner.without_loose_entities(graph.without_dangling(df)).collect()}
    assert ("stmt:c", "ent:N") not in loose and ("col:0", "stmt:a") in loose
    broken = df.where("src != 'stmt:a' or dst = 'col:2'")
    with pytest.raises(Exception, match="not in the graph"):
        steiner.with_statement_values(broken, df, create=False).collect()


def test_page_items_as_recorded():
    div = context.parse(PAGE).children[0]
    flat = [(i.id, i.value, i.tags, i.n_lines) for i in context.flatten(div)]
    assert flat == [(1, "\n      ", ["div"], 0), (2, "Hello world", ["h3", "div"], 0), (-1, "", [], 1), (3, "\n      ", ["div"], 0), (5, "This is a paragraph. ", ["p", "div"], 0), (6, "This is bold text.", ["b", "p", "div"], 0), (-1, "", [], 1), (7, "\n    ", ["div"], 0)]
    merged = [(i.value, i.n_lines) for i in context.compact(context.flatten(div))]
    assert merged == [("", 1), ("Hello world", 0), ("", 2), ("This is a paragraph. ", 0), ("This is bold text.", 0), ("", 2)]
    assert [i.n_lines for i in context.compact(context.flatten(div), merge_blank=False)] == [0, 0, 1, 0, 0, 0, 1, 0]
    inline = context.parse("<span>a<div>b</div><a href='/x'>c</a></span>").children[0]
    assert [(i.value, i.tags, i.hrefs) for i in context.flatten(inline) if not i.n_lines] == [("a", ["span"], {}), ("b", ["div"], {}), ("c", ["a", "span"], {3: "/x"})]


def test_headings_that_lead_to_a_table(spark):
    page = "<h1>A</h1>x<h2>B</h2>y<h3>C</h3><h2>D</h2>z<table><tr><td>1</td></tr></table>after<p>more</p><h2>E</h2>no<table></table>"
    rows = context.table_contexts(spark.createDataFrame([("u", page), ("v", None)], "url string, html string"))
    found = [(r["table"], r["level"], r["heading"]) for r in rows.orderBy("table", "pos").collect()]
    assert found == [(0, 0, ""), (0, 1, "A"), (0, 2, "D"), (1, 0, ""), (1, 1, "A"), (1, 2, "E")]
    last = rows.where("table = 0 and heading = 'D'").select(context.text_of(F.col("content_before")).alias("b"), context.text_of(F.col("content_after")).alias("a")).first()
    assert last["b"].strip() == "z" and last["a"].split() == ["aftermore"] or last["a"].split() == ["after", "more"]
    back = context.from_json(context.as_json(rows))
    assert sorted(map(str, back.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))


def test_spans_and_widths_of_page_tables(spark):
    cell = lambda **own: html._Cell(False, own.get("rowspan", 1), own.get("colspan", 1))
    wide = [[cell(), cell(colspan=5000)], [cell(), cell(), cell()]]
    status, grid = html.expanded(wide)
    assert status == "ok" and [len(r) for r in grid] == [3, 3] and grid[0][1] is grid[0][2]
    assert html.expanded([[cell(colspan=9), cell()], [cell(), cell()]])[0] == "too wide"
    assert html.expanded([[cell(), cell(rowspan=2)], [cell(colspan=2), cell()]])[0] == "overlap"
    assert html.expanded([[cell(rowspan=9), cell()], [cell()]])[0] == "ok"
    page = '<table><tr><th>n</th><th>x</th></tr><tr><td><a href="/wiki/A_b">A</a> and <a class="mw-selflink selflink">me</a></td><td>1</td></tr></table>'
    cells = html.html_cells(spark.createDataFrame([("http://en.wikipedia.org/wiki/My_page", page)], "url string, html string"))
    links = spark.createDataFrame([("A b", "Q1"), ("My page", "Q2")], "title string, entity_id string")
    corpus = html.linked_tables(cells, links, by_title=True)
    assert [(r["entity_id"], r["url"]) for r in corpus.links.orderBy("nr").collect()] == [("Q1", "http://en.wikipedia.org/wiki/A_b"), ("Q2", "http://en.wikipedia.org/wiki/My_page")]
    assert [r["name"] for r in corpus.columns.orderBy("col").collect()] == ["n", "x"] and corpus.contexts.first()["title"] == "My page"


def test_csv_and_json_tables(spark, tmp_path):
    (tmp_path / "one.csv").write_text("﻿name,born\nAda,1815\n\"Li, Bo\",701\n", encoding="utf-8")
    (tmp_path / "one.links.tsv").write_text('0\t0\tQ7259\tQ1:0.25\tQ2\n1\t0\thttp://www.wikidata.org/entity/Q7071\n1\t1\t{"start": 0, "end": 2, "url": "u", "entity_id": null, "candidates": [{"entity_id": "Q9", "prob": 0.5}]}\n0\t1\t \tQ5:0.5\n')
    (tmp_path / "two.csv").write_text("x\n1\n")
    corpus = tables.read_corpus(spark, f"{tmp_path}/*.csv")
    assert {(r["table_id"], r["n_rows"], r["n_cols"], r["n_cells"]) for r in corpus.shape().collect()} == {("one", 2, 2, 4), ("two", 1, 1, 1)}
    assert [r["name"] for r in corpus.columns.where("table_id = 'one'").orderBy("col").collect()] == ["name", "born"]
    got = {(r["row"], r["col"]): (r["entity_id"], r["end"], [(c["entity_id"], c["prob"]) for c in r["candidates"]]) for r in corpus.links.collect()}
    assert got == {(0, 0): ("Q7259", 3, [("Q7259", 1.0)]), (1, 0): ("Q7071", 6, [("Q7071", 1.0)]), (1, 1): (None, 2, [("Q9", 0.5)]), (0, 1): (None, 4, [("Q5", 0.5)])}
    lines = spark.createDataFrame([("one", 0, "0\t0\tQ7259\tQ1:0.25\tQ2"), ("one", 1, "1\t0\tQ5")], "table_id string, nr int, value string")
    kept = tables.parse_link_lines(lines, corpus.cells, top_k=1, keep_entity_only=False).orderBy("nr").collect()
    assert [[(c["entity_id"], c["prob"]) for c in r["candidates"]] for r in kept] == [[("Q1", 0.25)], []]
    for r in tables.to_json(corpus).collect():
        (tmp_path / f"{r['table_id']}.json").write_text(r["value"])
    again = tables.read_corpus(spark, f"{tmp_path}/*.json")
    for a, b in zip((corpus.cells, corpus.columns, corpus.links.drop("nr"), corpus.contexts), (again.cells, again.columns, again.links.drop("nr"), again.contexts), strict=True):
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))
    (tmp_path / "one.json").write_text('{"version": "0", "table_id": "one", "columns": []}')
    with pytest.raises(Exception, match="unknown version"):
        tables.read_corpus(spark, f"{tmp_path}/one.json").contexts.collect()
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(Exception, match="is empty"):
        tables.read_csv(spark, f"{tmp_path}/none.csv")[0].collect()
    (tmp_path / "none.csv").unlink()
    assert [r["name"] for r in tables.read_csv(spark, f"{tmp_path}/two.csv", first_row_header=False)[1].collect()] == ["column-000"]
    with pytest.raises(NotImplementedError):
        tables.read_corpus(spark, "a.xml")


def test_named_globs(spark):
    assert tables.named_glob("in/{name}.csv")[0] == "in/*.csv"
    files = spark.createDataFrame([("/d/in/b.csv",), ("/d/in/a.csv",), ("/d/other/a.csv",)], "path string")
    assert [tuple(r) for r in tables.outputs_of(files, "in/{name}.csv", "out/{name}.json").collect()] == [("/d/in/a.csv", "out/a.json"), ("/d/in/b.csv", "out/b.json")]
    with pytest.raises(ValueError, match="unknown wildcards"):
        tables.outputs_of(files, "in/{name}.csv", "out/{other}.json")


def test_stores_and_index(spark, tmp_path):
    base = spark.createDataFrame([("Q1", "a"), ("Q2", "b")], "id string, label string")
    fixed = spark.createDataFrame([("Q2", "c"), ("Q3", "d")], "id string, label string")
    assert {tuple(r) for r in tables.with_overrides(base, fixed).collect()} == {("Q1", "a"), ("Q2", "c"), ("Q3", "d")}
    assert tables.read_store(spark, None, "id string").count() == 0
    index = spark.createDataFrame([("a", "b", 1)], "src string, dst string, n int")
    tables.save_index(index, f"{tmp_path}/index")
    assert tables.load_index(spark, f"{tmp_path}/index").collect() == index.collect()


def test_texts_numbers_and_dates(spark):
    rows = [(1, "cafÃ© ", "1st"), (2, "café", "12.5 km away"), (3, None, None), (4, "Â x 中", "no number")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    got = {r["id"]: (r["x"], r["y"]) for r in df.select("id", text.norm_string(F.col("a")).alias("x"), text.number_unit(F.col("b")).alias("y")).collect()}
    assert got == {1: ("café", None), 2: ("café", "km"), 3: (None, None), 4: ("Â x 中", None)}
    said = spark.createDataFrame([("born 17 January 1967",), ("in 1999",), ("May 2001",), ("nothing",), (None,), ("99999999999999999",)], "t string")
    dates = {r["t"]: r["d"] and tuple(r["d"]) for r in said.select("t", text.fuzzy_date(F.col("t")).alias("d")).collect()}
    assert dates["born 17 January 1967"] == (1967, 1, 17) and dates["in 1999"] == (1999, None, None) and dates["May 2001"] == (2001, 5, None)
    assert dates["nothing"] is None and dates[None] is None and dates["99999999999999999"] in (None, (None, None, None))
    assert text.soft_jaccard_of("a b", "b a") == 1 and text.soft_jaccard_of("martha x", "marhta y") == pytest.approx(0.961111 / 3, abs=1e-5)
    assert text.soft_jaccard_of("x", "y") == 0


def test_best_assignment_equals_all_permutations():
    rng = random.Random(2)
    for _ in range(60):
        n, m = sorted((rng.randint(1, 4), rng.randint(1, 5)))
        scores = [[rng.random() for _ in range(m)] for _ in range(n)]
        best = max(sum(scores[i][c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert sum(text._best_assignment(scores)) == pytest.approx(best)


def test_entity_matcher_takes_the_first_similar_name(spark):
    df = spark.createDataFrame([(["Rome", "Roma"], "Paris, Roma"), (["Rome"], "Berlin")], "names array<string>, cell string")
    assert [r[0] for r in df.select(matchers.entity(F.col("names"), F.col("cell"))).collect()] == [0.95, None]
    kinds = spark.createDataFrame([("quantity", 10.0, 10.0), ("other", 1.0, 1.0)], "kind string, a double, b double")
    sure = matchers.by_type(F.col("kind"), {"quantity": F.col("a")}, {"quantity": F.col("b")})
    assert [r[0] for r in kinds.select(sure).collect()] == [1.0, None]
    with pytest.raises(ValueError, match="already"):
        matchers.register("time_test", matchers.time)


def test_friendly_names_are_for_encyclopedias(spark):
    df = spark.createDataFrame([("http://en.wikipedia.org/wiki/A_(b)",)], "u string")
    assert df.select(text.friendly_id(F.col("u"))).first()[0].startswith("wiki-a-b_")
    with pytest.raises(Exception, match="no friendly name"):
        spark.createDataFrame([("http://a.b/c",)], "u string").select(text.friendly_id(F.col("u"))).collect()


def test_a_class_above_itself_is_an_error(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "c")], "child string, parent string")
    assert ev.check_hierarchy(parents).count() == 2
    with pytest.raises(Exception, match="above itself"):
        ev.check_hierarchy(parents.union(spark.createDataFrame([("c", "a")], "child string, parent string"))).collect()


def test_equivalent_models_have_a_limit(spark):
    edges = [(1, f"class:{i}", f"stmt:{i}", "p") for i in range(9)] + [(1, f"stmt:{i}", f"class:{i + 1}", "p") for i in range(9)]
    df = spark.createDataFrame(edges, "table_id long, src string, dst string, prop string")
    inverse = spark.createDataFrame([("p", "q")], "prop string, inverse string")
    with pytest.raises(Exception, match="too many equivalent"):
        model.equivalents(df, inverse).collect()
    assert model.equivalents(df, inverse, most=511).select("variant").distinct().count() == 512
    data = spark.createDataFrame([(1, "class:0", "stmt:0", "p"), (1, "stmt:0", "data:1", "p")], "table_id long, src string, dst string, prop string")
    with pytest.raises(Exception, match="not invertible"):
        model.equivalents(data, inverse).collect()
    assert model.equivalents(data, inverse, strict=False).count() == 2
    forced = {(r["variant"], r["src"], r["dst"], r["prop"]) for r in model.equivalents(data, inverse, strict=False, force=True).collect()}
    assert {x[1:] for x in forced if x[0] == 1} == {("class:dummy-data:1", "stmt:0", "q"), ("stmt:0", "class:0", "q"), ("class:dummy-data:1", "data:1", "rdfs:label")}


def test_contexts_without_a_title_are_errors(spark):
    with pytest.raises(Exception, match="no title"):
        data_graph.context_nodes(spark.createDataFrame([(1, "Q1", None)], "table_id long, entity_id string, title string")).collect()


def test_models_as_dot_and_merged_claims(spark):
    nodes = spark.createDataFrame([(1, "class:0", "class", 0, 'a "b"')], "table_id long, id string, kind string, col long, label string")
    edges = spark.createDataFrame([(1, "class:0", "data:0", "rdfs:label")], "table_id long, src string, dst string, prop string")
    assert model.as_dot(nodes, edges).first()["dot"].startswith("digraph {\n")
    claims = spark.createDataFrame([(1, 0, "Q1", "p", "s", None, "x"), (1, 0, "Q1", "p", "t", None, "x")], "table_id long, row long, entity string, prop string, stmt string, qual string, value string")
    assert model.merged_entities(claims).first()["props"].count('"x"') == 1


def test_forest_repeats_a_class_under_each_parent(spark):
    from tessera.operators import features

    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("a", "d"), ("e", "x"), ("x", "c")], "child string, parent string")
    asked = spark.createDataFrame([(c,) for c in "acdez"], "class string")
    found = {("/".join(r["path"]), r["depth"], r["is_repeated"]) for r in features.forest(asked, parents).collect()}
    assert found == {("c", 0, False), ("d", 0, False), ("c/a", 1, False), ("d/a", 1, True), ("c/e", 1, False)}
    assert {(r["child"], r["parent"]) for r in features.transitive_reduction(parents).collect()} == {("a", "b"), ("b", "c"), ("a", "d"), ("e", "x"), ("x", "c")}
    with pytest.raises(Exception, match="above itself"):
        features.forest(asked, parents.union(spark.createDataFrame([("c", "a")], "child string, parent string"))).collect()


def test_a_chosen_class_of_all_entities_has_no_label_of_its_own(spark):
    """Only a subject column without a class gets that class's fixed label."""
    cpa = spark.createDataFrame([(t, "col:0", "stmt:a", "p") for t in (1, 2)] + [(t, "stmt:a", "col:1", "p") for t in (1, 2)], "table_id long, src string, dst string, pred string")
    cta = spark.createDataFrame([(1, 1, model.ENTITY), (2, 1, "Q2 Q1")], "table_id long, col long, class string")
    columns = spark.createDataFrame([(t, c, f"c{c}") for t in (1, 2) for c in (0, 1)], "table_id long, col long, name string")
    nodes, _ = model.create(cpa, cta, columns, spark.createDataFrame([("Q2", "two")], "id string, label string"))
    found = {(r["table_id"], r["id"]): r["label"] for r in nodes.where("kind = 'class'").collect()}
    assert found == {(1, "class:0"): "Entity (Q35120)", (1, "class:1"): "Q35120", (2, "class:0"): "Entity (Q35120)", (2, "class:1"): "two (Q2)"}
