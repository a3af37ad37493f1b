"""Solver, arborescence, matchers and links on small cases worked out by hand."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import matchers, text
from tessera.operators import flow, hlmrf, model, selection
from tessera.sources import links


@pytest.mark.parametrize(("prior", "rule", "expected"), [(0.1, 0.8, 0.889), (0.2, 0.5, 0.714)])
def test_solver_reaches_the_closed_form(spark, prior, rule, expected):
    evidence = spark.createDataFrame([(1, "AB", 1.0), (1, "AC", 0.0)], "table_id long, atom string, truth double")
    ground = hlmrf.ground_positive(evidence, rule, "rule").union(hlmrf.ground_negative(evidence.withColumn("truth", F.lit(1.0)), prior, "prior"))
    found = {r["atom"]: r["truth"] for r in hlmrf.solve(ground).collect()}
    assert found["AB"] == pytest.approx(expected, abs=1e-3)
    assert found["AC"] == pytest.approx(0.0, abs=2e-3)


def test_solver_with_coupled_atoms():
    """max(0, x + y - 1)^2 * 4 + (1 - x)^2 + (1 - y)^2 is least at x = y = 5/9 * ... solved by symmetry: x = (1 + 4) / (1 + 8)."""
    found = hlmrf.minimise(np.array([0, 0, 1, 2]), np.array([0, 1, 0, 1]), np.array([1.0, 1.0, -1.0, -1.0]), np.array([-1.0, 1.0, 1.0]), np.array([4.0, 1.0, 1.0]), 2)
    assert found == pytest.approx([5 / 9, 5 / 9], abs=1e-6)


def test_arborescence_is_minimal():
    for seed in range(40):
        rng = random.Random(seed)
        nodes = list(range(5))
        edges = [(u, v, rng.randint(1, 9)) for u in nodes for v in nodes[1:] if u != v and rng.random() < 0.8] + [(0, v, 30) for v in nodes[1:]]
        chosen = selection.arborescence_edges(edges, 0)
        best = None
        for ways in itertools.product(*[[e for e in edges if e[1] == v] for v in nodes[1:]]):
            parent = {v: u for u, v, _ in ways}
            if all(_reaches(parent, v) for v in nodes[1:]):
                cost = sum(w for *_, w in ways)
                best = cost if best is None else min(best, cost)
        assert sum(edges[i][2] for i in chosen) == best
        parent = {edges[i][1]: edges[i][0] for i in chosen}
        assert len(chosen) == 4 and all(_reaches(parent, v) for v in nodes[1:])


def _reaches(parent, v):
    for _ in range(6):
        if v == 0:
            return True
        v = parent.get(v)
    return False


def test_matchers(spark):
    row = spark.range(1).select(
        matchers.quantity(F.lit(100.0), F.lit(103.0)).alias("near"),
        matchers.quantity(F.lit(0.0), F.lit(0.0)).alias("zero"),
        matchers.quantity(F.lit(100.0), F.lit(106.0)).alias("far"),
        matchers.time(text.time_parts(F.lit("+1967-03-17T00:00:00Z")), text.time_parts(F.lit("+1967-00-00T00:00:00Z"))).alias("year"),
        matchers.time(text.time_parts(F.lit("-0044-03-15T00:00:00Z")), text.time_parts(F.lit("+0044-03-15T00:00:00Z"))).alias("era"),
        matchers.match(".string_exact_test,.string_similarity_test", F.lit("colour"), F.lit("color")).alias("edit"),
        text.parse_number(F.lit("about 1,234.5 km")).alias("number"),
        text.norm_string(F.lit(" a b ")).alias("norm"),
    ).first()
    assert row["near"] == pytest.approx(0.92) and row["zero"] == 1.0 and row["far"] is None
    assert row["year"] == 0.8 and row["era"] is None and row["edit"] == 0.95
    assert row["number"] == 1234.5 and row["norm"] == "a b"
    with pytest.raises(KeyError):
        matchers.match("no_such_test", F.lit("a"), F.lit("a"))


def test_links_one_id_everywhere_or_not(spark):
    lines = spark.createDataFrame([("one", "0\t1\tQ5"), ("two", "0\t1\tQ5"), ("two", "1\t1\t\thttp://x/Q7:0.25\tQ8"), ("two", "1\t1\tQ9\tQ1")], "table_id string, value string")
    found = sorted((r["table_id"], r["row"], r["entity_id"] or "", r["candidate"] or "", r["prob"] or 0) for r in links.parse_links(lines).collect())
    assert found == [("one", 0, "Q5", "Q5", 1.0), ("two", 0, "Q5", "", 0), ("two", 1, "", "Q7", 0.25), ("two", 1, "", "Q8", 1.0), ("two", 1, "Q9", "Q1", 1.0)]


def test_csv_tables_of_any_width(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"2,5"\n')
    (tmp_path / "b.csv").write_text("x,y,z\n1,2,3\n")
    found = sorted(tuple(r) for r in links.read_csv_tables(spark, str(tmp_path)).collect())
    assert ("a", 0, 1, "2,5") in found and ("b", 0, 2, "3") in found and ("b", -1, 0, "x") in found and len(found) == 10


def test_minify_undoes_normalise_and_keeps_qualified_statements(spark):
    edges = spark.createDataFrame([(1, "a", "b", "p"), (1, "a", "A", "rdfs:label"), (1, "c", "stmt:1", "q"), (1, "stmt:1", "d", "q"), (1, "stmt:1", "e", "r")], "table_id long, src string, dst string, prop string")
    assert sorted(map(tuple, model.minify(model.normalise(edges)).collect())) == sorted(map(tuple, edges.collect()))


def test_hidden_legs_need_a_direct_way_as_good_from_every_source(spark):
    link, literal = flow.LINK, flow.LITERAL
    rows = [(1, "u", "h", link, 9), (1, "h", "v", literal, 5), (1, "u", "v", link, 1), (2, "u", "h", link, 9), (2, "w", "h", link, 9), (2, "h", "v", literal, 5), (2, "u", "v", link, 1)]
    own = spark.createDataFrame([(t, s, d, "p", "s", m, "", p) for t, s, d, m, p in rows], "table_id long, src string, dst string, prop string, stmt string, method string, arg string, prob long")
    hidden = spark.createDataFrame([(1, "h"), (2, "h")], "table_id long, node string")
    left = {(r["table_id"], r["src"], r["dst"]) for r in flow.prune_hidden(own, hidden).collect()}
    assert (1, "h", "v") not in left and (2, "h", "v") in left and len(left) == 6
