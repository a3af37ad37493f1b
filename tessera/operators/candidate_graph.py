"""The candidate graph: the data graph with all cells of a column as one node.

Nodes: a column ``col:c``, an entity ``ent:id``, a literal ``val:text``, a statement ``stmt:source>prop>target``. A statement stands for a source, a property and
the target of its value; qualifiers of the data graph's statements are repeated in each.
``flow``: table_id, u, prop, stmt, v, pred (nodes of this graph), src, dg_stmt, dst (those of the data graph they come from), prob.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATEMENT = "stmt:"


def _column_node(node: Column | str) -> Column:
    """A cell's column, or the node itself; a context is the entity it names."""
    col = F.nullif(F.regexp_extract(node, r"^[0-9]+-([0-9]+)$", 1), F.lit(""))
    return F.coalesce(F.concat(F.lit("col:"), col), F.regexp_replace(node, r"^ctx:", "ent:"))


def build(data_flow: DataFrame) -> DataFrame:
    """The candidate graph's flow from the data graph's (see ``data_graph``): value legs name the statements, qualifier legs join them by their statement."""
    key = ["table_id", "src", "prop", "stmt"]
    together = data_flow.repartition(*key)  # all that follows goes by these four: the flow moves once
    legs = together.groupBy(*key, "dst", "pred").agg(F.max("prob").alias("prob"))
    return from_statements(legs.groupBy(*key).agg(F.collect_list(F.struct("dst", "pred", "prob")).alias("legs")))


def from_statements(statements: DataFrame) -> DataFrame:
    """The candidate graph's flow from the data graph's as statements with their legs (``table_id, src, prop, stmt, legs``; a leg without ``prob`` is certain), each on its own: nothing moves."""
    sure = "prob" in statements.schema["legs"].dataType.elementType.names
    ends = F.transform("legs", lambda x: F.struct(x["dst"].alias("dst"), _column_node(x["dst"]).alias("v"), x["pred"].alias("pred"), (x["prob"] if sure else F.lit(1.0)).alias("prob")))
    own = statements.select("table_id", "src", "prop", "stmt", _column_node("src").alias("u"), ends.alias("legs"))
    node = lambda v: F.concat(F.lit(STATEMENT), "u", F.lit(">"), "prop", F.lit(">"), v)
    values = F.array_distinct(F.transform(F.filter("legs", lambda x: x["pred"] == F.col("prop")), lambda x: node(x["v"])))
    each = own.withColumn("stmts", values).select("table_id", "src", "prop", "stmt", "u", "stmts", F.explode("legs").alias("leg"))
    named = F.when(F.col("leg.pred") == F.col("prop"), F.array(node(F.col("leg.v")))).otherwise(F.col("stmts"))
    return each.select("table_id", "u", "prop", F.explode(named).alias("node"), "leg.v", "leg.pred", "src", F.col("stmt").alias("dg_stmt"), "leg.dst", "leg.prob").select("table_id", "u", "prop", F.col("node").alias("stmt"), "v", "pred", "src", "dg_stmt", "dst", "prob")


def relations(flow: DataFrame) -> DataFrame:
    """``table_id, u, v, stmt, prop, pred``: every way out of a statement with the way into it."""
    return flow.select("table_id", "u", "v", "stmt", "prop", "pred").distinct()


def edges(flow: DataFrame) -> DataFrame:
    """``table_id, src, dst, pred``: edges into statements and out of them."""
    into, out = F.struct(F.col("u").alias("src"), F.col("stmt").alias("dst"), F.col("prop").alias("pred")), F.struct(F.col("stmt").alias("src"), F.col("v").alias("dst"), "pred")
    return flow.select("table_id", F.explode(F.array(into, out)).alias("e")).select("table_id", "e.*").distinct()


def repeated_flow(flow: DataFrame) -> DataFrame:
    """Flow that occurs more than once for its source, target and statement of the data graph: none, if the graph is sound."""
    key = ["table_id", "stmt", "src", "dg_stmt", "dst", "pred"]
    return flow.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def edge_frequency(flow: DataFrame) -> DataFrame:
    """``table_id, stmt, v, pred, freq, unique_freq``: by edge out of a statement the pairs of nodes that it stands for, and the distinct pairs of their entities.

    A data statement names its source's entity, so distinct sources are told by it. The flow moves once, to its edge and target, where pairs are counted.
    """
    edge, entity = ["table_id", "stmt", "v", "pred"], F.split("dg_stmt", r"\|")[0]
    by_target = flow.select(*edge, "dst", "src", entity.alias("entity")).repartition(*edge, "dst")
    pairs = by_target.groupBy(*edge, "dst", "src").agg(F.collect_set("entity").alias("entities"))  # of one cell: few
    by_entity = pairs.select(*edge, "dst", F.posexplode("entities").alias("nr", "entity")).groupBy(*edge, "dst", "entity").agg(F.count_if(F.col("nr") == 0).alias("n"))
    return by_entity.groupBy(*edge).agg(F.sum("n").alias("freq"), F.count("*").alias("unique_freq"))


def without_dangling(edges: DataFrame) -> DataFrame:
    """``edges`` without statements that lack a way in or a way out; one pass, for which edges move once, to their statement."""
    into = F.col("dst").startswith(STATEMENT)
    own = Window.partitionBy("table_id", "node")
    named = edges.withColumn("node", F.when(into, F.col("dst")).otherwise(F.col("src")))
    judged = named.withColumn("whole", F.max(into).over(own) & F.max(F.col("src").startswith(STATEMENT)).over(own))
    return judged.where("whole").select(*edges.columns)


def degrees(edges: DataFrame) -> DataFrame:
    """``table_id, node, n_in, n_out`` of every node that an edge touches."""
    ways = edges.select("table_id", F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("table_id", "dst", F.lit(1), F.lit(0)))
    return ways.groupBy("table_id", "node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def above(edges: DataFrame, probabilities: DataFrame, threshold: float) -> DataFrame:
    """``edges`` with ``prob``, those of ``threshold`` or more, without dangling statements. Nodes that no edge is left to are gone with them."""
    likely = probabilities.where(F.col("prob") >= threshold)
    return without_dangling(edges.join(likely, ["table_id", "src", "dst", "pred"]))


def drawn(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """``table_id, line``: each table's graph as the lines of a drawing in DOT: columns (``columns``: table_id, col, name) as gold text, all other nodes as grey ellipses."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit("'")), F.lit('"'))
    nodes = edges.select("table_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    named = nodes.join(columns.select("table_id", F.concat(F.lit("col:"), F.col("col").cast("string")).alias("node"), "col", "name"), ["table_id", "node"], "left")
    label = F.when(F.col("name").isNotNull(), F.concat("name", F.lit(" (column "), F.col("col").cast("string"), F.lit(")"))).otherwise(F.regexp_replace("node", "^(?:ent|val):", ""))
    style = F.when(F.col("node").startswith("col:"), "shape=plaintext, style=filled, fillcolor=gold").otherwise("shape=ellipse, style=filled, color=white, fillcolor=lightgray")
    lines = named.select("table_id", F.concat(quoted(F.col("node")), F.lit(" [label="), quoted(label), F.lit(", "), style, F.lit("];")).alias("line"))
    arrows = edges.select("table_id", F.concat(quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.lit(" [label="), quoted(F.col("pred")), F.lit("];")).alias("line"))
    return lines.unionByName(arrows)


def as_dot(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """``table_id, dot``: each table's drawing as one text."""
    return drawn(edges, columns).groupBy("table_id").agg(F.concat(F.lit("digraph {\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\n}")).alias("dot"))
