"""Evidence about the relations and types of a candidate graph: one DataFrame for each predicate of the inference model.

``relations``: table_id, u, v, stmt, prop, pred. ``linked``: table_id, row, col of cells with an entity. ``n_rows``: table_id, n_rows. ``data_props``: prop of data properties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.session import staged

RELATION = ["table_id", "u", "v", "stmt", "pred"]


def _column(node: str) -> Column:
    return F.regexp_extract(node, r"^col:([0-9]+)$", 1).try_cast("long")


def _is_column(node: str) -> Column:
    return F.col(node).startswith("col:")


def _flagged(relations: DataFrame, data_props: DataFrame) -> DataFrame:
    """``relations`` with the columns of their ends and whether they go out by a data property."""
    data = data_props.select(F.col("prop").alias("data_pred")).distinct()
    return relations.join(data, F.col("pred") == F.col("data_pred"), "left").select(*relations.columns, F.col("data_pred").isNotNull().alias("is_data"), _column("u").alias("u_col"), _column("v").alias("v_col"))


def _linked_counts(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """``table_id, ones, both``: of a table's rows, how many have an entity in a column (structs ``col, n``), and at both ends of ``pairs`` (table_id, u_col, v_col; structs ``u_col, v_col, n``)."""
    ones = linked.groupBy("table_id", "col").agg(F.count("*").alias("n")).groupBy("table_id").agg(F.collect_list(F.struct("col", "n")).alias("ones"))
    asked = pairs.groupBy("table_id").agg(F.collect_set(F.struct("u_col", "v_col")).alias("asked"))
    rows = linked.groupBy("table_id", "row").agg(F.collect_list("col").alias("cols")).join(asked, "table_id")
    met = rows.select("table_id", F.inline(F.filter("asked", lambda p: F.array_contains("cols", p["u_col"]) & F.array_contains("cols", p["v_col"]))))
    both = met.groupBy("table_id", "u_col", "v_col").agg(F.count("*").alias("n")).groupBy("table_id").agg(F.collect_list(F.struct("u_col", "v_col", "n")).alias("both"))
    return ones.join(both, "table_id", "left")


def possible_links(relations: DataFrame, linked: DataFrame, n_rows: DataFrame, data_props: DataFrame) -> DataFrame:
    """``RELATION, possible``: how many links a relation could have had.

    Neither end a column: one. Both: rows with an entity at the source, and at the target unless the property is a data property. One: rows with an entity in
    that column, but all rows where an entity has a data property. Counts of a table are few and lie in one row of it, so relations move once, to their table.
    """
    flagged = _flagged(relations, data_props)
    pairs = flagged.where("u_col is not null and v_col is not null and not is_data").select("table_id", "u_col", "v_col").distinct()
    counts = n_rows.join(_linked_counts(pairs, linked), "table_id", "left")
    of = lambda found: F.coalesce(F.expr(f"get(filter({found}), 0).n"), F.lit(0))
    n_u, n_v, n_both = of("ones, x -> x.col = u_col"), of("ones, x -> x.col = v_col"), of("both, x -> x.u_col = u_col and x.v_col = v_col")
    u, v = F.col("u_col").isNotNull(), F.col("v_col").isNotNull()
    possible = F.when(~u & ~v, 1).when(u & v, F.when(F.col("is_data"), n_u).otherwise(n_both)).when(u, n_u).otherwise(F.when(F.col("is_data"), F.col("n_rows")).otherwise(n_v))
    return flagged.join(counts, "table_id").select(*RELATION, possible.cast("long").alias("possible"))


def unmatched_links(relations: DataFrame, flow: DataFrame, candidates: DataFrame, statements: DataFrame, qualifiers: DataFrame, n_rows: DataFrame, data_props: DataFrame) -> DataFrame:
    """``RELATION, unmatched``: pairs of nodes that could have the relation, whose source has its property (and qualifier), but do not.

    ``statements``: entity_id, prop; ``qualifiers``: entity_id, prop, qual. Relations without such a pair are left out.
    """
    key, row = [*RELATION, "prop"], lambda node: F.nullif(F.regexp_extract(node, r"^([0-9]+)-", 1), F.lit("")).cast("long")
    flagged = _flagged(relations, data_props).withColumn("free", F.col("v_col").isNull() | F.col("is_data")).drop("is_data")
    of_columns, of_entities = flagged.where("u_col is not null"), flagged.where("u_col is null")
    own = statements.select("entity_id", "prop", F.col("prop").alias("pred")).union(qualifiers.select("entity_id", "prop", "qual")).distinct()
    cells = candidates.select("table_id", "row", "col", "entity_id").distinct()
    target = cells.select("table_id", "row", F.col("col").alias("v_col")).distinct()
    # sources that are columns: rows of which an entity has the property and the qualifier
    asked = of_columns.select("table_id", "u_col", "prop", "pred").distinct()
    has = cells.withColumnRenamed("col", "u_col").join(own, "entity_id").select("table_id", "row", "u_col", "prop", "pred").distinct().join(asked, ["table_id", "u_col", "prop", "pred"], "left_semi")
    # sources that are entities: every row, or none in particular where the target is no column either
    named = of_entities.withColumn("entity_id", F.regexp_extract("u", r"^ent:(.*)$", 1)).join(own, ["entity_id", "prop", "pred"], "left_semi").join(n_rows, "table_id")
    named = named.withColumn("rows", F.when(F.col("v_col").isNull(), 1).otherwise(F.col("n_rows")).cast("long")).where("rows > 0").select(*key, "v_col", "free", "rows")
    # relations are not spread over rows: the rows that each could have are counted by columns, those that it has are taken off
    at = ["table_id", "u_col", "prop", "pred"]
    both = has.join(of_columns.where("not free").select(*at, "v_col").distinct(), at).join(target, ["table_id", "row", "v_col"])
    could = of_columns.where("free").join(has.groupBy(*at).agg(F.count("*").alias("n")), at).select(*key, "n")
    could = could.unionByName(of_columns.where("not free").join(both.groupBy(*at, "v_col").agg(F.count("*").alias("n")), [*at, "v_col"]).select(*key, "n"))
    could = could.unionByName(named.where("free").select(*key, F.col("rows").alias("n")))
    could = could.unionByName(named.where("not free").join(target, ["table_id", "v_col"]).where("row >= 0 and row < rows").groupBy(*key).agg(F.count("*").alias("n")))
    met = flow.select(*RELATION, F.coalesce(row("src"), row("dst"), F.lit(0).cast("long")).alias("row")).distinct()
    there = lambda df: df.where("free").drop("v_col").unionByName(df.where("not free").join(target, ["table_id", "row", "v_col"], "left_semi").drop("v_col"))
    taken = there(met.join(of_columns, RELATION).join(has, [*at, "row"], "left_semi")).select(*key)
    taken = taken.unionByName(there(met.join(named, RELATION).where("row >= 0 and row < rows")).select(*key))
    left = could.unionByName(taken.select(*key, F.lit(-1).cast("long").alias("n"))).groupBy(*RELATION).agg(F.sum("n").alias("unmatched"))
    return left.where("unmatched > 0")


def relation_frequency(flow: DataFrame) -> DataFrame:
    """``RELATION, score, pairs``: the best probability of each pair of nodes, summed, and the pairs."""
    pairs = flow.groupBy(*RELATION, "src", "dst").agg(F.max("prob").alias("prob"))
    return pairs.groupBy(*RELATION).agg(F.sum("prob").alias("score"), F.count("*").alias("pairs"))


def relation_shares(frequency: DataFrame, possible: DataFrame, unmatched: DataFrame, n_rows: DataFrame) -> DataFrame:
    """The five shares of each relation: score and unmatched links over rows, over possible links, and over the most links any relation of its pair could have had."""
    whole = frequency.join(n_rows, "table_id").join(possible, RELATION, "left").join(unmatched, RELATION, "left").fillna(0, ["possible", "unmatched"])
    most = F.max(F.col("unmatched") + F.col("pairs")).over(Window.partitionBy("table_id", "u", "v"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    named = whole.withColumn("most", most)
    return named.select(
        *RELATION,
        share("score", "n_rows").alias("REL_FREQ_OVER_ROW"),
        share("score", "possible").alias("REL_FREQ_OVER_ENT_ROW"),
        share("score", "most").alias("REL_FREQ_OVER_POS_REL"),
        share("unmatched", "possible").alias("REL_FREQ_UNMATCH_OVER_ENT_ROW"),
        share("unmatched", "most").alias("REL_FREQ_UNMATCH_OVER_POS_REL"),
    )


def header_similarity(asked: DataFrame, label: str, header: str, similarity: Callable[[Column, Column], Column] = text.soft_jaccard) -> DataFrame:
    """``asked`` with ``similarity`` of two text columns, computed once for each pair of texts that occurs."""
    pairs = asked.select(label, header).distinct()
    return asked.join(pairs.withColumn("similarity", similarity(F.col(label), F.col(header))), [label, header], "left")


def value_keys(cells: DataFrame, links: DataFrame) -> DataFrame:
    """``table_id, row, col, key``: what tells values of a column apart: the entities a cell is linked to (``links``: table_id, row, col, nr, entity_id), or else its trimmed text."""
    named = links.where("entity_id is not null").groupBy("table_id", "row", "col").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("nr", "entity_id"))), lambda x: x["entity_id"])).alias("ids"))
    return cells.join(named, ["table_id", "row", "col"], "left").select("table_id", "row", "col", F.coalesce("ids", F.trim("value")).alias("key"))


def dependencies(keys: DataFrame, pairs: DataFrame, tolerance_percent: int = 1) -> DataFrame:
    """``table_id, src_col, dst_col, depends``: whether a column's value settles another's, for the pairs asked for; pairs of a column without cells depend."""
    asked = pairs.distinct().groupBy("table_id").agg(F.collect_list(F.struct("src_col", "dst_col")).alias("asked"))
    rows = keys.repartition("table_id").groupBy("table_id", "row").agg(F.collect_list(F.struct("col", "key")).alias("own"))  # all that follows goes by tables: keys move once
    each = rows.join(asked, "table_id").select("table_id", "own", F.inline("asked"))
    each = each.select("table_id", "src_col", "dst_col", "own", F.explode(F.expr("filter(own, o -> o.col = src_col)")["key"]).alias("src"))
    met = each.select("table_id", "src_col", "dst_col", "src", F.explode(F.expr("filter(own, o -> o.col = dst_col)")["key"]).alias("dst")).distinct()
    many = met.groupBy("table_id", "src_col", "dst_col", "src").agg(F.count("*").alias("n"))
    judged = many.groupBy("table_id", "src_col", "dst_col").agg((100 * F.count_if(F.col("n") > 1) <= tolerance_percent * F.count("*")).alias("holds"))
    return pairs.distinct().join(judged, ["table_id", "src_col", "dst_col"], "left").select("table_id", "src_col", "dst_col", F.coalesce("holds", F.lit(True)).alias("depends"))


def statement_facts(relations: DataFrame) -> dict[str, DataFrame]:
    """``REL`` and its parts, ``STATEMENT_PROPERTY``, and what kind each node is."""
    nodes = relations.select("table_id", F.explode(F.array("u", "v", "stmt")).alias("node")).distinct()
    statement = F.col("node").startswith("stmt:")
    return {
        "REL": relations.select(*RELATION),
        "REL_PROP": relations.where("prop = pred").select(*RELATION),
        "REL_QUAL": relations.where("prop != pred").select(*RELATION),
        "STATEMENT_PROPERTY": relations.where("prop = pred").select("table_id", "stmt", "pred").distinct(),
        "COLUMN": nodes.where(_is_column("node")),
        "STATEMENT": nodes.where(statement),
        "NOT_STATEMENT": nodes.where(~statement),
    }


def has_type(relations: DataFrame, types: DataFrame) -> DataFrame:
    """``table_id, node, truth``: typed columns (truth null: to be inferred), entities 1, literals and untyped columns 0. ``types``: table_id, node, class."""
    nodes = relations.select("table_id", F.explode(F.array("u", "v")).alias("node")).distinct()
    typed = types.select("table_id", "node").distinct()
    truth = F.when(F.col("node").startswith("ent:"), 1.0).otherwise(0.0)
    return typed.withColumn("truth", F.lit(None).cast("double")).unionByName(nodes.join(typed, ["table_id", "node"], "left_anti").withColumn("truth", truth))


def used_properties(relations: DataFrame) -> DataFrame:
    return relations.select("table_id", F.explode(F.array("prop", "pred")).alias("prop")).distinct()


def ancestors_used(used: DataFrame, ancestors: DataFrame, what: str) -> DataFrame:
    """``table_id, <what>, ancestor``: pairs of which both are used in the table (``used``: table_id, <what>; ``ancestors``: <what>, ancestor)."""
    mine = used.select("table_id", what).distinct()
    return mine.join(ancestors, what).join(mine.withColumnRenamed(what, "ancestor"), ["table_id", "ancestor"], "left_semi").select("table_id", what, "ancestor").distinct()


def property_kinds(used: DataFrame, data_props: DataFrame) -> dict[str, DataFrame]:
    """``OBJECT_PROPERTY`` and ``DATA_PROPERTY`` of each table: table_id, prop."""
    data = data_props.select("prop").distinct()
    return {"DATA_PROPERTY": used.join(data, "prop", "left_semi").select("table_id", "prop"), "OBJECT_PROPERTY": used.join(data, "prop", "left_anti").select("table_id", "prop")}


def accepted_classes(relations: DataFrame, types: DataFrame, declared: DataFrame, any_class: list[str], at: str) -> DataFrame:
    """``table_id, prop, class``: candidate classes that a property's declared domain (``at`` is ``u``) or range (``v``) accepts. Properties in ``any_class`` accept all."""
    used = relations.select("table_id", F.col(at).alias("node"), F.col("prop" if at == "u" else "pred").alias("prop")).distinct()
    asked = used.join(types, ["table_id", "node"]).select("table_id", "prop", "class").distinct()
    return asked.join(declared.select("prop", "class").distinct(), ["prop", "class"], "left_semi").select("table_id", "prop", "class").unionByName(asked.where(F.col("prop").isin(any_class))).distinct()


def not_range(types: DataFrame, incoming: DataFrame, subjects: DataFrame, closure: DataFrame) -> DataFrame:
    """``prop, class``: candidate classes of nodes that a property leads to which neither are nor lie under any of the property's declared classes.

    ``types``: table_id, node, class; ``incoming``: table_id, node, prop; ``subjects``: prop, class, whose properties alone are judged; ``closure``: child, ancestor.
    """
    declared = subjects.select("prop", "class").distinct()
    asked = incoming.join(declared.select("prop").distinct(), "prop", "left_semi").join(types, ["table_id", "node"]).select("prop", "class").distinct()
    within = asked.join(closure, asked["class"] == closure["child"]).select("prop", asked["class"], "ancestor")
    allowed = within.join(declared.withColumnRenamed("class", "ancestor"), ["prop", "ancestor"], "left_semi").select("prop", "class").union(declared)
    return asked.join(allowed, ["prop", "class"], "left_anti")


def ancestors(parents: DataFrame, steps: int = 100) -> DataFrame:
    """``child, ancestor, distance``: every class above another and its least distance, step by step until nothing new is reached."""
    edges = staged(parents.select("child", "parent").distinct(), "parents")
    out = step = staged(edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")), "step")
    up = edges.select(F.col("child").alias("ancestor"), "parent")
    for d in range(2, steps + 1):
        fresh = step.join(up, "ancestor").select("child", F.col("parent").alias("ancestor")).distinct().join(out, ["child", "ancestor"], "left_anti")
        step = staged(fresh.withColumn("distance", F.lit(d)), "step")
        if not step.take(1):
            break
        out = out.unionByName(step)
    return out


def _upward(starts: DataFrame, parents: DataFrame) -> DataFrame:
    """``table_id, node, class, distance``: the start classes and all above them, at their least distance."""
    own = starts.select("table_id", "node", "class").distinct()
    above = own.join(ancestors(parents), own["class"] == F.col("child")).select("table_id", "node", F.col("ancestor").alias("class"), "distance")
    return own.withColumn("distance", F.lit(0)).unionByName(above).groupBy("table_id", "node", "class").agg(F.min("distance").alias("distance"))


def _over_longest(reached: DataFrame) -> DataFrame:
    longest = F.greatest(F.lit(1), F.max("distance").over(Window.partitionBy("table_id", "node")))
    return reached.withColumn("longest", longest).withColumn("truth", F.coalesce(F.col("distance") / F.col("longest"), F.lit(0.5)))


def type_distance(types: DataFrame, frequency: DataFrame, parents: DataFrame, top: int = 2) -> DataFrame:
    """``table_id, node, class, truth``: how far a candidate class lies above the ``top`` most frequent direct types, as a share of the farthest.

    Classes that are not above them count as half the farthest. ``types`` and ``frequency``: table_id, node, class[, freq].
    """
    order = Window.partitionBy("table_id", "node").orderBy(F.col("freq").desc(), "class")
    starts = frequency.withColumn("nr", F.row_number().over(order)).where(F.col("nr") <= top)
    reached = types.select("table_id", "node", "class").distinct().join(_upward(starts, parents), ["table_id", "node", "class"], "left")
    return _over_longest(reached).select("table_id", "node", "class", "truth")


def absolute_type_distance(types: DataFrame, parents: DataFrame) -> DataFrame:
    """``table_id, node, class, truth``: how far a candidate class lies above the candidates that have none below them, as a share of the farthest."""
    mine = types.select("table_id", "node", "class").distinct()
    above = mine.join(parents, mine["class"] == parents["child"]).select("table_id", "node", F.col("parent").alias("class")).distinct()
    leaves = mine.join(above, ["table_id", "node", "class"], "left_anti")
    return _over_longest(mine.join(_upward(leaves, parents), ["table_id", "node", "class"], "left")).select("table_id", "node", "class", "truth")


def check_hierarchy(parents: DataFrame) -> DataFrame:
    """``parents`` itself; a class that is above itself is an error, found when the rows are read."""
    loops = ancestors(parents).where("child = ancestor").select("child", F.lit(True).alias("loop"))
    checked = parents.join(loops, "child", "left")
    return checked.select("child", F.when(F.col("loop"), F.raise_error(F.concat(F.lit("a class is above itself: "), "child"))).otherwise(F.col("parent")).alias("parent"))


def coverage(cells: DataFrame, spans: DataFrame, least: float = 0.8) -> DataFrame:
    """``table_id, col, coverage, is_entity_column``: the mean part of its cells that links cover (``spans``: table_id, row, col, start, end).

    A column counts as one of entities from ``least`` on, or if nothing is covered and its cells are all but empty.
    """
    lengths = spans.groupBy("table_id", "row", "col").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    joined = cells.join(lengths, ["table_id", "row", "col"], "left")
    part = F.coalesce("covered", F.lit(0)) / F.greatest(F.lit(1), F.length("value"))
    means = joined.groupBy("table_id", "col").agg(F.avg(part).alias("coverage"), F.avg(F.length("value")).alias("length"))
    return means.select("table_id", "col", "coverage", ((F.col("coverage") >= least) | ((F.col("coverage") == 0) & (F.col("length") < 1))).alias("is_entity_column"))
