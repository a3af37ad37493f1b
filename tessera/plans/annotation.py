"""The annotation life cycle over the star-schema tables: data graph, candidate graph, evidence, inference, selection and model.

Every table (a block of orders) has its page's entity, a nation, as context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import matchers, text
from tessera.operators import candidate_graph as graph
from tessera.operators import candidates as types_of
from tessera.operators import data_graph, flow, hlmrf, kg, model, models, rules, selection, steiner
from tessera.operators import evidence as ev
from tessera.plans import star
from tessera.plans.registry import query
from tessera.session import staged
from tessera.sources import context, html, tables

#: Nations, which contexts are taken from.
NATIONS = 25
TABLE = f"l_orderkey div {star.ORDERS}"


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``table_id, entity_id, title``: each table's page."""
    tables = star.read(spark, sf_dir, "lineitem").select(F.expr(TABLE).alias("table_id")).distinct()
    nation = star.read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("title"))
    return tables.join(nation, F.col("table_id") % NATIONS == F.col("n_nationkey")).select("table_id", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("entity_id"), "title")


def texts() -> Column:
    """The texts of a line item's four columns."""
    return F.array(F.concat(F.lit(" order "), F.col("l_orderkey").cast("string")), F.concat(F.lit("part "), F.col("l_partkey").cast("string")), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")), F.col("l_quantity").cast("int").cast("string"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``table_id, row, col, value``: the texts of the four columns."""
    return star.numbered_rows(spark, sf_dir).select("table_id", "row", F.posexplode(texts()).alias("col", "value"))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity_id, prop, stmt_idx, target, text``: the own value of every statement."""
    return star.statements(spark, sf_dir).withColumn("text", F.lit(None).cast("string"))


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(data_graph.ends(star.candidates(spark, sf_dir), contexts(spark, sf_dir)), "ends")


def _statements(spark: SparkSession, sf_dir: str, own_values: bool = True) -> DataFrame:
    """Statements of cells and contexts with what they meet. Rows lie by table, statements are whole: both move once, to the entity they are of. Lines without an order
    are in no table and say nothing."""
    pages = contexts(spark, sf_dir).where("table_id is not null").select("table_id", "entity_id")
    return data_graph.statements_met(star.linked_rows(spark, sf_dir), pages, star.statements_whole(spark, sf_dir, own_values))


def object_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(data_graph.flow_of(_statements(spark, sf_dir)), "flow")


_ENDS = """, ctx as (select distinct table_id, 'N' || (table_id % 25) as entity_id from nr),
    en as materialized (select table_id, "row" || '-' || col as node, cast("row" as bigint) as "row", cast(col as bigint) as col, entity_id from cand union all select table_id, 'ctx:' || entity_id, null, null, entity_id from ctx)"""
_FLOW = (
    _ENDS
    + """, hit as materialized (select u.table_id, u.node, v.node as v, h.src, h.dst, h.prop, h.stmt_idx, h.quals, h.is_value, h.src || '|' || h.prop || '|' || h.stmt_idx as stmt from en u join hop h on h.src = u.entity_id
        join en v on v.table_id = u.table_id and v.entity_id = h.dst and (u."row" is null or v."row" is null or u."row" = v."row") and u.node <> v.node where h.src <> h.dst),
    fl as materialized (select table_id, node as src, prop, stmt, v as dst, prop as pred from hit where is_value union select table_id, node, prop, stmt, v, quals from hit where quals <> ''
        union select table_id, node, hit.prop, stmt, 'ent:' || target, hit.prop from hit join stm on stm.entity_id = hit.src and stm.prop = hit.prop and stm.stmt_idx = hit.stmt_idx where not is_value)"""
)


@query(_ENDS + """ select n.table_id, n."row" || '-' || c.col as node, cast(c.col as bigint) as col, case c.col when 0 then 'O' || l_orderkey when 1 then 'P' || l_partkey when 2 then 'S' || l_suppkey else '' end as entities from nr n, (select unnest([0, 1, 2, 3]) as col) c""")
def dg_cells(spark, sf_dir):
    """Cells of the data graph with their entities."""
    found = data_graph.cell_nodes(cells(spark, sf_dir), star.candidates(spark, sf_dir))
    return found.select("table_id", "node", "col", F.array_join("entity_ids", ",").alias("entities"))


@query("select table_id, 'ctx:N' || (table_id % 25) as node, n_name as title, length(n_name) as \"end\" from (select distinct table_id from nr) join nation on n_nationkey = table_id % 25")
def dg_contexts(spark, sf_dir):
    return data_graph.context_nodes(contexts(spark, sf_dir)).select("table_id", "node", "title", F.col("end").cast("long").alias("end"))


@query(_ENDS + """ select u.table_id, u.node as u, v.node as v from en u join en v on v.table_id = u.table_id and v."row" = u."row" and u.col < v.col union all select u.table_id, u.node, 'ctx:' || c.entity_id from en u join ctx c on c.table_id = u.table_id where u."row" is not null""")
def dg_pairs(spark, sf_dir):
    """Pairs of linked cells of a row, and of cells with their context."""
    return data_graph.node_pairs(star.candidates(spark, sf_dir).select("table_id", "row", "col").distinct(), contexts(spark, sf_dir))


@query(_FLOW + " select * from fl")
def dg_object_flow(spark, sf_dir):
    """One-hop flow between cells, and between cells and contexts, in both directions."""
    return data_graph.flow_of(_statements(spark, sf_dir)).select("table_id", "src", "prop", "stmt", "dst", "pred")


def _supplier_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers a hundred to a table, each beside a region: the nation between them is no cell."""
    supplier = star.read(spark, sf_dir, "supplier")
    table, row = F.expr("s_suppkey div 100").alias("table_id"), (F.col("s_suppkey") % 100).alias("row")
    own = F.array(F.struct(F.lit(0).alias("col"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("entity_id")), F.struct(F.lit(1).alias("col"), F.concat(F.lit("R"), (F.col("s_suppkey") % 5).cast("string")).alias("entity_id")))
    return supplier.select(table, row, F.explode(own).alias("c")).select("table_id", "row", "c.*")


@query(
    """, m as (select s_suppkey // 100 as table_id, (s_suppkey % 100) || '-0' as u, (s_suppkey % 100) || '-1' as v, 'S' || s_suppkey as s, 'N' || n_nationkey as n from supplier join nation on n_nationkey = s_nationkey where n_regionkey = s_suppkey % 5)
    select table_id, u as src, 'in_nation' as prop, s || '|in_nation|0' as stmt, 'ent:' || n as dst, 'in_nation' as pred from m union all select distinct table_id, 'ent:' || n, 'in_region', n || '|in_region|0', v, 'in_region' from m"""
)
def dg_two_hop(spark, sf_dir):
    """Flow from a supplier through its nation to the region beside it."""
    index = kg.one_hop(star.statements(spark, sf_dir), star.qualifiers(spark, sf_dir))
    found = data_graph.two_hop_flow(data_graph.ends(_supplier_tables(spark, sf_dir)), index)
    return found.select("table_id", "src", "prop", "stmt", "dst", "pred")


def _literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders and their items say in numbers and dates: statements' own values, and the items' qualifiers."""
    orders = star.read(spark, sf_dir, "orders")
    lines = star.line_statements(spark, sf_dir)
    order = lambda key: F.concat(F.lit("O"), F.col(key).cast("string")).alias("entity_id")
    no_number, no_text = F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("stamp")
    none = F.lit(None).cast("string").alias("qual")
    stamp = lambda c: F.concat(F.lit("+"), F.date_format(c, "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("stamp")
    total = orders.select(order("o_orderkey"), F.lit("total").alias("prop"), F.lit(0).alias("stmt_idx"), none, F.lit("quantity").alias("kind"), F.col("o_totalprice").cast("double").alias("num"), no_text)
    date = orders.select(order("o_orderkey"), F.lit("date"), F.lit(0), none, F.lit("time"), no_number, stamp("o_orderdate"))
    quantity = lines.select(order("l_orderkey"), F.lit("has_item"), "stmt_idx", F.lit("quantity"), F.lit("quantity"), F.col("l_quantity").cast("double"), no_text)
    shipped = lines.select(order("l_orderkey"), F.lit("has_item"), "stmt_idx", F.lit("shipped"), F.lit("time"), no_number, stamp("l_shipdate"))
    return total.union(date).union(quantity).union(shipped)


@query(
    """, cell as (select table_id, "row", 3 as col, cast(l_quantity as double) as num, l_shipdate as day, 'O' || l_orderkey as e, l_orderkey from nr),
    lit as (select 'O' || l_orderkey as e, stmt_idx, cast(l_quantity as double) as num, l_shipdate as day from ls),
    h as (select c.table_id, c."row", c.e, 'has_item' as prop, l.stmt_idx, '3' as col, 'quantity' as pred, case when abs(l.num - c.num) < 1e-5 then 10000 else cast(floor(round((0.95 - abs(l.num - c.num) / abs(l.num)) * 10000, 4)) as bigint) end as prob from cell c join lit l on l.e = c.e where abs(l.num - c.num) < 1e-5 or abs(l.num - c.num) / abs(l.num) < 0.05
        union all select c.table_id, c."row", c.e, 'has_item', l.stmt_idx, '4', 'shipped', case when l.day = c.day then 10000 else 7500 end from cell c join lit l on l.e = c.e where year(l.day) = year(c.day) and (l.day = c.day or (month(c.day) = 1 and day(c.day) = 1))
        union all select c.table_id, c."row", c.e, 'date', 0, '4', 'date', case when cast(o_orderdate as date) = c.day then 10000 else 7500 end from cell c join orders on o_orderkey = c.l_orderkey where year(o_orderdate) = year(c.day) and (cast(o_orderdate as date) = c.day or (month(c.day) = 1 and day(c.day) = 1))
        union all select c.table_id, c."row", c.e, 'total', 0, '3', 'total', case when abs(o_totalprice - c.num) < 1e-5 then 10000 else cast(floor(round((0.95 - abs(o_totalprice - c.num) / abs(o_totalprice)) * 10000, 4)) as bigint) end from cell c join orders on o_orderkey = c.l_orderkey where abs(o_totalprice - c.num) < 1e-5 or abs(o_totalprice - c.num) / abs(o_totalprice) < 0.05)
    select table_id, "row" || '-0' as src, prop, e || '|' || prop || '|' || stmt_idx as stmt, "row" || '-' || col as dst, pred, cast(prob as bigint) as prob from h
    union select h.table_id, h."row" || '-0', h.prop, e || '|' || h.prop || '|' || h.stmt_idx, 'ent:' || target, h.prop, 10000 from h join stm on stm.entity_id = e and stm.prop = h.prop and stm.stmt_idx = h.stmt_idx where pred <> h.prop"""
)
def dg_value_flow(spark, sf_dir):
    """Flow from orders to the cells of their row that say a number or a date that a statement or a qualifier says."""
    rows = star.numbered_rows(spark, sf_dir)
    of = F.array(F.struct(F.lit(3).alias("col"), F.col("l_quantity").cast("double").alias("number"), F.lit(None).cast("string").alias("day")), F.struct(F.lit(4).alias("col"), F.lit(None).cast("double").alias("number"), F.concat(F.lit("+"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("day")))
    literal = rows.select("table_id", "row", F.explode(of).alias("c")).select("table_id", "row", "c.*").withColumn("date", text.time_parts(F.col("day")))
    matched = {"quantity": matchers.quantity(F.col("num"), F.col("number")), "time": matchers.time(text.time_parts(F.col("stamp")), F.col("date"))}
    own = data_graph.ends(star.candidates(spark, sf_dir).where(F.col("col") == star.ORDER))
    found = data_graph.value_flow(own, literal, _literals(spark, sf_dir), matched, values(spark, sf_dir))
    return found.select("table_id", "src", "prop", "stmt", "dst", "pred", F.floor(F.round(F.col("prob") * 10000, 4)).cast("long").alias("prob"))


@query(
    """, l as (select c_custkey // 100 as table_id, 'C' || c_custkey as src, 'R' || n_regionkey as dst, 'C' || c_custkey as entity_id from customer join nation on n_nationkey = c_nationkey)
    select table_id, src, 'located_in' as prop, entity_id || '|located_in|' || (case when cast(substr(src, 2) as bigint) % 2 = 0 then 7 else 9 end) as stmt, dst, cast(substr(src, 2) as bigint) % 2 = 0 as in_graph from l"""
)
def dg_infer_apply(spark, sf_dir):
    """Customers in nations in regions, one property: what follows takes the customer's statement with that value, or a new one with the next index."""
    customer, nation = star.read(spark, sf_dir, "customer"), star.read(spark, sf_dir, "nation")
    name = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    table = F.expr("c_custkey div 100").alias("table_id")
    leg = lambda df, src, dst: df.select("table_id", src.alias("src"), F.lit("located_in").alias("prop"), F.concat(src, F.lit("|located_in|0")).alias("stmt"), dst.alias("dst"), F.lit("located_in").alias("pred"), F.lit(flow.LINK).alias("method"), F.lit("").alias("arg"), F.lit(1.0).alias("prob"))
    up = leg(customer.select(table, "c_custkey", "c_nationkey"), name("C", "c_custkey"), name("N", "c_nationkey"))
    over = leg(customer.select(table).distinct().crossJoin(nation), name("N", "n_nationkey"), name("R", "n_regionkey"))
    inferred = data_graph.transitive_legs(up.unionByName(over), ["located_in"])
    own = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    even = F.col("c_custkey") % 2 == 0
    known = own.select(name("C", "c_custkey").alias("entity_id"), F.lit("located_in").alias("prop"), F.when(even, 7).otherwise(8).alias("stmt_idx"), F.when(even, name("R", "n_regionkey")).otherwise(F.lit("R?")).alias("target"))
    applied = data_graph.apply_inference(inferred.withColumn("target", F.col("dst")), known)
    return applied.select("table_id", "src", "prop", "stmt", "dst", "in_graph")


_PRUNED = """, fe as (select * from fl union all select distinct table_id, dst, 'made_in', substr(dst, 5) || '|made_in|0', 'val:x' || table_id, 'made_in' from fl where dst like 'ent:P%' and cast(substr(dst, 6) as bigint) % 3 = 0)"""


def _with_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow, and from some of the entities that no cell holds a leg on to a literal."""
    own = object_flow(spark, sf_dir)
    hidden = own.where("dst like 'ent:P%'").select("table_id", F.col("dst").alias("src")).where(F.substring("src", 6, 20).cast("long") % 3 == 0).distinct()
    more = hidden.select("table_id", "src", F.lit("made_in").alias("prop"), F.concat(F.substring("src", 5, 20), F.lit("|made_in|0")).alias("stmt"), F.concat(F.lit("val:x"), F.col("table_id").cast("string")).alias("dst"), F.lit("made_in").alias("pred"), F.lit(flow.LINK).alias("method"), F.lit("").alias("arg"), F.lit(1.0).alias("prob"))
    return own.unionByName(staged(more, "hidden"))


@query(_FLOW + _PRUNED + """, w as (select table_id, stmt, count(distinct (dst, pred)) as ways from fe group by all) select table_id, src, prop, stmt, dst, pred from fe where not (dst like 'ent:%' and (table_id, dst) not in (select table_id, src from fe) and (table_id, stmt) in (select table_id, stmt from w where ways = 1))""")
def dg_prune_single(spark, sf_dir):
    """Without legs into entities that lead nowhere, of statements that say nothing else."""
    return data_graph.prune_single_leaves(_with_hidden(spark, sf_dir)).select("table_id", "src", "prop", "stmt", "dst", "pred")


@query(_FLOW + " select * from fl")
def dg_prune_leaves(spark, sf_dir):
    """What only entities that no cell holds say of each other goes: here all that was added."""
    return data_graph.prune_entity_leaves(_with_hidden(spark, sf_dir)).select("table_id", "src", "prop", "stmt", "dst", "pred")


@query(_FLOW + """ select table_id, node from en where node is not null and substr(node, 1, 4) = 'ctx:' group by all union all select distinct table_id, dst from fl where dst like 'ent:%' and dst not like '%9'""")
def dg_connected(spark, sf_dir):
    """Nodes that a graph without part of its flow still needs."""
    own = object_flow(spark, sf_dir)
    hidden = own.where("dst like 'ent:%'").select("table_id", F.col("dst").alias("node")).distinct()
    pages = contexts(spark, sf_dir).select("table_id", F.concat(F.lit("ctx:"), "entity_id").alias("node"))
    left = own.where("dst not like 'ent:%9'")
    return data_graph.connected_nodes(hidden.unionByName(pages), left).select("table_id", "node")


_CG = (
    _FLOW
    + """, lg as (select *, case when src like 'ctx:%' then 'ent:' || substr(src, 5) when regexp_matches(src, '^[0-9]+-[0-9]+$') then 'col:' || split_part(src, '-', 2) else src end as u,
        case when dst like 'ctx:%' then 'ent:' || substr(dst, 5) when regexp_matches(dst, '^[0-9]+-[0-9]+$') then 'col:' || split_part(dst, '-', 2) else dst end as v from fl),
    vl as (select table_id, u, prop, 'stmt:' || u || '>' || prop || '>' || v as stmt, v, pred, src, stmt as dg_stmt, dst from lg where prop = pred),
    cgf as materialized (select * from vl union all select q.table_id, q.u, q.prop, s.stmt, q.v, q.pred, q.src, q.stmt, q.dst from lg q join (select distinct table_id, src, prop, dg_stmt, stmt from vl) s on s.table_id = q.table_id and s.src = q.src and s.prop = q.prop and s.dg_stmt = q.stmt where q.prop <> q.pred),
    rel as materialized (select distinct table_id, u, v, stmt, prop, pred from cgf)"""
)


def _cg_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate graph's flow, for what reads it once."""
    return graph.from_statements(_statements(spark, sf_dir))


def cg_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(_cg_flow(spark, sf_dir), "graph")


@query(_CG + " select * from cgf")
def cg_statements(spark, sf_dir):
    """The candidate graph's flow: columns, statements and values, qualifiers repeated in each statement of their source and property."""
    return _cg_flow(spark, sf_dir).drop("prob")


@query(_CG + " select table_id, stmt, v, pred, count(distinct (src, dst)) as freq, count(distinct (split_part(dg_stmt, '|', 1), dst)) as unique_freq from cgf group by all")
def cg_edge_frequency(spark, sf_dir):
    return graph.edge_frequency(_cg_flow(spark, sf_dir))


@query(
    _CG
    + """, e as (select distinct table_id, u as src, stmt as dst, prop as pred from cgf where v not like 'ent:%7' union select table_id, stmt, v, pred from cgf where u <> 'col:2'),
    k as (select table_id, dst as node from e where dst like 'stmt:%' intersect select table_id, src from e where src like 'stmt:%'),
    g as (select e.* from e semi join k on k.table_id = e.table_id and k.node = case when e.dst like 'stmt:%' then e.dst else e.src end)
    select table_id, node, cast(sum(i) as bigint) as n_in, cast(sum(o) as bigint) as n_out from (select table_id, src as node, 0 as i, 1 as o from g union all select table_id, dst, 1, 0 from g) group by all"""
)
def cg_degrees(spark, sf_dir):
    """Degrees of the graph without statements that have lost their way in or out."""
    own = cg_flow(spark, sf_dir)
    into = own.where("v not like 'ent:%7'").select("table_id", F.col("u").alias("src"), F.col("stmt").alias("dst"), F.col("prop").alias("pred"))
    out = own.where("u != 'col:2'").select("table_id", F.col("stmt").alias("src"), F.col("v").alias("dst"), "pred")
    return graph.degrees(graph.without_dangling(into.union(out).distinct()))


@query(_CG + " select table_id, stmt from cgf group by all having false")
def cg_repeated_flow(spark, sf_dir):
    """Flow that occurs twice for its ends and statement: none."""
    # what flow occurs for a statement of the data graph is told where its legs are together, and those move as one row
    own = _statements(spark, sf_dir).repartition("table_id", "src", "stmt")
    return graph.repeated_flow(graph.from_statements(own)).select("table_id", "stmt")


def _n_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.read(spark, sf_dir, "lineitem").groupBy(F.expr(TABLE).alias("table_id")).agg(F.count("*").alias("n_rows"))


def _data_props(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("supplied_by",), ("in_nation",)], "prop string")


#: Every third row's supplier cell has no entity, so that possible links differ; ``supplied_by`` and ``in_nation`` are taken for data properties.
_LINKED = """, cd as (select * from cand where not (col = 2 and "row" % 3 = 0)), lk as materialized (select distinct table_id, "row", cast(col as bigint) as col from cd), n as (select table_id, count(*) as n_rows from nr group by table_id),
    nl as materialized (select table_id, col, count(*) as k from lk group by all), nb as materialized (select a.table_id, a.col as cu, b.col as cv, count(*) as k from lk a join lk b on a.table_id = b.table_id and a."row" = b."row" and a.col <> b.col group by all),
    rf as materialized (select *, pred in ('supplied_by', 'in_nation') as d, try_cast(nullif(regexp_extract(u, '^col:([0-9]+)$', 1), '') as bigint) as uc, try_cast(nullif(regexp_extract(v, '^col:([0-9]+)$', 1), '') as bigint) as vc from rel),
    pos as materialized (select rf.table_id, u, v, stmt, pred, cast(case when uc is null and vc is null then 1 when uc is not null and vc is not null then case when d then coalesce(a.k, 0) else coalesce(ab.k, 0) end when uc is not null then coalesce(a.k, 0) when d then n_rows else coalesce(b.k, 0) end as bigint) as possible
        from rf join n using (table_id) left join nl a on a.table_id = rf.table_id and a.col = uc left join nl b on b.table_id = rf.table_id and b.col = vc left join nb ab on ab.table_id = rf.table_id and ab.cu = uc and ab.cv = vc)"""


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.candidates(spark, sf_dir).where(~((F.col("col") == star.SUPPLIER) & (F.col("row") % 3 == 0)))


def _sparse_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir).select("table_id", "row", F.col("col").cast("long").alias("col")).distinct()


@query(_CG + _LINKED + " select * from pos")
def ev_possible_links(spark, sf_dir):
    """How many links each relation could have had, by the kinds of its ends and its property."""
    return ev.possible_links(graph.relations(cg_flow(spark, sf_dir)), _sparse_linked(spark, sf_dir), _n_rows(spark, sf_dir), _data_props(spark))


_UNMATCHED = """, own as (select distinct entity_id, prop, prop as pred from stm union select distinct entity_id, prop, qual from qual),
    has as materialized (select distinct c.table_id, c."row", cast(c.col as bigint) as uc, o.prop, o.pred from cd c join own o using (entity_id)),
    could as (select r.table_id, u, v, stmt, r.pred, h."row", vc, d from rf r join has h on h.table_id = r.table_id and h.uc = r.uc and h.prop = r.prop and h.pred = r.pred
        union all select r.table_id, u, v, stmt, r.pred, x."row", vc, d from rf r join own o on o.entity_id = substr(r.u, 5) and o.prop = r.prop and o.pred = r.pred join (select table_id, "row" from nr) x on x.table_id = r.table_id and (r.vc is not null or x."row" = 0) where r.uc is null),
    met as (select distinct table_id, u, v, stmt, pred, cast(case when regexp_matches(src, '^[0-9]+-') then split_part(src, '-', 1) when regexp_matches(dst, '^[0-9]+-') then split_part(dst, '-', 1) else '0' end as bigint) as "row" from cgf),
    um as materialized (select c.table_id, c.u, c.v, c.stmt, c.pred, count(*) as unmatched from could c left join lk t on t.table_id = c.table_id and t."row" = c."row" and t.col = c.vc left join met m on m.table_id = c.table_id and m.u = c.u and m.v = c.v and m.stmt = c.stmt and m.pred = c.pred and m."row" = c."row"
        where m.u is null and (c.vc is null or c.d or t.col is not null) group by all)"""


def _unmatched(spark: SparkSession, sf_dir: str, own: DataFrame, relations: DataFrame) -> DataFrame:
    return ev.unmatched_links(relations, own, _sparse(spark, sf_dir), star.statements(spark, sf_dir), star.qualifiers(spark, sf_dir), _n_rows(spark, sf_dir), _data_props(spark))


@query(_CG + _LINKED + _UNMATCHED + " select * from um")
def ev_unmatched_links(spark, sf_dir):
    """Pairs that could have each relation and whose source has its property and qualifier, but do not have it."""
    own = cg_flow(spark, sf_dir)
    return _unmatched(spark, sf_dir, own, graph.relations(own))


_SHARES = """, fr as (select table_id, u, v, stmt, pred, count(distinct (src, dst)) as pairs from cgf group by all),
    al as (select fr.*, n_rows, possible, coalesce(unmatched, 0) as unmatched, max(coalesce(unmatched, 0) + pairs) over (partition by fr.table_id, fr.u, fr.v) as most from fr join n using (table_id) join pos using (table_id, u, v, stmt, pred) left join um using (table_id, u, v, stmt, pred))"""


@query(
    _CG + _LINKED + _UNMATCHED + _SHARES + """ select table_id, u, v, stmt, pred, cast(round(10000 * pairs / n_rows) as bigint) as over_row, cast(round(case when possible = 0 then 0 else 10000 * pairs / possible end) as bigint) as over_ent_row, cast(round(10000 * pairs / most) as bigint) as over_pos_rel,
        cast(round(case when possible = 0 then 0 else 10000 * unmatched / possible end) as bigint) as unmatch_over_ent_row, cast(round(10000 * unmatched / most) as bigint) as unmatch_over_pos_rel from al"""
)
def ev_relation_shares(spark, sf_dir):
    """The five shares of each relation by statement and predicate."""
    own = cg_flow(spark, sf_dir)
    relations = graph.relations(own)
    possible = ev.possible_links(relations, _sparse_linked(spark, sf_dir), _n_rows(spark, sf_dir), _data_props(spark))
    shares = ev.relation_shares(ev.relation_frequency(own), possible, _unmatched(spark, sf_dir, own, relations), _n_rows(spark, sf_dir))
    whole = lambda c: F.round(F.col(c) * 10000).cast("long")
    return shares.select(*ev.RELATION, whole("REL_FREQ_OVER_ROW").alias("over_row"), whole("REL_FREQ_OVER_ENT_ROW").alias("over_ent_row"), whole("REL_FREQ_OVER_POS_REL").alias("over_pos_rel"), whole("REL_FREQ_UNMATCH_OVER_ENT_ROW").alias("unmatch_over_ent_row"), whole("REL_FREQ_UNMATCH_OVER_POS_REL").alias("unmatch_over_pos_rel"))


def _candidate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``table_id, node, class, freq``: direct classes of each column."""
    own = types_of.type_frequency(star.candidates(spark, sf_dir), star.classes(spark, sf_dir))
    return own.select("table_id", F.concat(F.lit("col:"), F.col("col").cast("string")).alias("node"), "class", "freq")


_TYPES = """, ty as materialized (select table_id, 'col:' || col as node, class, sum(prob) as freq from (select table_id, "row", col, class, max(prob) as prob from cand join cls using (entity_id) group by all) group by all)"""


@query(
    _CG
    + """ select 'REL' as fact, table_id, u as a, v as b, stmt as c, pred as d from rel union all select 'REL_PROP', table_id, u, v, stmt, pred from rel where prop = pred union all select 'REL_QUAL', table_id, u, v, stmt, pred from rel where prop <> pred
    union all (select distinct 'STATEMENT_PROPERTY', table_id, stmt, pred, null, null from rel where prop = pred) union all (select distinct 'COLUMN', table_id, x, null, null, null from (select table_id, unnest([u, v, stmt]) as x from rel) where x like 'col:%')
    union all (select distinct 'STATEMENT', table_id, stmt, null, null, null from rel) union all (select distinct 'NOT_STATEMENT', table_id, x, null, null, null from (select table_id, unnest([u, v]) as x from rel))"""
)
def ev_statement_facts(spark, sf_dir):
    """Which relations, statements and nodes there are."""
    out = None
    for name, df in ev.statement_facts(staged(graph.relations(_cg_flow(spark, sf_dir)), "relations")).items():
        columns = [c for c in df.columns if c != "table_id"]
        padded = [F.col(c) for c in columns] + [F.lit(None).cast("string")] * (4 - len(columns))
        own = df.select(F.lit(name).alias("fact"), "table_id", *[c.alias(n) for c, n in zip(padded, "abcd", strict=True)])
        out = own if out is None else out.unionByName(own)
    return out


@query(
    _CG
    + _TYPES
    + """, nd as (select distinct table_id, x as node from (select table_id, unnest([u, v]) as x from rel)), td as (select distinct table_id, node from ty)
    select table_id, node, cast(null as double) as truth from td union all select table_id, node, case when node like 'ent:%' then 1.0 else 0.0 end from nd where (table_id, node) not in (select table_id, node from td)"""
)
def ev_has_type(spark, sf_dir):
    return ev.has_type(_cg_flow(spark, sf_dir), staged(_candidate_types(spark, sf_dir), "types"))


@query(_CG + """, us as (select distinct table_id, unnest([prop, pred]) as prop from rel), an as (select * from (values ('has_item', 'in_nation'), ('supplied_by', 'has_item'), ('in_nation', 'located_in')) v(prop, ancestor)) select us.table_id, us.prop, an.ancestor from us join an using (prop) where (us.table_id, an.ancestor) in (select table_id, prop from us)""")
def ev_sub_properties(spark, sf_dir):
    """Properties and their ancestors, where a table uses both."""
    used = ev.used_properties(_cg_flow(spark, sf_dir))
    return ev.ancestors_used(used, spark.createDataFrame([("has_item", "in_nation"), ("supplied_by", "has_item"), ("in_nation", "located_in")], "prop string, ancestor string"), "prop")


@query(_CG + " select distinct table_id, prop, case when prop in ('supplied_by', 'in_nation') then 'DATA_PROPERTY' else 'OBJECT_PROPERTY' end as kind from (select table_id, unnest([prop, pred]) as prop from rel)")
def ev_property_kinds(spark, sf_dir):
    kinds = ev.property_kinds(staged(ev.used_properties(_cg_flow(spark, sf_dir)), "used"), _data_props(spark))
    return kinds["DATA_PROPERTY"].withColumn("kind", F.lit("DATA_PROPERTY")).unionByName(kinds["OBJECT_PROPERTY"].withColumn("kind", F.lit("OBJECT_PROPERTY"))).distinct()


@query(_CG + _TYPES + """, uv as (select distinct table_id, v as node, pred as prop from rel) select distinct uv.table_id, prop, class from uv join ty using (table_id, node) where prop = 'has_item' and class like 'STANDARD%'""")
def ev_accepted_classes(spark, sf_dir):
    """Candidate classes that the range of a property accepts."""
    declared = star.read(spark, sf_dir, "part").where("p_type like 'STANDARD%'").select(F.lit("has_item").alias("prop"), F.col("p_type").alias("class")).distinct()
    return ev.accepted_classes(_cg_flow(spark, sf_dir), _candidate_types(spark, sf_dir), declared, models.ANY_CLASS, "v")


@query(
    _TYPES
    + """, c1 as (select entity_id, class from cls union select entity_id, parent from cls join par on class = child union select entity_id, 'goods' from cls where entity_id like 'P%'),
    wide as (select distinct table_id, 'col:' || col as node, c1.class from cand join c1 using (entity_id)), top as (select * from ty qualify row_number() over (partition by table_id, node order by freq desc, class) <= 2),
    up as (select table_id, node, class, 0 as d from top union all select table_id, node, parent, 1 from top join par on child = class union all select table_id, node, 'goods', 2 from top), nearest as (select table_id, node, class, min(d) as d from up group by all),
    g as (select w.table_id, w.node, w.class, d, greatest(1, max(d) over (partition by w.table_id, w.node)) as longest from wide w left join nearest using (table_id, node, class))
    select table_id, node, class, cast(round(10000 * coalesce(d / longest, 0.5)) as bigint) as truth from g"""
)
def ev_type_distance(spark, sf_dir):
    """How far each class, direct or above, lies from the two most frequent ones."""
    parents = star.class_parents(spark, sf_dir)
    wide = star.candidates(spark, sf_dir).join(types_of.with_parents(star.classes(spark, sf_dir), parents, 2), "entity_id").select("table_id", F.concat(F.lit("col:"), F.col("col").cast("string")).alias("node"), "class").distinct()
    found = ev.type_distance(wide, _candidate_types(spark, sf_dir), ev.check_hierarchy(parents))
    return found.select("table_id", "node", "class", F.round(F.col("truth") * 10000).cast("long").alias("truth"))


@query(
    _TYPES
    + """, w as (select table_id, node, class, 0 as d from ty union all select distinct table_id, node, parent, 1 from ty join par on child = class union all select distinct table_id, node, 'goods', 2 from ty)
    select table_id, node, class, 5000 * d as truth from w"""
)
def ev_absolute_type_distance(spark, sf_dir):
    """How far each class lies above the classes that have none below them."""
    parents = star.class_parents(spark, sf_dir)
    wide = star.candidates(spark, sf_dir).join(types_of.with_parents(star.classes(spark, sf_dir), parents, 2), "entity_id").select("table_id", F.concat(F.lit("col:"), F.col("col").cast("string")).alias("node"), "class").distinct()
    return ev.absolute_type_distance(wide, parents).select("table_id", "node", "class", F.round(F.col("truth") * 10000).cast("long").alias("truth"))


@query(
    """, k as (select table_id, "row", col, case when col = 2 then 'supplier ' || l_suppkey else '["' || (case col when 0 then 'O' || l_orderkey else 'P' || l_partkey end) || '"]' end as key from nr, (select unnest([0, 1, 2]) as col)),
    d as (select a.table_id, a.col as src_col, b.col as dst_col, a.key, count(distinct b.key) as n from k a join k b on a.table_id = b.table_id and a."row" = b."row" and a.col <> b.col group by all)
    select table_id, cast(src_col as bigint) as src_col, cast(dst_col as bigint) as dst_col, 100 * count(*) filter (n > 1) <= count(*) as depends from d group by all"""
)
def ev_dependencies(spark, sf_dir):
    """Which column settles which, by the entities of their cells or by their texts (suppliers here are not linked)."""
    linked = star.candidates(spark, sf_dir).where(F.col("col") != star.SUPPLIER).select("table_id", "row", "col", F.lit(0).alias("nr"), "entity_id")
    keys = ev.value_keys(cells(spark, sf_dir).where("col < 3"), linked)
    pairs = _n_rows(spark, sf_dir).select("table_id", F.explode(F.array(*[F.struct(F.lit(a).alias("src_col"), F.lit(b).alias("dst_col")) for a in range(3) for b in range(3) if a != b])).alias("p")).select("table_id", "p.*")
    return ev.dependencies(keys, pairs)


@query("""select table_id, cast(c.col as bigint) as col, cast(round(10000 * avg(case c.col when 0 then 1.0 when 1 then (length('part ' || l_partkey) - 5) / length('part ' || l_partkey) else 0 end)) as bigint) as coverage, c.col = 0 as is_entity_column from nr, (select unnest([0, 1, 2, 3]) as col) c group by all""")
def ev_coverage(spark, sf_dir):
    """How much of its cells a column's links cover: orders wholly, parts without the word before the number, others not at all."""
    own = cells(spark, sf_dir)
    spans = own.where("col < 2").select("table_id", "row", "col", F.when(F.col("col") == 0, 0).otherwise(5).alias("start"), F.length("value").alias("end"))
    return ev.coverage(own, spans).select("table_id", "col", F.round(F.col("coverage") * 10000).cast("long").alias("coverage"), "is_entity_column")


def _shares_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = star.candidates(spark, sf_dir).withColumn("prob", F.col("prob") / 10000.0)
    return models.type_shares(share, star.classes(spark, sf_dir), star.class_parents(spark, sf_dir), _n_rows(spark, sf_dir))


@query(
    """, n as (select table_id, count(*) as n_rows from nr group by table_id), c1 as (select entity_id, class from cls union select entity_id, parent from cls join par on class = child),
    f as (select table_id, col, class, sum(prob) as freq from (select table_id, "row", col, class, max(prob) as prob from cand join cls using (entity_id) group by all) group by all), w as (select table_id, col, class, sum(prob) as freq from (select table_id, "row", col, class, max(prob) as prob from cand join c1 using (entity_id) group by all) group by all)
    select table_id, 'col:' || col as node, class, f.freq is not null as direct, cast(round(coalesce(f.freq, 0) / n_rows) as bigint) as over_row, cast(round(w.freq / n_rows) as bigint) as extended_over_row from w left join f using (table_id, col, class) join n using (table_id)"""
)
def ev_type_shares(spark, sf_dir):
    """Shares of rows by class, direct and with the classes above; every row has a part here, so rows with an entity are all rows."""
    share = _shares_of_types(spark, sf_dir)
    whole = lambda c: F.round(F.round(F.col(c) * 10000, 6)).cast("long")
    return share.where("abs(TYPE_FREQ_OVER_ROW - TYPE_FREQ_OVER_ENT_ROW) < 1e-12").select("table_id", "node", "class", "direct", whole("TYPE_FREQ_OVER_ROW").alias("over_row"), whole("EXTENDED_TYPE_FREQ_OVER_ROW").alias("extended_over_row"))


def _linked_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate graph of what cells and contexts themselves hold."""
    return graph.from_statements(_statements(spark, sf_dir, own_values=False))


def _linked_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its edges, made once: a few for each table, so that its flow need not be written."""
    return staged(graph.edges(_linked_flow(spark, sf_dir)), "edges")


_LINKS = """, tb as (select distinct table_id from nr),
    near as (select distinct nr.table_id, 'N' || (nr.table_id % 25) as n from nr join supplier on s_suppkey = l_suppkey where s_nationkey = nr.table_id % 25),
    ce as materialized (select table_id, 'col:0' as src, 'stmt:col:0>has_item>col:1' as dst, 'has_item' as pred from tb union all select table_id, 'stmt:col:0>has_item>col:1', 'col:1', 'has_item' from tb union all select table_id, 'stmt:col:0>has_item>col:1', 'col:2', 'supplied_by' from tb
        union all select table_id, 'col:2', 'stmt:col:2>in_nation>ent:' || n, 'in_nation' from near union all select table_id, 'stmt:col:2>in_nation>ent:' || n, 'ent:' || n, 'in_nation' from near)"""


def _weighed(edges: DataFrame) -> DataFrame:
    """Edges with a probability: links to a context half as likely as others."""
    return edges.withColumn("prob", F.when(F.col("pred") == "in_nation", 0.4).otherwise(0.8))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).select("table_id", F.concat(F.lit("ent:"), "entity_id").alias("node"))


@query(_LINKS + " select * from ce")
def cg_links(spark, sf_dir):
    """The candidate graph's edges without the values that no cell holds."""
    return _linked_edges(spark, sf_dir)


@query(
    _LINKS
    + """, nn as (select table_id, src as node from ce union select table_id, dst from ce), lb as (select table_id, node, case node when 'col:0' then 'order (column 0)' when 'col:1' then 'part (column 1)' when 'col:2' then 'supplier (column 2)' else regexp_replace(node, '^ent:', '') end as label from nn)
    select table_id, '"' || node || '" [label="' || label || '", ' || case when node like 'col:%' then 'shape=plaintext, style=filled, fillcolor=gold' else 'shape=ellipse, style=filled, color=white, fillcolor=lightgray' end || '];' as line from lb union all select table_id, '"' || src || '" -> "' || dst || '" [label="' || pred || '"];' from ce"""
)
def cg_drawing(spark, sf_dir):
    """The candidate graph as a drawing: columns gold, all else grey."""
    names = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(n).alias("name")) for c, n in enumerate(("order", "part", "supplier", "quantity"))])
    columns = _n_rows(spark, sf_dir).select("table_id", F.explode(names).alias("c")).select("table_id", "c.*")
    return graph.drawn(_linked_edges(spark, sf_dir), columns)


@query(_LINKS + " select table_id, src, dst, pred from ce where pred <> 'in_nation'")
def select_steiner_tree(spark, sf_dir):
    """The best tree over all columns among the edges above a half."""
    likely = _weighed(_linked_edges(spark, sf_dir))
    return steiner.select_steiner(graph.above(likely.drop("prob"), likely, 0.5)).select("table_id", "src", "dst", "pred")


@query(_LINKS + " select table_id, src, dst, pred from ce")
def select_steiner_context(spark, sf_dir):
    """The best tree over columns, with the page's entity put back by the supplier's nation."""
    likely = _weighed(_linked_edges(spark, sf_dir))
    return steiner.select_steiner(graph.above(likely.drop("prob"), likely, 0.3), _pages(spark, sf_dir)).select("table_id", "src", "dst", "pred")


@query(_LINKS + " select table_id, src, dst, pred from ce")
def select_simple_path(spark, sf_dir):
    """One path between any two columns, or a column and the context."""
    return steiner.simple_paths(_weighed(_linked_edges(spark, sf_dir)), _pages(spark, sf_dir)).select("table_id", "src", "dst", "pred")


@query(_LINKS + " select table_id, src, dst, pred from ce where pred <> 'in_nation'")
def select_valid_statements(spark, sf_dir):
    """A selection of qualifiers alone gets its statements' values back."""
    whole = _weighed(_linked_edges(spark, sf_dir))
    return steiner.with_statement_values(whole.where("pred = 'supplied_by' or (pred = 'has_item' and dst like 'stmt:%')"), whole).select("table_id", "src", "dst", "pred")


@query(_LINKS + " select table_id, src, dst, pred from ce where pred <> 'in_nation'")
def select_entity_cleanup(spark, sf_dir):
    """Without the entities that only end a statement: here the nations, where they are no context."""
    whole = _weighed(_linked_edges(spark, sf_dir))
    return steiner.without_loose_entities(whole).select("table_id", "src", "dst", "pred")


def _default(spark: SparkSession, sf_dir: str):
    """Evidence and targets of the default model over the linked candidate graph."""
    own = staged(_linked_flow(spark, sf_dir), "linked")
    relations = staged(graph.relations(own), "relations")
    linked = staged(star.candidates(spark, sf_dir), "candidates")
    n_rows = _n_rows(spark, sf_dir)
    no_data = spark.createDataFrame([], "prop string")
    possible = ev.possible_links(relations, linked.select("table_id", "row", F.col("col").cast("long").alias("col")).distinct(), n_rows, no_data)
    unmatched = ev.unmatched_links(relations, own, linked, star.statements(spark, sf_dir), star.qualifiers(spark, sf_dir), n_rows, no_data)
    shares = staged(ev.relation_shares(ev.relation_frequency(own), possible, unmatched, n_rows), "shares")
    types = staged(_shares_of_types(spark, sf_dir), "types")
    keys = ev.value_keys(cells(spark, sf_dir), linked.select("table_id", "row", "col", F.lit(0).alias("nr"), "entity_id"))
    ranges = star.classes(spark, sf_dir).select(F.lit("has_item").alias("prop"), "class").distinct()
    none = spark.createDataFrame([], "prop string, class string")
    parts = {"keys": staged(keys, "keys"), "data_props": no_data, "domains": none, "ranges": ranges, "ancestors": spark.createDataFrame([], "prop string, ancestor string"), "parents": star.class_parents(spark, sf_dir)}
    return models.assemble(relations, shares, types, **parts)


@query(
    _LINKS
    + _TYPES
    + """, nt as (select count(*) as k, table_id from ty group by table_id), rc as (select table_id, count(*) as k from (select table_id from ce where src like 'stmt:%') group by table_id)
    select table_id, 'REL_PRIOR_NEG' as rule, k as n from rc union all select table_id, 'TYPE_PRIOR_NEG', k from nt union all select table_id, 'REL_FREQ_OVER_ROW', k from rc union all select table_id, 'TYPE_FREQ_OVER_ROW', k from nt union all select table_id, 'EXTENDED_TYPE_FREQ_OVER_ROW', k from nt"""
)
def model_ground(spark, sf_dir):
    """How many ground terms the priors and features of the default model have in each table."""
    evidence, targets = _default(spark, sf_dir)
    model_of = models.default_model()
    out = None
    for name in ("REL_PRIOR_NEG", "TYPE_PRIOR_NEG", "REL_FREQ_OVER_ROW", "TYPE_FREQ_OVER_ROW", "EXTENDED_TYPE_FREQ_OVER_ROW"):
        own = rules.counted(model_of, name, evidence, targets).select("table_id", F.lit(name).alias("rule"), "n")
        out = own if out is None else out.unionByName(own)
    return out


def annotated(spark: SparkSession, sf_dir: str, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Edges of each table's selected tree and the type of each column: from linked cells to the answer."""
    evidence, targets = _default(spark, sf_dir)
    likely, types = models.predict(models.default_model(), evidence, targets)
    likely = staged(likely, "likely")
    edges = likely.drop("prob")
    cpa = steiner.select_steiner(graph.above(edges, likely, threshold), _pages(spark, sf_dir).limit(0))
    named = types.select("table_id", F.regexp_extract("node", r"^col:([0-9]+)$", 1).cast("long").alias("col"), "class", F.round("prob", 6).alias("freq"))
    return cpa, types_of.best_type(named)


@query(
    _LINKS
    + _TYPES
    + """ select table_id, 'cpa' as task, src, dst, pred as answer from ce where pred <> 'in_nation'
    union all (select table_id, 'cta', node, '', class from ty qualify row_number() over (partition by table_id, node order by freq desc, class) = 1)"""
)
def annotate(spark, sf_dir):
    """The whole life cycle: the relations between the columns of every table, and each column's class."""
    cpa, cta = annotated(spark, sf_dir)
    own = cpa.select("table_id", F.lit("cpa").alias("task"), "src", "dst", F.col("pred").alias("answer"))
    return own.unionByName(cta.select("table_id", F.lit("cta").alias("task"), F.concat(F.lit("col:"), F.col("col").cast("string")).alias("src"), F.lit("").alias("dst"), F.col("class").alias("answer")))


def _model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A model of every table: the links of the columns, parts with a class of their own."""
    cpa = _linked_edges(spark, sf_dir).where("pred != 'in_nation'")
    tables = _n_rows(spark, sf_dir).select("table_id")
    cta = tables.select("table_id", F.lit(1).alias("col"), F.concat(F.lit("Q"), F.col("table_id").cast("string"), F.lit(" Q0")).alias("class"))
    columns = tables.select("table_id", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(n).alias("name")) for c, n in enumerate(("order", "part", "supplier", "quantity"))])).alias("c")).select("table_id", "c.*")
    return model.create(cpa, cta, columns, spark.createDataFrame([("Q1", "one")], "id string, label string"))


_MODEL = """, tb as (select distinct table_id from nr),
    me as (select table_id, x[1] as src, x[2] as dst, x[3] as prop from tb, (select unnest([['class:0', 'data:0', 'rdfs:label'], ['class:1', 'data:1', 'rdfs:label'], ['class:0', 'stmt:col:0>has_item>col:1', 'has_item'], ['stmt:col:0>has_item>col:1', 'class:1', 'has_item'], ['stmt:col:0>has_item>col:1', 'data:2', 'supplied_by']]) as x))"""


@query(_MODEL + " select table_id, src || ' ' || prop || ' ' || dst as line from me union all select table_id, x from tb, (select unnest(['data:0 order', 'data:1 part', 'data:2 supplier', 'class:0 Entity (Q35120)', 'stmt:col:0>has_item>col:1 statement']) as x) union all select table_id, 'class:1 ' || case when table_id = 1 then 'one (Q1)' else 'Q' || table_id end from tb")
def sm_create(spark, sf_dir):
    """Models made of relations and classes: their edges and their nodes with labels."""
    nodes, edges = _model(spark, sf_dir)
    return edges.select("table_id", F.concat_ws(" ", "src", "prop", "dst").alias("line")).union(nodes.select("table_id", F.concat_ws(" ", "id", "label")))


@query(_MODEL + " select table_id, cast(substr(dst, 6) as bigint) as col from me where prop = 'rdfs:label'")
def sm_entity_columns(spark, sf_dir):
    return model.entity_columns(_model(spark, sf_dir)[1])


@query(
    """, b as (select cast(n_nationkey as bigint) as table_id from nation), v as (select table_id, cast(x as bigint) as variant from b, (select unnest([0, 1, 2, 3, 4, 5]) as x)),
    e as (select table_id, variant, case when variant % 3 = 0 then 'class:0' when true then 'class:1' end as s1, case variant % 3 when 0 then 'class:1' else 'class:0' end as d1, ['in_region', 'contains', 'holds'][variant % 3 + 1] as p1, variant // 3 as other from v)
    select table_id, variant, s1 as src, 'stmt:a' as dst, p1 as prop from e union all select table_id, variant, 'stmt:a', d1, p1 from e union all select table_id, variant, 'stmt:a', 'data:2', 'since' from e
    union all select table_id, variant, case other when 0 then 'class:1' else 'class:3' end, 'stmt:b', case other when 0 then 'part_of' else 'has_part' end from e union all select table_id, variant, 'stmt:b', case other when 0 then 'class:3' else 'class:1' end, case other when 0 then 'part_of' else 'has_part' end from e"""
)
def sm_equivalents(spark, sf_dir):
    """A model with two invertible statements, of three and two ways to say them: six models that say the same."""
    table = F.col("n_nationkey").cast("long").alias("table_id")
    edge = lambda s, d, p: F.struct(F.lit(s).alias("src"), F.lit(d).alias("dst"), F.lit(p).alias("prop"))
    edges = F.array(edge("class:0", "stmt:a", "in_region"), edge("stmt:a", "class:1", "in_region"), edge("stmt:a", "data:2", "since"), edge("class:1", "stmt:b", "part_of"), edge("stmt:b", "class:3", "part_of"))
    own = star.read(spark, sf_dir, "nation").select(table, F.explode(edges).alias("e")).select("table_id", "e.*")
    inverse = spark.createDataFrame([("in_region", "contains"), ("in_region", "holds"), ("part_of", "has_part")], "prop string, inverse string")
    return model.equivalents(own, inverse)


@query(
    """, c as (select table_id, "row", 'O' || l_orderkey as o, case when "row" % 2 = 0 then 'P' || l_partkey else "row" || '-1' end as p, 'supplier ' || l_suppkey as s from nr)
    select table_id, "row", o as entity, 'has_item' as prop, null as qual, p as value from c union all select table_id, "row", o, 'has_item', 'supplied_by', s from c"""
)
def sm_claims(spark, sf_dir):
    """What each row says by its table's model: parts of odd rows are new entities, suppliers are texts."""
    _, edges = _model(spark, sf_dir)
    linked = star.candidates(spark, sf_dir).where((F.col("col") == star.ORDER) | ((F.col("col") == star.PART) & (F.col("row") % 2 == 0)))
    nodes = data_graph.cell_nodes(cells(spark, sf_dir), linked).select("table_id", "row", "col", "value", "entity_ids")
    return model.qualified_claims(nodes, edges).drop("stmt")


@query(_MODEL + """ select table_id, count(*) as n_edges, 6 as n_nodes from me group by all""")
def sm_json(spark, sf_dir):
    """Models as JSON, read back as their numbers of edges and nodes."""
    texts = model.as_models(*_model(spark, sf_dir))
    schema = "struct<semantic_models: array<struct<nodes: array<struct<id: string>>, edges: array<struct<src: string>>>>>"
    read = texts.select("table_id", F.from_json("value", schema)["semantic_models"][0].alias("m"))
    return read.select("table_id", F.size("m.edges").cast("long").alias("n_edges"), F.size("m.nodes").alias("n_nodes"))


@query("""select table_id, cast(3 as bigint) as col, 'integer' as kind from nr group by table_id union all select table_id, unnest([0, 1, 2]), null from (select distinct table_id from nr)""")
def column_kinds(spark, sf_dir):
    """Which columns are numbers: the quantities."""
    return text.numeric_kind(cells(spark, sf_dir))


@query("""select p_partkey, p_retailprice as number, 'USD' as unit, trim(p_name) as normed from part""")
def parse_once(spark, sf_dir):
    """Prices in a sentence: the number, its unit and the text itself, each distinct text parsed once."""
    part = star.read(spark, sf_dir, "part")
    said = part.select("p_partkey", F.concat(F.lit(" "), F.format_number("p_retailprice", 2), F.lit("USD ")).alias("value"), F.concat(F.lit(" "), "p_name").alias("name"))
    found = text.parsed(said)
    return found.select("p_partkey", "number", "unit", text.norm_string(F.col("name")).alias("normed"))


@query("""select o_orderkey, cast(year(o_orderdate) as bigint) as year, cast(case when o_orderkey % 2 = 0 then month(o_orderdate) else 0 end as bigint) as month, cast(case when o_orderkey % 2 = 0 then day(o_orderdate) else 0 end as bigint) as day, o_orderkey % 2 = 1 as only_year, o_orderkey % 2 = 0 and month(o_orderdate) = 1 and day(o_orderdate) = 1 as first_day from orders""")
def parse_dates(spark, sf_dir):
    """Dates somewhere in a text, some of them years only."""
    orders = star.read(spark, sf_dir, "orders")
    said = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.date_format("o_orderdate", "'in the year' yyyy")).alias("value"))
    dated = said.join(said.select("value").distinct().withColumn("date", text.fuzzy_date(F.col("value"))), "value")
    return dated.select("o_orderkey", "date.year", F.coalesce("date.month", F.lit(0)).alias("month"), F.coalesce("date.day", F.lit(0)).alias("day"), F.coalesce(text.has_only_year(F.col("date")), F.lit(False)).alias("only_year"), F.coalesce(text.first_day_of_year(F.col("date")), F.lit(False)).alias("first_day"))


@query("""select table_id, col, freq >= 5 as gte5, freq >= 10 as gte10, freq >= 50 as gte50 from (select table_id, cast(col as bigint) as col, count(*) as freq from cand group by all)""")
def link_steps(spark, sf_dir):
    """Which steps the number of a column's links reaches."""
    counted = star.candidates(spark, sf_dir).groupBy("table_id", "col").agg(F.count("*").alias("freq"))
    return counted.select("table_id", "col", text.at_least(F.col("freq")).alias("s")).select("table_id", "col", "s.gte5", "s.gte10", "s.gte50")


@query("""select entity_id, count(*) as n, coalesce(min(n_name), min(entity_id)) as label from (select 'N' || c_nationkey as entity_id from customer union all select 'C' || c_custkey from customer) left join nation on entity_id = 'N' || n_nationkey group by entity_id""")
def kg_labels(spark, sf_dir):
    """Labels of all that customers refer to, or the id where there is none."""
    customer = star.read(spark, sf_dir, "customer")
    ids = customer.select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("entity_id")).unionByName(customer.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("entity_id")))
    names = star.read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"))
    none = names.limit(0)
    return tables.with_labels(ids.groupBy("entity_id").agg(F.count("*").alias("n")), "entity_id", none, names)


@query()
def html_tables(spark, sf_dir):
    """Cells of the tables of all pages."""
    return html.html_cells(star.read(spark, sf_dir, "pages")).drop("links")


@query()
def html_contexts(spark, sf_dir):
    """Headings and text around the tables of all pages."""
    found = context.table_contexts(star.read(spark, sf_dir, "pages"))
    return found.select("url", "table", "pos", "level", "heading", context.text_of(F.col("content_before")).alias("before"), context.text_of(F.col("content_after")).alias("after"))


@query()
def header_similarity(spark, sf_dir):
    """Part types against containers, each pair of texts compared once."""
    part = star.read(spark, sf_dir, "part").select("p_partkey", F.lower("p_type").alias("label"), F.lower("p_name").alias("header"))
    return ev.header_similarity(part, "label", "header").select("p_partkey", F.round("similarity", 6).alias("similarity"))


@query()
def hlmrf_coupled(spark, sf_dir):
    """Atoms of a table that exclude each other in a chain, solved with their features: the default model's coupling on its own."""
    lines = star.read(spark, sf_dir, "lineitem").select(F.expr(TABLE).alias("table_id"), F.concat(F.lit("a"), F.col("l_suppkey").cast("string")).alias("atom"), (1 - F.col("l_discount")).cast("double").alias("truth"))
    evidence = lines.groupBy("table_id", "atom").agg(F.max("truth").alias("truth"))
    ranked = evidence.select("table_id", "atom", F.lead("atom").over(star.Window.partitionBy("table_id").orderBy("atom")).alias("atom2"))
    pairs = ranked.where("atom2 is not null").select("table_id", F.col("atom").alias("atom1"), "atom2", F.lit(1.0).alias("truth"))
    ground = hlmrf.ground_positive(evidence, 2.0, "feature").union(hlmrf.ground_negative(evidence.withColumn("truth", F.lit(1.0)), 1.0, "prior")).union(hlmrf.ground_implication(pairs, 1.0, "exclude"))
    return hlmrf.solve(ground).withColumn("truth", F.round(F.col("truth") * 1000).cast("long"))


@query("""select g, p_partkey as id, cast(round(avg(v) over (partition by g, island)) as bigint) as mean from (select *, cast(sum(jump) over (partition by g order by v, p_partkey) as bigint) as island from (select *, case when v - lag(v) over (partition by g order by v, p_partkey) > 500 then 1 else 0 end as jump from (select p_partkey // 200 as g, p_partkey, cast(round(p_retailprice * 100) as bigint) as v from part where p_retailprice >= 905)))""")
def prob_smoothing(spark, sf_dir):
    """Values below a threshold are dropped, others become the mean of their cluster."""
    part = star.read(spark, sf_dir, "part").select(F.expr("p_partkey div 200").alias("g"), F.col("p_partkey").alias("id"), F.round(F.col("p_retailprice") * 100).cast("long").alias("value"))
    return flow.smoothed(part, 500, ["g"], 90_500).select("g", "id", F.round("mean").cast("long").alias("mean"))


@query("""select table_id, cast(u.col as bigint) as col, class, cast(freq as bigint) as freq from (select table_id, col, class, sum(prob) as freq from (select table_id, "row", col, class, max(prob) as prob from cand join cls using (entity_id) group by all) group by all) u where col = 1 qualify row_number() over (partition by table_id, col order by freq desc, class) = 1""")
def select_known_types(spark, sf_dir):
    """The best class of the columns that are asked for."""
    frequency = types_of.type_frequency(star.candidates(spark, sf_dir), star.classes(spark, sf_dir))
    asked = _n_rows(spark, sf_dir).select("table_id", F.lit(star.PART).alias("col"))
    return selection.known_types(frequency, asked).select("table_id", "col", "class", "freq")
