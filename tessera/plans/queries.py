"""The library's own operators over the star-schema tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import layout, matchers, text
from tessera.operators import candidates as cg
from tessera.operators import features, flow, hlmrf, kg, model, paths, selection
from tessera.plans import star
from tessera.plans.registry import query
from tessera.session import staged
from tessera.sources import links

@query(
    """, f as (select table_id, class, sum(prob) as freq from (select table_id, "row", class, max(prob) as prob from cand join cls using (entity_id) where col = 1 group by all) group by all),
    n as (select table_id, count(*) as n_rows from nr group by table_id)
    select table_id, class, cast(freq as bigint) as freq, cast(freq // n_rows as bigint) as share from f join n using (table_id)
    qualify row_number() over (partition by table_id order by freq desc, class) = 1"""
)
def cta_argmax_part_type(spark, sf_dir):
    """Which class the part column of each table has: the flagship query."""
    parts = star.candidates(spark, sf_dir).where(F.col("col") == star.PART)
    best = cg.best_type(cg.type_frequency(parts, star.classes(spark, sf_dir)))
    n_rows = star.read(spark, sf_dir, "lineitem").groupBy(F.expr(f"l_orderkey div {star.ORDERS}").alias("table_id")).agg(F.count("*").alias("n_rows"))
    return best.join(n_rows, "table_id").select("table_id", "class", "freq", F.expr("freq div n_rows").alias("share"))


@query("""select table_id, cast(col as bigint) as col, class, cast(sum(prob) as bigint) as freq from (select table_id, "row", col, class, max(prob) as prob from cand join cls using (entity_id) group by all) group by all""")
def type_freq(spark, sf_dir):
    return cg.type_frequency(star.candidates(spark, sf_dir), star.classes(spark, sf_dir))


@query(
    """, c1 as (select entity_id, class from cls union select entity_id, parent from cls join par on class = child)
    select table_id, cast(col as bigint) as col, class, cast(sum(prob) as bigint) as freq from (select table_id, "row", col, class, max(prob) as prob from cand join c1 using (entity_id) group by all) group by all"""
)
def type_freq_extended(spark, sf_dir):
    wide = cg.with_parents(star.classes(spark, sf_dir), star.class_parents(spark, sf_dir))
    return cg.type_frequency(star.candidates(spark, sf_dir), wide)


@query(
    """select table_id, cast(col as bigint) as col, class, votes from (select table_id, col, class, count(distinct "row") as votes from cand join cls using (entity_id) group by all)
    qualify row_number() over (partition by table_id, col order by votes desc, class) = 1"""
)
def type_majority_vote(spark, sf_dir):
    return cg.majority_type(star.candidates(spark, sf_dir), star.classes(spark, sf_dir))


@query("""select table_id, cast(col as bigint) as col, count(distinct "row") as n_rows from cand group by all""")
def entity_row_count(spark, sf_dir):
    return cg.entity_rows(star.candidates(spark, sf_dir))


@query("select src, dst, prop, stmt_idx, quals, is_value, is_value and quals <> '' as both from hop")
def kg_hop1_index(spark, sf_dir):
    return kg.one_hop(star.statements(spark, sf_dir), star.qualifiers(spark, sf_dir)).withColumn("quals", F.array_join("quals", ","))


@query(
    """, e as (select distinct src, dst, case when prop in ('in_nation', 'in_region') then 'located_in' else prop end as prop from hop where is_value)
    select a.src, a.dst as mid, b.dst, a.prop as prop1, b.prop as prop2 from e a join e b on a.dst = b.src and a.src <> b.dst and a.prop = b.prop where a.prop = 'located_in'"""
)
def kg_hop2_paths(spark, sf_dir):
    located = star.statements(spark, sf_dir).replace({"in_nation": "located_in", "in_region": "located_in"}, subset=["prop"])
    return kg.two_hop(kg.one_hop(located, star.qualifiers(spark, sf_dir)), star.TRANSITIVE)


@query(
    """, k as (select 'O' || o_orderkey as entity_id from orders where o_orderstatus = 'F'),
    r as (select target from stm semi join k using (entity_id) union select target from qual semi join k using (entity_id))
    select target as entity_id from r where target not in (select entity_id from k)"""
)
def kg_entity_expand(spark, sf_dir):
    ids = star.read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("entity_id"))
    return kg.expand(ids, star.statements(spark, sf_dir), star.qualifiers(spark, sf_dir))


@query("""select table_id, "row", cast(p[1] as bigint) as col_u, cast(p[2] as bigint) as col_v from nr, (select unnest([[0, 1], [0, 2], [1, 2]]) as p)""")
def cell_pairs(spark, sf_dir):
    return paths.cell_pairs(star.candidates(spark, sf_dir))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.object_search(star.candidates(spark, sf_dir), kg.one_hop(star.statements(spark, sf_dir), star.qualifiers(spark, sf_dir), by_source=True))


@query(
    """select table_id, "row", src_col, dst_col, src, dst, prop, stmt_idx, 'value' as kind, cast(null as varchar) as via from lnk where is_value
    union all select table_id, "row", src_col, dst_col, src, dst, prop, stmt_idx, 'qualifier', quals from lnk where quals <> ''"""
)
def object_search(spark, sf_dir):
    return _links(spark, sf_dir).drop("prob")


@query(
    """, v as (select table_id, "row", l_extendedprice / l_quantity as value from nr),
    l as (select 'P' || p_partkey as src, 'price' as prop, p_retailprice as num from part union all select 'O' || o_orderkey, 'total', o_totalprice from orders)
    select c.table_id, c."row", cast(c.col as bigint) as src_col, c.entity_id as src, l.prop, case when abs(num - value) < 1e-5 then 10000 else cast(floor((0.95 - abs(num - value) / abs(num)) * 10000) as bigint) end as confidence
    from cand c join l on l.src = c.entity_id join v on v.table_id = c.table_id and v."row" = c."row" where abs(num - value) < 1e-5 or abs(num - value) / abs(num) < 0.05"""
)
def value_search(spark, sf_dir):
    rows = star.numbered_rows(spark, sf_dir)
    values = rows.select("table_id", "row", F.lit(star.QUANTITY).alias("col"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))
    sure = matchers.quantity(F.col("num"), F.col("value"))
    found = paths.value_search(star.candidates(spark, sf_dir), values, star.literals(spark, sf_dir), sure.isNotNull(), F.floor(sure * 10000).cast("long"))
    return found.select("table_id", "row", "src_col", "src", "prop", "confidence")


@query("""select p_partkey, p_name from part where trim(p_brand) = 'Brand#' || (1 + p_partkey % 25)""")
def match_string(spark, sf_dir):
    """Parts whose brand is what their cell says, but for spaces."""
    cell = F.concat(F.lit("\u00a0 Brand#"), (1 + F.col("p_partkey") % 25).cast("string"), F.lit(" "))
    return star.read(spark, sf_dir, "part").where(matchers.match("string_exact_test", F.col("p_brand"), cell) == 1.0).select("p_partkey", "p_name")


@query(
    """, x as (select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d, year(l_shipdate) as y2, month(l_shipdate) as m2, day(l_shipdate) as d2 from orders join lineitem on o_orderkey = l_orderkey)
    select o_orderkey, cast(sum(case when y = y2 and m = m2 and d = d2 then 100 when y = y2 and m2 = 1 and d2 = 1 then 75 end) as bigint) as score, count(*) as n from x where y = y2 and ((m = m2 and d = d2) or (m2 = 1 and d2 = 1)) group by all"""
)
def match_time(spark, sf_dir):
    def stamp(c):
        return text.time_parts(F.concat(F.lit("+"), F.date_format(c, "yyyy-MM-dd"), F.lit("T00:00:00Z")))

    joined = star.read(spark, sf_dir, "orders").join(star.read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    sure = matchers.time(stamp("o_orderdate"), stamp("l_shipdate"))
    return joined.withColumn("sure", F.round(sure * 100).cast("long")).where("sure is not null").groupBy("o_orderkey").agg(F.sum("sure").alias("score"), F.count("*").alias("n"))


@query(
    """, w as (select distinct p_type as t from part), x as (select a.t as a, b.t as b, levenshtein(a.t, b.t) as d from w a join w b on string_split(a.t, ' ')[1] = string_split(b.t, ' ')[1] and a.t <= b.t)
    select a, b, case when a = b then 100 when d <= 1 then 95 else 85 end as score from x where a = b or d <= 1 or d / greatest(1, least(length(a), length(b))) < 0.03"""
)
def match_similarity(spark, sf_dir):
    words = star.read(spark, sf_dir, "part").select("p_type").distinct()
    key = F.element_at(F.split("p_type", " "), 1)
    a, b = words.select(F.col("p_type").alias("a"), key.alias("k")), words.select(F.col("p_type").alias("b"), key.alias("k"))
    scored = a.join(b, "k").where("a <= b").withColumn("score", F.round(text.similarity(F.col("a"), F.col("b")) * 100).cast("int"))
    return scored.where("score is not null").select("a", "b", "score")


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in nations and nations in regions as flows, a table for each block of customers."""
    customer = star.read(spark, sf_dir, "customer")
    nation = star.read(spark, sf_dir, "nation")
    table = F.expr("c_custkey div 100").alias("table_id")
    up = customer.select(table, F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("dst"), F.lit("in_nation").alias("prop"), F.lit("s1").alias("stmt"), F.lit(flow.LINK).alias("method"), F.lit("").alias("arg"), (5000 + F.col("c_custkey") % 5000).alias("prob"))
    tables = customer.select(table).distinct()
    region = tables.crossJoin(nation).select("table_id", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), F.lit("in_region"), F.lit("s2"), F.lit(flow.LINK), F.lit(""), F.lit(9000).cast("long"))
    used = tables.select("table_id", F.lit("N0"), F.lit("R0"), F.lit("located_in"), F.lit("s3"), F.lit(flow.LITERAL), F.lit("x"), F.lit(100).cast("long"))
    return up.union(region).union(used)


_FLOW = """, t as (select distinct c_custkey // 100 as table_id from customer),
    fl as (select c_custkey // 100 as table_id, 'C' || c_custkey as src, 'N' || c_nationkey as dst, 'in_nation' as prop, 's1' as stmt, 'from_wikidata_link' as method, '' as arg, cast(5000 + c_custkey % 5000 as bigint) as prob from customer
        union all select table_id, 'N' || n_nationkey, 'R' || n_regionkey, 'in_region', 's2', 'from_wikidata_link', '', 9000 from t, nation
        union all select table_id, 'N0', 'R0', 'located_in', 's3', 'from_literal_matching_function', 'x', 100 from t)"""


@query(_FLOW + """ select table_id, src, dst, prop, stmt, method, arg, max(prob) as prob from (select * from fl union all select table_id, src, dst, prop, stmt, method, arg, prob - 1 from fl) group by all""")
def flow_merge(spark, sf_dir):
    own = _flow(spark, sf_dir)
    return flow.merge_provenance(own.union(own.withColumn("prob", F.col("prob") - 1)))


@query(_FLOW + """ select table_id, src, dst, 'located_in' as prop, 'located_in<-' || stmt as stmt, method, arg, prob from fl where prop in ('in_nation', 'in_region')""")
def infer_subproperty(spark, sf_dir):
    ancestors = spark.createDataFrame(star.PROPERTY_ANCESTORS, "prop string, ancestor string")
    return flow.infer_subproperties(_flow(spark, sf_dir), ancestors)


@query(
    _FLOW
    + """, g as (select table_id, src, dst, max(prob) as prob from fl group by all)
    select a.table_id, a.src, b.dst, 'located_in' as prop, max(least(a.prob, b.prob)) as prob from g a join g b on a.table_id = b.table_id and a.dst = b.src and a.src <> b.dst group by all"""
)
def infer_transitive(spark, sf_dir):
    own = _flow(spark, sf_dir)
    ancestors = spark.createDataFrame(star.PROPERTY_ANCESTORS, "prop string, ancestor string")
    return flow.infer_transitive(own.unionByName(flow.infer_subproperties(own, ancestors)), star.TRANSITIVE)


@query(
    _FLOW
    + """, f2 as (select * from fl union all select table_id, src, 'R' || (cast(substr(dst, 2) as bigint) % 5), 'direct', 's4', method, arg, prob + 4000 from fl where prop = 'in_nation'),
    best as (select table_id, src, dst, max((case when method = 'from_wikidata_link' then 1 else 0 end) * 1000000 + prob) as b from f2 group by all),
    h as (select distinct table_id, dst as h, src as u from f2 where dst like 'N%'),
    ways as (select h.table_id, h.u, h.h, o.dst as v, o.b as leg from h join best o on o.table_id = h.table_id and o.src = h.h where h.u <> o.dst),
    gone as (select w.table_id, w.h, w.v from ways w left join best d on d.table_id = w.table_id and d.src = w.u and d.dst = w.v group by all having bool_and(coalesce(d.b >= w.leg, false)))
    select f2.* from f2 where not exists (select 1 from gone g where g.table_id = f2.table_id and g.h = f2.src and g.v = f2.dst)"""
)
def prune_redundant_legs(spark, sf_dir):
    own = _flow(spark, sf_dir)
    direct = own.where("prop = 'in_nation'").select("table_id", "src", F.concat(F.lit("R"), (F.substring("dst", 2, 9).cast("long") % 5).cast("string")).alias("dst"), F.lit("direct").alias("prop"), F.lit("s4").alias("stmt"), "method", "arg", (F.col("prob") + 4000).alias("prob"))
    every = own.union(direct)
    hidden = every.where("dst like 'N%'").select("table_id", F.col("dst").alias("node")).distinct()
    return flow.prune_hidden(every, hidden)


@query(
    """, f as (select 'O' || l_orderkey as src, 'F' || l_returnflag as dst, l_linestatus as stmt from lineitem), w as (select distinct src, dst from f where dst <> 'FN')
    select src, stmt from (select f.src, f.stmt, count(distinct f.dst) as have from f join w using (src, dst) group by all) join (select src, count(*) as need from w group by all) using (src) where have = need"""
)
def flow_division(spark, sf_dir):
    lines = star.read(spark, sf_dir, "lineitem").select(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("F"), "l_returnflag").alias("dst"), F.col("l_linestatus").alias("stmt"))
    return flow.divide(lines, lines.where("dst != 'FN'").select("src", "dst"))


def _relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links with the lower probability of their ends, and the column relations they make."""
    found = _links(spark, sf_dir)
    linked = staged(found.withColumn("prop", F.when(F.col("kind") == "value", F.col("prop")).otherwise(F.concat("prop", F.lit("/"), "via"))), "linked")
    return linked, cg.column_relations(linked)


_RELATIONS = """, lp as (select table_id, "row", src_col, dst_col, src, dst, prop, prob from lnk where is_value union all select table_id, "row", src_col, dst_col, src, dst, prop || '/' || quals, prob from lnk where quals <> ''),
    pr as (select table_id, src_col, dst_col, prop, "row", src, dst, max(prob) as prob from lp group by all),
    rl as (select table_id, src_col, dst_col, prop, count(*) as freq, count(distinct (src, dst)) as unique_freq, cast(sum(prob) as bigint) as score from pr group by all)"""


@query(_RELATIONS + " select * from rl")
def cg_build(spark, sf_dir):
    return _relations(spark, sf_dir)[1]


@query(
    _RELATIONS
    + """, n as (select table_id, count(*) as n_rows from nr group by all), pairs as (select distinct table_id, src_col, dst_col from rl),
    pos as (select p.table_id, p.src_col, p.dst_col, count(*) as possible from pairs p join cand u on u.table_id = p.table_id and u.col = p.src_col join cand v on v.table_id = u.table_id and v."row" = u."row" and v.col = p.dst_col group by all),
    has as (select distinct c.table_id, c."row", cast(c.col as bigint) as src_col, s.prop from cand c join (select distinct entity_id, prop from stm) s using (entity_id)),
    um as (select r.table_id, r.src_col, r.dst_col, r.prop, count(*) as unmatched from rl r join has h on h.table_id = r.table_id and h.src_col = r.src_col and h.prop = r.prop join cand v on v.table_id = h.table_id and v."row" = h."row" and v.col = r.dst_col
        where not exists (select 1 from lp where lp.table_id = r.table_id and lp."row" = h."row" and lp.src_col = r.src_col and lp.dst_col = r.dst_col and lp.prop = r.prop) group by all),
    x as (select rl.*, n_rows, coalesce(possible, 0) as possible, coalesce(unmatched, 0) as unmatched, max(coalesce(unmatched, 0) + freq) over (partition by table_id, src_col, dst_col) as most
        from rl join n using (table_id) left join pos using (table_id, src_col, dst_col) left join um using (table_id, src_col, dst_col, prop))
    select table_id, src_col, dst_col, prop, cast(score // n_rows as bigint) as over_row, cast(coalesce(score // nullif(possible, 0), 0) as bigint) as over_ent_row, cast(coalesce(score // nullif(most, 0), 0) as bigint) as over_pos_rel,
        cast(coalesce(unmatched * 10000 // nullif(possible, 0), 0) as bigint) as unmatch_over_ent_row, cast(coalesce(unmatched * 10000 // nullif(most, 0), 0) as bigint) as unmatch_over_pos_rel from x"""
)
def feat_relations(spark, sf_dir):
    """Relation features: score over rows, over possible rows, over the pair's possible relations, and the two of unmatched links."""
    linked, relations = _relations(spark, sf_dir)
    cand, relations = staged(star.candidates(spark, sf_dir), "candidates"), staged(relations, "relations")
    n_rows = star.read(spark, sf_dir, "lineitem").groupBy(F.expr(f"l_orderkey div {star.ORDERS}").alias("table_id")).agg(F.count("*").alias("n_rows"))
    return features.relation_features(relations, n_rows, features.possible_links(cand, relations), features.unmatched_links(cand, star.statements(spark, sf_dir), linked))


@query(
    """, p as (select 'nation-region' as name, cast(n_nationkey as varchar) as src, cast(n_regionkey as varchar) as dst from nation union all select 'order-customer', cast(o_orderkey as varchar), cast(o_custkey as varchar) from orders
        union all select 'order-status', cast(l_orderkey as varchar), l_linestatus from lineitem), k as (select name, src, count(distinct dst) as n from p group by all)
    select name, count(*) as n_keys, count(*) filter (n > 1) as n_many, 100 * count(*) filter (n > 1) <= count(*) as depends from k group by name"""
)
def fd_matrix(spark, sf_dir):
    def pairs(name, table, a, b):
        return star.read(spark, sf_dir, table).select(F.lit(name).alias("name"), F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst"))

    every = pairs("nation-region", "nation", "n_nationkey", "n_regionkey").union(pairs("order-customer", "orders", "o_orderkey", "o_custkey")).union(pairs("order-status", "lineitem", "l_orderkey", "l_linestatus"))
    return features.functional_dependency(every)


@query(
    """, c as (select c_custkey as table_id, cast(0 as bigint) as "row", cast(0 as bigint) as col, 'N' || c_nationkey as entity_id from customer union all select c_custkey, 0, 0, 'R' || (c_nationkey % 5) from customer)
    select * from c where not exists (select 1 from c d join nation on d.entity_id = 'N' || n_nationkey where d.table_id = c.table_id and c.entity_id = 'R' || n_regionkey)"""
)
def spatial_merge(spark, sf_dir):
    customer = star.read(spark, sf_dir, "customer")
    zero = F.lit(0).cast("long")
    nations = customer.select(F.col("c_custkey").alias("table_id"), zero.alias("row"), zero.alias("col"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("entity_id"))
    regions = customer.select("c_custkey", zero, zero, F.concat(F.lit("R"), (F.col("c_nationkey") % 5).cast("string")))
    contains = star.statements(spark, sf_dir).where("prop = 'in_region'").select("entity_id", F.col("target").alias("container"))
    return cg.without_containers(nations.union(regions), contains)


@query(
    """, asked as (select distinct p_brand as prop, p_type as class from part), dom as (select distinct p_brand as prop, p_type as class from part where p_size <= 10)
    select * from asked semi join dom using (prop, class) union select * from asked where prop = 'Brand#11'"""
)
def domain_range_semi(spark, sf_dir):
    part = star.read(spark, sf_dir, "part")
    named = lambda df: df.select(F.col("p_brand").alias("prop"), F.col("p_type").alias("class")).distinct()
    return features.in_domain(named(part), named(part.where("p_size <= 10")), ["Brand#11"])


@query(
    """, v as (select p_partkey // 200 as g, p_partkey as id, cast(round(p_retailprice * 100) as bigint) as value from part),
    j as (select *, case when value - lag(value) over (partition by g order by value, id) > 500 then 1 else 0 end as jump from v), i as (select g, id, value, cast(sum(jump) over (partition by g order by value, id) as bigint) as island from j)
    select *, cast(sum(value) over (partition by g, island) as bigint) as island_sum, count(*) over (partition by g, island) as island_n from i"""
)
def prob_islands(spark, sf_dir):
    values = star.read(spark, sf_dir, "part").select(F.expr("p_partkey div 200").alias("g"), F.col("p_partkey").alias("id"), F.round(F.col("p_retailprice") * 100).cast("long").alias("value"))
    return flow.islands(values, 500, ["g"])


@query(
    """select l_orderkey // 200 as table_id, 'a' || l_partkey as atom, cast(round(10000 * max(1 - l_discount) * 2 / 3) as bigint) as truth from lineitem group by all"""
)
def hlmrf_independent(spark, sf_dir):
    """One positive feature of weight 2 and a negative prior of weight 1 for each atom: the optimum is 2 f / 3."""
    evidence = star.read(spark, sf_dir, "lineitem").groupBy(F.expr(f"l_orderkey div {star.ORDERS}").alias("table_id"), F.concat(F.lit("a"), F.col("l_partkey").cast("string")).alias("atom")).agg(F.max(1 - F.col("l_discount")).alias("truth"))
    ground = hlmrf.ground_positive(evidence, 2.0, "feature").union(hlmrf.ground_negative(evidence.withColumn("truth", F.lit(1.0)), 1.0, "prior"))
    return hlmrf.solve(ground).withColumn("truth", F.round(F.col("truth") * 10000).cast("long"))


_EDGES = """, e as (select o_custkey as table_id, 'o' || o_orderkey as src, 'stmt:' || o_orderpriority as dst, cast(o_orderkey % 100 as bigint) as prob from orders
        union all select distinct o_custkey, 'stmt:' || o_orderpriority, 'c' || o_custkey, cast(o_custkey % 50 as bigint) from orders), ee as (select table_id, src, dst, max(prob) as prob from e group by all)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each customer: orders, their priorities as statements, and the customer; graphs grow in number, not in size."""
    orders = star.read(spark, sf_dir, "orders")
    table = F.col("o_custkey").alias("table_id")
    stmt = F.concat(F.lit("stmt:"), "o_orderpriority")
    into = orders.select(table, F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("src"), stmt.alias("dst"), (F.col("o_orderkey") % 100).alias("prob"))
    out = orders.select(table, stmt, F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.col("o_custkey") % 50)
    return into.union(out).groupBy("table_id", "src", "dst").agg(F.max("prob").alias("prob"))


@query(_EDGES + """ select a.table_id, a.src as u, b.dst as v, a.dst as stmt, a.prob + b.prob as prob from ee a join ee b on a.table_id = b.table_id and a.dst = b.src and a.src <> b.dst qualify row_number() over (partition by a.table_id, a.src, b.dst order by a.prob + b.prob desc, a.dst) = 1""")
def select_pairwise(spark, sf_dir):
    return selection.pairwise(_edges(spark, sf_dir))


@query(_RELATIONS + """ select table_id, src_col, dst_col, prop, score from rl where src_col = 0 qualify row_number() over (partition by table_id, src_col, dst_col order by score desc, prop) = 1""")
def select_known_targets(spark, sf_dir):
    relations = _relations(spark, sf_dir)[1]
    return selection.known_targets(relations, relations.where(F.col("src_col") == star.ORDER).select("table_id", "src_col", "dst_col").distinct())


@query(_EDGES + """ select table_id, src, dst, 101 - prob as weight from ee qualify row_number() over (partition by table_id, dst order by 101 - prob, src) = 1""")
def select_arborescence(spark, sf_dir):
    """These graphs have no cycles, so every node's cheapest way in is the arborescence."""
    return selection.arborescences(_edges(spark, sf_dir).select("table_id", "src", "dst", (101 - F.col("prob")).alias("weight")))


@query("""select cast(n_nationkey as bigint) as table_id, 'n' || n_nationkey as src, 'r' || n_regionkey as dst, 'in_region' as prop from nation union all select n_nationkey, 'n' || n_nationkey, n_name, 'rdfs:label' from nation""")
def sm_minify_normalize(spark, sf_dir):
    """``minify`` undoes ``normalise`` on a model without qualifiers."""
    nation = star.read(spark, sf_dir, "nation")
    me = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    table = F.col("n_nationkey").cast("long")
    edges = nation.select(table.alias("table_id"), me.alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"), F.lit("in_region").alias("prop")).union(nation.select(table, me, "n_name", F.lit("rdfs:label")))
    return model.minify(model.normalise(edges))


@query(
    """select table_id, "row", 'O' || l_orderkey as subject, 'has_item' as prop, case when round(l_discount * 10000) > 500 then 'text ' else '' end || 'P' || l_partkey as value from nr
    union all select table_id, "row", 'O' || l_orderkey, 'supplied_by', case when round(l_tax * 10000) > 500 then 'text ' else '' end || 'S' || l_suppkey from nr
    union all select table_id, "row", case when round(l_discount * 10000) > 500 then "row" || '-1' else 'P' || l_partkey end, 'sold_by', case when round(l_tax * 10000) > 500 then 'text ' else '' end || 'S' || l_suppkey from nr"""
)
def claims_extract(spark, sf_dir):
    cells = star.candidates(spark, sf_dir).withColumn("value", F.concat(F.lit("text "), "entity_id")).withColumn("entity_id", F.when(F.col("prob") >= 9500, F.col("entity_id")))
    relations = cells.select("table_id").distinct().select("table_id", F.explode(F.array(*[F.struct(F.lit(s).alias("src_col"), F.lit(c).alias("dst_col"), F.lit(p).alias("prop")) for s, c, p in ((star.ORDER, star.PART, "has_item"), (star.ORDER, star.SUPPLIER, "supplied_by"), (star.PART, star.SUPPLIER, "sold_by"))])).alias("x")).select("table_id", "x.*")
    return model.claims(cells, relations)


@query("""select p_brand as table_id, cast(p_partkey as bigint) as "row", cast(p_size as bigint) as col, 'Q' || p_partkey as entity_id, cast(0 as bigint) as rank, 'Q' || (p_partkey + 1) as candidate, 0.5::double as prob from part union all select p_brand, p_partkey, p_size, 'Q' || p_partkey, 1, 'Q' || p_size, 1.0 from part""")
def links_parse(spark, sf_dir):
    part = star.read(spark, sf_dir, "part")
    line = F.concat_ws("\t", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.concat(F.lit("http://www.wikidata.org/entity/Q"), F.col("p_partkey").cast("string")), F.concat(F.lit("Q"), (F.col("p_partkey") + 1).cast("string"), F.lit(":0.5")), F.concat(F.lit("Q"), F.col("p_size").cast("string")))
    return links.parse_links(part.select(F.col("p_brand").alias("table_id"), line.alias("value")))


@query(
    """select l_orderkey // 200 as table_id, l_orderkey as "row", cast(l_linenumber % 3 as bigint) as col, 'P' || l_orderkey as gt, count(*) as n,
    string_agg('P' || l_partkey || ':' || l_suppkey || '.500000000', chr(9) order by l_suppkey desc, 'P' || l_partkey) as listed from lineitem group by all"""
)
def linker_group(spark, sf_dir):
    """The grouped candidates of every cell as they are listed, and its ground truth."""
    lines = star.read(spark, sf_dir, "lineitem")
    linker = lines.select(F.expr(f"l_orderkey div {star.ORDERS}").alias("table_id"), F.col("l_orderkey").alias("row"), (F.col("l_linenumber") % 3).alias("col"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("kg_id"), (F.col("l_suppkey") + 0.5).alias("score"), F.concat(F.lit("P"), F.col("l_orderkey").cast("string")).alias("gt"))
    return links.link_candidates(linker).select("table_id", "row", "col", "gt", F.size(F.split("candidates", "\t")).cast("long").alias("n"), F.col("candidates").alias("listed"))


@query(r"""select page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '_' || md5(url) as friendly from pages""")
def friendly_id(spark, sf_dir):
    return star.read(spark, sf_dir, "pages").select("page_id", text.slug_id(F.col("url")).alias("friendly"))


@query(
    """, k as (select conv_id % 40 as g, max(turn) as last from conversations group by all)
    select c.g as table_id, r."row", x.col, coalesce(v.role, '') as value from k c join (select distinct conv_id as "row" from conversations) r on r."row" % 40 = c.g join range(0, 1000) x(col) on x.col <= c.last left join conversations v on v.conv_id = r."row" and v.turn = x.col"""
)
def pad_ragged(spark, sf_dir):
    """Conversations as ragged rows (a turn is a cell), padded within groups of conversations."""
    cells = star.read(spark, sf_dir, "conversations").select((F.col("conv_id") % 40).alias("table_id"), F.col("conv_id").alias("row"), F.col("turn").alias("col"), F.col("role").alias("value"))
    return layout.pad(cells)


@query("""select cast(0 as bigint) as table_id, conv_id as "row", string_agg(coalesce(role, ''), '|' order by turn) as cells from (select c.conv_id, t.turn, max(v.role) as role from (select distinct conv_id from conversations) c, (select distinct turn from conversations) t left join conversations v on v.conv_id = c.conv_id and v.turn = t.turn group by all) group by conv_id""")
def matrix_pivot(spark, sf_dir):
    cells = star.read(spark, sf_dir, "conversations").select(F.lit(0).cast("long").alias("table_id"), F.col("conv_id").alias("row"), F.col("turn").alias("col"), F.col("role").alias("value"))
    wide = layout.matrix(cells)
    return wide.select("table_id", "row", F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), "|").alias("cells"))


@query(
    """, e as (select user_id as g, event_id as pos, event_type from events), c as (select *, case when event_type <> lag(event_type) over (partition by g order by pos) then 1 else 0 end as ch from e), i as (select *, cast(sum(ch) over (partition by g order by pos) as bigint) as island from c)
    select g, island, event_type, count(*) as n, min(pos) as first, max(pos) as last from i group by all"""
)
def compact_runs(spark, sf_dir):
    items = star.read(spark, sf_dir, "events").select(F.col("user_id").alias("g"), F.col("event_id").alias("pos"), "event_type")
    return layout.compact_runs(items, ["g"], "pos", "event_type")


@query(
    """, p as (select child, parent from par union select p_type, 'goods' from part) select child, parent from p where not exists (select 1 from p a join p b on a.parent = b.child where a.child = p.child and b.parent = p.parent)"""
)
def hierarchy_forest(spark, sf_dir):
    parents = star.class_parents(spark, sf_dir)
    return features.transitive_reduction(parents.union(star.read(spark, sf_dir, "part").select("p_type", F.lit("goods"))))


@query(""" select child as class, 'goods/' || parent || '/' || child as path, cast(2 as bigint) as depth, false as is_repeated from par0 union all select distinct parent, 'goods/' || parent, 1, false from par0 union all select 'goods', 'goods', 0, false""")
def hierarchy_preorder(spark, sf_dir):
    """Part types and the classes above them as a forest, in pre-order by path."""
    parents = star.class_parents(spark, sf_dir)
    found = features.forest(parents.select(F.col("child").alias("class")).union(parents.select("parent")), parents)
    return found.select("class", F.array_join("path", "/").alias("path"), F.col("depth").cast("long").alias("depth"), "is_repeated")


@query(""", ty as (select distinct table_id, col, c.class from cand join (select entity_id, class from cls union select entity_id, parent from cls join par on class = child) c using (entity_id)) select distinct t.table_id, cast(t.col as bigint) as col, t.class from ty t join par on par.parent = t.class join ty u on u.table_id = t.table_id and u.col = t.col and u.class = par.child""")
def sub_types(spark, sf_dir):
    wide = cg.with_parents(star.classes(spark, sf_dir), star.class_parents(spark, sf_dir))
    types = staged(star.candidates(spark, sf_dir).join(wide, "entity_id").select("table_id", "col", "class").distinct(), "types")
    return features.sub_types(types, star.class_parents(spark, sf_dir))
