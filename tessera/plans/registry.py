"""Queries by name, and the SQL that gives the same rows over views of the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_VIEWS = f"""
    ls as materialized (select *, row_number() over (partition by l_orderkey order by {_LINE}) - 1 as stmt_idx from lineitem),
    stm as (select 'N' || n_nationkey as entity_id, 'in_region' as prop, cast(0 as bigint) as stmt_idx, 'R' || n_regionkey as target from nation
        union all select 'C' || c_custkey, 'in_nation', 0, 'N' || c_nationkey from customer
        union all select 'S' || s_suppkey, 'in_nation', 0, 'N' || s_nationkey from supplier
        union all select 'O' || o_orderkey, 'placed_by', 0, 'C' || o_custkey from orders
        union all select 'O' || l_orderkey, 'has_item', stmt_idx, 'P' || l_partkey from ls),
    qual as (select 'O' || l_orderkey as entity_id, 'has_item' as prop, stmt_idx, 'supplied_by' as qual, 'S' || l_suppkey as target from ls),
    nr as materialized (select *, l_orderkey // 200 as table_id, row_number() over (partition by l_orderkey // 200 order by {_LINE}) - 1 as "row" from lineitem),
    cand as materialized (select table_id, "row", 0 as col, 'O' || l_orderkey as entity_id, cast(10000 as bigint) as prob from nr
        union all select table_id, "row", 1, 'P' || l_partkey, 10000 - cast(round(l_discount * 10000) as bigint) from nr
        union all select table_id, "row", 2, 'S' || l_suppkey, 10000 - cast(round(l_tax * 10000) as bigint) from nr),
    cls as (select 'P' || p_partkey as entity_id, p_type as class from part union all select 'C' || c_custkey, c_mktsegment from customer),
    par0 as (select distinct p_type as child, 'any ' || string_split(p_type, ' ')[-1] as parent from part),
    par as (select child, parent from par0 union select parent, 'goods' from par0),
    hop as materialized (select src, dst, prop, stmt_idx, coalesce(string_agg(distinct qual, ',' order by qual), '') as quals, bool_or(v) as is_value
        from (select entity_id as src, target as dst, prop, stmt_idx, null as qual, true as v from stm union all select entity_id, target, prop, stmt_idx, qual, false from qual) group by all),
    lnk as (select u.table_id, u."row", cast(u.col as bigint) as src_col, cast(v.col as bigint) as dst_col, u.entity_id as src, v.entity_id as dst, h.prop, h.stmt_idx, h.is_value, h.quals, least(u.prob, v.prob) as prob
        from cand u join hop h on h.src = u.entity_id join cand v on v.table_id = u.table_id and v."row" = u."row" and v.entity_id = h.dst and v.col <> u.col where h.src <> h.dst)
"""


def query(sql: str | None = None):
    """Registers a query under its function's name, and the SQL for it after the common views."""

    def register(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = make(spark, sf_dir)
            return df.select(*[F.col(c).cast("long").alias(c) if kind in ("int", "tinyint", "smallint") else F.col(c) for c, kind in df.dtypes])

        QUERIES[make.__name__] = run
        if sql is not None:
            ORACLE_SQL[make.__name__] = f"with {_VIEWS} {sql}"
        return make

    return register
