"""What kind of numbers a property has, and columns that do not fit: statistics that can be kept in a store and added to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY = ["prop", "qual"]


def statistics(numbers: DataFrame) -> DataFrame:
    """``prop, qual, size, int_size, least, most, total, squares`` of ``numbers`` (prop, qual, number): of a statement's own values (``qual`` null) and of each qualifier.

    Every measure is a sum, a least or a most, so statistics of parts of the knowledge graph can be merged. Null numbers do not count.
    """
    own = numbers.where("number is not null").select(*_KEY, F.col("number").cast("double").alias("x"))
    whole = F.count_if(F.col("x") == F.floor("x"))
    return own.groupBy(*_KEY).agg(F.count("*").alias("size"), whole.alias("int_size"), F.min("x").alias("least"), F.max("x").alias("most"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"))


def merged(*stores: DataFrame) -> DataFrame:
    every = reduce(DataFrame.unionByName, stores)
    return every.groupBy(*_KEY).agg(F.sum("size").alias("size"), F.sum("int_size").alias("int_size"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))


def moments(store: DataFrame) -> DataFrame:
    """``store`` with ``mean`` and ``deviation`` (of all values, not of a sample)."""
    mean = F.col("total") / F.col("size")
    return store.withColumn("mean", mean).withColumn("deviation", F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("size") - mean * mean)))


def type_mismatch(relations: DataFrame, kinds: DataFrame, store: DataFrame, least: float = 0.99) -> DataFrame:
    """``relations`` (table_id, u, v, stmt, prop, pred) with ``mismatch``: 1 where a numeric column stands for a property whose numbers are of the other kind, 0 where they agree.

    A property's numbers are whole if more than ``least`` of them are. Null where ``v`` is no numeric column (``kinds``: table_id, col, kind) or nothing is known of the property; a
    qualifier's numbers are those it has under the statement's property.
    """
    asked = relations.withColumn("qual", F.when(F.col("pred") != F.col("prop"), F.col("pred"))).withColumn("col", F.regexp_extract("v", r"^col:([0-9]+)$", 1).try_cast("long"))
    known = store.where("size > 0").select(F.col("prop").alias("p"), F.col("qual").alias("q"), (F.col("int_size") > least * F.col("size")).alias("is_whole"))
    typed = asked.join(kinds.select("table_id", F.col("col").cast("long").alias("col"), "kind"), ["table_id", "col"], "left")
    met = typed.join(known, (typed["prop"] == known["p"]) & typed["qual"].eqNullSafe(known["q"]), "left")
    mismatch = F.when(F.col("kind") == "integer", (~F.col("is_whole")).cast("long")).when(F.col("kind") == "float", F.col("is_whole").cast("long"))
    return met.select(*relations.columns, mismatch.alias("mismatch"))
