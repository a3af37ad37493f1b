"""Shapes of tables and runs of text items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pad(cells: DataFrame) -> DataFrame:
    """``table_id, row, col, value``: ragged rows filled with empty cells up to the widest row of their table."""
    width = cells.groupBy("table_id").agg(F.max("col").alias("last"))
    grid = cells.select("table_id", "row").distinct().join(width, "table_id").select("table_id", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("col"))
    return grid.join(cells.select("table_id", "row", "col", "value"), ["table_id", "row", "col"], "left").select("table_id", "row", "col", F.coalesce("value", F.lit("")).alias("value"))


def matrix(cells: DataFrame) -> DataFrame:
    """``table_id, row, cells``: each row's cells as an array, as wide as its table; null where there is none."""
    width = cells.groupBy("table_id").agg(F.max("col").alias("last"))
    rows = cells.groupBy("table_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("held"))
    places = F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))
    return rows.join(width, "table_id").select("table_id", "row", F.transform(places, lambda c: F.col("held")[c]).alias("cells"))


def compact_runs(items: DataFrame, group: list[str], order: str, kind: str) -> DataFrame:
    """``group, island, kind, n, first, last``: neighbours of one kind as one run."""
    own = Window.partitionBy(*group).orderBy(order)
    change = F.when(F.col(kind) != F.lag(kind).over(own), 1).otherwise(0)
    marked = items.withColumn("change", change).withColumn("island", F.sum("change").over(own))
    return marked.groupBy(*group, "island", kind).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))
