"""The candidate graph: flows between cells collapsed on columns, and types of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def column_relations(links: DataFrame) -> DataFrame:
    """``table_id, src_col, dst_col, prop, freq, unique_freq, score``: links of cells by column pair and property.

    ``freq`` counts linked pairs of cells, ``unique_freq`` distinct pairs of entities, ``score`` sums each pair's best probability.
    """
    key = ["table_id", "src_col", "dst_col", "prop"]
    pairs = links.groupBy(*key, "row", "src", "dst").agg(F.max("prob").alias("prob"))
    ends = pairs.groupBy(*key, "src", "dst").agg(F.count("*").alias("n"), F.sum("prob").alias("score"))
    return ends.groupBy(*key).agg(F.sum("n").alias("freq"), F.count("*").alias("unique_freq"), F.sum("score").alias("score"))


def with_parents(classes: DataFrame, parents: DataFrame, distance: int = 1) -> DataFrame:
    """``entity_id, class`` with the classes up to ``distance`` steps above added."""
    out = step = classes.select("entity_id", "class").distinct()
    for _ in range(distance):
        step = step.join(parents, step["class"] == parents["child"]).select("entity_id", F.col("parent").alias("class")).distinct()
        out = out.union(step)
    return out.distinct()


def type_frequency(candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """``table_id, col, class, freq``: per cell the best probability of a class, summed over the column."""
    cells = candidates.join(classes, "entity_id").groupBy("table_id", "row", "col", "class").agg(F.max("prob").alias("prob"))
    return cells.groupBy("table_id", "col", "class").agg(F.sum("prob").alias("freq"))


def entity_rows(candidates: DataFrame) -> DataFrame:
    """``table_id, col, n_rows``: rows whose cell has an entity."""
    return candidates.select("table_id", "col", "row").distinct().groupBy("table_id", "col").agg(F.count("*").alias("n_rows"))


def best_type(frequency: DataFrame) -> DataFrame:
    """``table_id, col, class, freq``: each column's most frequent class, the first by name of equals."""
    order = Window.partitionBy("table_id", "col").orderBy(F.col("freq").desc(), "class")
    return frequency.withColumn("nr", F.row_number().over(order)).where("nr = 1").drop("nr")


def majority_type(candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """``table_id, col, class, votes``: each column's class with most cells."""
    votes = candidates.join(classes, "entity_id").select("table_id", "col", "row", "class").distinct().groupBy("table_id", "col", "class").agg(F.count("*").alias("freq"))
    return best_type(votes).withColumnRenamed("freq", "votes")


def without_containers(candidates: DataFrame, contains: DataFrame) -> DataFrame:
    """Candidates of a cell less those that another candidate of the cell lies in (``contains``: entity_id, container)."""
    outer = candidates.select("table_id", "row", "col", "entity_id").join(contains, "entity_id").select("table_id", "row", "col", F.col("container").alias("entity_id")).distinct()
    return candidates.join(outer, ["table_id", "row", "col", "entity_id"], "left_anti")
