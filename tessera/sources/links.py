"""Links of cells: sidecar lines and the output of an entity linker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_links(lines: DataFrame, top_k: int = 100) -> DataFrame:
    """``table_id, row, col, entity_id, rank, candidate, prob`` from lines ``table_id, value`` of row, column and ids, separated by tabs.

    Where every line of a table has one id, it is the only candidate; otherwise the first id is the entity and the others are
    candidates. Ids may be URIs and may carry ``:probability``. At most ``top_k`` candidates are read.
    """
    fields = lines.withColumn("f", F.split("value", "\t")).withColumn("ids", F.slice("f", 3, top_k + 1))
    alone = fields.groupBy("table_id").agg((F.max(F.size("ids")) == 1).alias("alone"))
    named = fields.join(alone, "table_id").select("table_id", F.element_at("f", 1).cast("long").alias("row"), F.element_at("f", 2).cast("long").alias("col"), F.element_at("ids", 1).alias("first"), F.when(F.col("alone"), F.col("ids")).otherwise(F.expr("slice(ids, 2, size(ids))")).alias("rest"))
    key = lambda c: F.regexp_extract(c, r"([A-Z][0-9]+)(?::[0-9.eE+-]+)?$", 1)
    each = named.select("table_id", "row", "col", F.nullif(key("first"), F.lit("")).alias("entity_id"), F.posexplode_outer("rest").alias("rank", "one"))
    prob = F.nullif(F.regexp_extract("one", r":([0-9.eE+-]+)$", 1), F.lit("")).cast("double")
    return each.select("table_id", "row", "col", "entity_id", F.col("rank").cast("long").alias("rank"), F.nullif(key("one"), F.lit("")).alias("candidate"), F.when(F.col("one").isNotNull(), F.coalesce(prob, F.lit(1.0))).alias("prob"))


def link_candidates(linker: DataFrame) -> DataFrame:
    """``table_id, row, col, gt, candidates`` from linker rows ``table_id, row, col, kg_id, score, gt``: ids with 9 decimals, best first."""
    one = F.struct((-F.col("score")).alias("down"), "kg_id", F.concat("kg_id", F.lit(":"), F.format_string("%.9f", "score")).alias("text"))
    return linker.groupBy("table_id", "row", "col").agg(F.min("gt").alias("gt"), F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["text"]), "\t").alias("candidates"))


def known_only(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates whose entity is in the graph."""
    return candidates.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")


def read_csv_tables(spark: SparkSession, glob: str) -> DataFrame:
    """``table_id, row, col, value`` of CSV files of any width, header as row -1; the file's stem is the table's id."""
    lines = spark.read.text(glob, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("table_id"), "value")

    def cut(batches):
        import csv
        import io

        import pandas as pd

        for pdf in batches:
            rows = [(t, r - 1, c, v) for t, text in zip(pdf["table_id"], pdf["value"], strict=True) for r, own in enumerate(csv.reader(io.StringIO(text))) for c, v in enumerate(own)]
            yield pd.DataFrame(rows, columns=["table_id", "row", "col", "value"])

    return lines.mapInPandas(cut, "table_id string, row long, col long, value string")
