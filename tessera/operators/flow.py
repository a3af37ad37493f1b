"""Flows of the data graph: which source reaches which target by which statement, with what evidence.

``flow``: table_id, src, dst, prop, stmt, method, arg, prob. Nodes and edges are views of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINK = "from_wikidata_link"
LITERAL = "from_literal_matching_function"
KEY = ["table_id", "src", "dst", "prop", "stmt"]


def merge_provenance(flow: DataFrame) -> DataFrame:
    """One row for each flow, method and argument, with the highest probability."""
    return flow.groupBy(*KEY, "method", "arg").agg(F.max("prob").alias("prob"))


def infer_subproperties(flow: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Flows that follow by ``ancestors`` (prop, ancestor): a flow by a property is one by each ancestor that the same table uses.

    The statement keeps its name with the ancestor's in front, so it is told from the one it follows from.
    """
    used = flow.select("table_id", F.col("prop").alias("ancestor")).distinct()
    return flow.join(ancestors, "prop").join(used, ["table_id", "ancestor"], "left_semi").select("table_id", "src", "dst", F.col("ancestor").alias("prop"), F.concat("ancestor", F.lit("<-"), "stmt").alias("stmt"), "method", "arg", "prob")


def infer_transitive(flow: DataFrame, transitive: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """``table_id, src, dst, prop, prob``: a to c where a reaches b and b reaches c by the same transitive property; one round.

    The probability is the lower of the two legs, the best over all middles.
    """
    legs = flow.where(F.col("prop").isin(transitive)).groupBy("table_id", "src", "dst", "prop").agg(F.max("prob").alias("prob"))
    a, b = legs.alias("a"), legs.alias("b")
    on = (F.col("a.table_id") == F.col("b.table_id")) & (F.col("a.dst") == F.col("b.src")) & (F.col("a.prop") == F.col("b.prop")) & (F.col("a.src") != F.col("b.dst"))
    found = a.join(b, on).select("a.table_id", "a.src", "b.dst", "a.prop", F.least("a.prob", "b.prob").alias("prob"))
    return found.groupBy("table_id", "src", "dst", "prop").agg(F.max("prob").alias("prob"))


def prune_hidden(flow: DataFrame, hidden: DataFrame) -> DataFrame:
    """``flow`` without legs out of ``hidden`` entities (table_id, node) whose every source reaches the target itself at least as well.

    A leg hidden -> v goes if no source u of the hidden entity lacks a direct leg u -> v as good: a link beats a literal match, then the
    higher probability wins. So a leg stays where there is a counter-example, found by an anti-join. Hidden entities without a source are roots and
    keep their legs.
    """
    better = F.struct((F.col("method") == LINK).cast("int").alias("link"), "prob")
    best = flow.groupBy("table_id", "src", "dst").agg(F.max(better).alias("best"))
    into = flow.join(hidden.select("table_id", F.col("node").alias("dst")), ["table_id", "dst"], "left_semi").select("table_id", F.col("src").alias("u"), F.col("dst").alias("h")).distinct()
    out = best.join(hidden.select("table_id", F.col("node").alias("src")), ["table_id", "src"], "left_semi").select("table_id", F.col("src").alias("h"), F.col("dst").alias("v"), F.col("best").alias("leg"))
    ways = into.join(out, ["table_id", "h"]).where("u != v")
    direct = best.select("table_id", F.col("src").alias("u"), F.col("dst").alias("v"), F.col("best").alias("direct"))
    judged = ways.join(direct, ["table_id", "u", "v"], "left").groupBy("table_id", "h", "v").agg(F.bool_and(F.coalesce(F.col("direct") >= F.col("leg"), F.lit(False))).alias("covered"))
    gone = judged.where("covered").select("table_id", F.col("h").alias("src"), F.col("v").alias("dst"))
    return flow.join(gone, ["table_id", "src", "dst"], "left_anti")


def divide(flow: DataFrame, wanted: DataFrame) -> DataFrame:
    """``src, stmt``: statements that reach all targets wanted of their source (``wanted``: src, dst)."""
    need = wanted.distinct().groupBy("src").agg(F.count("*").alias("need"))
    have = flow.join(wanted.distinct(), ["src", "dst"], "left_semi").groupBy("src", "stmt").agg(F.countDistinct("dst").alias("have"))
    return have.join(need, "src").where("have = need").select("src", "stmt")


def islands(values: DataFrame, eps: int, group: list[str]) -> DataFrame:
    """Values of a group clustered where sorted neighbours are at most ``eps`` apart: adds ``island``, and the sum and count of its values."""
    order = Window.partitionBy(*group).orderBy("value", "id")
    jump = F.when(F.col("value") - F.lag("value").over(order) > eps, 1).otherwise(0)
    marked = values.withColumn("jump", jump).withColumn("island", F.sum("jump").over(order))
    own = Window.partitionBy(*group, "island")
    return marked.withColumn("island_sum", F.sum("value").over(own)).withColumn("island_n", F.count("*").over(own)).drop("jump")


def smoothed(values: DataFrame, eps: float, group: list[str], threshold: float = 0.0) -> DataFrame:
    """``values`` from ``threshold`` on, with ``mean``: the mean of the cluster that a value is in (see ``islands``); the value itself if ``eps`` and ``threshold`` are 0."""
    if not eps and not threshold:
        return values.withColumn("mean", F.col("value").cast("double"))
    return islands(values.where(F.col("value") >= threshold), eps, group).withColumn("mean", F.col("island_sum") / F.col("island_n")).drop("island", "island_sum", "island_n")
