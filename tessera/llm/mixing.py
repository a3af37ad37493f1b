"""Mixing sources to target weights by systematic sampling.

Each source gets a target of words; a document's expected copies are target / source size. These are prefix-summed within the
source from one random offset, and a document is emitted once per integer boundary that its stretch of the sum crosses. Documents stand in
the order of their size, so the words taken stay near the target.

The prefix sum has two levels: documents are dealt into buckets of (source, size class, hash), as many as the table's rows ask for; buckets are summed and
put in order, and each bucket runs its own sum from where the one before ends. So a source that holds a third of all rows is as many tasks as
it has buckets, and no task sees all sources. Sums are integers in units of 2^-24 copies; reruns agree.

Defined results: a null text has size 0; null is a source of its own, last in order; documents of size 0 take part in the sum
but add no words; repeated rows and null ids each count as a document; an empty table gives no rows; other columns are
ignored, ``carry`` columns come back untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import _stage

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_COPIES = 2
SEED = 20
#: Rows of the table for each hash bucket that a source's size class is dealt into.
BUCKET_ROWS = 50_000
UNIT_BITS = 24
UNIT = 1 << UNIT_BITS
WORD = r"[^\x20\x09-\x0D]+"


def _ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``nr``, the place of each source in order of its name, null last.

    Sources may be hosts, so no task sees them all: they are sorted in ranges, and a range is numbered on from the counts of those before.
    """
    spark = sizes.sparkSession
    placed = _stage.written(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()), "sources")
    counts = {r["part"]: r["n"] for r in placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each range
    parts = sorted(counts)
    before = [(p, sum(counts[q] for q in parts[:i])) for i, p in enumerate(parts)]
    starts = spark.createDataFrame(before, "part long, before long")
    local = F.col("place").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(starts), F.shiftright("place", 33) == F.col("part")).withColumn("nr", F.col("before") + local).drop("part", "before", "place")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row a source).

    The total is shared by weight; targets stop at ``most`` times the source's size and what is over goes to the others by weight,
    until none is above. Each round is one sum over the sources: those that the rate so far takes to their limit spend it, and what is left, over the
    weight that is left, is the next rate. It only rises, so the rounds end when no further source stops.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    weighted = _ranked(sizes).withColumn("weight", F.element_at(cycle, F.pmod("nr", F.lit(len(weights))).cast("int") + 1))
    weighted = _stage.written(weighted.withColumn("limit", (F.col("source_size") * most).cast("double")), "weighted")
    total = (weighted.agg(F.sum("source_size")).first()[0] or 0) * share_percent / 100
    rate, stopped = 0.0, None
    while True:
        over = F.col("limit") <= rate * F.col("weight")
        spent, n, weight = weighted.agg(F.coalesce(F.sum(F.when(over, F.col("limit"))), F.lit(0.0)), F.count_if(over), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == stopped or not weight:
            break
        rate, stopped = (total - spent) / weight, n
    return weighted.select("source", "source_size", F.least("limit", rate * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES, seed: int = SEED, carry: str | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, copies, taken``. ``bucket_rows``: rows of the table for each hash bucket."""
    kept = [carry] if carry else []
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("tie"), *kept)
    # size classes: exact up to 15 words, then 8 to each doubling
    power = F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int")
    step = F.floor((F.col("size") / F.pow(F.lit(2.0), power) - 1) * 8).cast("int")
    base = base.withColumn("class", F.when(F.col("size") < 16, F.col("size").cast("int")).otherwise(16 + (power - 4) * 8 + step))
    base = base.withColumn("hash", F.xxhash64("doc_id", "tie", F.lit(seed)))
    base = base.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    sized = _stage.written(base.drop(*kept), "sized")
    # carried columns are read from the documents again, not written and read on the way
    base = base if kept else sized
    n_buckets = max(1, -(-sized.count() // bucket_rows))
    in_bucket = F.pmod("hash", F.lit(n_buckets)).alias("bucket")

    buckets = sized.withColumn("bucket", in_bucket).groupBy("key", "source", "class", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    buckets = _stage.written(buckets, "buckets")
    sizes = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, share_percent, most)
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    targets = targets.withColumn("expected", F.least(rate, F.lit(most * UNIT)))
    start = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(UNIT))
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("key"), "source_size", "target", "expected")
    # copies expected before a bucket: those of the classes before its own, and of its class's buckets before it
    classes = buckets.groupBy("key", "class").agg(F.sum("n").alias("in_class"))
    earlier = lambda n, order, *by: F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = classes.withColumn("before_class", earlier("in_class", "class", "key"))
    within = buckets.select("key", "class", "bucket", "n").withColumn("before_bucket", earlier("n", "bucket", "key", "class"))
    offsets = within.join(classes, ["key", "class"]).join(targets, "key").withColumn("offset", start + (F.col("before_class") + F.col("before_bucket")) * F.col("expected"))
    offsets = _stage.written(offsets.select("key", "class", "bucket", "source_size", "target", "expected", "offset"), "offsets")

    # merged, not broadcast: documents have to meet by the same key for their own sum anyway
    placed = base.withColumn("bucket", in_bucket).join(offsets.hint("merge"), ["key", "class", "bucket"])
    own = Window.partitionBy("key", "class", "bucket").orderBy("size", "doc_id", "tie")
    upto = F.col("offset") + F.sum("expected").over(own.rowsBetween(Window.unboundedPreceding, 0))
    shifted = F.shiftright(upto, UNIT_BITS) - F.shiftright(upto - F.col("expected"), UNIT_BITS)
    return placed.withColumn("copies", shifted.cast("long")).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *kept)
