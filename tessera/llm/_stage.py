"""Tables written between the steps of one operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``. Only where that is unset on one machine (tests) a temporary folder is made and set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        where = tempfile.mkdtemp(prefix="spark-llm-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, what: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{what}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str, modulus: int, remainder: int):
    """True where crc32 of the id as text leaves ``remainder``; a null id hashes as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus == remainder


def columns_of(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast, whatever else the table holds under whatever names."""
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds.items()])


def long_field(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


#: A key that holds one row in HOT, or more, is joined by broadcast.
HOT = 1000


def spread_join(rows: DataFrame, by_key: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``by_key``, which has one row for each key and in ``n`` how many of ``rows`` hold it; ``total`` is how many rows there are.

    Keys with a thousandth of all rows or more are few whatever the input's size (HOT, or HOT for each sort of key that every row has one of), so their
    rows stay where they are; all others shuffle, and no task gets a hot key.
    """
    is_hot = F.col("n") * HOT >= total
    hot = by_key.where(is_hot)
    met = rows.join(F.broadcast(hot), keys)
    return met.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(by_key.where(~is_hot), keys))
