"""One place that says how a session for this library is set up."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, name: str = "tessera") -> SparkSession:
    """A local session with the settings tests and the bench use; on a cluster the submitter's settings stay in force."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, ``spark.checkpoint.dir``. Only where that is unset on one machine a temporary one is made."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        where = tempfile.mkdtemp(prefix="spark-tessera-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def staged(df: DataFrame, what: str = "staged") -> DataFrame:
    """``df`` written as Parquet into the folder that all machines share, and read again: what several parts of a query use is made once, and lost executors
    cost only their own tasks."""
    spark, where = df.sparkSession, shared_folder(df.sparkSession)
    path = f"{where}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more, such as the rounds before the last of an iteration."""
    for df in tables:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
