"""Intermediate tables in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset and Spark runs on this machine alone, as in tests, a new local folder is set once;
    on a cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("helixpath.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-helixpath-", dir="/tmp")
        spark.conf.set("helixpath.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/helixpath-{name}-{uuid.uuid4().hex}"


def deleted_at_end(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted when the driver's JVM ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def materialized(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet and reads it back: cuts lineage, and survives the loss of executors. ``by``: a column whose values get folders of their own.

    The table is deleted when the driver's JVM ends; until then results may read it.
    """
    spark = df.sparkSession
    path = deleted_at_end(spark, new_path(spark, name))
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tasks for each core that costly rows are dealt to.
TASKS_PER_CORE = 4


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` with its rows dealt to all cores by a key. A compressed table of many rows may be one split of a file, and so one task, whatever its rows cost."""
    return df.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, *by)
