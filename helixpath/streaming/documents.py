"""A folder of documents as a stream: new files are checked, and paths evaluated, as they come."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import TASKS_PER_CORE
from ..sources.documents import IGNORED, checked, within

_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listed_in_few_tasks(spark: SparkSession) -> Iterator[None]:
    """Streams that start within list each batch's files in tasks for the cores; Spark's own setting gives each file a task, which costs more than its contents."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


def read_stream(spark: SparkSession, root: str, files_per_batch: int = 1_000, pattern: str = "*.json", ignore: tuple[str, ...] = IGNORED) -> DataFrame:
    """(path, modified, json, v, resource_type, doc_error) of the files below ``root`` whose names fit ``pattern``, each once, as ``sources.documents`` gives them.
    Files below a folder named in ``ignore`` are left out."""
    files = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).text(root, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("json"))
    return checked(files.where(within(root, ignore)))


def counts(docs: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, resource_type, documents) by time of change; a window is given out once no document can be late for it."""
    return docs.withWatermark("modified", late).groupBy(F.window("modified", window), "resource_type").agg(F.count("*").alias("documents"))
