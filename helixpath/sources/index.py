"""A stored index of a folder of documents, which a rescan merges with what the folder holds now.

The index is four tables of one folder: files (path, modified, resource_type, doc_error), resources, identities and references, all with the path of
the file they are from. A rescan lists the files, takes over the rows of those that are unchanged, reads the others, and leaves out those that are gone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..plans.shared import deleted_at_end, materialized, new_path
from .documents import IGNORED, checked, listed, read_files

TABLES = ("files", "resources", "identities", "references")


@dataclass(frozen=True)
class Index:
    """``root``: the folder of documents, ``folder``: that of the tables. ``kept``, ``read`` and ``removed`` count files of the rescan that made it."""

    root: str
    folder: str
    kept: int
    read: int
    removed: int

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")


def _records(docs: DataFrame) -> dict[str, DataFrame]:
    found = materialized(graph.resources(docs), "resources")
    return {"files": docs.select("path", "modified", "resource_type", "doc_error"), "resources": found, "identities": graph.identities(docs, found), "references": graph.references(found)}


def rescan(spark: SparkSession, root: str, before: Index | None = None, ignore: tuple[str, ...] = IGNORED, folder: str | None = None, pattern: str = "*.json") -> Index:
    """The index of ``root`` as it is now. ``before``: an earlier one, whose records of files with the same path and time of change are taken over unread.

    ``folder``: where the tables are written, a new folder (default: one in the shared folder that is deleted when the driver ends). An empty folder of
    documents gives empty tables.
    """
    folder = folder or deleted_at_end(spark, new_path(spark, "index"))
    now = materialized(listed(spark, root, ignore, pattern), "listing")
    known = before.table(spark, "files").select("path", "modified") if before else now.where("false")
    same = materialized(now.join(known, ["path", "modified"], "left_semi").select("path"), "unchanged")
    changed = now.join(same, "path", "left_anti")
    # the listing is filtered by one time before any file is opened; what is left is compared by path
    since = changed.agg(F.min("modified")).first()[0]
    fresh = read_files(spark, root, ignore, pattern=pattern)[0]
    fresh = fresh.where(F.col("modified") >= F.lit(since)) if since is not None else fresh.where("false")
    docs = materialized(checked(fresh.join(changed.select("path"), "path", "left_semi")).select("path", "modified", "v", "resource_type", "doc_error"), "changed")
    for name, rows in _records(docs).items():
        if before:
            rows = before.table(spark, name).join(same, "path", "left_semi").unionByName(rows)
        rows.write.parquet(f"{folder}/{name}")
    n_known, n_same, n_now = known.count(), same.count(), now.count()
    gone = known.join(now.select("path"), "path", "left_anti").count() if n_known else 0
    return Index(root, folder, n_same, n_now - n_same, gone)
