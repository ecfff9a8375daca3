"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same vertices as (a, b) does, one for each vertex but the least of its component."""
    if not len(a):
        return a, b
    ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = where[: len(a)], where[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    kept = np.flatnonzero(root != np.arange(len(ids)))
    return ids[kept], ids[root[kept]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst: long): root is the least node of its component.

    Each round is two shuffles of at most the edges there are: a large-star step joins the
    greater neighbours of a node to its least one, a small-star step the smaller ones. A
    star's centre with very many edges meets one row of its least neighbour, so Spark can split
    that join. A self-edge makes a node of its own component; nulls are dropped; no edges give
    no rows. Each round's table is written to the shared folder.
    """
    edges = saved(edges.select("src", "dst").where("src is not null and dst is not null"), "edges")
    alone = edges.select(F.col("src").alias("node"))
    alone = alone.union(edges.select(F.col("dst").alias("node"))).distinct()
    links = saved(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        "links",
    )
    seen = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        links = saved(small.distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return alone.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
