"""Exact top-k search by inner product: tiles of queries x shards of candidates, a selection in each tile, and a tree that merges the lists.

Queries go to every task in blocks of a fixed number of bytes, one block at a time; each task multiplies the block with its own shard of the
candidates, tile by tile, and keeps a list for each query. The lists of all tasks are merged in groups of FAN_IN, level by level.
Scores are integers and exact: a tile is multiplied in single or double precision only where no sum can leave the range in which those are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import deleted_at_end, new_path, saved

#: Bytes of query vectors that are sent to every task at a time.
BLOCK_BYTES = 32 << 20
QUERY_TILE = 512
CANDIDATE_TILE = 4_096
FAN_IN = 16
_LISTS = "tile long, node long, query array<long>, vec_id array<long>, score array<long>, known array<boolean>, taken array<int>"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def matrix(vectors: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of every vector that takes part, shorter ones filled up with zeros, and the rows that those are.

    Null vectors and those with a null or non-finite component take no part.
    """
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    holes = values.is_null().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    bad = np.concatenate([[0], np.cumsum(holes | ~np.isfinite(x))])
    size = np.diff(offsets)
    rows = np.flatnonzero(~vectors.is_null().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]]))
    width = int(size[rows].max(initial=0))
    out = np.zeros((len(rows), width))
    if width:
        at = np.arange(width)
        inside = at < size[rows, None]
        out[inside] = x[(offsets[rows, None] + at)[inside]]
    return out, rows


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact; beyond 64 bits, the ends of that range."""
    width = min(queries.shape[1], candidates.shape[1])
    queries, candidates = queries[:, :width], candidates[:, :width]
    if not width:
        return np.zeros((len(queries), len(candidates)))
    # no partial sum is greater than the product of the lengths
    most = np.sqrt((queries * queries).sum(1).max(initial=0) * (candidates * candidates).sum(1).max(initial=0))
    if most < 1 << 23:
        return queries.astype(np.float32) @ candidates.astype(np.float32).T
    if most < 1 << 52:
        return queries @ candidates.T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(queries).dot(whole(candidates).T), _LEAST, _MOST).astype(np.int64)


class Lists:
    """The k best candidates met so far of each of n queries: by score, then by smaller id, null ids last."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.known = np.zeros(0, bool)
        self.least = np.full(n, _LEAST, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        if not len(query):
            return
        query, score, ids, known = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids), (self.known, known)))
        order = np.lexsort((ids, ~known, np.invert(score), query))
        query = query[order]
        first = np.searchsorted(query, np.arange(self.n))
        kept = np.arange(len(query)) - first[query] < self.k
        order = order[kept]
        self.query, self.score, self.id, self.known = query[kept], score[order], ids[order], known[order]
        taken = np.bincount(self.query, minlength=self.n)
        full = np.flatnonzero(taken == self.k)
        self.least[full] = self.score[np.searchsorted(self.query, full, side="right") - 1]

    def meet(self, low: int, scores: np.ndarray, own: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """A tile's scores, of queries from ``low`` on and candidates by ascending id, null ids last. ``own``: pairs that take no part."""
        width = scores.shape[1]
        bound = self.least[low : low + len(scores)]
        if width > self.k:  # the k-th score of the tile bounds the list as well
            part = np.where(own, -np.inf, scores) if own.any() and scores.dtype != np.int64 else np.where(own, _LEAST, scores) if own.any() else scores
            at = np.partition(part, width - self.k, axis=1)[:, width - self.k]
            bound = np.maximum(bound, np.where(at == -np.inf, _LEAST, at.astype(np.int64, copy=False) if at.dtype == np.int64 else np.maximum(at, -(2.0**62)).astype(np.int64)))
        take = (scores >= bound[:, None].astype(scores.dtype)) & ~own
        many = np.flatnonzero(take.sum(1) > 2 * self.k)
        if len(many):  # of equal scores at the bound only the first k can be in the list
            tied = take[many] & (scores[many] == bound[many, None].astype(scores.dtype))
            take[many] &= ~(tied & (np.cumsum(tied, axis=1) > self.k))
        q, c = np.nonzero(take)
        self.add(q + low, scores[q, c].astype(np.int64), ids[c], known[c])


def _lists(x: Lists, tile: int, node: int, low: int, high: int) -> pa.RecordBatch:
    a, b = np.searchsorted(x.query, [low, high])
    one = lambda v, t: pa.array([v], pa.list_(t))
    taken = np.bincount(x.query[a:b] - low, minlength=high - low)
    return pa.RecordBatch.from_arrays(
        [pa.array([tile], pa.int64()), pa.array([node], pa.int64()), one(x.query[a:b], pa.int64()), one(x.id[a:b], pa.int64()), one(x.score[a:b], pa.int64()), one(x.known[a:b], pa.bool_()), one(taken, pa.int32())],
        ["tile", "node", "query", "vec_id", "score", "known", "taken"],
    )


def _blocks(packs: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, whether known, vectors) of the queries, BLOCK_BYTES at a time: the driver holds one block, and a part of ``packs``."""
    held, size = [], 0
    for r in packs.toLocalIterator():
        x = np.frombuffer(r["image"], np.float64).reshape(len(r["ids"]), r["width"])
        ids = np.array([i if i is not None else 0 for i in r["ids"]], np.int64)
        held.append((ids, np.array([i is not None for i in r["ids"]], bool), x))
        size += max(x.nbytes, 8 * len(ids))
        if size >= BLOCK_BYTES:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = max(x.shape[1] for _, _, x in held)
    wide = [np.pad(x, ((0, 0), (0, width - x.shape[1]))) for _, _, x in held]
    return np.concatenate([i for i, _, _ in held]), np.concatenate([k for _, k, _ in held]), np.concatenate(wide)


def search(candidates: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of the greatest inner product of each row that ``is_query`` takes; fewer where there are fewer.

    Components are floor(scale * x), x as a double; scores are exact integers (beyond 64 bits: the ends of that range). Of equal scores the smaller id comes first,
    a null id last. A query's own row is no candidate, nor are others of the same id. Rows whose vector is null or holds a null or non-finite component, also
    after scaling, take no part; a shorter vector counts as if it went on with zeros, an empty one has the score 0. Repeated
    rows stay, as candidates and as queries. An empty table gives no rows. Other columns are not read.
    """
    spark = candidates.sparkSession
    rows = candidates.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, QUERY_TILE):
                part = batch.slice(low, QUERY_TILE)
                x, kept = matrix(part.column("vector"), scale)
                ids = part.column("id").take(pa.array(kept))
                if len(kept):
                    yield pa.RecordBatch.from_pylist([{"ids": ids.to_pylist(), "width": x.shape[1], "image": x.tobytes()}], pa.schema([("ids", pa.list_(pa.int64())), ("width", pa.int32()), ("image", pa.binary())]))

    packs = saved(rows.where("asks").select("id", "vector").mapInArrow(pack, "ids array<long>, width int, image binary"), "queries")
    path = deleted_at_end(spark, new_path(spark, "topk"))
    first = 0
    for ids, known, vectors in _blocks(packs):
        block = spark.sparkContext.broadcast((first, ids, known, vectors))
        _partial(rows, block, k, scale).write.mode("append").parquet(path)
        block.destroy()
        first += -(-len(ids) // QUERY_TILE)
    if not first:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lists = spark.read.schema(_LISTS + ", ids array<long>").parquet(path)
    highest = lists.agg(F.max("node")).first()[0] or 0
    while highest:
        lists = lists.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long")).groupBy("tile", "node").applyInArrow(lambda t: _merged(t, k), lists.schema)
        highest //= FAN_IN
    return _ranked(lists)


def _partial(rows: DataFrame, block, k: int, scale: float) -> DataFrame:
    """For each task and tile of queries a row with the best of the task's candidates."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, ids, known, vectors = block.value
        top = Lists(len(ids), k)
        for batch in batches:
            for start in range(0, batch.num_rows, CANDIDATE_TILE):
                part = batch.slice(start, CANDIDATE_TILE)
                x, kept = matrix(part.column("vector"), scale)
                here = part.column("id").take(pa.array(kept))
                has = here.is_valid().to_numpy(zero_copy_only=False)
                name = here.fill_null(0).to_numpy(zero_copy_only=False)
                order = np.lexsort((name, ~has))
                x, has, name = x[order], has[order], name[order]
                for low in range(0, len(ids), QUERY_TILE):
                    high = min(low + QUERY_TILE, len(ids))
                    own = (ids[low:high, None] == name) & known[low:high, None] & has
                    top.meet(low, products(vectors[low:high], x), own, name, has)
        for t, low in enumerate(range(0, len(ids), QUERY_TILE)):
            high = min(low + QUERY_TILE, len(ids))
            named = pa.array([[i if k_ else None for i, k_ in zip(ids[low:high].tolist(), known[low:high].tolist(), strict=True)]], pa.list_(pa.int64()))
            out = _lists(top, first + t, TaskContext.get().partitionId(), low, high)
            yield pa.RecordBatch.from_arrays([*out.columns, named], [*out.schema.names, "ids"])

    return rows.select("id", "vector").mapInArrow(best, _LISTS + ", ids array<long>")


def _merged(lists: pa.Table, k: int) -> pa.Table:
    """FAN_IN lists of one tile of queries, at most, as one."""
    ids = lists.column("ids")[0]
    n = len(ids)
    top = Lists(n, k)
    for r in range(lists.num_rows):
        flat = lambda c: lists.column(c)[r].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
        top.add(np.repeat(np.arange(n), flat("taken")), flat("score"), flat("vec_id"), flat("known").astype(bool))
    out = _lists(top, lists.column("tile")[0].as_py(), lists.column("node")[0].as_py(), 0, n)
    return pa.Table.from_batches([pa.RecordBatch.from_arrays([*out.columns, pa.array([ids.as_py()], pa.list_(pa.int64()))], [*out.schema.names, "ids"])])


def _ranked(lists: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                flat = lambda c: batch.column(c)[r].values  # noqa: E731, B023
                taken = flat("taken").to_numpy()
                which = np.repeat(np.arange(len(taken)), taken)
                rank = np.arange(len(which)) - np.repeat(np.cumsum(taken) - taken, taken) + 1
                vec = pa.array(flat("vec_id").to_numpy(), mask=~flat("known").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([flat("ids").take(pa.array(which)), pa.array(rank, pa.int32()), vec, flat("score")], ["query_id", "rank", "vec_id", "score"])

    return lists.mapInArrow(rows, "query_id long, rank int, vec_id long, score long")
