"""Exact top-k inner products by columnar branch and bound.

Vectors stay where they are read; queries travel in blocks of at most ``block_bytes``.  One block at a time is sent, met
by all vectors, its results written and its copies on the executors removed, so neither the driver nor an executor holds
more than a block however many queries there are.  A task turns each batch into a vertical layout (one array per
dimension) and takes, for each query, blocks of dimensions in turn: partial score + |rest of query| |rest of vector|
(Cauchy-Schwarz on the remaining mass) bounds the final score.  After each block the candidates whose bound is below the
query's k-th best so far are compacted away.

Partial scores and bounds are float64; a bound is widened by the most that rounding can have taken from it, and what is
left is scored anew in integers, so results are exact whatever the components are.  A score beyond a long counts as the
nearest long, and ties with what else does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.runtime import dropped, materialise, trimmed

K, SCALE, DIM_BLOCK, BLOCK_BYTES = 5, 256, 16, 8 << 20
#: Vectors that a task works on at once; smaller Arrow batches are joined until they hold as many.
BATCH = 16384


def quantise(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of each component as long; vectors that are null or hold null or non-finite parts go."""
    x = F.col(vec_col).cast("array<double>")
    ok = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(ok & F.col("id").isNotNull()).select("id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Searcher:
    """Keeps each query's k best (score, id) over the batches of one task."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, dim_block: int):
        self.ids, self.whole, self.q, self.k = ids, matrix, matrix.astype(np.float64), k
        self.cuts = [*range(0, matrix.shape[1], dim_block), matrix.shape[1]]
        # norms of what remains of each query from each cut on
        squares = self.q**2
        self.rest = [np.sqrt(squares[:, c:].sum(axis=1)) for c in self.cuts]
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]
        #: Rows that are the query's own, or wholly equal to it.
        self.own = np.zeros(len(ids), np.int64)
        self.places: dict[int, list[int]] = {}
        for i, name in enumerate(ids.tolist()):
            self.places.setdefault(name, []).append(i)

    def add(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        for at in np.flatnonzero(np.isin(ids, self.ids)).tolist():
            for i in self.places[int(ids[at])]:
                self.own[i] += bool((self.whole[i] == matrix[at]).all())
        columns = matrix.T.astype(np.float64)
        mass = np.sqrt((columns**2).sum(axis=0))
        # rows of large norm first: the first slice sets a high threshold for the rest
        order = np.argsort(-mass, kind="stable")
        columns, ids, matrix, mass = np.ascontiguousarray(columns[:, order]), ids[order], matrix[order], mass[order]
        squares = columns**2
        rest = [np.sqrt(squares[c:].sum(axis=0)) for c in self.cuts]
        largest = float(np.abs(columns).max()) if columns.size else 0.0
        head = max(64, 4 * self.k)
        for i, query in enumerate(self.q):
            # sums below 2^53 are exact; otherwise each of the products and sums may have been rounded
            exact = len(query) * largest * float(np.abs(query).max()) < 1 << 53
            slack = np.zeros(len(ids)) if exact else mass * (self.rest[0][i] * (len(query) + 4) * 2.0**-52)
            first = 0
            if len(self.best[i]) < self.k:
                self._merge(i, ids[:head], query @ columns[:, :head], slack[:head], matrix[:head], exact)
                first = head
            floor = float(self.best[i][-1][0]) if len(self.best[i]) >= self.k else -np.inf
            alive, scores = np.arange(first, len(ids)), None
            for b, (lo, hi) in enumerate(zip(self.cuts, self.cuts[1:])):
                if not len(alive):
                    break
                scores = query[lo:hi] @ columns[lo:hi, first:] if scores is None else scores + query[lo:hi] @ columns[lo:hi, alive]
                if np.isfinite(floor):
                    live = scores + self.rest[b + 1][i] * rest[b + 1][alive] + slack[alive] >= floor - 1e-6 * (1 + abs(floor))
                    alive, scores = alive[live], scores[live]
            if len(alive):
                self._merge(i, ids[alive], scores, slack[alive], matrix[alive], exact)

    def _merge(self, i: int, ids: np.ndarray, scores: np.ndarray, slack: np.ndarray, rows: np.ndarray, exact: bool) -> None:
        same = ids == self.ids[i]
        if same.any():  # another vector of the query's id is a candidate, an equal one is counted apart
            same[same] = (rows[same] == self.whole[i]).all(axis=1)
        ids, scores, slack, rows = ids[~same], scores[~same], slack[~same], rows[~same]
        if len(ids) > 4 * self.k:  # ties with the k-th score stay
            least = np.partition(np.clip(scores - slack, -(2.0**63), 2.0**63), len(scores) - self.k)[len(scores) - self.k]
            near = scores + slack >= least
            ids, scores, rows = ids[near], scores[near], rows[near]
        whole = scores.astype(np.int64).tolist() if exact else products(rows, self.whole[i])
        both = self.best[i] + list(zip(whole, ids.tolist()))
        self.best[i] = sorted(both, key=lambda x: (-x[0], x[1]))[: self.k]


def products(rows: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products in integers, as longs."""
    if len(query) * float(np.abs(query.astype(np.float64)).max()) * float(np.abs(rows.astype(np.float64)).max(initial=0)) < 2.0**62:
        return (rows @ query).tolist()
    own = query.tolist()
    return [as_long(sum(a * b for a, b in zip(row, own))) for row in rows.tolist()]


def as_long(x: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, x))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, dim_block: int = DIM_BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row with every other row.

    Both inputs are (id, v: array<long>); ties go to the smaller id.  A query's own row is no candidate: of the rows with
    its id and its very vector one is left out, the others of that id are candidates.  Every query row has ranks of its
    own, so a repeated query id has as many rows of each rank as it has query rows.  Only vectors of the query's length
    are compared.  Null and non-finite vectors must be gone (``quantise`` drops them).  Empty tables give no rows.  Runs
    its jobs when it is called.
    """
    spark = vectors.sparkSession
    shapes = queries.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).collect()
    found: list[DataFrame] = []
    for shape in sorted(shapes):
        own = vectors.where(F.size("v") == shape.dims)
        blocks = -(-shape.n * shape.dims * 8 // block_bytes)
        asked = queries.where(F.size("v") == shape.dims).groupBy("id", "v").agg(F.count("*").alias("asked"))
        asked = materialise(asked.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks))), "queries")
        for block in range(blocks):
            rows = asked.where(F.col("block") == block).toArrow()
            if not len(rows):
                continue
            sent = spark.sparkContext.broadcast((rows.column("id").to_numpy(), _matrix(rows.column("v").combine_chunks(), shape.dims), rows.column("asked").to_numpy()))
            part = own.mapInArrow(trimmed(_task(sent, shape.dims, k, dim_block)), "query long, query_id long, asked long, vec_id long, score long, own long")
            found.append(materialise(_best(part, k), "best"))
            sent.destroy()
            if len(found) == 64:  # a plan over few tables, however many blocks there are
                found = _one(found)
        dropped(asked)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "asked"))).select("query_id", "rank", "vec_id", "score")


def _one(tables: list[DataFrame]) -> list[DataFrame]:
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    out = materialise(every, "best")
    dropped(*tables)
    return [out]


def _best(part: DataFrame, k: int) -> DataFrame:
    """The first k rows of each query; the rows that equal it count as candidates but for one."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    own = part.where("own > 0").groupBy("query", "query_id", "asked", "vec_id", "score").agg(F.least(F.sum("own") - 1, F.lit(k)).alias("n")).where("n > 0")
    own = own.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long")))).select("query", "query_id", "asked", "vec_id", "score")
    every = part.where("own = 0").drop("own").unionByName(own)
    return every.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "asked", "rank", "vec_id", "score")


def _joined(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of about BATCH rows, whatever the Arrow batches hold."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, len(batch), BATCH):
            piece = batch.slice(at, BATCH)
            held.append((piece.column("id").to_numpy(), _matrix(piece.column("v"), dims)))
            size += len(piece)
            if size >= BATCH:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _task(sent, dims: int, k: int, dim_block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher, asked = None, None
        for ids, matrix in _joined(batches, dims):
            if searcher is None:
                asked = sent.value[2]
                searcher = Searcher(*sent.value[:2], k, dim_block)
            searcher.add(ids, matrix)
        if searcher:
            rows = [(i, int(q), int(n), v, s, 0) for i, (q, n, best) in enumerate(zip(searcher.ids, asked, searcher.best)) for s, v in best]
            rows += [(i, int(searcher.ids[i]), int(asked[i]), int(searcher.ids[i]), products(searcher.whole[i : i + 1], searcher.whole[i])[0], int(searcher.own[i])) for i in np.flatnonzero(searcher.own)]
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], ["query", "query_id", "asked", "vec_id", "score", "own"])

    return run
