"""Exact top-k search by inner product with multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.llm._common import staged

K = 20
#: Segments of a vector at each resolution, coarse to fine.
LEVELS = (4, 16)
#: Queries that a task holds, about; candidates and queries that are compared at once.
QUERY_BLOCK, BLOCK, ROWS = 16384, 1024, 512
#: Candidates that a block of queries meets in one task, at least.
SLICE_ROWS = 4096
#: Sums of products below this are exact in floating point.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
#: The score of a place that isn't taken yet.
NONE = -LONG - 1


def summary(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Segment means and deviations, scaled so that a product of two summaries bounds the
    vectors' inner product from above.

    In a segment of m components the product is m * (mean * mean + covariance), and the
    covariance is at most the product of the deviations. With the vectors' norms this is
    the lower bound of their distance by means and deviations.
    """
    pad = -vectors.shape[1] % segments
    parts = np.pad(vectors, ((0, 0), (0, pad))).reshape(len(vectors), segments, -1)
    scale = np.sqrt(parts.shape[2])
    return np.concatenate((parts.mean(axis=2) * scale, parts.std(axis=2) * scale), axis=1)


class Best:
    """The best scores so far of each query, larger first, ties to smaller ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.summaries = [summary(vectors, s) for s in LEVELS]
        self.norms = np.linalg.norm(vectors, axis=1)
        self.largest = np.abs(vectors).max(initial=0)
        self.score = np.full((len(ids), k), NONE)
        self.found = np.full((len(ids), k), LONG)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Compare a block of candidates with all queries."""
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        wide = max(vectors.shape[1], self.vectors.shape[1])
        mine, vectors = (np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for v in (self.vectors, vectors))
        if wide != self.vectors.shape[1]:
            self.vectors, self.summaries = mine, [summary(mine, s) for s in LEVELS]
        large = wide * self.largest * np.abs(vectors).max(initial=0) >= EXACT
        summaries = [summary(vectors, s) for s in LEVELS]
        # rounding in a bound stays far below this
        with np.errstate(over="ignore", invalid="ignore"):
            slack = 1e-9 * self.norms[:, None] * np.linalg.norm(vectors, axis=1)[None] + 1e-6
        for r in range(0, len(self.ids), ROWS):
            rows = slice(r, r + ROWS)
            least = self.score[rows, -1][:, None]
            floor = np.where(least <= -LONG, -np.inf, least)  # what is clamped there isn't below it
            alive = self.ids[rows][:, None] != ids[None]
            for own, other in zip(self.summaries, summaries, strict=True):
                with np.errstate(over="ignore", invalid="ignore"):
                    alive &= ~(own[rows] @ other.T + slack[rows] < floor)  # what overflows stays
                if not alive.any():
                    break
            else:
                self._keep(rows, alive, ids, vectors, least, large)

    def _keep(self, rows: slice, alive: np.ndarray, ids: np.ndarray, vectors: np.ndarray, least: np.ndarray, large: bool) -> None:
        mine = self.vectors[rows]
        q, x = np.nonzero(alive)
        if large:
            whole = [[int(a) for a in v] for v in mine], [[int(a) for a in v] for v in vectors]
            exact = [sum(map(mul, whole[0][i], whole[1][j])) for i, j in zip(q.tolist(), x.tolist(), strict=True)]
            score = np.array([min(LONG, max(-LONG, s)) for s in exact], np.int64)
        elif len(q) > alive.size // 16:
            every = mine @ vectors.T
            score = every[q, x].astype(np.int64)
        else:
            score = np.einsum("ij,ij->i", mine[q], vectors[x]).astype(np.int64)
        good = score >= least[q, 0]
        q, x, score = q[good], x[good], score[good]
        if len(q) > 4 * self.k * len(mine) and not large:
            # scores and places as one whole number, so that a partition decides ties too
            packed = np.full(alive.shape, -LONG)
            packed[q, x] = score * BLOCK + (BLOCK - 1 - x)
            top = np.argpartition(-packed, self.k, axis=1)[:, : self.k]
            q, x = np.nonzero(np.isin(np.arange(alive.size).reshape(alive.shape), top + np.arange(len(mine))[:, None] * alive.shape[1]) & (packed != -LONG))
            score = (packed[q, x] - (BLOCK - 1 - x)) // BLOCK
        n = len(mine)
        q = np.concatenate((np.repeat(np.arange(n), self.k), q))
        score = np.concatenate((self.score[rows].ravel(), score))
        found = np.concatenate((self.found[rows].ravel(), ids[x]))
        order = np.lexsort((found, ~score, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order = order[place < self.k]
        self.score[rows] = score[order].reshape(n, self.k)
        self.found[rows] = found[order].reshape(n, self.k)


def _searcher(k: int) -> Callable:
    """Rows come sorted by block and slice, in each of them the queries first."""

    def done(best: Best | None) -> Iterator[pa.RecordBatch]:
        if best is not None:
            q, rank = np.nonzero(best.score > NONE)
            yield pa.RecordBatch.from_arrays([pa.array(best.ids[q]), pa.array(best.found[q, rank]), pa.array(best.score[q, rank])], names=["query_id", "vec_id", "score"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, last = None, [], None
        for batch in batches:
            at, kind = (batch.column(c).to_numpy() for c in ("place", "kind"))
            edges = np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in pairwise([0, *edges.tolist(), len(at)]):
                if a == b:
                    continue
                if at[a] != last:
                    yield from done(best)
                    best, held, last = None, [], at[a]
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    held.append(part)
                    continue
                if best is None and held:
                    ids, vectors = _matrix(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    best, held = Best(ids, vectors, k), []
                if best is not None:
                    ids, vectors = _matrix(part)
                    for c in range(0, len(ids), BLOCK):
                        best.add(ids[c : c + BLOCK], vectors[c : c + BLOCK])
        yield from done(best)

    return run


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a batch; missing components count as zero."""
    ids, lists = batch.column("vec_id").to_numpy(), batch.column("vector")
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        return ids, values.reshape(len(ids), sizes[0])
    vectors = np.zeros((len(ids), int(sizes.max(initial=0))))
    vectors[np.repeat(np.arange(len(ids)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return ids, vectors


def whole(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null if the vector or a component is null, or a
    component isn't finite, scaled or not."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * float(scale)) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda x: _floor(x, scale)))


def _floor(x: Column, scale: int) -> Column:
    """As a double, which holds every such floor; Spark's floor gives a long, which doesn't."""
    scaled = x.cast("double") * F.lit(float(scale))
    nearest = F.rint(scaled)
    return F.when(nearest > scaled, nearest - 1.0).otherwise(nearest)


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` candidates of largest inner product.

    Both tables have ``vec_id`` and ``vector``, an array of whole numbers as doubles (see
    ``whole``). Rows with a query's vec_id aren't its candidates. Ties go to the smaller
    vec_id; rank counts from 1.

    Queries are dealt to blocks of about QUERY_BLOCK rows and candidates to slices; each pair
    of a block and a slice is one place of a grid, whose rows a task reads: it holds the
    block and streams the slice past it, keeping the best k of each query. With more blocks
    there are fewer slices, so that the grid has about as many places as there are
    partitions; a query's results are k rows for each slice. A candidate is dropped as soon
    as the bound by its segments' means and deviations, coarse first, is below the k-th best
    score; the products of the others are exact whole numbers.

    Defined cases: null vectors and null vec_ids take no part; repeated queries are one;
    queries with one vec_id and different vectors are ranked together; a repeated candidate
    counts each time; missing components of shorter vectors count as zero; scores beyond a
    long are clamped to its range and rank as such; empty tables give no rows; further
    columns are ignored.
    """
    named = F.col("vector").isNotNull() & F.col("vec_id").isNotNull()
    vector = F.col("vector").cast("array<double>").alias("vector")
    candidates = vectors.where(named).select(F.col("vec_id").cast("long").alias("vec_id"), vector)
    asked = staged(queries.where(named).select(F.col("vec_id").cast("long").alias("vec_id"), vector).distinct(), "queries")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    slices = max(1, min(-(-parts // blocks), -(-candidates.count() // SLICE_ROWS)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    block = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks))
    left = asked.select(block.alias("block"), every(slices).alias("slice"), F.lit(0).alias("kind"), "vec_id", "vector")
    # by place, not by value: a vector with a third of all rows is spread like others
    dealt = candidates.select(F.pmod(F.monotonically_increasing_id(), F.lit(slices)).alias("slice"), "vec_id", "vector")
    right = dealt.select(every(blocks).alias("block"), "slice", F.lit(1).alias("kind"), "vec_id", "vector")
    place = (F.col("block") * slices + F.col("slice")).alias("place")
    rows = left.unionByName(right).select(place, "kind", "vec_id", "vector")
    found = rows.repartitionByRange(parts, "place").sortWithinPartitions("place", "kind").mapInArrow(_searcher(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
