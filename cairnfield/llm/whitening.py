"""Whitening of embeddings by a matrix-free block Lanczos method."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.llm._common import distinct, dropped, staged

SCALE = 256
COMPONENTS = 4
#: Vectors that a pass multiplies at once, and the most that are held before a restart.
BLOCK, HELD = 8, 96
#: A component is found when its residual is below RESIDUAL of the largest eigenvalue; or is
#: below SMALL of it and hasn't halved for so many passes, as rounding allows no better.
RESIDUAL, SMALL, STILL = 1e-15, 1e-11, 3
#: Passes after which the last vectors are taken.
PASSES = 200
#: A direction that is shorter than this, beside what it was before, is lost to rounding.
LOST = 1e-10
#: An eigenvalue below this share of the trace is zero but for rounding.
NONE = 1e-13
LONGEST = (1 << 63) - 1


class Fit(NamedTuple):
    """What whitens a vector; ``vectors`` has a column for each component."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of each entry, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite entries."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda c: F.coalesce(bad(c), F.lit(True))), F.lit(False))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The x-vectors of a batch as rows; missing last entries are zero."""
    column = batch.column("x")
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (sizes == d).all():
        return flat.reshape(len(sizes), d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.arange(d) < sizes[:, None]] = flat
    return out


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, from the whole numbers n * x - S where these fit."""
    top = int(np.abs(x).max(initial=0)) * n + max((abs(int(s)) for s in sums), default=0)
    if top <= LONGEST:
        return (x * np.int64(n) - sums.astype(np.int64)) / n
    return np.array([[(n * int(a) - int(s)) / n for a, s in zip(row, sums, strict=True)] for row in x], float).reshape(x.shape)


def _product(n: int, sums: list[int], v: np.ndarray) -> Callable:
    """For mapInArrow: this partition's part of Y'YV, as a row for each dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, total = np.array(sums, object), np.zeros_like(v)
        for batch in batches:
            y = _centred(_matrix(batch, len(sums)), n, exact)
            total += y.T @ (y @ v)
        rows = pa.array(total.tolist(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), rows], names=["dim", "row"])

    return run


def _summed(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of the partitions' rows, added up by Spark: as many rows as dimensions."""
    sums = parts.groupBy("dim").agg(F.array(*(F.sum(F.col("row")[k]) for k in range(width))).alias("row")).orderBy("dim").collect()
    return np.array([r["row"] for r in sums], float)


def orthogonal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the orthonormal ``basis``; directions that
    it adds only by rounding go. Projected twice, which is enough for full orthogonality."""
    out = np.zeros((len(block), 0))
    for column in block.T:
        size = np.linalg.norm(column)
        for _ in range(2):
            for known in (basis, out):
                column = column - known @ (known.T @ column)
        left = np.linalg.norm(column)
        if left > LOST * size and left > 0:
            column = column / left
            for known in (basis, out):
                column = column - known @ (known.T @ column)
            out = np.column_stack((out, column / np.linalg.norm(column)))
    return out


def lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int = BLOCK, held: int = HELD) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues and unit eigenvectors of a symmetric operator of which
    only products with a block of vectors are known.

    Each pass multiplies the newest block; the product, made orthogonal to the whole basis,
    is the next one. Where it adds less than a block (breakdown: the basis holds an invariant
    space), fresh random directions fill it up, so copies of an eigenvalue aren't missed;
    when the basis has all d directions it is exact. A basis of over ``held``
    vectors is restarted from its best Ritz vectors and their residuals' block. Ends when the wanted
    residuals, ||Av - ev||, are as small as doubles make them, or after PASSES.
    """
    rng = np.random.default_rng(42)
    held = max(held, 3 * block + wanted)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    fresh = orthogonal(rng.standard_normal((d, min(block, d))), basis)
    values, vectors, best, still = np.zeros(0), np.zeros((d, 0)), np.inf, 0
    for _ in range(PASSES):
        product = apply(fresh)
        basis, image = np.column_stack((basis, fresh)), np.column_stack((image, product))
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        keep = min(wanted, len(values))
        vectors = basis @ turn[:, :keep]
        residual = np.linalg.norm(image @ turn[:, :keep] - vectors * values[:keep], axis=0)
        worst = residual.max() / max(values[0], 1e-300)
        still, best = (0, worst) if worst <= best / 2 else (still + 1, best)
        if basis.shape[1] >= d or (basis.shape[1] > block and (worst <= RESIDUAL or (best <= SMALL and still >= STILL))):
            break
        fresh = orthogonal(product, basis)
        if basis.shape[1] + block > held:
            ritz = turn[:, : wanted + block]
            basis, image = basis @ ritz, image @ ritz
        short = min(block, d - basis.shape[1]) - fresh.shape[1]
        while short > 0:
            more = orthogonal(rng.standard_normal((d, short)), np.column_stack((basis, fresh)))
            fresh = np.column_stack((fresh, more))
            short -= more.shape[1]
    return values[:wanted], vectors / np.maximum(np.linalg.norm(vectors, axis=0), 1e-300)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sums of (n * x - S)^2, exact; null where that is over a long."""
    top = int(np.abs(x).max(initial=0)) * n + max((abs(int(s)) for s in sums), default=0)
    if top * top * max(1, x.shape[1]) <= LONGEST:
        y = x * np.int64(n) - sums.astype(np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = (sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x)
    return [e if e <= LONGEST else None for e in exact]


def _spread(n: int, sums: list[int]) -> Callable:
    """For mapInArrow: the sum of squared deviations from the mean of each batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(sums, object)
        for batch in batches:
            y = _centred(_matrix(batch, len(sums)), n, exact)
            yield pa.RecordBatch.from_arrays([pa.array([float((y * y).sum())])], names=["spread"])

    return run


def fit(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK, held: int = HELD) -> Fit:
    """The leading components of ``vectors`` (x array<long>), each distinct vector counted once.

    The covariance (divisor n) is never formed: each pass over the written fit list multiplies
    the centred vectors with a block (``lanczos``), tasks send a d x block matrix, and
    Spark adds those up. The driver holds d x ``held`` numbers, whatever the rows.
    The trace is the mean squared deviation from the mean. Components whose eigenvalue is zero,
    as where there are fewer directions than asked for, are left out; without rows there are none.
    """
    rows = staged(vectors.select("x").distinct(), "fit-list")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = size["n"], size["d"] or 0
    if not n or not d:
        dropped(rows)
        return Fit(n, [0] * d, np.zeros(0), np.zeros((d, 0)), 0.0, 0.0)
    sums = [0] * d
    for r in rows.select(F.posexplode("x").alias("dim", "c")).groupBy("dim").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).collect():
        sums[r["dim"]] = int(r["s"])
    apply = lambda v: _summed(rows.mapInArrow(_product(n, sums, v), "dim long, row array<double>"), v.shape[1]) / n
    trace = rows.mapInArrow(_spread(n, sums), "spread double").agg(F.sum("spread")).first()[0] / n
    values, found = lanczos(apply, d, min(components, d), block, held)
    real = values > NONE * trace
    values, found = values[real], found[:, real]
    error = 0.0
    if len(values):
        white = found / np.sqrt(values)
        error = float(np.abs(white.T @ apply(white) - np.eye(len(values))).max())
    dropped(rows)
    return Fit(n, sums, values, found, trace, error)


def transform(vectors: DataFrame, model: Fit, keep: Iterable[str] = ("vec_id",)) -> DataFrame:
    """``keep, component (from 1), n, deviation, whitened, explained, identity_error``: a row for
    each vector and component."""
    kept = distinct(keep, "x", "component", "n", "deviation", "whitened", "explained", "identity_error")
    k = len(model.values)
    n, sums, identity = model.n, model.sums, model.identity_error
    white = model.vectors / np.sqrt(model.values) if k else model.vectors
    shares = model.values / model.trace if k else model.values

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(sums, object)
        for batch in batches:
            x = _matrix(batch, len(sums))
            rows, again = len(x), np.repeat(np.arange(len(x)), k)
            new = [
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, n)),
                pa.array(_deviations(x, n, exact), pa.int64()).take(pa.array(again)),
                pa.array((_centred(x, n, exact) @ white).reshape(-1)),
                pa.array(np.tile(shares, rows)),
                pa.array(np.full(rows * k, identity)),
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(again)) for c in kept), *new], names=[*kept, "component", "n", "deviation", "whitened", "explained", "identity_error"]
            )

    kinds = "".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}, " for c in kept)
    return vectors.select(*kept, "x").mapInArrow(run, f"{kinds}component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every usable row's embedding in whole numbers of 1/SCALE, whitened.

    Takes ``vec_id, embedding``. Components are numbered by falling eigenvalue; their signs are
    arbitrary but the same for all rows. ``explained`` is an eigenvalue's share of the trace,
    ``identity_error`` the largest absolute entry of the whitened fit list's covariance minus
    the identity, measured by one more pass.

    Defined cases: rows whose vector is null or has a null or non-finite entry go; null or repeated
    vec_ids stay as they are; equal vectors count once in the fit and all in the result;
    shorter vectors end in zeros; a component without variance is left out, so equal vectors, one row, empty vectors or an empty
    table give no rows; a deviation over a long is null; of equal eigenvalues any orthogonal
    directions may come; other columns are ignored. Entries beyond 2^63 / SCALE are an error.
    """
    rows = staged(embeddings.where(usable(F.col("embedding"))).select("vec_id", whole(F.col("embedding")).alias("x")), "whole")
    return transform(rows, fit(rows, components))
