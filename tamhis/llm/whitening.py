"""Embedding whitening by shifted CholeskyQR: Gram passes over the rows, triangular solves, SVD of the composed R."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.llm.common import stored

COMPONENTS = 4
#: Steps of an entry: a vector is compared and fitted as whole numbers of 1/256.
STEPS = 256
#: Numbers that a task holds as one matrix, and Gram passes at most.
BLOCK = 1 << 21
PASSES = 6
#: A direction counts as flat below this share of the largest eigenvalue, the noise of doubles over a few thousand dimensions.
FLAT = 1e-24
OUTPUT = [
    T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
    T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())]


class Moments(NamedTuple):
    """Number of fitted vectors and exact sums; the mean of a dimension is ``whole + rest``, so that centring loses no digit."""

    n: int
    sums: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of ``(n x - S)^2`` for each row, exact; null beyond 64 bits."""
        reach = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if reach * reach * max(len(self.sums), 1) < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


class Whitening(NamedTuple):
    """Components as rows, their standard deviations and shares of the variance."""

    moments: Moments
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.moments.centred(x) @ self.components.T / self.deviations


def _matrices(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Blocks of rows of a list column as matrices, each of bounded size."""
    rows = max(1, BLOCK // max(width, 1))
    for at in range(0, len(column), rows):
        part = column.slice(at, rows)
        yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), width)


def add_up(fit: DataFrame, width: int, height: int, of: Callable[[np.ndarray], np.ndarray], kind: type, cells: int) -> np.ndarray:
    """Sum of the ``height x cells`` matrices that ``of`` makes of the blocks of rows in ``x``.

    Each task adds its own blocks; the rows of its matrix are then dealt out by number and added up in several tasks, so
    the driver gets one matrix, however many tasks there were.
    """
    schema = T.StructType([
        T.StructField("i", T.IntegerType()), T.StructField("v", T.ArrayType(T.LongType() if kind is np.int64 else T.DoubleType()))])
    item = pa.int64() if kind is np.int64 else pa.float64()

    def rows(numbers, values):
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(values, pa.list_(item))], ["i", "v"])

    def partial(batches):
        total = np.zeros((height, cells), kind)
        some = False
        for batch in batches:
            for block in _matrices(batch.column(0), width):
                total += of(block)
                some = True
        if some:
            yield rows(range(height), list(total))

    def merge(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            at = 0
            for block in _matrices(batch.column(1), cells):
                for i, own in zip(batch.column(0).slice(at, len(block)).to_pylist(), block, strict=True):
                    totals[i] = totals[i] + own if i in totals else own.copy()
                at += len(block)
        if totals:
            yield rows(list(totals), list(totals.values()))

    parts = fit.select("x").mapInArrow(partial, schema).repartition("i").mapInArrow(merge, schema)
    total = np.zeros((height, cells), kind)
    for row in parts.collect():
        total[row["i"]] += np.array(row["v"], kind)
    return total


def usable(vectors: DataFrame, keep: Sequence[str | Column], vector: str) -> DataFrame:
    """``keep`` columns and ``x``, the vector in whole steps, of the rows with a vector of finite entries only."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(F.col(vector).isNotNull() & ~bad).select(
        *keep, F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS).cast("bigint")).alias("x"))


def moments_of(fit: DataFrame, width: int) -> Moments:
    def of(x):
        return np.array([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), np.full(width, len(x))])

    high, low, n = add_up(fit, width, 3, of, np.int64, width).tolist()
    return Moments(n[0], tuple((h << 32) + v for h, v in zip(high, low, strict=True)))


def orthogonal(rows: np.ndarray, factors: Sequence[np.ndarray]) -> np.ndarray:
    """``rows`` times the inverse of each upper triangular factor in turn, by substitution."""
    for r in factors:
        solved = np.empty_like(rows)
        for j in range(len(r)):
            solved[:, j] = (rows[:, j] - solved[:, :j] @ r[:j, j]) / r[j, j]
        rows = solved
    return rows


def factor(gram: np.ndarray, rows: int) -> np.ndarray:
    """Upper Cholesky factor of a Gram matrix; far from orthonormal rows are shifted by a bound of the rounding error, so that it always exists."""
    size = len(gram)
    if np.linalg.norm(gram - np.eye(size), 2) < 0.5:
        return np.linalg.cholesky(gram).T
    shift = 11 * (min(rows, BLOCK // size) + size * (size + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(gram, 2)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(size)).T
        except np.linalg.LinAlgError:
            shift *= 100


def fit_whitening(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the vectors ``x`` of ``fit``, all of length ``width``; None if they do not vary.

    Each pass over the rows divides the centred rows by the factors found so far and adds up their Gram matrix; its
    shifted Cholesky factor is the next one. The passes end once the rows are orthonormal, flat directions aside. The
    factors multiply to an R with the same right singular vectors and singular values as the centred rows.
    """
    moments = moments_of(fit, width)
    factors: list[np.ndarray] = []
    for number in range(PASSES):
        def of(x):
            q = orthogonal(moments.centred(x), factors)
            return q.T @ q

        gram = add_up(fit, width, width, of, np.float64, width)
        gram = (gram + gram.T) / 2
        if not gram.any():
            return None
        spread = np.linalg.eigvalsh(gram)
        factors = [*factors, factor(gram, moments.n)]
        off = np.abs(spread - 1) > 1e-9
        if number and (not off.any() or (number > 1 and (spread[off] < 1e-3).all())):
            break
    composed = factors[0]
    for r in factors[1:]:
        composed = r @ composed
    _, lengths, axes = np.linalg.svd(composed)
    variance = lengths**2 / moments.n
    kept = min(components, int((variance > FLAT * variance[0]).sum()))
    return Whitening(moments, axes[:kept], np.sqrt(variance[:kept]), variance[:kept] / variance.sum())


def identity_error(fit: DataFrame, width: int, model: Whitening) -> float:
    """Largest entry of the whitened covariance of the fitted vectors less the identity."""
    kept = len(model.components)

    def of(x):
        white = model.apply(x)
        return white.T @ white

    return float(np.abs(add_up(fit, width, kept, of, np.float64, kept) / model.moments.n - np.eye(kept)).max())


def whiten(vectors: DataFrame, keep: Sequence[str | Column] = ("vec_id",), vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``keep`` columns and, for each component up to ``components``: ``component, n, deviation, whitened, explained, identity_error``.

    Rows whose vector is null or holds a null or non-finite entry are left out, and so are vectors of another length than most
    distinct ones (of equally common lengths, the longer one counts); vectors are compared in whole steps of 1/256, and each distinct one is fitted once, however many
    rows repeat it. Repeated rows each get their result. Directions in which the vectors do not vary are no components: a table that is empty, or
    whose vectors are all alike, gives no row. ``deviation`` is null beyond 64 bits. Other columns are not read.

    What the driver holds is one square matrix of the vectors' length; the rows are read once for each Gram pass.
    """
    rows = usable(vectors, keep, vector)
    schema = T.StructType([*rows.schema.fields[:-1], *OUTPUT])
    fit = stored(rows.select("x").distinct(), "vectors")
    lengths = fit.where(F.size("x") > 0).groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = lengths["width"] if lengths else 0
    fit = fit.where(F.size("x") == width)
    model = fit_whitening(fit, width) if width else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(fit, width, model)
    names = rows.columns[:-1]

    def run(batches):
        kept = len(model.components)
        for batch in batches:
            at = 0
            for x in _matrices(batch.column(len(names)), width):
                part = batch.slice(at, len(x))
                at += len(x)
                white, deviations = model.apply(x), model.moments.deviations(x)
                each = pa.array(np.repeat(np.arange(len(x)), kept))
                columns = [part.column(i).take(each) for i in range(len(names))]
                columns += [
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * kept, model.moments.n)),
                    pa.array(deviations, pa.int64()).take(each), pa.array(white.ravel()), pa.array(np.tile(model.explained, len(x))),
                    pa.array(np.full(len(x) * kept, error))]
                yield pa.RecordBatch.from_arrays(columns, [*names, *[f.name for f in OUTPUT]])

    return rows.where(F.size("x") == width).mapInArrow(run, schema)
