"""Whitening of embeddings.

The scatter of the distinct vectors is summed exactly, in whole numbers, after each dimension is centred. A
pivoted Cholesky factor of it, A = G G', is rotated by one-sided Jacobi: pairs of columns of G are turned until
all are at right angles, which leaves G G' as it is. The squared norms of the columns are then the
eigenvalues and the columns of length 1 the components, without ever forming a product that squares the
condition of the factor.

Components c become x = floor(64 c) + 1000000. Vectors that are null, or hold a null or non-finite entry, are
left out; so are those with an entry beyond 2^56, whose x is no long. Shorter vectors, also empty ones, count
as filled up with entries of 0. Repeated vectors count once in the fit, and each row keeps its result; rows
without an id are kept. Directions without variance are no components: there are at most as many as the rank, so
equal vectors, a single one, or an empty table give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panewise.llm.common import Scratch

SCALE, OFFSET = 64, 1_000_000

#: Entries of a batch of vectors inside a task.
_ENTRIES = 1 << 20
_LARGEST = float(1 << 56)
_TOTAL = "decimal(38,0)"


def whole(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`id, x` of the rows that take part, x an array of longs."""
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    fit = lambda c: F.coalesce(F.abs(c) < _LARGEST, F.lit(False))
    rows = rows.filter(F.col("x").isNotNull() & F.forall("x", lambda c: fit(c) & ~F.isnan(c)))
    return rows.select("id", F.transform("x", lambda c: F.floor(c * SCALE).cast("bigint") + OFFSET).alias("x"))


# Exact sums ------------------------------------------------------------------------------------------


def _rows(batch: pa.RecordBatch, width: int, centre: np.ndarray | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch with their x as int64, less `centre`."""
    step = max(1, _ENTRIES // max(1, width))
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        column = part.column("x")
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        x = np.full((part.num_rows, width), OFFSET, np.int64)
        x[np.arange(width)[None, :] < sizes[:, None]] = flat
        yield part, x if centre is None else x - centre


def _exact_products(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers; float arithmetic where no sum can leave 2^53."""
    most = int(np.abs(y).max(initial=0))
    step = (1 << 53) // max(1, most * most)
    if step < 16:
        y = y.astype(object)
        return y.T @ y
    y, total = y.astype(np.float64), np.zeros((y.shape[1], y.shape[1]), object)
    for start in range(0, len(y), step):
        part = y[start : start + step]
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _as_rows(i: np.ndarray, j: np.ndarray, values: list[int]) -> pa.RecordBatch:
    from decimal import Decimal

    return pa.RecordBatch.from_arrays(
        [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))],
        names=["i", "j", "v"],
    )


_PARTIAL = f"i int, j int, v {_TOTAL}"


def _linear(width: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width, object), 0
        for batch in batches:
            for part, x in _rows(batch, width):
                # Halves, so that no sum of a batch leaves 63 bits.
                high, low = (x >> 31).sum(0), (x & ((1 << 31) - 1)).sum(0)
                total += high.astype(object) * (1 << 31) + low.astype(object)
                n += part.num_rows
        if n:
            yield _as_rows(np.arange(-1, width), np.zeros(width + 1), [n, *total])

    return sums


def _squares(width: int, centre: np.ndarray):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for batch in batches:
            for _, y in _rows(batch, width, centre):
                total += _exact_products(y)
        i, j = np.triu_indices(width)
        yield _as_rows(i, j, total[i, j].tolist())

    return sums


def _summed(fit: DataFrame, partial) -> list:
    """Sums of what the tasks give, combined before the shuffle; the driver gets one row for each place."""
    return fit.select("x").mapInArrow(partial, _PARTIAL).groupBy("i", "j").agg(F.sum("v").cast(_TOTAL).alias("v")).collect()


@dataclass(frozen=True)
class Scatter:
    """n vectors with sums S, and `entries` = the sum of (n x - S)(n x - S)' over n, exact: n squared times the covariance."""

    n: int
    sums: list[int]
    entries: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        square = self.n * self.n
        return np.array([[float(Fraction(v, square)) for v in row] for row in self.entries])


def scatter(fit: DataFrame) -> Scatter | None:
    """Two passes over distinct vectors: sums, then products of what is left after the rounded means.

    The products are a square of the dimension; tasks and driver hold one such square each.
    """
    width = fit.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return None
    first = {r.i: int(r.v) for r in _summed(fit, _linear(width))}
    n, sums = first[-1], [first[i] for i in range(width)]
    centre = [round(Fraction(s, n)) for s in sums]
    rest = np.array([s - n * c for s, c in zip(sums, centre)], object)
    squares = np.zeros((width, width), object)
    for r in _summed(fit, _squares(width, np.array(centre, np.int64))):
        squares[r.i, r.j] = squares[r.j, r.i] = int(r.v)
    return Scatter(n, sums, n * squares - np.outer(rest, rest))


# Components ------------------------------------------------------------------------------------------


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """G with G G' = a, a column for each pivot: the largest entry of the diagonal that is left.

    It ends where that is no more than rounding; G has as many columns as `a` has rank.
    """
    left, columns = a.astype(np.float64).copy(), []
    least = len(a) * np.finfo(np.float64).eps * max(0.0, float(np.diag(a).max(initial=0)))
    for _ in range(len(a)):
        p = int(np.argmax(np.diag(left)))
        if left[p, p] <= least:
            break
        column = left[:, p] / np.sqrt(left[p, p])
        columns.append(column)
        left -= np.outer(column, column)
        left[p, :] = left[:, p] = 0.0
    return np.array(columns).T if columns else np.zeros((len(a), 0))


def jacobi(g: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components in columns) of g g', largest first.

    Each round turns disjoint pairs of columns, all pairs once in a sweep, until every pair is at right
    angles to rounding.
    """
    g = g.copy()
    r = g.shape[1]
    for _ in range(sweeps):
        turned = False
        for left, right in _rounds(r):
            a, b = g[:, left], g[:, right]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            turn = np.abs(ab) > 1e-15 * np.sqrt(aa * bb)
            if not turn.any():
                continue
            turned = True
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                zeta = (bb - aa) / (2 * ab)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(turn & np.isfinite(t), t, 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            g[:, left], g[:, right] = c * a - s * b, s * a + c * b
        if not turned:
            break
    values = (g * g).sum(0)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > 0]
    return values[order], g[:, order] / np.sqrt(values[order])


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of 0..n-1 in rounds of disjoint pairs."""
    ring = list(range(n + n % 2))
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], ring[:half - 1:-1]) if max(a, b) < n]
        if pairs:
            left, right = np.array(pairs).T
            yield left, right
        ring = [ring[0], ring[-1], *ring[1:-1]]


@dataclass(frozen=True)
class Whitening:
    """What turns x into whitened values: (x - centre - rest) @ turn."""

    n: int
    sums: list[int]
    centre: np.ndarray
    rest: np.ndarray
    turn: np.ndarray
    explained: np.ndarray

    def apply(self, y: np.ndarray) -> np.ndarray:
        """Of x less `centre`."""
        return (y - self.rest) @ self.turn


def fit(distinct: DataFrame, most: int = 16) -> Whitening | None:
    """None without vectors."""
    found = scatter(distinct)
    if found is None:
        return None
    covariance = found.covariance
    values, components = jacobi(pivoted_cholesky(covariance))
    values, components = values[:most], components[:, :most]
    centre = [round(Fraction(s, found.n)) for s in found.sums]
    rest = np.array([float(Fraction(s, found.n) - c) for s, c in zip(found.sums, centre)])
    trace = float(np.trace(covariance))
    return Whitening(
        found.n, found.sums, np.array(centre, np.int64), rest, components / np.sqrt(values)[None, :], values / (trace or 1.0)
    )


def identity_error(distinct: DataFrame, made: Whitening) -> float:
    """How far the whitened vectors' covariance is from the identity: its largest absolute difference, measured
    on all of them. The driver gets one row for each pair of components."""
    width, k = len(made.centre), made.turn.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            for _, y in _rows(batch, width, made.centre):
                w = np.column_stack([np.ones(len(y)), made.apply(y)])
                total += w.T @ w
        i, j = np.indices(total.shape).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    rows = distinct.select("x").mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((k + 1, k + 1))
    for r in rows:
        total[r.i, r.j] = r.v
    mean = total[0, 1:] / made.n
    return float(np.abs(total[1:, 1:] / made.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def _deviations(y: np.ndarray, made: Whitening) -> list[int | None]:
    """The sum over dimensions of (n x - S) squared, exact; None where that is no long."""
    rest = np.array([made.n * int(c) - s for c, s in zip(made.centre, made.sums)], object)
    largest = made.n * int(np.abs(y).max(initial=0)) + max(abs(v) for v in rest)
    if largest * largest * y.shape[1] < 1 << 63:
        d = y * made.n + rest.astype(np.int64)
        return (d * d).sum(1).tolist()
    d = y.astype(object) * made.n + rest
    return [v if v < 1 << 63 else None for v in (d * d).sum(1)]


def whiten(vectors: DataFrame, most: int = 16, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per vector and component: `id, component, n, deviation, whitened, explained, identity_error`.

    The fit reads the distinct vectors, written once; the rows themselves are not shuffled.
    """
    rows = whole(vectors, id, vector)
    scratch = Scratch(vectors.sparkSession, "whitening")
    distinct = scratch.write(rows.select("x").distinct())
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    made = fit(distinct, most)
    k = 0 if made is None else made.turn.shape[1]
    if not k:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id)
    error, width = identity_error(distinct, made), len(made.centre)
    scratch.drop(distinct)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, y in _rows(batch, width, made.centre):
                m = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, made.n, np.int64)),
                        pa.array(_deviations(y, made), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(made.apply(y).ravel()),
                        pa.array(np.tile(made.explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(apply, schema).withColumnRenamed("id", id)
