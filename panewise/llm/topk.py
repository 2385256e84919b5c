"""Exact top-k inner products by a pivot-distance index.

Each vector is keyed by its nearest pivot and its distance from it, cut into rings. A query at distance D
from a pivot is at least |D - r| from every vector at distance r from it (triangle inequality), so with the
norms of a ring's vectors its inner product there is at most (|q|^2 + |x|^2 - |D - r|^2) / 2, and by Cauchy
and Schwarz at most |q| |x|. A query first opens the rings with the highest bounds, until they hold k
vectors; the k-th score then shuts out all rings with a lower bound, and the rest are opened.

Components are turned into floor(256 x); scores are exact integers, those beyond 63 bits count as the largest or
least long, and ties go to the smaller id. Rows without an id, and vectors that are null or hold a null or
non-finite component, take no part. Shorter vectors, also empty ones, count as filled up with zeros. Each row is
a candidate and a query of its own, also one that repeats another; a row is never a candidate of its own id. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panewise.llm.common import written

#: Bounds of the index: the directory has at most PIVOTS * RINGS rows; pivots come from a sample.
PIVOTS, RINGS, SAMPLE = 32, 8, 4096
#: Rows of a ring, and queries, that meet in one group.
ROWS_PER_GROUP, QUERIES_PER_GROUP = 2048, 1024

_KEY = ["cell", "ring", "part", "block"]


def whole(vectors: DataFrame, id: str, vector: str, scale: int = 256) -> DataFrame:
    """`id, v` of the vectors that take part, v an array of whole numbers, as DOUBLE, which holds each exactly."""
    x = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), x.alias("x"))
    fit = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: F.coalesce(fit(c), F.lit(False))))
    # From 2^53 on a DOUBLE is whole already.
    down = lambda c: F.when(F.abs(c * scale) < 2.0**53, F.floor(c * scale).cast("double")).otherwise(c * scale)
    return rows.select("id", F.transform("x", down).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Rows of lists as float64, filled up with zeros to the longest or to `width`."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    if len(flat) == out.size:
        return flat.reshape(out.shape)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(m.shape[1], pivots.shape[1])
    m, pivots = widened(m, width), widened(pivots, width)
    squares = (m * m).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * m @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as int64; float arithmetic where every sum stays below 2^53, Python's integers where one
    could leave 63 bits."""
    width = max(q.shape[1], x.shape[1])
    q, x = widened(q, width), widened(x, width)
    most = width * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0))
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    narrow = width * np.abs(q).max(initial=0) * np.abs(x).max(1, initial=0) < 2**53
    if narrow.any():  # a few wide rows don't slow the others down
        out = np.zeros((len(q), len(x)), np.int64)
        out[:, narrow], out[:, ~narrow] = products(q, x[narrow]), products(q, x[~narrow])
        return out
    if most < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    exact = (whole(q) @ whole(x).T) if q.size and x.size else np.zeros((len(q), len(x)), object)
    return np.clip(exact, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)


def choose_pivots(sample: np.ndarray, pivots: int, rounds: int = 4) -> np.ndarray:
    """Means of near sample vectors: a few rounds of k-means from the first distinct ones."""
    centres = np.unique(sample, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(pivots, len(centres))).astype(int)]
    for _ in range(rounds):
        near = distances(sample, centres).argmin(1)
        for c in np.unique(near):
            centres[c] = sample[near == c].mean(0)
    return centres


@dataclass(frozen=True)
class Directory:
    """What is known of each ring; at most pivots * rings rows."""

    pivots: np.ndarray
    cell: np.ndarray
    ring: np.ndarray
    rows: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    norm: np.ndarray  # the largest squared norm

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and ring, no inner product is higher. Rounding is given away, never gained."""
        d = distances(q, self.pivots)[:, self.cell]
        qq = (q * q).sum(1)[:, None]
        gap = np.maximum(0, np.maximum(d - self.farthest, self.nearest - d))
        # A distance is a difference of squares: its error goes by the lengths, not by itself.
        lengths = np.sqrt(qq) + np.sqrt(self.norm)[None, :] + np.sqrt((self.pivots * self.pivots).sum(1))[self.cell][None, :]
        gap = np.maximum(0, gap - 1e-6 * (1 + d + lengths))
        triangle = (qq + self.norm[None, :] - gap * gap) / 2
        cauchy = np.sqrt(qq * self.norm[None, :])
        bound = np.minimum(triangle, cauchy)
        return bound + 1e-6 * np.abs(bound) + 1e-6

    def first(self, bound: np.ndarray, k: int) -> np.ndarray:
        """Which rings a query opens first: the highest bounds that together hold more than k rows."""
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        opened = np.zeros(bound.shape, bool)
        np.put_along_axis(opened, order, before <= k, axis=1)
        return opened


def build(vectors: DataFrame, pivots: int = PIVOTS, rings: int = RINGS, sample: int = SAMPLE) -> tuple[DataFrame, Directory]:
    """Every vector with its `cell, ring`, written to the working folder, and the directory of the rings."""
    rows = written(vectors.withColumn("no", F.monotonically_increasing_id()), "vectors")
    taken = rows.orderBy(F.xxhash64("v", "id"), "id").limit(sample).select("v").toArrow().column("v")
    if len(taken) == 0:
        none = np.zeros(0)
        return rows.selectExpr("*", "0 cell", "0 ring"), Directory(np.zeros((0, 1)), *[none.astype(int)] * 3, none, none, none)
    taken = matrix(taken)
    centres = choose_pivots(taken, pivots)
    near = distances(taken, centres).min(1)
    low, step = float(near.min()), float(np.ptp(near)) / rings or 1.0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column("v"))
            d = distances(m, centres)
            cell = d.argmin(1) if len(m) else np.zeros(0, int)
            r = d[np.arange(len(m)), cell]
            ring = np.clip((r - low) // step, 0, rings - 1).astype(np.int32)
            arrays = [*batch.columns, cell.astype(np.int32), ring, r, (m * m).sum(1)]
            yield pa.RecordBatch.from_arrays(
                [a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=["id", "v", "no", "cell", "ring", "r", "norm"]
            )

    placed = rows.mapInArrow(place, "id long, v array<double>, no long, cell int, ring int, r double, norm double")
    index = written(placed, "index")
    known = index.groupBy("cell", "ring").agg(
        F.count(F.lit(1)).alias("rows"), F.min("r").alias("near"), F.max("r").alias("far"), F.max("norm").alias("norm")
    )
    known = known.orderBy("cell", "ring").toPandas()
    columns = [known[c].to_numpy() for c in ("cell", "ring", "rows", "near", "far", "norm")]
    return index, Directory(centres, *columns)


def _open(directory: Directory, k: int, first: bool):
    """Rows `query, of, q, cell, ring` of the rings that queries open: at first, or after their k-th score is known."""

    def rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 1024):
                batch = whole_batch.slice(at, 1024)
                bound = directory.bounds(matrix(batch.column("v"), directory.pivots.shape[1]))
                opened = directory.first(bound, k)
                if not first:
                    least = batch.column("least").to_numpy(zero_copy_only=False).astype(float)
                    opened = ~opened & ~(bound < least[:, None])  # no k-th score: NaN shuts nothing out
                row, ring = np.nonzero(opened)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(row)),
                        batch.column("no").take(pa.array(row)),
                        batch.column("v").take(pa.array(row)),
                        pa.array(directory.cell[ring], pa.int32()),
                        pa.array(directory.ring[ring], pa.int32()),
                    ],
                    names=["query", "of", "q", "cell", "ring"],
                )

    return rings


def _best(k: int):
    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["query", "of", "id", "score"]
        if not queries.num_rows or not rows.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        ids = rows.column("id").to_numpy()
        own = queries.column("query").to_numpy()
        score = products(matrix(queries.column("q")), matrix(rows.column("v")))
        by_id = np.argsort(ids, kind="stable")
        ids, score = ids[by_id], score[:, by_id]
        usable = ids[None, :] != own[:, None]
        score = np.where(usable, score, np.iinfo(np.int64).min)
        # ~score falls as score rises for every long; -score would put the least long, which has no negative, first.
        order = np.argsort(~score, axis=1, kind="stable")[:, :k]
        top, good = np.take_along_axis(score, order, 1), np.take_along_axis(usable, order, 1)
        row = np.repeat(np.arange(len(own)), order.shape[1])[good.ravel()]
        return pa.table(
            [own[row], queries.column("of").to_numpy()[row], ids[order][good], top[good]],
            names=names,
        )

    return best


def _score(opened: DataFrame, index: DataFrame, directory: Directory, k: int) -> DataFrame:
    """The k best of each query in each ring, or part of a large one, that it opens.

    Rings are cut into parts of about ROWS_PER_GROUP rows and their queries into blocks, by hash; both counts
    come from directories of bounded size. Equal vectors, however many, spread over the parts.
    """
    spark = index.sparkSession
    opened = written(opened, "opened")
    wanted = {(r["cell"], r["ring"]): r["n"] for r in opened.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts = [
        (int(c), int(r), -(-int(n) // ROWS_PER_GROUP), -(-wanted[c, r] // QUERIES_PER_GROUP))
        for c, r, n in zip(directory.cell, directory.ring, directory.rows)
        if (c, r) in wanted
    ]
    small = F.broadcast(spark.createDataFrame(cuts, "cell int, ring int, parts int, blocks int"))
    left = opened.join(small, ["cell", "ring"]).select(
        "cell", "ring", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("of"), "blocks").cast("int").alias("block"), "query", "of", "q",
    )
    right = index.join(small, ["cell", "ring"]).select(
        "cell", "ring", F.pmod(F.xxhash64("no"), "parts").cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v",
    )
    best = _best(k)

    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        return best(queries, rows)

    return left.groupBy(*_KEY).cogroup(right.groupBy(*_KEY)).applyInArrow(meet, "query long, of long, id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("of").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding", **index_bounds: int
) -> DataFrame:
    """`query_id, rank, id, score`: the k best rows of `vectors` for each row of `queries`, all if there are fewer."""
    index, directory = build(whole(vectors, id, vector), **index_bounds)
    asked = written(whole(queries, id, vector).withColumn("no", F.monotonically_increasing_id()), "queries")
    ring = "query long, of long, q array<double>, cell int, ring int"
    seeds = written(_top(_score(asked.mapInArrow(_open(directory, k, True), ring), index, directory, k), k), "seeds")
    least = seeds.filter(F.col("rank") == k).select(F.col("of").alias("no"), F.col("score").cast("double").alias("least"))
    rest = asked.join(least, "no", "left").select("id", "v", "no", "least")
    more = _score(rest.mapInArrow(_open(directory, k, False), ring), index, directory, k)
    top = _top(seeds.drop("rank").unionByName(more), k)
    return top.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id), "score")
