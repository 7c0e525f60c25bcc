"""Exact nearest neighbours with pruning, and what lies outside of a training set.

Points are dealt to their nearest pivot, and by their distance from it into SHELLS shells.  For a query at distance D from a pivot,
a point at distance d from it is |D - d| away or more (triangle inequality), so a query visits only shells that can hold
something nearer than what it has: first its own shell, then all that are left.  Queries meet points by pivot and shell in a
cogroup, a block at a time; equal points are one with a count.  Results are exact; pruning only saves comparisons, which are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.statistics import running
from tidemark.sources.shared import kept

#: Pivots at most, one for 16 points with fewer; shells of a pivot; queries that are compared at once.
PIVOTS, SHELLS, BLOCK = 256, 8, 256


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances by differences: products of large coordinates would cancel."""
    return np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))


def _dealt(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """df (x, ...) with the nearest pivot and the distance from it."""
    dims = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            near, far = np.empty(len(x), np.int32), np.empty(len(x))
            for k in range(0, len(x), BLOCK):
                d = _far(x[k : k + BLOCK], pivots)
                near[k : k + BLOCK], far[k : k + BLOCK] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(far)], [*batch.schema.names, "pivot", "away"])

    return df.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", pivot int, away double")


def nearest(queries: DataFrame, points: DataFrame) -> DataFrame:
    """(x, distance, compared) for each distinct vector x of queries (x array<double>): how far the nearest point (x) is.

    A point that is equal to the query is 0 away; to leave a query's own row out, see `apart`.  All vectors have one length; rows with null vectors are
    left out.  Without points distances are null.  compared: the points that the query was held against, its pivots not counted.
    """
    return _search(queries.where("x is not null").select("x").distinct().withColumn("own", F.lit(False)), points.where("x is not null").groupBy("x").agg(F.count("*").alias("n")))


def apart(points: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(x, n, distance, compared) for each distinct vector of points, or of those that are asked too: how far the nearest other row is; 0 for one that is there twice."""
    unique = kept(points.where("x is not null").groupBy("x").agg(F.count("*").alias("n")))
    some = unique if asked is None else unique.join(asked.select("x").distinct(), "x", "left_semi")
    twice = some.where("n > 1").select("x", "n", F.lit(0.0).alias("distance"), F.lit(0).cast("bigint").alias("compared"))
    once = some.where("n = 1")
    return twice.unionByName(once.join(_search(once.select("x", F.lit(True).alias("own")), unique), "x").select("x", "n", "distance", "compared"))


def _search(queries: DataFrame, points: DataFrame) -> DataFrame:
    """(x, distance, compared) of queries (x, own) in distinct points; own: the equal point is not to be found."""
    points = kept(points.select("x"))
    chosen = points.orderBy(F.xxhash64("x"), "x").limit(min(PIVOTS, -(-points.count() // 16))).collect()
    if not chosen:
        return queries.select("x", F.lit(None).cast("double").alias("distance"), F.lit(0).cast("bigint").alias("compared"))
    pivots = np.array([r.x for r in chosen], float)
    held, asked = kept(_dealt(points, pivots)), kept(_dealt(queries.select("x", "own"), pivots))
    radii = {r.pivot: r.radius for r in held.groupBy("pivot").agg(F.max("away").alias("radius")).collect()}
    radius = np.array([radii.get(k, -1.0) for k in range(len(pivots))])  # -1: nothing is there
    width = np.maximum(radius, 1e-300) / SHELLS
    shell = F.least(F.floor(F.col("away") / F.element_at(F.array(*map(F.lit, width.tolist())), F.col("pivot") + 1)), F.lit(SHELLS - 1)).cast("int")
    held = held.withColumn("shell", shell)
    first = _compared(asked.select("x", "own", F.lit(None).cast("double").alias("distance"), "pivot", shell.alias("shell")), held)
    best = kept(asked.select("x", "own", "pivot", shell.alias("shell")).join(first.groupBy("x").agg(F.min("distance").alias("distance"), F.sum("compared").alias("compared")), "x", "left"))
    rest = best.select("x", "own", "distance", "pivot", "shell").mapInArrow(lambda batches: _visits(batches, pivots, radius, width), "x array<double>, own boolean, distance double, pivot int, shell int")
    second = _compared(rest, held)
    found = best.select("x", "distance", F.coalesce("compared", F.lit(0)).alias("compared")).unionByName(second)
    return found.groupBy("x").agg(F.min("distance").alias("distance"), F.sum("compared").alias("compared"))


def _visits(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, radius: np.ndarray, width: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The other shells that can hold something nearer than what a query has."""
    low = np.arange(SHELLS) * width[:, None]
    high = np.where(np.arange(SHELLS) == SHELLS - 1, np.maximum(radius[:, None], low), low + width[:, None])
    for batch in batches:
        x, names = _matrix(batch.column(0), pivots.shape[1]), ["x", "own", "distance", "pivot", "shell"]
        have = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
        seen = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        for k in range(0, len(x), BLOCK):
            d = _far(x[k : k + BLOCK], pivots)
            # a pivot is a point itself, though a query's own one may be at 0
            own = batch.column(1).slice(k, BLOCK).to_numpy(zero_copy_only=False)
            bound = np.fmin(have[k : k + BLOCK], np.where((d == 0) & own[:, None], np.inf, d).min(axis=1))
            gap = np.maximum(np.maximum(d[:, :, None] - high, low - d[:, :, None]), 0)
            may = (gap <= bound[:, None, None] * (1 + 1e-12)) & (radius >= 0)[:, None]
            may[np.arange(len(d)), seen[0][k : k + BLOCK], seen[1][k : k + BLOCK]] = False
            row, pivot, shell = np.nonzero(may)
            at = pa.array(row + k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(bound[row]), pa.array(pivot.astype(np.int32)), pa.array(shell.astype(np.int32))], names)


def _compared(queries: DataFrame, points: DataFrame) -> DataFrame:
    """(x, distance, compared) of queries with the points of their pivot and shell."""

    def run(asked: pa.Table, there: pa.Table) -> pa.Table:
        if not asked.num_rows or not there.num_rows:
            return pa.table({"x": pa.array([], pa.list_(pa.float64())), "distance": pa.array([], pa.float64()), "compared": pa.array([], pa.int64())})
        dims = len(there.column("x")[0])
        x, y, own = _matrix(asked.column("x"), dims), _matrix(there.column("x"), dims), asked.column("own").to_numpy()
        best = np.empty(len(x))
        for k in range(0, len(x), BLOCK):
            least = np.full(len(x[k : k + BLOCK]), np.inf)
            for j in range(0, len(y), 4096):
                d = _far(x[k : k + BLOCK], y[j : j + 4096])
                d[own[k : k + BLOCK, None] & (d == 0)] = np.inf
                least = np.minimum(least, d.min(axis=1))
            best[k : k + BLOCK] = least
        nothing = np.isinf(best)
        return pa.table({"x": asked.column("x"), "distance": pa.array(best, mask=nothing), "compared": pa.array(np.full(len(x), len(y)), pa.int64())})

    by = lambda df: df.groupBy("pivot", "shell")
    return by(queries.select("x", "own", "pivot", "shell")).cogroup(by(points.select("x", "pivot", "shell"))).applyInArrow(run, "x array<double>, distance double, compared bigint")


def order_statistic(df: DataFrame, value: str, weight: str, share: float) -> DataFrame:
    """p: the value at a share of the rows, each counted `weight` times, between two of them in proportion; no task holds all values."""
    counted = running(df.groupBy(value).agg(F.sum(weight).alias("n")), value, ["n"], [])
    place = (F.col("all_n") - 1) * share
    at = lambda k: F.min(F.when(F.col("upto_n") > k, F.col(value)))
    return counted.agg(at(F.floor(place)).alias("low"), at(F.ceil(place)).alias("high"), F.max(place - F.floor(place)).alias("part")).select((F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("p"))


def extrapolation(train: DataFrame, test: DataFrame, share: float = 0.95) -> DataFrame:
    """Limit, n, beyond, expected, z: how many test rows (x) lie further from training rows (x) than `share` of these do from each other, and the binomial z of that.

    Null limit, beyond and z where fewer than two training rows are; z is null without test rows.
    """
    limit = order_statistic(apart(train), "distance", "n", share).select(F.col("p").alias("limit"))
    rows = test.where("x is not null").groupBy("x").agg(F.count("*").alias("times")).join(nearest(test, train), "x")
    met = rows.join(F.broadcast(limit), F.lit(True)).agg(F.max("limit").alias("limit"), F.coalesce(F.sum("times"), F.lit(0)).alias("n"), F.sum(F.when(F.col("distance") > F.col("limit"), F.col("times")).otherwise(0)).alias("beyond"), F.sum("compared").alias("compared"))
    expected = F.col("n") * (1 - share)
    return met.select("limit", "n", F.when(F.col("limit").isNotNull(), F.col("beyond")).alias("beyond"), F.round(expected, 9).alias("expected"), F.try_divide(F.when(F.col("limit").isNotNull(), F.col("beyond")) - expected, F.sqrt(expected * share)).alias("z"), "compared")
