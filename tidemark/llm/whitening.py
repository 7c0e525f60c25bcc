"""Whitening of vectors by a tall-skinny QR factorisation.

Rows are centred by exact sums of whole numbers.  Each partition reduces its centred rows to the triangle R of a QR
factorisation, a batch at a time; triangles are stacked and factorised again, FAN at a time, over all partitions until one is
left.  That R has the singular values and right vectors of all centred rows, so its decomposition whitens, and no covariance,
which would square the condition number, is ever formed.  A task holds a batch and a few triangles, whatever the table is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._arrow import keep, prepare

#: x = floor(SCALE * c) + SHIFT; |SCALE * c| is below BOUND, so that x and sums of a batch are whole numbers of 64 bits.
SCALE, SHIFT, BOUND = 1024, 100_000, 2.0**52
#: Triangles that one task stacks.
FAN = 32
#: A component is one if its eigenvalue is more than this part of the largest; what is below is rounding.
LEAST = 1e-20


def whole_numbers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, x as an int64 matrix) of the vectors of a list column that have `dims` finite entries in range."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(lengths == dims)
    flat = column.take(pa.array(kept)).flatten()
    c = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(len(kept), dims)
    good = (np.abs(c) < BOUND / SCALE).all(axis=1)  # not so for NaN
    return kept[good], np.floor(SCALE * c[good]).astype(np.int64) + SHIFT


def _dims(vectors: DataFrame) -> int:
    """The length that most of the vectors have; of several such the greatest.  0 if there are none."""
    sizes = vectors.where("embedding is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("dims")).first()
    return first.dims if first else 0


def exact_sums(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of vectors that count and the exact sum of x of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for batch in batches:
            _, x = whole_numbers(batch.column(0), dims)
            n += len(x)
            sums = [s + t for s, t in zip(sums, x.sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([str(s) for s in (n, *sums)])], ["dim", "sum"])

    rows = vectors.select("embedding").mapInArrow(add, "dim int, sum string").groupBy("dim").agg(F.sum(F.col("sum").cast("decimal(38,0)")).cast("string").alias("sum")).collect()
    found = {r.dim: int(r.sum) for r in rows}
    return found.get(-1, 0), [found.get(d, 0) for d in range(dims)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n as doubles: the whole part is taken off first, so that nothing cancels, and the rest is at most 1."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x - whole) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over dimensions of (n x - S)^2; null where a long can't hold it."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    off = x - whole
    widest = int(np.abs(off).max(initial=0)) + 1
    if (n * widest) ** 2 * x.shape[1] >= 1 << 63:
        off, rest = off.astype(object), rest.astype(object)  # Python's own whole numbers have no end
    squares = ((n * off - rest) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in map(int, squares)]


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _triangles(part: int, held: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["part", "r"])


def merge(table: pa.Table, dims: int) -> pa.Table:
    """The triangle of a group's triangles, in the order of their parts."""
    table = table.sort_by("part")
    held = triangle(np.vstack([np.frombuffer(r.as_py()).reshape(-1, dims) for r in table.column("r")]))
    return pa.Table.from_batches([_triangles(table.column("part")[0].as_py() // FAN, held)])


def tall_skinny_r(vectors: DataFrame, dims: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR factorisation of all centred rows."""

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, dims))
        for batch in batches:
            _, x = whole_numbers(batch.column(0), dims)
            if len(x):
                held = triangle(np.vstack([held, centred(x, n, sums)]))
        if len(held):
            yield _triangles(TaskContext.get().partitionId(), held)

    rows = keep(vectors.select("embedding").mapInArrow(reduce_rows, "part bigint, r binary"))
    parts = rows.rdd.getNumPartitions()
    while parts > 1:
        rows = keep(rows.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(lambda table: merge(table, dims), "part bigint, r binary"))
        parts = -(-parts // FAN)
    return np.frombuffer(rows.first().r).reshape(-1, dims)


def components(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix that whitens centred rows, eigenvalues, their shares of the trace) of at most `most` components of R."""
    _, values, vectors = np.linalg.svd(r)
    e = values**2 / n
    found = min(most, int((e > LEAST * e[0]).sum())) if e[0] > 0 else 0
    return vectors[:found].T / np.sqrt(e[:found]), e[:found], e[:found] / (e.sum() or 1.0)


def whiten(vectors: DataFrame, most: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each vector that counts and each component.

    vectors: vec_id, embedding.  Null vectors, those with null or non-finite entries or entries of 2^42 and more, and those of another
    length than most have don't count and give no row.  Components without variance (below LEAST of the largest) give none
    either, so equal vectors alone, a single one and an empty frame give an empty frame.  Repeated rows and null vec_ids are
    rows of their own; other columns are ignored.  deviation is null where a long can't hold it.  Of equal eigenvalues any basis is taken, the same for all rows.
    """
    spark = prepare(vectors.sparkSession)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    vectors = vectors.select("embedding", "vec_id")
    dims = _dims(vectors)
    n, sums = exact_sums(vectors, dims) if dims else (0, [])
    if not n:
        return spark.createDataFrame([], schema)
    by, _, shares = components(tall_skinny_r(vectors, dims, n, sums), n, most)
    found = by.shape[1]
    error = identity_error(vectors, dims, n, sums, by)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = whole_numbers(batch.column(0), dims)
            size = len(at)
            ids = batch.column(1).take(pa.array(np.repeat(at, found)))
            deviation = pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(size), found)))
            each = lambda v, k: pa.array(np.tile(v, size), k)
            yield pa.RecordBatch.from_arrays(
                [ids, each(np.arange(1, found + 1), pa.int32()), pa.array(np.full(size * found, n), pa.int64()), deviation, pa.array((centred(x, n, sums) @ by).ravel()), each(shares, pa.float64()), pa.array(np.full(size * found, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(project, schema)


def identity_error(vectors: DataFrame, dims: int, n: int, sums: list[int], by: np.ndarray) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity; rows are centred before they are multiplied."""
    found = by.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((found, found))
        for batch in batches:
            _, x = whole_numbers(batch.column(0), dims)
            w = centred(x, n, sums) @ by
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(found * found), pa.int32()), pa.array(total.ravel())], ["cell", "sum"])

    rows = vectors.select("embedding").mapInArrow(add, "cell int, sum double").groupBy("cell").agg(F.sum("sum").alias("sum")).collect()
    total = np.zeros(found * found)
    for r in rows:
        total[r.cell] = r.sum
    return float(np.abs(total.reshape(found, found) / n - np.eye(found)).max(initial=0.0))
