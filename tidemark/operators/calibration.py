"""Calibration without bins: isotonic fits and their decomposition (N09), and kernel smoothing by series.

Isotonic: the fit is the slope of the greatest convex minorant of (rows, positives) summed up by score.  A convex minorant of
minorants is that of all points, so each range of scores reduces itself to its own corners, and ranges are merged FAN at a time.
Corners of n rows with 0/1 outcomes are at most of the order of n to the power 2/3, and a few hundred in practice.

Kernel: a Gaussian sum over all rows is expanded around the centres of cells half a kernel's width wide, to TERMS terms.  What
is left out of a sum of weights n is below n * 0.25^TERMS / sqrt(TERMS!) * 4 / 3, which is 10^-9 for 10^12 rows; the sum
itself is 1 at least.  So every row is read once for the moments and once for the result, and no pairs are formed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.statistics import running
from tidemark.sources.shared import kept

#: Ranges whose corners one task merges; terms of a series; bounds of the kernel's width.
FAN, TERMS, NARROW, WIDE = 32, 20, 0.015, 0.35


def corners(n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The indices of the lower convex corners of points in order of n; points on an edge are no corners."""
    kept_: list[int] = []
    x, y = n.tolist(), pos.tolist()
    for k in range(len(x)):
        while len(kept_) > 1 and (y[kept_[-1]] - y[kept_[-2]]) * (x[k] - x[kept_[-1]]) >= (y[k] - y[kept_[-1]]) * (x[kept_[-1]] - x[kept_[-2]]):
            kept_.pop()
        kept_.append(k)
    return np.array(kept_, int)


def isotonic(df: DataFrame, p: str, y: str) -> DataFrame:
    """(from_n, to_n, pos): the segments of the isotonic fit of y (0 or 1) on p, as ranges of rows in order of p; each one's value is
    pos / (to_n - from_n).  Rows with nulls are left out; tied scores are one point, so they share a value."""
    points = running(df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(p).agg(F.sum(y).cast("bigint").alias("pos"), F.count("*").alias("n")), p, ["pos", "n"], [])
    spread = points.select(F.col("upto_n").alias("n"), F.col("upto_pos").alias("pos")).repartitionByRange("n")

    def reduce_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pos = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:  # in order: a range is sorted
            n, pos = np.r_[n, batch.column(0).to_numpy()], np.r_[pos, batch.column(1).to_numpy()]
            at = corners(n, pos)
            n, pos = n[at], pos[at]
        if len(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), TaskContext.get().partitionId()), pa.int64()), pa.array(n), pa.array(pos)], ["part", "n", "pos"])

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        at = corners(table.column("n").to_numpy(), table.column("pos").to_numpy())
        return table.take(pa.array(at)).select(["team", "n", "pos"]).rename_columns(["part", "n", "pos"])

    rows = kept(spread.sortWithinPartitions("n").mapInArrow(reduce_range, "part bigint, n bigint, pos bigint"))
    # the corner that all begin from
    start = df.sparkSession.createDataFrame([(0, 0, 0)], "part bigint, n bigint, pos bigint")
    rows, parts = rows.unionByName(start), rows.rdd.getNumPartitions()
    while True:
        parts = -(-parts // FAN)
        rows = kept(rows.withColumn("team", F.floor(F.col("part") / FAN)).groupBy("team").applyInArrow(merge, "part bigint, n bigint, pos bigint"))
        if parts <= 1:
            break
    ordered = F.array_sort(F.collect_list(F.struct("n", "pos")))
    pairs = rows.agg(ordered.alias("c")).select(F.explode(F.zip_with(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), lambda a, b: F.struct(a["n"].alias("from_n"), b["n"].alias("to_n"), (b["pos"] - a["pos"]).alias("pos")))).alias("x"))
    return pairs.select("x.*")


def decomposition(df: DataFrame, p: str, y: str) -> DataFrame:
    """Score (mean squared error), mcb, dsc and unc, so that score = mcb - dsc + unc.

    mcb: what recalibration by the isotonic fit gains; dsc: what that fit gains over the base rate.  Null without rows.
    """
    clean = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    whole = clean.agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("score"), F.avg(F.col(y).cast("double")).alias("base"))
    c = F.col("pos") / (F.col("to_n") - F.col("from_n"))
    fitted = isotonic(clean, p, y).agg((F.sum(F.col("pos") * (1 - c)) / F.max("to_n")).alias("fitted"))
    unc = F.col("base") * (1 - F.col("base"))
    return whole.join(F.broadcast(fitted), F.lit(True)).select("score", (F.col("score") - F.col("fitted")).alias("mcb"), (unc - F.col("fitted")).alias("dsc"), unc.alias("unc"))


def recalibrated(df: DataFrame, p: str, y: str, cells: int = 4096) -> DataFrame:
    """df with `calibrated`, the isotonic fit's value; null where p or y is.  Segments meet scores by cells of the rank."""
    clean = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    scores = running(clean.groupBy(p).agg(F.count("*").alias("n")), p, ["n"], [])
    cell = lambda n: F.floor((n - 1) * cells / F.col("all_n"))
    total = clean.agg(F.count("*").alias("all_n"))
    segments = isotonic(df, p, y).join(F.broadcast(total), F.lit(True)).withColumn("cell", F.explode(F.sequence(cell(F.col("from_n") + 1), cell(F.col("to_n"))))).withColumn("calibrated", F.col("pos") / (F.col("to_n") - F.col("from_n")))
    placed = scores.withColumn("cell", cell(F.col("upto_n"))).join(segments.drop("all_n", "pos"), "cell").where((F.col("from_n") < F.col("upto_n")) & (F.col("upto_n") <= F.col("to_n"))).select(F.col(p).alias("_p"), "calibrated")
    return df.join(placed, F.col(p) == F.col("_p"), "left").withColumn("calibrated", F.when(F.col(y).isNotNull(), F.col("calibrated"))).drop("_p")


def hermite(t: np.ndarray, terms: int) -> np.ndarray:
    """h_k(t) = (-1)^k d^k/dt^k exp(-t^2) for k below `terms`, along a last axis."""
    out = np.empty((*t.shape, terms))
    out[..., 0] = np.exp(-t * t)
    if terms > 1:
        out[..., 1] = 2 * t * out[..., 0]
    for k in range(1, terms - 1):
        out[..., k + 1] = 2 * t * out[..., k] - 2 * k * out[..., k - 1]
    return out


def silverman(df: DataFrame, p: str) -> DataFrame:
    """h: Silverman's width from the smaller of the spread and the quartiles' distance / 1.34, within NARROW and WIDE."""
    stats = df.agg(F.stddev_pop(p).alias("sd"), F.percentile(p, F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count(p).alias("total"))
    return stats.select(F.greatest(F.lit(NARROW), F.least(F.lit(WIDE), 0.9 * F.least("sd", (F.col("q")[1] - F.col("q")[0]) / 1.34) * F.pow("total", F.lit(-0.2)))).alias("h"))


def smoothed(df: DataFrame, p: str, y: str, h: float) -> DataFrame:
    """(p, n, smooth): for each distinct p in [0, 1] its rows and the kernel mean of all outcomes there."""
    distinct = kept(df.where(F.col(p).between(0, 1) & F.col(y).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.count("*").alias("n"), F.sum(y).cast("double").alias("pos")))
    width, scale = h / 2, math.sqrt(2) * h
    cell = F.floor(F.col("p") / width)
    s = (F.col("p") - (cell + 0.5) * width) / scale
    moments = [F.sum(F.col(w) * F.pow(s, F.lit(float(k))) / math.factorial(k)).alias(f"{w}{k}") for w in ("n", "pos") for k in range(TERMS)]
    # 1 / (NARROW / 2) + 1 cells at most
    found = distinct.groupBy(cell.alias("cell")).agg(*moments).orderBy("cell").collect()
    centres = np.array([(r.cell + 0.5) * width for r in found])
    table = {w: np.array([[r[f"{w}{k}"] for k in range(TERMS)] for r in found]).reshape(-1, TERMS) for w in ("n", "pos")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy()
            smooth = np.empty(len(x))
            for k in range(0, len(x), 1024):
                h_k = hermite((x[k : k + 1024, None] - centres) / scale, TERMS)
                smooth[k : k + 1024] = np.einsum("ick,ck->i", h_k, table["pos"]) / np.einsum("ick,ck->i", h_k, table["n"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(smooth)], ["p", "n", "smooth"])

    return distinct.select(F.col("p").cast("double").alias("p"), "n").mapInArrow(run, "p double, n bigint, smooth double")


def smooth_error(df: DataFrame, p: str, y: str) -> DataFrame:
    """Ece, the mean distance between p and the outcomes smoothed by a Gaussian kernel of Silverman's width.

    Probabilities outside [0, 1] and rows with nulls are left out; null without rows.
    """
    clean = df.where(F.col(p).between(0, 1) & F.col(y).isNotNull())
    h = silverman(clean, p).first().h
    return smoothed(clean, p, y, h if h is not None else WIDE).agg((F.sum(F.col("n") * F.abs(F.col("smooth") - F.col("p"))) / F.sum("n")).alias("ece"))
