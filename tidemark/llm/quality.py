"""Regularised quadratic discriminant over statistics of documents.

Each class has a mean and a covariance of the standardised, bounded statistics.  A covariance is shrunk towards the pooled
one and towards a multiple of the identity, so it has a Cholesky factor even where a class has few rows or a statistic
is constant.  The factors are computed once; a score is the logistic of the difference of the two log densities
(Mahalanobis distances by solves with the factors, log determinants, and log priors).

All labelled training rows count.  Their sums and products are added up on the executors; a fixed number of sums comes
to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._arrow import keep, pieces, prepare
from tidemark.llm.statistics import PROFILE, profile

#: Shares of the pooled covariance and of the identity in each class's covariance; bound of standardised statistics.
POOLED, ROUND, BOUND = 0.1, 0.1, 3.0


def remainder(modulus: int) -> Column:
    """crc32(doc_id as text) mod `modulus`; a null doc_id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % modulus


def profiles(docs: DataFrame) -> DataFrame:
    """All columns of docs but text, and x: its statistics as an array."""
    prepare(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profile(data, at) for _, _, data, at in pieces(batch.column(0))]
            flat = np.concatenate(found) if found else np.empty((0, len(PROFILE)))
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * len(PROFILE), pa.int32()), pa.array(flat.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], x], [*others, "x"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others]
    return docs.select("text", *others).mapInArrow(run, ", ".join([*fields, "x array<double>"]))


@dataclass
class Discriminant:
    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverses of the Cholesky factors
    offsets: list[float]  # log prior less half the log determinant

    def bounded(self, x: np.ndarray) -> np.ndarray:
        return BOUND * np.tanh((x - self.centre) / self.scale / BOUND)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.bounded(x)
        logs = [o - 0.5 * np.sum(((z - m) @ f.T) ** 2, axis=1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -700, 700)))


def sums(labelled: DataFrame, centre: list[float] | None, scale: list[float] | None) -> dict[int, np.ndarray]:
    """Of each label: rows, sums, and products of x (bounded, if centre and scale are given), added up over all rows."""
    k = len(PROFILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + k + k * k))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy().reshape(-1, k)
            if centre is not None:
                x = BOUND * np.tanh((x - centre) / scale / BOUND)
            for c in (0, 1):
                z = x[y == c]
                total[c] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).reshape(-1)])
        index = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(index, pa.int32()), pa.array(total.reshape(-1))], ["at", "value"])

    rows = labelled.select("quality", "x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    flat = np.zeros(2 * (1 + k + k * k))
    flat[rows["at"].to_numpy(int)] = rows["value"].to_numpy()
    return dict(enumerate(flat.reshape(2, -1)))


def fit(labelled: DataFrame) -> Discriminant | None:
    """From quality (0 or 1) and x; None unless both labels are there."""
    k = len(PROFILE)
    raw = sums(labelled, None, None)
    if not (raw[0][0] and raw[1][0]):
        return None
    n = raw[0][0] + raw[1][0]
    centre = (raw[0][1 : k + 1] + raw[1][1 : k + 1]) / n
    square = (raw[0][k + 1 :] + raw[1][k + 1 :]).reshape(k, k).diagonal() / n
    scale = np.sqrt(np.maximum(square - centre**2, 1e-12))
    shaped = sums(labelled, centre.tolist(), scale.tolist())
    means, scatters = [], []
    for c in (0, 1):
        m = shaped[c][1 : k + 1] / shaped[c][0]
        means.append(m)
        scatters.append(shaped[c][k + 1 :].reshape(k, k) - shaped[c][0] * np.outer(m, m))
    pooled = (scatters[0] + scatters[1]) / n
    factors, offsets = [], []
    for c in (0, 1):
        own = scatters[c] / shaped[c][0]
        mixed = (1 - POOLED) * own + POOLED * pooled
        mixed = (1 - ROUND) * mixed + ROUND * (np.trace(mixed) / k + 1e-6) * np.eye(k)
        low = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(low))
        offsets.append(float(np.log(shaped[c][0] / n) - np.log(np.diag(low)).sum()))
    return Discriminant(centre, scale, means, factors, offsets)


def score(profiled: DataFrame, model: Discriminant | None) -> DataFrame:
    """All columns but x, score and predicted."""
    others = [c for c in profiled.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, len(PROFILE))
            p = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*others, "score", "predicted"])

    fields = [f"`{c}` {profiled.schema[c].dataType.simpleString()}" for c in others]
    return profiled.select("x", *others).mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))


def train(profiled: DataFrame, labels: DataFrame) -> Discriminant | None:
    """From the rows whose remainder mod 3 is not 1 and that have a label 0 or 1."""
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("label_id"), "quality")
    return fit(profiled.where(remainder(3) != 1).join(known, F.col("doc_id") == F.col("label_id")).select("quality", "x"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null texts are empty texts, and these are scored like others.  A repeated document, or label, counts as often as it is
    there.  Where training rows lack one of the labels every score is 0.5.  Other columns are ignored; an empty frame gives
    an empty frame.  Statistics, a few numbers a document, are written to the checkpoint folder and read for training
    and scoring.
    """
    profiled = keep(profiles(docs.select("doc_id", "text")))
    model = train(profiled, labels)
    return score(profiled, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, whose text is predicted to be of quality; see classify.

    Statistics are computed twice, for training and for the verdict, so that no text is written or shuffled.
    """
    model = train(keep(profiles(docs.select("doc_id", "text"))), labels)
    if model is None:
        return docs
    names = docs.columns
    put = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(profile(data, at)) >= 0.5 for _, _, data, at in pieces(batch.column(put))]
            yield batch.filter(pa.array(np.concatenate(found) if found else np.empty(0, bool)))

    fields = [f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema)]
    return docs.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(run, ", ".join(fields)).toDF(*names)
